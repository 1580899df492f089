"""Toxicity: a linear-chain conditional random field over words.

Labelled documents give labelled tokens: a word is toxic if it, or one of its
prefixes, is found in toxic documents significantly more often than chance
explains.  A two-state chain is trained on these tokens (word, prefix and
suffix features, transitions); forward-backward marginals tag words, and a
logistic curve over their sum, fitted on the documents' labels, is the score.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE); scoring
covers every word of every text.

Defined results: null and empty texts have no words and get the score of a
document without toxic words; labels that are null take no part; if labels
disagree for one id, each counts; without labelled rows of both kinds the score
is 0 everywhere.  Other columns of the documents are kept.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import crc_mod, table, unused
from .text import ALNUM, U64, Batch, chunks, encode, mix

#: Labelled documents that the classifier is fitted on: clean ones, toxic ones.
SAMPLE = (3000, 1000)
#: Longest text in that sample, in bytes.
SAMPLE_TEXT = 40_000
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
SEGMENT = 256
STEPS = 40
RATE = 0.3
DECAY = 1e-6


def features(batch: Batch, start: np.ndarray, end: np.ndarray, bits: int = FEATURE_BITS) -> np.ndarray:
    """Hashed features of each word, one row a kind: the word, its prefixes, its suffix."""
    data = np.concatenate([np.zeros(8, np.uint8), batch.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = end - start
    ones = [U64(0)] + [U64((1 << (8 * k)) - 1) for k in range(1, 8)] + [U64(0xFFFFFFFFFFFFFFFF)]
    masks = np.array(ones, U64)
    head = eight[start + 8] & masks[np.minimum(size, 8)]
    tail = eight[end] & ~masks[np.maximum(0, 8 - size)]  # the last eight bytes, of the word alone
    kinds = [mix(head ^ mix(tail + size.astype(U64)))]
    for k in PREFIXES:
        kinds.append(np.where(size >= k, mix((head & masks[k]) + U64(k * 0x9E3779B97F4A7C15 % 2**64)), U64(0)))
    kinds.append(mix((tail >> U64(40)) + U64(77 * 0x9E3779B97F4A7C15 % 2**64)))
    return np.stack([(x >> U64(64 - bits)).astype(np.int64) for x in kinds])


def chain_scan(gain: np.ndarray, at: np.ndarray, into: float, stay: float, leave: float) -> np.ndarray:
    """r[t] = gain[t] * (into + stay * r[t-1]) / (1 + leave * r[t-1]) along each chain; r[-1] = 0.

    at: where each chain starts, and the end.  The maps are linear-fractional, so
    they compose as 2x2 matrices: first each segment's product, then the values
    at segment starts, then all values, each step over all segments at once.
    """
    size = np.diff(at)
    n_seg = -(-size // SEGMENT)
    total = int(n_seg.sum())
    if not total:
        return np.zeros(0)
    seg0 = np.concatenate([[0], np.cumsum(n_seg)])
    chain = np.repeat(np.arange(len(size)), n_seg)
    k = np.arange(total) - seg0[chain]
    begin = at[chain] + k * SEGMENT
    length = np.minimum(SEGMENT, at[chain + 1] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # segments longer than t
    a, b, c, d = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    if int(n_seg.max()) > 1:
        for t in range(SEGMENT):
            m = live[t]
            if not m:
                break
            g = gain[begin[:m] + t]
            na, nb = g * (stay * a[:m] + into * c[:m]), g * (stay * b[:m] + into * d[:m])
            nc, nd = leave * a[:m] + c[:m], leave * b[:m] + d[:m]
            s = 1.0 / (na + nb + nc + nd)
            a[:m], b[:m], c[:m], d[:m] = na * s, nb * s, nc * s, nd * s
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    initial = np.zeros(total)  # by sorted place
    value = np.zeros(len(size))
    for j in range(int(n_seg.max()) - 1):
        on = np.flatnonzero(n_seg > j + 1)
        p = place[seg0[on] + j]
        value[on] = (a[p] * value[on] + b[p]) / (c[p] * value[on] + d[p])
        initial[place[seg0[on] + j + 1]] = value[on]
    out = np.empty(len(gain))
    r = initial
    for t in range(SEGMENT):
        m = live[t]
        if not m:
            break
        where = begin[:m] + t
        r = r[:m]
        r = gain[where] * (into + stay * r) / (1.0 + leave * r)
        out[where] = r
    return out


def marginals(score: np.ndarray, at: np.ndarray, trans: np.ndarray):
    """Odds that each word is toxic, and the forward and backward ratios; trans: log potentials 01, 10, 11.

    A clean word is taken to stand before and after each text.
    """
    into, leave, stay = np.exp(trans)
    gain = np.exp(np.clip(score, -30, 30))
    forward = chain_scan(gain, at, into, stay, leave)
    n = len(score)
    back = chain_scan(gain[::-1], n - at[::-1], leave, stay, into)[::-1]
    return forward * back / gain, forward, back


class Crf:
    """Weights of a trained chain, its calibration, and document scores."""

    def __init__(self, weights, bias, trans, slope, offset):
        self.weights, self.bias, self.trans, self.slope, self.offset = weights, bias, trans, slope, offset

    def tags(self, batch: Batch):
        """(start, end, first word of each text, probability) of the words of a lower-cased batch."""
        start, end, first = batch.words(ALNUM)
        if not len(start):
            return start, end, first, np.zeros(0)
        score = self.weights[features(batch, start, end)].sum(axis=0) + self.bias
        odds, *_ = marginals(score, first, self.trans)
        return start, end, first, odds / (1 + odds)

    def evidence(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of the number of toxic words of each text; a word counts by its squared probability,

        so that many words that are hardly toxic do not add up in a long text.
        """
        total = np.concatenate([[0.0], np.cumsum(p * p)])
        return np.log(np.maximum(0, total[first[1:]] - total[first[:-1]]) + 1e-2)

    def scores(self, texts) -> np.ndarray:
        raw = encode(texts)
        out = [np.zeros(0)]
        for a, b in chunks(raw):
            _, _, first, p = self.tags(Batch(raw[a:b], lower=True))
            out.append(1 / (1 + np.exp(-(self.slope * self.evidence(p, first) + self.offset))))
        return np.concatenate(out)

    def spans(self, texts, least: float = 0.5) -> list[list[dict]]:
        """Character offsets of the words whose probability is `least` or more."""
        out = []
        for raw in encode(texts):
            start, end, _, p = self.tags(Batch([raw], lower=True))
            bad = np.flatnonzero(p >= least)
            out.append([{"start": len(raw[: start[i]].decode()), "end": len(raw[: end[i]].decode())} for i in bad])
        return out


def toxic_tokens(feats: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Label of each word: 1 if one of its features marks toxic documents beyond chance."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    label = np.zeros(feats.shape[1], bool)
    open_ = toxic == 1
    for _ in range(3):  # again for toxic documents that no mark explains yet
        if not open_.any():
            break
        use = open_[doc] | (toxic[doc] == 0)
        share = open_.sum() / (open_.sum() + (toxic == 0).sum())
        for kind in feats[:-1]:  # suffixes are context, not evidence
            both = np.unique(doc[use] * (1 << FEATURE_BITS) + kind[use])
            d, f = both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)
            bad = np.bincount(f[toxic[d] == 1], minlength=1 << FEATURE_BITS)
            good = np.bincount(f[toxic[d] == 0], minlength=1 << FEATURE_BITS)
            n = bad + good
            gain = bad * np.log((bad + 1e-9) / (share * n + 1e-9)) + good * np.log((good + 1e-9) / ((1 - share) * n + 1e-9))
            marks = (bad > 0.9 * n) & (bad >= 3) & (gain > np.log(max(2, np.count_nonzero(n >= 3))) + 2)
            label |= marks[kind]
        open_ = (toxic == 1) & (np.bincount(doc, label, minlength=len(toxic)) == 0)
    return label


def train(texts, toxic) -> Crf | None:
    """A chain fitted to labelled texts; None without both labels."""
    one = dict.fromkeys(zip(texts, toxic, strict=True))  # copies are no further evidence; a text with both labels is one of each
    texts, toxic = [t for t, _ in one], np.array([k for _, k in one], np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    batch = Batch(encode(texts), lower=True)
    start, end, first = batch.words(ALNUM)
    feats = features(batch, start, end)
    label = toxic_tokens(feats, first, toxic).astype(float)
    n, size = len(label), 1 << FEATURE_BITS
    theta = np.zeros(size + 4)
    theta[-4] = -3.0  # bias; then transitions 01, 10, 11
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    cur = np.flatnonzero(inner)
    prev = cur - 1
    heads, tails = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    seen = np.array([((label[prev] == 0) & (label[cur] == 1)).sum(), ((label[prev] == 1) & (label[cur] == 0)).sum(), ((label[prev] == 1) & (label[cur] == 1)).sum()], float)
    seen += [label[heads].sum(), label[tails].sum(), 0]
    for step in range(1, STEPS + 1):
        score = theta[feats].sum(axis=0) + theta[-4]
        odds, fwd, back = marginals(score, first, theta[-3:])
        p = odds / (1 + odds)
        grad = np.zeros_like(theta)
        miss = label - p
        for kind in feats:
            grad[:size] += np.bincount(kind, miss, minlength=size)
        grad[-4] = miss.sum()
        into, leave, stay = np.exp(theta[-3:])
        w = np.stack([into * back[cur], fwd[prev] * leave, fwd[prev] * stay * back[cur]])
        grad[-3:] = seen - (w / (1 + w.sum(axis=0))).sum(axis=1) - [p[heads].sum(), p[tails].sum(), 0]
        grad -= DECAY * n * theta
        m = 0.8 * m + 0.2 * grad
        v = 0.95 * v + 0.05 * grad**2
        theta += RATE * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8 + 1e-3)
        theta[-3:] = np.clip(theta[-3:], -6, 6)
    crf = Crf(theta[:size].astype(np.float32), float(theta[-4]), theta[-3:].copy(), 1.0, 0.0)
    score = crf.weights[feats].sum(axis=0) + crf.bias
    odds, *_ = marginals(score, first, crf.trans)
    crf.slope, crf.offset = logistic(crf.evidence(odds / (1 + odds), first), toxic)
    return crf


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a ridge logistic fit, by Newton steps."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        g = a.T @ (y - p) - 0.01 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Crf | None:
    """A chain fitted on a bounded sample of the training fold (crc32 of the id modulo 5 is not 0)."""
    spark = docs.sparkSession
    fold = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(crc_mod(F.col("doc_id")) != 0)
    by_hash = F.xxhash64(F.lit(3), "doc_id")
    kinds = [fold.filter(F.col("toxic") == k).orderBy(by_hash, "doc_id").limit(sample[k]) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))  # at most sum(sample) rows
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_TEXT).join(chosen, "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64(F.lit(4), "doc_id", "text"), "doc_id", "text", "toxic").limit(2 * sum(sample))

    def learn(batches):
        got = [*batches]
        pdf = pd.concat(got) if got else pd.DataFrame({"text": [], "toxic": []})
        yield pd.DataFrame({"model": [pickle.dumps(train(pdf["text"].tolist(), pdf["toxic"].tolist()))]})

    models = rows.coalesce(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def score(docs: DataFrame, model: Crf | None, text: str = "text", out: str = "score", spans: str | None = None) -> DataFrame:
    """docs with the model's score of the whole text and, if asked, the offsets of offending words."""
    if model is None:
        done = docs.withColumn(out, F.lit(0.0))
        return done.withColumn(spans, F.array().cast("array<struct<start:int,end:int>>")) if spans else done
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def one(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def where(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.spans(texts))

    done = docs.withColumn(out, one(F.col(text)))
    return done.withColumn(spans, where(F.col(text))) if spans else done


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half."""
    name = unused(docs, "_toxicity")
    return score(docs, fit(docs, labels), out=name).filter(F.col(name) < 0.5).drop(name)
