"""Scoring whole documents with a gated recurrent language model.

The network reads words and predicts the next one by a class-factored softmax:
first the class, then the word within its class.  The VOCABULARY most frequent
words fall into classes of about equal weight by frequency, and the softmax
within a class is learned.  All other words are classed, and read, by their
ending; within such a class a word's share comes from counts over all training
documents, so that every word has a probability.

The network is trained by truncated backpropagation in numpy, first on a small
sample and then, from there, on every training document: in each of a few rounds
all partitions train on their share of the documents, and Spark averages their
weights, with which the next round begins (so the weights depend on how the
documents are partitioned; the counts do not).  Scoring carries the state
through the whole text, however long.

Counts cover every training document.  Counts of frequent words are broadcast
(at most FREQUENT of them); the rest of each text's words meet their counts in a
join.  Words are told apart by 64-bit hashes.

Defined results: a null or empty text is one end token; a null id belongs to the
training fold; ids that are no integers are refused; without training documents
each token has probability one for the base; rows are scored one by one; other
columns play no part.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .frames import crc_mod, cut, table
from .text import U64, Batch, chunks, encode, mix

#: Words that the network knows by themselves, their classes; classes by ending; the end has a class and a token of its own.
VOCABULARY, GROUPS, ENDINGS = 1536, 48, 31
CLASSES = GROUPS + ENDINGS + 1
TOKENS = VOCABULARY + ENDINGS + 1
END_TOKEN = TOKENS - 1
END = 0x1234_5678_9ABC_DEF1
EMBED, HIDDEN = 16, 24
#: Words whose counts may be broadcast.
FREQUENT = 500_000
#: Training documents of the first fit; rounds that all training documents are dealt to, each document to one.
WARM_DOCS, AVERAGED = 800, 4
#: Streams side by side in the first fit and in the rounds, tokens between updates, rate of learning.
WARM_LANES, LANES, SPAN, RATE = 48, 384, 32, 0.01
#: Tokens that a training task holds before it trains on them.
STREAM = LANES * SPAN * 20
#: Distinct words that a counting task holds before it hands them on; tasks that add up weights.
HELD, ADDERS = 2_000_000, 16
#: Bytes of text that are scored side by side, and states whose probabilities are taken at once.
SIDE_BY_SIDE, SCORED = 5_000_000, 32_768
#: Rows of a softmax that are computed at once.
ROWS = 1024


def ending(batch: Batch, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kind of ending of each word, by its last three bytes."""
    last = batch.data[end - 1].astype(U64)
    second = np.where(end - start > 1, batch.data[np.maximum(end - 2, 0)], 0).astype(U64)
    third = np.where(end - start > 2, batch.data[np.maximum(end - 3, 0)], 0).astype(U64)
    return (mix(last | (second << U64(8)) | (third << U64(16))) % U64(ENDINGS)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, kind of ending, c) of the words of docs, ends included."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def hand_on():
            h, k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first, back = np.unique(h, return_index=True, return_inverse=True)
            return h, k[first], np.bincount(back, c).astype(np.int64)

        def frame(h, k, c):
            return pd.DataFrame({"h": h.view(np.int64), "kind": k.astype(np.int32), "c": c})

        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in chunks(raw):
                batch = Batch(raw[a:b], lower=True)
                start, end, _ = batch.words()
                h, first, c = np.unique(batch.hashes(start, end), return_index=True, return_counts=True)
                held.append((h, ending(batch, start[first], end[first]), c))
                size += len(h)
                if size > HELD:
                    held, size = [hand_on()], 0
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield frame(*held[0])
                        held, size = [], 0
            yield frame(np.array([END], U64), np.array([ENDINGS]), np.array([len(pdf)]))
        if held:
            yield frame(*hand_on())

    return docs.select("text").mapInPandas(run, "h long, kind int, c long").groupBy("h").agg(F.max("kind").alias("kind"), F.sum("c").alias("c"))


class Words:
    """Frequent words' counts, the vocabulary in order of frequency with its classes, and what the endings' shares are divided by."""

    def __init__(self, h, c, vocabulary, frequency, denominator, total, distinct):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.token = np.argsort(vocabulary)
        self.vocabulary = vocabulary[self.token]
        self.denominator = denominator  # log10, of each ending's
        self.total, self.distinct = total, distinct
        weight = np.sqrt(np.concatenate([frequency, np.ones(VOCABULARY - len(frequency))]))
        group = np.minimum((np.cumsum(weight) - weight) * GROUPS // weight.sum(), GROUPS - 1).astype(np.int64)
        self.class_of = np.concatenate([group, np.arange(GROUPS, CLASSES)])
        self.bounds = np.searchsorted(group, np.arange(GROUPS + 1))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Token of each word of the vocabulary, -1 of any other."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary.take(at) == h, self.token.take(at), -1)

    def counts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, found) of each word."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        return np.where(found, self.c[at], 0), found


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    """e, x, h, b: embeddings and gates; o, p: classes; m, q: words within classes."""
    rng = np.random.default_rng(seed)
    shape = {
        "e": (TOKENS, EMBED), "x": (EMBED, 3 * HIDDEN), "h": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
        "o": (HIDDEN, CLASSES), "p": (CLASSES,), "m": (VOCABULARY, HIDDEN), "q": (VOCABULARY,),
    }
    scale = {"e": EMBED, "x": EMBED, "h": HIDDEN, "o": HIDDEN, "m": HIDDEN}
    return {k: (rng.standard_normal(s) / np.sqrt(scale[k]) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shape.items()}


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)  # several times as fast as sum() over short rows


def forward(w: np.ndarray, gates: np.ndarray, h: np.ndarray):
    """One step of the gated unit; returns the new state and what backpropagation needs.

    w: the state's weights, (gates, state); gates: what the input gives them. A text is a column, so that a gate is a block.
    """
    u = w @ h
    zr = gates[: 2 * HIDDEN] + u[: 2 * HIDDEN]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:HIDDEN], zr[HIDDEN:]
    n = r * u[2 * HIDDEN :]
    n += gates[2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, n, u[2 * HIDDEN :])


def exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sum) of each row, up to a factor; only where they leave the range of floats is a row's largest taken off first."""
    with np.errstate(over="ignore"):
        p = np.exp(logits)
        total = row_sums(p)
    if not (total.min() > 1e-20 and total.max() < 1e30):
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        total = row_sums(p)
    return p, total


def softmax(logits: np.ndarray) -> np.ndarray:
    """Shares of each row."""
    p, total = exponentials(logits)
    p /= total[:, None]
    return p


def slopes(state: np.ndarray, w: np.ndarray, bias: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes of the weighted losses of softmax(state @ w + bias) by its logits."""
    logits = state @ w
    logits += bias
    p, total = exponentials(logits)
    p *= (weight / total)[:, None]
    p[np.arange(len(p)), target] -= weight
    return p


def by_class(words: Words, classes: np.ndarray):
    """(places in order of their classes, [(first and last word, first and last place in that order) of each class of several words that is met])."""
    order = np.argsort(classes.astype(np.int16), kind="stable")  # short integers are sorted by radix
    at = np.searchsorted(classes[order], np.arange(GROUPS + 1)).tolist()
    b = words.bounds.tolist()
    return order, [(b[c], b[c + 1], at[c], at[c + 1]) for c in range(GROUPS) if b[c + 1] - b[c] > 1 and at[c + 1] > at[c]]


class Trainer:
    """Truncated backpropagation over streams of tokens in which each text ends with END_TOKEN."""

    def __init__(self, w: dict[str, np.ndarray], words: Words, lanes: int = LANES):
        self.words, self.lanes = words, lanes
        self.w = {k: v.copy() for k, v in w.items()}
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v2 = {k: np.zeros_like(v) for k, v in w.items()}
        self.done = 0

    def feed(self, stream: np.ndarray, rate, before: int = END_TOKEN) -> None:
        """Train on all of stream, which follows the token `before`; rate: of each update, by its number from 0."""
        count = int(np.clip(len(stream) // SPAN, 1, self.lanes))
        steps = -(-len(stream) // count)
        # the last lane is filled up; what fills it has no weight
        shape = lambda x, fill: np.concatenate([x, np.full(steps * count - len(x), fill, x.dtype)]).reshape(count, steps).T
        lanes, source = shape(stream, END_TOKEN), shape(np.concatenate([[before], stream[:-1]]), END_TOKEN)
        real = shape(np.ones(len(stream), np.float32), 0)
        h = np.zeros((HIDDEN, count), np.float32)
        for i, first in enumerate(range(0, steps, SPAN)):
            on = slice(first, first + SPAN)
            h = self.update(source[on], lanes[on], real[on], h, rate(i))

    def update(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step down the gradient of a span; returns the state after it."""
        w, g = self.w, {}
        steps, lanes = x.shape
        gates_in = np.ascontiguousarray((w["e"] @ w["x"] + w["b"]).take(x, 0).transpose(0, 2, 1))
        goes_on = (x != END_TOKEN).astype(np.float32)  # a new text starts from nothing
        of_state = np.ascontiguousarray(w["h"].T)
        before, after = np.empty((2, steps, HIDDEN, lanes), np.float32)
        kept = []
        for t in range(steps):
            np.multiply(h, goes_on[t], out=before[t])
            h, need = forward(of_state, gates_in[t], before[t])
            kept.append(need)
            after[t] = h
        state = np.ascontiguousarray(after.transpose(0, 2, 1)).reshape(-1, HIDDEN)
        target, weight = y.ravel(), (real / real.sum()).ravel()
        classes = self.words.class_of[target]
        into = np.empty_like(state)
        for k in ("o", "p", "m", "q"):
            g[k] = np.zeros_like(w[k])
        for a in range(0, len(state), ROWS):  # few rows at a time stay in the cache
            b = a + ROWS
            p = slopes(state[a:b], w["o"], w["p"], classes[a:b], weight[a:b])
            g["o"] += state[a:b].T @ p
            g["p"] += np.ones(len(p), p.dtype) @ p
            into[a:b] = p @ w["o"].T
        order, found = by_class(self.words, classes)
        ordered, place, share = state.take(order, 0), target[order], weight[order]
        more = into.take(order, 0)
        for a, b, i, j in found:
            p = slopes(ordered[i:j], w["m"][a:b].T, w["q"][a:b], place[i:j] - a, share[i:j])
            g["m"][a:b], g["q"][a:b] = p.T @ ordered[i:j], np.ones(len(p), p.dtype) @ p
            more[i:j] += p @ w["m"][a:b]
        into[order] = more
        into = np.ascontiguousarray(into.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
        gates, backs = np.empty((2, steps, 3 * HIDDEN, lanes), np.float32)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            z, r, n, u = kept[t]
            dz, dr, dn = gates[t, :HIDDEN], gates[t, HIDDEN : 2 * HIDDEN], gates[t, 2 * HIDDEN :]
            dh += into[t]
            past = dh * z
            dh -= past
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh
            np.subtract(before[t], n, out=dz)
            dz *= z
            dz *= dh
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= u
            dr *= dn
            backs[t, : 2 * HIDDEN] = gates[t, : 2 * HIDDEN]
            np.multiply(dn, r, out=backs[t, 2 * HIDDEN :])
            dh = w["h"] @ backs[t]
            dh += past
            dh *= goes_on[t]
        g["h"] = np.matmul(before, backs.transpose(0, 2, 1)).sum(0)
        g["b"] = gates.sum((0, 2))
        g["x"] = np.matmul(w["e"].take(x, 0).transpose(0, 2, 1), gates.transpose(0, 2, 1)).sum(0)
        rows = np.matmul(w["x"], gates)
        g["e"] = np.stack([np.bincount(x.ravel(), rows[:, i].ravel(), TOKENS) for i in range(EMBED)], axis=1).astype(np.float32)
        self.done += 1
        for k in w:
            d = np.clip(g[k], -1, 1)
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v2[k] = 0.99 * self.v2[k] + 0.01 * d * d
            w[k] = w[k] - np.float32(rate) * (self.m[k] / (1 - 0.9**self.done)) / (np.sqrt(self.v2[k] / (1 - 0.99**self.done)) + 1e-6)
        return h


def train(stream: np.ndarray, w: dict[str, np.ndarray], words: Words, rate: float = RATE, epochs: int = 1):
    """The network w after some epochs over stream, with a rate that falls in their second half."""
    if not len(stream):
        return w
    count = int(np.clip(len(stream) // SPAN, 1, WARM_LANES))
    total = epochs * -(-(-(-len(stream) // count)) // SPAN)
    trainer = Trainer(w, words, WARM_LANES)
    for _ in range(epochs):
        begun = trainer.done
        trainer.feed(stream, lambda i: rate * min(1.0, 2 * (1 - (begun + i) / total)))  # noqa: B023
    return trainer.w


def log_shares(state: np.ndarray, w: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    logits = state @ w
    logits += bias
    return logits[np.arange(len(target)), target] - np.log(row_sums(np.exp(logits, out=logits)))


def chances(w, words: Words, state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target's class and, for words of the vocabulary, of the word within it."""
    classes = words.class_of[target]
    out = np.empty(len(target))
    for a in range(0, len(state), ROWS):
        out[a : a + ROWS] = log_shares(state[a : a + ROWS], w["o"], w["p"], classes[a : a + ROWS])
    order, found = by_class(words, classes)
    ordered, place = state.take(order, 0), target[order]
    more = np.zeros(len(target))
    for a, b, i, j in found:
        more[i:j] = log_shares(ordered[i:j], w["m"][a:b].T, w["q"][a:b], place[i:j] - a)
    out[order] += more
    return out


def log_likelihood(w, words: Words, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each text's tokens; at: where each text's begin, and the end. State runs through whole texts."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    table_ = w["e"] @ w["x"] + w["b"]
    of_state = np.ascontiguousarray(w["h"].T)
    h = np.zeros((HIDDEN, len(size)), np.float32)
    total = np.zeros(len(size))
    now = np.full(len(size), END_TOKEN)
    held: list[tuple] = []
    count = 0

    def settle():
        text = np.concatenate([np.arange(len(t)) for _, t in held])
        np.add.at(total, text, chances(w, words, np.concatenate([s.T for s, _ in held]), np.concatenate([t for _, t in held])))

    for t, m in enumerate(live):
        h, _ = forward(of_state, np.ascontiguousarray(table_.take(now[:m], 0).T), h[:, :m])
        now = tokens[begin[:m] + t]
        held.append((h, now))
        count += m
        if count >= SCORED:
            settle()
            held, count = [], 0
    if held:
        settle()
    out = np.empty(len(size))
    out[order] = total / np.log(10)
    return out


def read(batch: Batch, words: Words):
    """(hashes, tokens, first) of the words of a lower-cased batch."""
    start, end, first = batch.words()
    h = batch.hashes(start, end)
    tokens = words.tokens(h)
    rare = np.flatnonzero(tokens < 0)
    tokens[rare] = VOCABULARY + ending(batch, start[rare], end[rare])
    return h, tokens, first


def read_all(raw: list[bytes], words: Words):
    """read() of texts in pieces of bounded size, put together: arrays as long as the bytes are short-lived."""
    hashes, tokens, ends, seen = [], [], [np.zeros(1, np.int64)], 0
    for a, b in chunks(raw):
        h, k, first = read(Batch(raw[a:b], lower=True), words)
        hashes.append(h)
        tokens.append(k)
        ends.append(first[1:] + seen)
        seen += len(h)
    return np.concatenate(hashes), np.concatenate(tokens), np.concatenate(ends)


def side_by_side(raw: list[bytes]):
    """Places of the texts that are scored side by side. Texts of like length share a group: a step costs nearly as much for one
    text as for hundreds, so long ones are to take their steps together."""
    order = np.argsort([-len(x) for x in raw], kind="stable")
    for a, b in chunks([raw[i] for i in order], SIDE_BY_SIDE):
        yield order[a:b]


def with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """values with `end` after each text's, and where each text's begin."""
    return np.insert(values, first[1:], end), first + np.arange(len(first))


def flatten(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def averaged(docs: DataFrame, w: dict[str, np.ndarray], words, rate: float, streams) -> dict[str, np.ndarray]:
    """The mean, by tokens, of what w becomes in each partition of docs; streams: from batches of texts to pieces of their tokens."""
    start = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        trainer, held, size, before, seen = Trainer(start.value, words.value), [], 0, END_TOKEN, 0
        for piece in streams(batches):
            held.append(piece)
            size += len(piece)
            if size >= STREAM:
                whole = np.concatenate(held)
                trainer.feed(whole, lambda i: rate, before)
                held, size, before, seen = [], 0, int(whole[-1]), seen + size
        if size:
            trainer.feed(np.concatenate(held), lambda i: rate, before)
            seen += size
        if seen:
            k = TaskContext.get().partitionId()
            yield pd.DataFrame({"k": [zlib.crc32(str(k).encode()) % ADDERS], "n": [float(seen)], "w": [zlib.compress(flatten(trainer.w).astype(np.float32).tobytes(), 1)]})

    def add(batches):
        total, n = 0.0, 0.0
        for pdf in batches:
            for one, seen in zip(pdf["w"], pdf["n"], strict=True):
                total, n = total + seen * np.frombuffer(zlib.decompress(one), np.float32), n + seen
        if n:
            yield pd.DataFrame({"n": [n], "w": [np.asarray(total, np.float64).tobytes()]})

    # a task for each share of the partitions adds up their weights; ADDERS sums reach the driver
    sums = docs.mapInPandas(run, "k int, n double, w binary").repartition(ADDERS, "k").mapInPandas(add, "n double, w binary").collect()
    if not sums:
        return w
    flat, at, out = sum(np.frombuffer(r["w"]) for r in sums) / sum(r["n"] for r in sums), 0, {}
    for k in sorted(w):
        out[k] = flat[at : at + w[k].size].reshape(w[k].shape).astype(np.float32)
        at += w[k].size
    return out


def count_and_choose(docs: DataFrame) -> tuple[Words, DataFrame]:
    """(words, all counts) of the training documents docs."""
    counts = cut(count_words(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.col("h") != END).orderBy(F.desc("c"), "h").limit(VOCABULARY)
    chosen = top.collect()
    vocabulary = np.array([r["h"] for r in chosen], np.int64).view(U64)
    sums = counts.filter(F.col("h") != END).join(F.broadcast(top.select("h")), "h", "left_anti")
    denominator = np.full(ENDINGS, np.log10(0.5))
    for r in sums.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row for each ending
        denominator[r["kind"]] = np.log10(r["n"] + 0.5 * (r["v"] + 1))
    # the least count whose words, and all more frequent ones, are few enough to be broadcast
    least, held = 1 << 62, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["c"]
    often = counts.filter(F.col("c") >= least).select("h", "c").toPandas()
    frequency = np.array([r["c"] for r in chosen], float)
    return Words(often["h"].to_numpy(np.int64).view(U64), often["c"].to_numpy(np.int64), vocabulary, frequency, denominator, total, distinct), counts


def learn(docs: DataFrame) -> tuple[Words, dict[str, np.ndarray], DataFrame]:
    """(words, network, all counts) of the training documents docs."""
    words, counts = count_and_choose(docs)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def streams(batches):
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in chunks(raw):
                _, k, first = read(Batch(raw[a:b], lower=True), shared.value)
                yield with_ends(k, first, END_TOKEN)[0]

    def warm(batches):
        yield pd.DataFrame({"w": [pickle.dumps(train(np.concatenate([np.zeros(0, np.int64), *streams(batches)]), fresh(), shared.value, epochs=2))]})

    sampled = docs.orderBy(F.xxhash64(F.lit(9), "doc_id", "text")).limit(WARM_DOCS).select("text")
    first = sampled.coalesce(1).mapInPandas(warm, "w binary").collect()
    w = pickle.loads(first[0]["w"]) if first else fresh()
    fold = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(AVERAGED))
    for i in range(AVERAGED):
        w = averaged(docs.filter(fold == i).select("text"), w, shared, RATE / 4 * (1 - i / AVERAGED), streams)
    return words, w, counts


def score(docs: DataFrame, words: Words, network: dict[str, np.ndarray], counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of the whole text of each row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    shared = docs.sparkSession.sparkContext.broadcast((words, network))

    def run(batches):
        words, w = shared.value
        for pdf in batches:
            raw = encode(pdf["text"])
            for on in side_by_side(raw):
                h, k, first = read_all([raw[i] for i in on], words)
                h, _ = with_ends(h, first, U64(END))
                k, at = with_ends(k, first, END_TOKEN)
                c, found = words.counts(h)
                share = np.where(found, np.log10(c + 0.5), 0.0)
                rare = (k >= VOCABULARY) & (k != END_TOKEN)
                less = np.where(rare, words.denominator[np.where(rare, k - VOCABULARY, 0)], 0.0)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (found & (c > 0), share, np.where(rare, share, 0.0) - less)]
                known, plus, within = [x[at[1:]] - x[at[:-1]] for x in sums]
                yield pd.DataFrame({
                    "id": pdf["id"].to_numpy()[on], "lost": pdf["lost"].to_numpy()[on], "row": pdf["row"].to_numpy()[on], "n_tokens": np.diff(at),
                    "known": known, "plus": plus, "model": log_likelihood(w, words, k, at) + within,
                    "rest": [h[x:y][~found[x:y]].view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)],
                })

    schema = "id long, lost boolean, row long, n_tokens long, known long, plus double, model double, rest array<long>"
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("lost"), F.col("text").cast("string").alias("text")
    ).withColumn("row", F.monotonically_increasing_id())
    partly = cut(named.mapInPandas(run, schema))
    rare = partly.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("h"))
    half = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.log10(half + 0.5)).alias("more"), F.count_if(half > 0).alias("found")
    )
    unit = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return partly.drop("rest").join(rare, "row", "left").select(
        F.when(~F.col("lost"), F.col("id")).alias("doc_id"), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        (F.col("plus") + more - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(crc_mod(F.col("doc_id")) == 1, F.lit(False))
    words, network, counts = learn(docs.filter(~held_out))
    return score(docs, words, network, counts).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )

