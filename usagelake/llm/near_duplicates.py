"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles (64-bit hashes).  A register
holds the least of exponentially distributed values of the set's elements,
truncated to a geometric scale; registers of a union are the larger ones of the
parts, so sketches merge, and equal registers are as likely as the sets are
alike.  Documents with equal sets form a class.  Bands of registers are hashed
to buckets; documents of a bucket are compared by their registers' joint
likelihood and, if that leaves a doubt, on their full sets.

A bucket of any size is handled without listing its pairs: first each member is
compared with one hub; links give components; then only members outside the
hub's component are compared with the rest, in blocks of bounded size.  Pairs
inside a component need no further look, so no link between components is lost.

Bands: with four registers to a band and 32 bands, a pair of similarity 0.8
misses every bucket with a probability of 5e-8.

Defined results: null and empty texts have no set, link with nothing and are
components of their own; a text with fewer words than a shingle is one shingle;
rows with the same id are judged alike; null ids are kept and are the largest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, sized, table, unused
from .text import U64, Batch, chunks, encode, mix, prefix_of, window_hashes

SHINGLE = 4
SHARE = 0.8
REGISTERS = 128
BAND = 4
#: Base of the geometric scale; register of the value 1.
SCALE, ZERO = 1.001, 4000
#: A pair is dropped on its registers alone if they are exp(DOUBT) times likelier without a link.
DOUBT = 14.0
#: A pair with a smaller share of equal registers is dropped as well; at a similarity of 0.8 that has a probability of 1e-23.
FEWEST = 0.4
BLOCK = 4096


def shingle_sets(raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at): the distinct shingles of each text, sorted, and where each text's begin."""
    batch = Batch(raw, lower=True)
    start, end, first = batch.words()
    pre = prefix_of(batch.hashes(start, end))
    words = np.diff(first)
    number = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(raw)), number)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + first[:-1][doc]
    h = window_hashes(pre, begin, begin + np.minimum(words, size)[doc])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(raw) + 1))


def registers(h: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """uint16 registers of each set, one row a set; zeros for an empty set.

    Each element draws an ascending Poisson process of points, each point in a
    random register; points beyond the value that fills all registers (nearly
    always) are never drawn.
    """
    size = np.diff(at)
    least = np.full((len(size), m), np.inf)
    todo = np.flatnonzero(size)
    reach = 5.0
    while len(todo):
        doc = np.repeat(todo, size[todo])
        own = h[np.repeat(at[:-1][todo], size[todo]) + np.arange(len(doc)) - np.repeat(np.cumsum(size[todo]) - size[todo], size[todo])]
        limit = ((np.log(m) + reach) / size)[doc] if len(doc) else np.zeros(0)
        least[todo] = np.inf
        x, step = np.zeros(len(own)), 0
        while len(own):
            step += 1
            r = mix(own + U64(step * 0x9E3779B97F4A7C15 % 2**64))
            x = x - np.log1p(-((r >> U64(11)).astype(np.float64) * 2.0**-53)) / m
            on = x < limit
            own, x, limit, doc, r = own[on], x[on], limit[on], doc[on], r[on]
            np.minimum.at(least.reshape(-1), doc * m + (r % U64(m)).astype(np.int64), x)
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        reach *= 2
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.floor(ZERO + 1 - np.log(least) / np.log(SCALE))
    return np.clip(np.where(np.isinf(least), 0, k), 0, 65535).astype(np.uint16)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-9, 1 - 1e-9) * (SCALE - 1) / SCALE) / np.log(SCALE)


def maybe_linked(more, less, same, n_a, n_b, share: float) -> np.ndarray:
    """Whether similarity `share` or more is likely enough, given registers that are larger, smaller, equal.

    A likelihood ratio against the true similarity is exp(DOUBT) or more with a probability of exp(-DOUBT) at most
    (Markov's inequality), so over the 40 values tried a linked pair is dropped with one of 40 exp(-DOUBT), 3.4e-5, at
    most; a link between components is lost only if all their pairs' are.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(u, v)

    def loglik(j):
        a, b = _chance(u - v * j), _chance(v - u * j)
        return more * np.log(np.maximum(a, 1e-12)) + less * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))

    grid = np.linspace(0.02, 1, 40)
    best = np.max([loglik(np.minimum(j, top)) for j in grid], axis=0)
    high = np.max([loglik(np.clip(j, share, np.maximum(top, share))) for j in np.linspace(share, 1, 9)], axis=0)
    return (top >= share * (1 - 1e-12)) & (high >= best - DOUBT)


def sketch(docs: DataFrame, size: int, with_sets: bool = False) -> DataFrame:
    """(key, n, class, regs and, if asked, the set) of each document; key is a hash of its id and text."""

    def run(batches):
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in chunks(raw):
                h, at = shingle_sets(raw[a:b], size)
                regs = registers(h, at)
                n = np.diff(at)
                zero = np.zeros(1, U64)
                pre = np.concatenate([zero, np.cumsum(mix(h ^ U64(0xA0761D6478BD642F)))])
                alt = np.concatenate([zero, np.cumsum(mix(h + U64(0xE7037ED1A0B428DB)))])
                cls = mix((pre[at[1:]] - pre[at[:-1]]) ^ mix(alt[at[1:]] - alt[at[:-1]] + n.astype(U64)))
                out = {"key": pdf["key"].to_numpy()[a:b], "n": n, "class": cls.view(np.int64), "regs": [r.tobytes() for r in regs]}
                if with_sets:
                    out["own"] = [h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pd.DataFrame(out)

    schema = "key long, n long, class long, regs binary" + (", own binary" if with_sets else "")
    return docs.select("key", "text").mapInPandas(run, schema)


class Side:
    """Rows of a block: classes, components, sizes, registers, sets."""

    def __init__(self, rows: pd.DataFrame):
        self.cls, self.comp = rows["class"].to_numpy(), rows["comp"].to_numpy()
        self.n = rows["n"].to_numpy().astype(float)
        self.regs = np.stack([np.frombuffer(x, np.uint16) for x in rows["regs"]])
        self.own = [np.frombuffer(x, U64) for x in rows["own"]]


def block_links(q: Side, t: Side, band: int, share: float):
    """One linked pair for each two components of the block that have one."""
    found = {}
    for i in range(len(q.cls)):
        on = np.flatnonzero((t.comp != q.comp[i]) & (np.minimum(t.n, q.n[i]) >= share * np.maximum(t.n, q.n[i]) - 1e-9))
        if not len(on):
            continue
        equal = t.regs[on] == q.regs[i]
        keep = equal.sum(axis=1) >= FEWEST * REGISTERS
        if band > 0:  # a pair that shares an earlier band is compared there
            keep &= ~equal[:, : band * BAND].reshape(len(on), band, BAND).all(axis=2).any(axis=1)
        on, equal = on[keep], equal[keep]
        if not len(on):
            continue
        same = equal.sum(axis=1)
        more = (q.regs[i] > t.regs[on]).sum(axis=1)
        on = on[maybe_linked(more, REGISTERS - same - more, same, q.n[i], t.n[on], share)]
        on = on[[(min(q.comp[i], c), max(q.comp[i], c)) not in found for c in t.comp[on]]] if found else on
        if not len(on):
            continue
        sizes = t.n[on].astype(np.int64)
        every = np.concatenate([t.own[j] for j in on])
        place = np.searchsorted(q.own[i], every)
        hit = q.own[i][np.minimum(place, len(q.own[i]) - 1)] == every
        both = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
        linked = 100 * both >= round(100 * share) * (q.n[i] + sizes - both)
        for j in on[linked]:
            found.setdefault((min(q.comp[i], t.comp[j]), max(q.comp[i], t.comp[j])), (q.cls[i], t.cls[j]))
    return list(found.values())


def links_in_blocks(rows: DataFrame, share: float) -> DataFrame:
    """rows: (block, band, ask, class, comp, n, regs, own), a block's rows being few -> linked (a, b)."""

    def run(batches):
        rest = None

        def done(part):
            for _, g in part.groupby("block", sort=False):
                ask = g["ask"].to_numpy()
                if ask.any() and not ask.all():
                    yield from block_links(Side(g[ask]), Side(g[~ask]), int(g["band"].iloc[0]), share)

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["block"].to_numpy() == pdf["block"].iloc[-1]  # may go on in the next batch
            rest = pdf[last]
            yield pd.DataFrame([*done(pdf[~last])], columns=["a", "b"], dtype="int64")
        if rest is not None:
            yield pd.DataFrame([*done(rest)], columns=["a", "b"], dtype="int64")

    return rows.repartition("block").sortWithinPartitions("block").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(class, comp) of every node of the edges (a, b): comp is the least node that it reaches.

    Large-star and small-star steps in turn; the number of rounds grows as the
    logarithm of the longest path.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    sign = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            break
        sign = now
    roots = edges.select(F.col("b").alias("class"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("class"), F.col("b").alias("comp")).union(roots)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, leader) of each row of docs.

    key names a (doc_id, text); leader is the key with the least doc_id of the component.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    ids = keyed.select("key", "doc_id")
    sketched = cut(sketch(keyed, size))
    known = sketched.filter("n > 0")
    reps = cut(known.groupBy("class").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    bands = REGISTERS // BAND
    spread = reps.select("class", F.posexplode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("regs", b * BAND * 2 + 1, BAND * 2)) for b in range(bands)
    ])).alias("band", "bucket"))
    many = cut(spread.groupBy("bucket").agg(F.count("*").alias("g"), F.min("class").alias("hub")).filter("g > 1"))
    members = cut(spread.join(sized(many), "bucket"))
    wanted = cut(members.select("class").distinct().join(reps.select("class", "key"), "class").select("key"))
    chosen = keyed.join(sized(wanted), "key", "left_semi")
    sets = cut(sketch(chosen, size, with_sets=True).dropDuplicates(["class"]).drop("key"))

    # every member with its bucket's hub
    pairs = cut(members.filter("class != hub").select("hub", "class").distinct())
    parts = cut(pairs.groupBy("hub").agg(F.count("*").alias("g")).withColumn("parts", F.ceil(F.col("g") / BLOCK).cast("int")))
    dealt = pairs.join(sized(parts), "hub").withColumn("block", F.xxhash64("hub", F.pmod(F.xxhash64("class"), F.col("parts"))))
    ask = dealt.select("block", F.col("hub").alias("class")).distinct().withColumn("ask", F.lit(True))
    rows = ask.unionByName(dealt.select("block", "class").withColumn("ask", F.lit(False)))
    rows = rows.withColumn("band", F.lit(0)).withColumn("comp", F.col("class"))
    edges = cut(links_in_blocks(rows.join(sets, "class"), share))

    # members outside the hub's component with all members
    comp = cut(components(edges))
    labelled = members.filter("g > 2").join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    labelled = cut(labelled.select("bucket", "band", "class", "comp", "g"))
    split = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "class").alias("home"))
    split = cut(split.filter("lo != hi").select("bucket", "home"))
    open_ = labelled.join(sized(split), "bucket")
    n_ask = cut(open_.groupBy("bucket").agg(F.count_if(F.col("comp") != F.col("home")).alias("n_ask")))
    open_ = open_.join(sized(n_ask), "bucket").withColumn("qs", F.ceil(F.col("n_ask") / BLOCK).cast("int")).withColumn("ts", F.ceil(F.col("g") / BLOCK).cast("int"))
    here = F.xxhash64("class")
    asks = open_.filter("comp != home").withColumn("q", F.pmod(here, F.col("qs"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("ts") - 1)))
    told = open_.withColumn("t", F.pmod(here, F.col("ts"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    cols = [F.xxhash64("bucket", F.col("q").cast("long"), F.col("t").cast("long")).alias("block"), "class", "band", "comp"]
    rows = asks.select(*cols, F.lit(True).alias("ask")).unionByName(told.select(*cols, F.lit(False).alias("ask")))
    more = cut(links_in_blocks(rows.join(sets, "class"), share))
    if not more.isEmpty():
        comp = cut(components(edges.unionByName(more)))

    classes = known.select("key", "n", "class").join(ids.distinct(), "key")
    least = classes.join(sized(comp), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = cut(least.select("key", "n", "comp", "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    top = least.groupBy("comp").agg(F.count("*").alias("g"), F.min("doc_id").alias("component_id"), first.alias("leader"))
    top = cut(top.filter("g > 1").drop("g"))  # a row alone in its component leads itself
    found = least.join(sized(top), "comp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("leader", F.coalesce("leader", "key"))
    found = found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "component_id", "leader")])
    every = ids.join(found, "key", "left")
    return every.select(
        "key", "doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("leader", "key").alias("leader"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, share: float = SHARE) -> DataFrame:
    """docs with one row of each component: the one with the least id; of equal rows one stays.  Rows without words all stay."""
    found = cut(near_duplicates(docs, size, share).filter("n_shingles > 0").select("key", "leader"))
    key, row, first = [unused(docs, n) for n in ("_near_key", "_near_row", "_near_first")]
    named = docs.withColumn(key, F.xxhash64("doc_id", F.col("text").cast("string")))
    lost = cut(found.filter("key != leader").select(F.col("key").alias(key)).distinct())
    kept = named.join(sized(lost), key, "left_anti")
    twice = cut(found.filter("key = leader").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    if twice.isEmpty():
        return kept.select(docs.columns)
    kept = cut(kept.withColumn(row, F.monotonically_increasing_id()))
    least = kept.select(key, row).join(sized(twice), key, "left_semi").groupBy(key).agg(F.min(row).alias(first))
    kept = kept.join(sized(cut(least)), key, "left").filter(F.col(first).isNull() | (F.col(first) == F.col(row)))
    return kept.select(docs.columns)
