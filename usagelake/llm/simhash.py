"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit for each of 64 positions: whether most of the
hashes of its word shingles have it.  Documents link where at most `radius` bits
differ.

Covering: each bit position gets a nonzero code of radius + 1 bits, all codes
dealt evenly.  For every nonzero vector w of radius + 1 bits there is a mask, of
the positions whose code has an odd inner product with w.  The codes of `radius`
differing positions never span the whole space, so some w is orthogonal to all of
them: under that mask the two fingerprints are equal.  2**(radius + 1) - 1 tables,
keyed by the masked fingerprint, therefore hold every linked pair in a bucket, none
by luck.

Equal fingerprints are one class from the start, so copies cost nothing.  A bucket
of at most `BUCKET` classes is compared in full inside one task.  A larger one is
covered again: the positions outside its mask are cut into radius + 1 parts, and
as a linked pair differs in `radius` of them at most, it agrees on one of the parts
at least; so the bucket is dealt to radius + 1 finer tables, each with one part more
in its mask.  Masks grow until buckets are small: classes that agree on all but a
few positions are few.  No bucket is capped, and rows grow only by radius + 1 a level.

Of a bucket's links only a spanning forest is passed on.

Defined results: null and empty texts, and texts without words, have the fingerprint
zero, linked like any other; a text with fewer words than a shingle is one shingle;
rows with a null id take the least id of their component, null if it has none;
repeated rows are all returned; texts are read whole; columns other than doc_id and
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, spread_join, table
from .near_duplicates import components
from .text import U64, Batch, chunks, encode

SHINGLE, RADIUS, BITS = 3, 3, 64
#: Classes of a bucket that are compared in one task.
BUCKET = 2048

# The primes and the seed of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
# End of fixed values.


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _lane(acc, word):
    return _rotl(acc + word * U64(P2), 31) * U64(P1)


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte ranges [start, end) of a uint8 buffer, all side by side."""
    padded = np.concatenate([data, np.zeros(16 + -len(data) % 8, np.uint8)])
    n = (len(padded) - 8) // 8 * 8
    shifted = np.stack([padded[s : s + n].view("<u8") for s in range(8)])  # every 8 bytes, wherever they begin

    def word(at):
        return shifted[at & 7, at >> 3]

    length = end - start
    h = np.full(len(start), (seed + P5) % 2**64, U64)
    at = start.copy()
    long = np.flatnonzero(length >= 32)
    if len(long):
        lanes = [np.full(len(long), x % 2**64, U64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        stripes = length[long] // 32
        for step in range(int(stripes.max())):
            on = np.flatnonzero(stripes > step)
            for i in range(4):
                lanes[i][on] = _lane(lanes[i][on], word(at[long[on]] + 8 * i))
            at[long[on]] += 32
        acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            acc = (acc ^ _lane(np.zeros(len(long), U64), lane)) * U64(P1) + U64(P4)
        h[long] = acc
    h = h + length.astype(U64)
    left = end - at
    for step in range(4):  # whole words of 8 bytes, three at most
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        h[on] = _rotl(h[on] ^ _lane(np.zeros(len(on), U64), word(at[on])), 27) * U64(P1) + U64(P4)
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rotl(h[on] ^ ((word(at[on]) & U64(0xFFFFFFFF)) * U64(P1)), 23) * U64(P2) + U64(P3)
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        h[on] = _rotl(h[on] ^ (padded[at[on]].astype(U64) * U64(P5)), 11) * U64(P1)
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> U64(33))) * U64(P2)
    h = (h ^ (h >> U64(29))) * U64(P3)
    return h ^ (h >> U64(32))


def fingerprints_of(raw: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The uint64 fingerprint of each text."""
    batch = Batch(raw, lower=True)
    start, end, first = batch.words()
    # words joined by single spaces: a word's bytes and one after it
    keep = np.zeros(len(batch.data) + 1, np.int8)
    keep[start] += 1
    keep[end] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    inside[end] = True
    joined = batch.data[inside].copy()
    length = end - start
    at = np.cumsum(length + 1) - length - 1
    joined[at + length] = 0x20
    words = np.diff(first)
    number = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(raw)), number)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + first[:-1][doc]
    last = begin + np.minimum(words, size)[doc] - 1
    out = np.zeros(len(raw), U64)
    if not len(doc):
        return out
    h = xxh64(joined, at[begin], at[last] + length[last])
    held = np.flatnonzero(number)
    edge = (np.cumsum(number) - number)[held]
    for bit in range(BITS):
        on = np.add.reduceat(((h >> U64(bit)) & U64(1)).astype(np.int64), edge)
        out[held] |= (2 * on > number[held]).astype(U64) << U64(bit)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row of docs."""

    def run(batches):
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in chunks(raw):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "fp": fingerprints_of(raw[a:b], size).view(np.int64)})

    named = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return named.mapInPandas(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, fp long")


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius + 1) - 1 masks: any `radius` positions are all outside one of them."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & w).bit_count() % 2) for w in range(1, 2 ** (radius + 1))]


def finer_masks(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """radius + 1 masks, each with one more part of the positions outside `mask`."""
    out = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in out[part :: radius + 1]) for part in range(radius + 1)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    label = np.arange(len(fps))
    links = []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((fps[i], fps[j]))
    return links


def links_of(buckets: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, mask, key) of buckets of bounded size -> linked (a, b), a spanning forest of each bucket."""

    def run(batches):
        for pdf in batches:
            found = [x for fps in pdf["fps"] for x in forest(np.asarray(fps, np.int64).view(U64), radius)]
            out = np.array(found, U64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return buckets.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(run, "a long, b long")


def masked(fps: DataFrame, masks: Column) -> DataFrame:
    """(fp, mask, key): a row for each mask of the array."""
    found = fps.select("fp", F.explode(masks).alias("mask"))
    return found.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Linked (a, b) of the distinct fingerprints `fp`: as many as connect every component."""
    if bucket < 2**radius:
        raise ValueError("fingerprints that agree on all but `radius` positions must fit in a bucket")
    rows = masked(fps, F.array(*[F.lit(signed(m)) for m in covering_masks(radius)]))
    masks, found = covering_masks(radius), []
    while masks:
        size = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        size = cut(size)
        members = cut(spread_join(rows, size, ["mask", "key"]))
        found.append(cut(links_of(members.filter(F.col("n") <= bucket), radius).distinct()))
        large = members.filter(F.col("n") > bucket)
        masks = [r["mask"] % 2**64 for r in size.filter(F.col("n") > bucket).select("mask").distinct().collect()]  # of this level's tables
        if masks:
            finer = F.create_map(*[F.lit(x) for m in masks for x in (signed(m), [signed(f) for f in finer_masks(m, radius)])])
            # a finer mask holds the one above it: equal keys come from one bucket
            rows = masked(large.select("fp", "mask"), finer[F.col("mask")]).distinct()
            masks = sorted({f for m in masks for f in finer_masks(m, radius)})
    return reduce(DataFrame.union, found).distinct()


def near_fingerprints(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs."""
    found = cut(fingerprints(docs, size))
    classes = cut(found.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    links = near_links(classes.select("fp"), radius, bucket)
    comp = cut(components(links).withColumnRenamed("class", "fp"))
    joined = classes.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    joined = cut(joined)
    least = joined.groupBy("comp").agg(F.count("*").alias("m"), F.min("least").alias("component_id"))
    least = cut(least.withColumnRenamed("m", "n"))
    named = cut(spread_join(joined.select("fp", "comp", F.col("n").alias("copies")), least, ["comp"]).select("fp", "component_id", F.col("copies").alias("n")))
    return spread_join(found, named, ["fp"]).select("doc_id", "fp", "component_id")


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
