"""Repeated windows of items (words or bytes) across a corpus, without listing every window.

A window is represented by the least hash of the shorter grams it holds;
neighbouring windows with one representative form a piece.  Equal windows have
equal representatives, so a piece can repeat only where its key (that hash) is
met again.  Pieces that agree in key and in the digest of their context (the
bytes under all their windows) repeat as a whole; where contexts of a key
differ, one piece of each context goes on to the next, longer gram.  Pieces
travel as (key, digest, id, doc, place), never as text.

Pieces are sorted by range, not hashed by key, so that a key of any frequency is
spread over as many tasks as it needs; each row is judged by its neighbours, and
only the rows at the edges of partitions are looked at once more.  Equal texts
are folded first: one of them stands for all.

A document is known by its id and 64 bits of its text's hash, so that rows that
share an id but not the text are told apart.  A null id is the largest.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .frames import BROADCAST_ROWS, cut, sized, spread_join
from .text import _BYTES, CHUNK_BYTES, Batch, prefix_of, sliding_min, steps, window_hashes

ROWS = "hk long, hc long, id long, doc long, place long"
ORDER = ["hk", "hc", "id", "place", "doc"]
MARKS = "id long, doc long, place long, later boolean, again boolean, open boolean, edge boolean, hk long, hc long"


def identified(docs: DataFrame) -> DataFrame:
    """docs as (id, lost, doc, text, first_id, copies): `lost` marks a null id, `copies` counts rows of one text.

    first_id is the least id of the text's rows; it and `copies` are null for a text that is there once.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("doc_id").isNull().alias("lost"),
        F.xxhash64(text).alias("doc"), text.alias("text"),
    )
    same = F.sha2(F.col("text").cast("binary"), 256).alias("same")
    copies = known.groupBy(same).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return spread_join(known.withColumn("same", same), cut(copies), ["same"], outer=True).drop("same").withColumnRenamed("n", "copies")


def firsts(known: DataFrame) -> DataFrame:
    """One row for each text: of the text's rows with the least id, whose places are alike, any.

    Only where such rows agree in their id as well are texts shuffled, one from each task.
    """
    chosen = known.filter("first_id IS NULL OR id = first_id")
    alike = cut(known.filter("id = first_id").groupBy("id", "doc").agg(F.count("*").alias("n")).filter("n > 1").select("id", "doc"))
    if alike.isEmpty():
        return chosen
    names = sized(alike)
    return chosen.join(names, ["id", "doc"], "left_anti").unionByName(chosen.join(names, ["id", "doc"], "left_semi").dropDuplicates(["id", "doc"]))


#: Bytes of text that one vectorised step handles: some 150 bytes of arrays for each item.
STEP_BYTES = {"byte": CHUNK_BYTES // 8, "word": CHUNK_BYTES}
#: Bits of a packed place that hold a piece's number of windows.
COUNT_BITS = 16


def fits(window: int, levels) -> None:
    """Refuse windows whose pieces, at most window - gram + 1 windows each, do not fit in a packed place."""
    if not 0 < min(levels) <= max(levels) <= window or window - min(levels) + 1 >= 1 << COUNT_BITS:
        raise ValueError(f"levels lie between 1 and the window, and a piece has less than {1 << COUNT_BITS} windows")


def pack(first, count):
    """(first window, number of windows) as one integer that sorts by the first window."""
    return (np.asarray(first, np.int64) << COUNT_BITS) | np.asarray(count, np.int64)


def first_of(place):
    return place >> COUNT_BITS


def count_of(place):
    return place & ((1 << COUNT_BITS) - 1)


class Sequence:
    """The items of a batch of texts in one row: prefix hashes, where each text's begin and end, and their bytes."""

    def __init__(self, raw: list[bytes], unit: str):
        if unit == "word":  # one space between words, so that equal words are equal bytes
            batch = Batch([b" ".join(r.split()) for r in raw])
            self.start, self.end, first = batch.words()
            self.pre = prefix_of(batch.hashes(self.start, self.end))
            self.lo, self.hi = first[:-1], first[1:]
        else:
            batch = Batch(raw)
            self.start = np.arange(len(batch.data))
            self.end = self.start + 1
            self.pre = prefix_of(_BYTES[batch.data])
            self.lo, self.hi = batch.at[:-1], batch.at[1:] - 1
        self.bytes = batch.data.tobytes()

    def span(self, first: np.ndarray, last: np.ndarray):
        """Byte range of the items first..last, both included."""
        return self.start[first], self.end[last]

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit digests of the bytes of the items first..last."""
        data = self.bytes
        a, b = self.span(first, last)
        out = [blake2b(data[x:y], digest_size=8).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return np.frombuffer(b"".join(out), np.int64)

    def windows(self, window: int, places: list[np.ndarray] | None) -> np.ndarray:
        """Whether a window of interest starts at each item: any window, or one of the packed places of its text."""
        step = np.zeros(len(self.pre) + 1, np.int32)
        if places is None:
            on = self.hi - self.lo >= window
            np.add.at(step, self.lo[on], 1)
            np.add.at(step, self.hi[on] - window + 1, -1)
        else:
            at = np.concatenate([np.zeros(0, np.int64), *places])
            first = np.repeat(self.lo, [len(p) for p in places]) + first_of(at)
            np.add.at(step, first, 1)
            np.add.at(step, first + count_of(at), -1)
        return np.cumsum(step[:-2]) > 0

    def pieces(self, window: int, gram: int, places: list[np.ndarray] | None):
        """(key, first window, number of windows, text) of each piece."""
        n = len(self.pre) - 1
        if n < window:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        at = np.arange(n - gram + 1)
        h = window_hashes(self.pre, at, at + gram)
        least = sliding_min(h, window - gram + 1)
        wanted = self.windows(window, places)[: len(least)]
        new = wanted.copy()
        # the first gram of that hash stands for the window: a piece ends where it is left behind
        new[1:] &= ~wanted[:-1] | (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
        first = np.flatnonzero(new)
        stop = np.append(np.flatnonzero(new | ~wanted), len(wanted))
        count = stop[np.searchsorted(stop, first, side="right")] - first
        return least[first].view(np.int64), first, count, np.searchsorted(self.lo, first, side="right") - 1


def pieces(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """Pieces of all windows of docs (id, doc, text), or of the windows in the packed `places` of each."""
    given = "places" in docs.columns

    def run(batches):
        for batch in batches:
            ids, names = batch.column("id").to_numpy(), batch.column("doc").to_numpy()
            for a, b, raw in steps(batch.column("text"), STEP_BYTES[unit]):
                seq = Sequence(raw, unit)
                key, first, count, text = seq.pieces(window, gram, arrays(batch, "places", a, b) if given else None)
                if len(key):
                    yield pa.RecordBatch.from_pydict({
                        "hk": key, "hc": seq.digests(first, first + count + window - 2), "id": ids[a + text], "doc": names[a + text],
                        "place": pack(first - seq.lo[text], count),
                    })

    return docs.select("id", "doc", "text", *["places"] * given).mapInArrow(run, ROWS)


def arrays(batch: pa.RecordBatch, name: str, first: int, last: int) -> list[np.ndarray]:
    """The arrays of some rows of a column of arrays."""
    return list(batch.column(name).slice(first, last - first).to_numpy(zero_copy_only=False))


class Marker:
    """Judges the sorted pieces of one partition, batch by batch; it holds two rows at most.

    Of each piece: `later` (its context is met at a smaller (id, first window)),
    `again` (met elsewhere), `open` (the first of its context, and its key has
    others).  Rows at the partition's ends are `edge`: their neighbours beyond
    are not known here, and they count as open.
    """

    def __init__(self):
        self.held = self.before = self.head = self.lead = self.pending = None

    def feed(self, rows: np.ndarray, end: bool = False) -> pd.DataFrame:
        """rows: (n, 5) in ORDER. All but the last are judged; that one too at the end."""
        if self.held is not None:
            rows = np.concatenate([self.held[None], rows])
        if not len(rows):
            return self.frame(rows, *np.zeros((4, 0), bool))
        start = self.before is None
        if start:
            self.lead = rows[0]
        hk, hc = rows[:, 0], rows[:, 1]
        same_key, same = np.zeros(len(rows) + 1, bool), np.zeros(len(rows) + 1, bool)
        same_key[1:-1] = hk[1:] == hk[:-1]
        same[1:-1] = same_key[1:-1] & (hc[1:] == hc[:-1])
        if not start:
            same_key[0] = hk[0] == self.before[0]
            same[0] = same_key[0] and hc[0] == self.before[1]
        n = len(rows) if end else len(rows) - 1
        place = np.arange(len(rows))
        head = np.maximum.accumulate(np.where(~same[:-1], place, -1))
        old = rows[0] if self.head is None else self.head
        at = np.where(head[:, None] >= 0, rows[np.maximum(head, 0)][:, 2:4], old[2:4])
        first = first_of(rows[:, 3])
        later = (rows[:, 2] > at[:, 0]) | (first > first_of(at[:, 1]))
        again = same[:-1] | same[1:]
        lead = (hk == self.lead[0]) & (hc == self.lead[1]) & (rows[:, 2] == self.lead[2]) & (first == first_of(self.lead[3]))
        edge = lead.copy()
        open_ = same_key[:-1] & ~same[:-1]
        if start:
            open_[0] = True
        # the first context of a key is open if another follows
        ends = np.flatnonzero(~same[1:-1]) + 1  # rows that begin another context
        extra = []
        if self.pending is not None:
            e = 0 if not same[0] else (ends[0] if len(ends) else None)
            if e is not None:
                if same_key[e]:
                    extra.append(self.pending)
                self.pending = None
        alone = np.flatnonzero(~same_key[:-1])
        where = np.searchsorted(ends, alone, side="right")
        known = where < len(ends)
        open_[alone[known]] |= same_key[ends[where[known]]]
        if (~known).any():  # at most one: the last
            self.pending = rows[alone[~known][-1]]
        if end:
            edge[-1] = open_[-1] = True
            if self.pending is not None:
                extra.append(self.pending)
        else:
            self.held = rows[-1]
            if n:
                self.before = rows[n - 1]
                self.head = old if head[n - 1] < 0 else rows[head[n - 1]]
        out = self.frame(rows[:n], later[:n], again[:n], open_[:n], edge[:n])
        if extra:
            no = np.zeros(len(extra), bool)
            out = pd.concat([out, self.frame(np.stack(extra), no, no, ~no, no)], ignore_index=True)
        return out

    @staticmethod
    def frame(rows, later, again, open_, edge) -> pd.DataFrame:
        on = later | again | open_ | edge
        r = rows[on].reshape(-1, 5)
        return pd.DataFrame({
            "id": r[:, 2], "doc": r[:, 4], "place": r[:, 3], "later": later[on], "again": again[on], "open": open_[on], "edge": edge[on],
            "hk": r[:, 0], "hc": r[:, 1],
        })


def settled(rows: DataFrame) -> DataFrame:
    """(id, doc, place, later, again, open, hk) of the pieces for which one of the three holds (see Marker)."""

    def mark(batches):
        marker = Marker()
        for pdf in batches:
            yield marker.feed(np.stack([pdf[c].to_numpy(np.int64) for c in ORDER], axis=1))
        yield marker.feed(np.zeros((0, 5), np.int64), end=True)

    ordered = cut(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    marked = cut(ordered.mapInPandas(mark, MARKS))
    # two rows of each partition, and those that tie with its first
    alike = W.partitionBy("hk", "hc")
    at = F.struct("id", F.shiftright("place", COUNT_BITS).alias("first"))
    edges = marked.filter("edge").withColumn("at", at).withColumn("least", F.min("at").over(alike))
    edges = edges.withColumn("past", F.min_by("later", F.struct("at", ~F.col("later"))).over(alike)).withColumn("n", F.count("*").over(alike))
    edges = edges.withColumn("later", F.col("later") | F.col("past") | (F.col("at") > F.col("least"))).withColumn("again", F.col("again") | (F.col("n") > 1))
    out = ["id", "doc", "place", "later", "again", "open", "hk"]
    return marked.filter("NOT edge").select(out).unionByName(edges.select(out))


def listed(places: DataFrame, *more: str) -> DataFrame:
    """(id, doc, places): the packed places of each document as an array; `more` columns are arrays beside it."""
    one = F.collect_list(F.struct("place", *more))
    return cut(places.groupBy("id", "doc").agg(one.alias("p")).select("id", "doc", F.col("p.place").alias("places"), *[F.col(f"p.{m}").alias(m) for m in more]))


def with_places(docs: DataFrame, places: DataFrame, *more: str) -> DataFrame:
    """The documents (id, doc, text) that have packed places, with them."""
    lists = listed(places, *more)
    some = docs.select("id", "doc", "text").join(sized(lists.select("id", "doc")), ["id", "doc"], "left_semi")
    return some.join(lists, ["id", "doc"])


def every_document(docs: DataFrame, places: DataFrame) -> DataFrame:
    """All documents with their packed places (none for most); only those with some are shuffled, if they are few."""
    lists = listed(places)
    none = F.array().cast("array<long>")
    if lists.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return docs.join(lists, ["id", "doc"], "left").withColumn("places", F.coalesce("places", none))
    names = F.broadcast(lists.select("id", "doc"))
    some = docs.join(names, ["id", "doc"], "left_semi").join(lists, ["id", "doc"])
    return some.unionByName(docs.join(names, ["id", "doc"], "left_anti").withColumn("places", none), allowMissingColumns=False)


def doc_id() -> Column:
    return F.when(~F.col("lost"), F.col("id")).alias("doc_id")


def covered(places, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) runs of items that the windows of packed places cover, merged and in order."""
    at = np.sort(np.asarray(places, np.int64))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = first_of(at)
    e = np.maximum.accumulate(np.minimum(s + count_of(at) - 1 + window, size))
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]
