"""Suffix-array dedup of byte strings.

Bytes covered by a 200-byte string that also starts elsewhere are removed.
Prefix polynomial hashes give the hash of any range; the longest common
extension of two suffixes is found by binary search over such hashes, so one
comparison takes a logarithm of the string's length, and mergesort orders the
suffixes; neighbours whose extension reaches 200 bytes are verified byte by
byte.

Suffixes whose outcome is plain without a sort are set aside first: a window
stands for the least of the 32-byte grams it holds, and pieces of windows are
compared by that key and by a cryptographic digest of all their bytes (see
repeats.py).  A piece whose key is met nowhere else cannot repeat, one whose
bytes are met again repeats as a whole; what stays open at 32 and then 176 bytes
is sorted, key by key.  A key with very many open contexts is dealt out by
window hashes modulo a number of parts, and each part is sorted by itself, a
bounded number of suffixes at a time.

Defined results: null and empty texts have no bytes and keep the empty string;
shorter texts than a window are kept; equal rows count as two places; ids that
are no integers are refused; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, sized, table
from .repeats import STEP_BYTES, arrays, count_of, covered, doc_id, every_document, first_of, firsts, fits, identified, pack, pieces, settled, with_places
from .text import _BYTES, _INVERSE, powers, prefix_of, steps, window_hashes

WINDOW = 200
LEVELS = (32, 176)
#: Open contexts of one key in a part, on average; keys with more are dealt out to several parts.
PART = 2_000
#: Suffixes that one vectorised sort takes.
SUFFIXES = 200_000


class Suffixes:
    """Suffixes of a byte buffer, compared over their first `limit` bytes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        self.pre = prefix_of(_BYTES[data])
        self.inverse = powers(_INVERSE, len(self.pre))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes a and b, up to the limit."""
        pre = self.pre
        pa, pb, ia, ib = pre[a], pre[b], self.inverse[a], self.inverse[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.limit)
        for _ in range(int(self.limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = (pre[a + mid] - pa) * ia == (pre[b + mid] - pb) * ib
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return np.minimum(low, self.limit)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        whole = n >= self.limit
        n = np.where(whole, 0, n)
        return ~whole & (self.data[a + n] < self.data[b + n])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (group ascends), by bottom-up mergesort of all groups at once."""
        n = len(start)
        order = np.arange(n)
        g0 = np.searchsorted(group, group, side="left")
        g1 = np.searchsorted(group, group, side="right")
        width, most = 1, int((g1 - g0).max()) if n else 0
        at = np.arange(n)
        local = at - g0
        while width < most:
            run = local // width
            other = g0 + (run ^ 1) * width
            on = np.flatnonzero(other < g1)
            low, high = other[on].copy(), np.minimum(other[on] + width, g1[on])
            right = run[on] & 1 == 1
            own = start[order[on]]
            seek = np.arange(len(on))
            while len(seek):
                seek = seek[low[seek] < high[seek]]
                if not len(seek):
                    break
                mid = (low[seek] + high[seek]) >> 1
                x, y = own[seek], start[order[mid]]
                r = right[seek]
                before = self.less(np.where(r, x, y), np.where(r, y, x))  # left: other < own; right: own < other
                up = before ^ r
                low[seek[up]] = mid[up] + 1
                high[seek[~up]] = mid[~up]
            place = at.copy()
            place[on] = g0[on] + (run[on] & ~1) * width + (local[on] - run[on] * width) + (low - other[on])
            fresh = np.empty_like(order)
            fresh[place] = order
            order = fresh
            width *= 2
        return order

    def repeated(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each suffix's first `limit` bytes are those of another one of its group, and whether it is the first with its bytes."""
        order = self.sort(start, group)
        a, b = order[:-1], order[1:]
        alike = group[a] == group[b]
        near = np.flatnonzero(alike)
        alike[near] = self.common(start[a[near]], start[b[near]]) >= self.limit
        near = np.flatnonzero(alike)
        out, lead, doubt = np.zeros(len(start), bool), np.ones(len(start), bool), np.zeros(len(near), bool)
        step = np.arange(self.limit)
        for i in range(0, len(near), 10_000):  # equal hashes are no proof
            k = near[i : i + 10_000]
            same = (self.data[start[a[k]][:, None] + step] == self.data[start[b[k]][:, None] + step]).all(axis=1)
            out[a[k[same]]] = out[b[k[same]]] = True
            lead[b[k[same]]] = False
            doubt[i : i + 10_000] = ~same
        run = np.concatenate([[0], np.cumsum(~alike)])
        for r in np.unique(run[near[doubt]]):  # suffixes that collide are told apart by their bytes
            met: dict[bytes, int] = {}
            for x in order[np.searchsorted(run, r) : np.searchsorted(run, r, side="right")].tolist():
                own = self.data[start[x] : start[x] + self.limit].tobytes()
                lead[x] = own not in met
                if own in met:
                    out[x] = out[met[own]] = True
                met.setdefault(own, x)
        return out, lead


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """(hk, part, parts, id, doc, place, own): the bytes under each packed place of docs, once for each part that its windows fall in.

    docs: (id, doc, text, places, hk, parts), the last three arrays of one length.
    """

    names = ["hk", "part", "parts", "id", "doc", "place", "own"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids, docs_known = batch.column("id").to_pylist(), batch.column("doc").to_pylist()
            for a, b, raw in steps(batch.column("text"), STEP_BYTES["byte"]):
                out = step(raw, *[arrays(batch, c, a, b) for c in ("places", "hk", "parts")], ids[a:b], docs_known[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def step(*columns):
        out = []
        for text, places, keys, parts, i, d in zip(*columns, strict=True):
            pre = prefix_of(_BYTES[np.frombuffer(text, np.uint8)]) if max(parts) > 1 else None
            for p, k, n in zip(places.tolist(), keys.tolist(), parts.tolist(), strict=True):
                f, c = first_of(p), count_of(p)
                at = np.arange(f, f + c)
                every = [0] if n == 1 else np.unique(window_hashes(pre, at, at + window) % np.uint64(n)).tolist()
                out += [(k, q, n, i, d, p, text[f : f + c - 1 + window]) for q in every]
        return out

    return docs.mapInArrow(run, "hk long, part int, parts int, id long, doc long, place long, own binary")


def settle(rows: pd.DataFrame, window: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(repeats, distinct windows of the last group) of whole rows of contexts(), in order of (hk, part)."""
    own = [np.frombuffer(x, np.uint8) for x in rows["own"]]
    size = np.array([len(x) for x in own])
    at = np.cumsum(size) - size
    number = size - window + 1
    ctx = np.repeat(np.arange(len(own)), number)
    offset = np.arange(len(ctx)) - np.repeat(np.cumsum(number) - number, number)
    suffixes = Suffixes(np.concatenate(own), window)
    start = at[ctx] + offset
    parts = rows["parts"].to_numpy()
    if parts.max() > 1:
        mine = window_hashes(suffixes.pre, start, start + window) % parts[ctx].astype(np.uint64) == rows["part"].to_numpy()[ctx].astype(np.uint64)
        ctx, offset, start = ctx[mine], offset[mine], start[mine]
    change = (rows["hk"].to_numpy()[1:] != rows["hk"].to_numpy()[:-1]) | (rows["part"].to_numpy()[1:] != rows["part"].to_numpy()[:-1])
    group = np.concatenate([[0], np.cumsum(change)])
    again, lead = suffixes.repeated(start, group[ctx])
    hit = np.flatnonzero(again)
    new = np.ones(len(hit), bool)
    new[1:] = (ctx[hit[1:]] != ctx[hit[:-1]]) | (offset[hit[1:]] != offset[hit[:-1]] + 1)
    count = np.diff(np.append(np.flatnonzero(new), len(hit)))
    c, o = ctx[hit[new]], offset[hit[new]]
    row = lambda c, o, n: pd.DataFrame({
        "id": rows["id"].to_numpy()[c], "doc": rows["doc"].to_numpy()[c], "place": pack(first_of(rows["place"].to_numpy()[c]) + o, n),
    })
    keep = lead & (group[ctx] == group[-1])
    c2, o2 = ctx[keep], offset[keep]
    rest = row(c2, o2, np.ones(len(c2), np.int64)).assign(**{k: rows[k].to_numpy()[c2] for k in ("hk", "part", "parts")})
    rest["own"] = [rows["own"].iloc[x][y : y + window] for x, y in zip(c2.tolist(), o2.tolist(), strict=True)]
    return row(c, o, count), rest[rows.columns]


def sorted_repeats(rows: DataFrame, window: int) -> DataFrame:
    """(id, doc, place): packed places of the windows that repeat among the contexts of their key and part.

    About SUFFIXES windows are sorted at a time; of a group that goes on, each
    distinct window so far is sorted again with what follows.
    """

    def run(batches):
        held = None

        def done(pdf):
            nonlocal held
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            found, rest = settle(pdf, window)
            return found, rest

        wait, size = [], 0
        for pdf in batches:
            for first in range(0, len(pdf), 4096):
                piece = pdf[first : first + 4096]
                wait.append(piece)
                size += int(piece["own"].map(len).sum()) - len(piece) * (window - 1)
                if size >= SUFFIXES:
                    found, held = done(pd.concat(wait, ignore_index=True))
                    wait, size = [], 0
                    yield found
        if wait:
            yield done(pd.concat(wait, ignore_index=True))[0]

    return rows.repartition("hk", "part").sortWithinPartitions("hk", "part").mapInPandas(run, "id long, doc long, place long")


def repeated_bytes(docs: DataFrame, window: int = WINDOW, levels=LEVELS, part: int = PART) -> DataFrame:
    """(id, doc, place): packed places of windows that also start elsewhere. docs: (id, doc, text), each text once."""
    found, some = None, docs
    for gram in levels:
        level = cut(settled(pieces(some, "byte", window, gram)))
        again = level.filter("again").select("id", "doc", "place")
        found = again if found is None else found.unionByName(again)
        open_ = level.filter("open").select("id", "doc", "place", "hk").distinct()
        if gram != levels[-1]:
            some = with_places(docs, open_)
    many = cut(open_.groupBy("hk").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).filter("parts > 1"))
    open_ = open_.join(sized(many), "hk", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return found.unionByName(sorted_repeats(contexts(with_places(docs, open_, "hk", "parts"), window), window))


def _strip(docs: DataFrame, window: int) -> DataFrame:
    names = ["id", "lost", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for a, b, texts in steps(batch.column("text")):
                rows = []
                given = [batch.column(c).slice(a, b - a).to_pylist() for c in ("id", "lost", "twice")]
                for i, lost, twice, raw, places in zip(*given, texts, arrays(batch, "places", a, b), strict=True):
                    s, e = covered(places, window, len(raw))
                    if twice and len(raw) >= window:
                        s, e = np.zeros(1, np.int64), np.array([len(raw)])
                    at = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(at[::2], at[1::2], strict=True)) if len(s) else raw
                    rows.append((i, lost, len(raw), len(raw) - len(kept), len(s), kept))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    twice = F.col("copies").isNotNull().alias("twice")
    stripped = docs.select("id", "lost", "text", "places", twice).mapInArrow(run, "id long, lost boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return stripped.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept")


def dedup_bytes(docs: DataFrame, window: int = WINDOW, levels=LEVELS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that are left."""
    fits(window, levels)
    known = identified(docs)
    return _strip(every_document(known, repeated_bytes(firsts(known), window, levels)), window)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
