"""Compression of vectors to codes by product quantisation, with annular norm pruning.

Components become integers and vectors are cut into equal parts.  Each part
position has a codebook, fitted by rounds of exact nearest-entry assignment and
componentwise floor means.

The nearest entry of a part x is found without looking at every entry.  Entries
are sorted by norm.  As |norm(x) - norm(e)| <= distance(x, e), an entry that is as
near as the best one found so far, at distance d, has a norm within
[norm(x) - d, norm(x) + d]; binary search gives that interval, and only entries
inside it, bounds included, are compared, exactly and in integers.  The search
starts at norm(x) and works outwards, so d shrinks and the annulus with it.

Tables meet the codebooks in tasks: each task adds its parts up by entry, Spark
adds the tasks' sums, and the driver gets one row for an entry of a codebook,
whatever the size of the table.

Defined results: vectors that are null or hold null or non-finite components are
dropped; each length of vectors has codebooks of its own; a length that does not
divide into the parts has null codes and errors; with fewer vectors than entries a
codebook has as many entries as there are vectors; null ids are the largest, equal
ids are ordered by their vectors; repeated rows all count and are all returned;
components are held within a bound that no squared distance overflows; sums of
errors stop at the largest long; columns other than the three named are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, sized, table
from .vectors import as_long, finite, first_rows, floored, matrices, mean_floor, summed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries on each side of the annulus's evaluated core that are compared at a time.
REACH = 6


class Annuli:
    """The entries of one codebook, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norm = np.sqrt((entries**2).sum(1).astype(np.float64))
        self.number = np.argsort(norm, kind="stable")
        self.norm, self.entries = norm[self.number], entries[self.number]

    def within(self, norm: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, last) of the entries whose norm is at most `distance` off; roundings only widen it."""
        slack = (norm + distance) * 1e-12 + 1e-9
        return np.searchsorted(self.norm, norm - distance - slack, "left"), np.searchsorted(self.norm, norm + distance + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, squared distance) of each row of x; ties to the smaller number."""
        k = len(self.norm)
        norm = np.sqrt((x**2).sum(1).astype(np.float64))
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
        done_lo = np.searchsorted(self.norm, norm)
        done_hi = done_lo.copy()
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), k)
        todo = np.arange(len(x))
        reach = np.arange(REACH)
        while len(todo):
            up, down = done_hi[todo, None] + reach, done_lo[todo, None] - 1 - reach
            at = np.clip(np.concatenate([up, down], axis=1), lo[todo, None], hi[todo, None] - 1)  # an entry seen twice does no harm
            d = ((x[todo, None, :] - self.entries[at]) ** 2).sum(2)
            least = d.min(1)
            which = np.where(d == least[:, None], self.number[at], k).min(1)
            better = (least < best[todo]) | ((least == best[todo]) & (which < number[todo]))
            best[todo[better]], number[todo[better]] = least[better], which[better]
            done_hi[todo] = np.minimum(done_hi[todo] + REACH, k)
            done_lo[todo] = np.maximum(done_lo[todo] - REACH, 0)
            lo[todo], hi[todo] = self.within(norm[todo], np.sqrt(best[todo].astype(np.float64)))
            todo = todo[(done_lo[todo] > lo[todo]) | (done_hi[todo] < hi[todo])]
        return number, best


def assign(x: np.ndarray, books: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of each row of x."""
    width = x.shape[1] // len(books)
    found = [b.nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def refit(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, position) after one round over the rows `v`."""
    parts, entries, width = books.shape
    sums = ", ".join(["part int", "entry int", "n long", *[f"s{i} long" for i in range(width)]])
    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]

    def add_up(batches):
        sorted_books = [Annuli(b) for b in books]
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, x in matrices(batch, "v", parts * width):
                entry, _ = assign(x, sorted_books)
                flat = (entry + np.arange(parts) * entries).ravel()
                np.add.at(total, flat, x.reshape(len(flat), width))
                n += np.bincount(flat, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            columns = [(used // entries).astype(np.int32), (used % entries).astype(np.int32), n[used], *total[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    found = kept.select("v").mapInArrow(add_up, sums)
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for r in found.collect():  # a row for each entry of the codebooks at most
        out[r["part"], r["entry"]] = mean_floor(np.array([r[f"s{i}"] for i in range(width)], np.int64), r["n"])
    return out


def fit(kept: DataFrame, length: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the rows (vec_id, v), all `length` long."""
    start = first_rows(kept, entries, F.asc_nulls_last("vec_id"))
    books = np.ascontiguousarray(start.reshape(len(start), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refit(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """kept with code (binary, a byte a part) and error in place of v."""
    parts, _, width = books.shape
    others = [c for c in kept.columns if c != "v"]
    schema = ", ".join([*[f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others], "code binary", "error long"])

    def run(batches):
        sorted_books = [Annuli(b) for b in books]
        for batch in batches:
            codes, errors = [], []
            for _, x in matrices(batch, "v", parts * width):
                entry, d = assign(x, sorted_books)
                codes += [c.tobytes() for c in entry.astype(np.uint8)]
                errors.append(d.sum(1))
            arrays = [batch.column(c) for c in others] + [pa.array(codes, pa.binary()), pa.array(np.concatenate(errors) if errors else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "code", "error"])

    return kept.mapInArrow(run, schema)


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of each vector kept; code is hexadecimal, two digits a part.

    entries: 256 at most.  One fit for each length of vectors, so a table of very many lengths takes many rounds.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code's digits hold 1 to 256 entries")
    v = F.col(vector)
    kept = rows.filter(finite(v)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), floored(v, scale).alias("v"))
    kept = cut(kept)
    lengths = sorted(r["n"] for r in kept.select(F.size("v").alias("n")).distinct().collect())
    found = kept.limit(0).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    for n in lengths:
        alike = kept.filter(F.size("v") == n)
        if n % parts:
            coded = alike.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
        else:
            books = fit(alike, n, parts, entries, rounds)
            sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
            coded = encode(alike, books).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", F.lit(sha).alias("codebooks_sha256"))
        found = coded if n == lengths[0] else found.unionByName(coded)
    return found


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = cut(compress(table(spark, sf_dir, "embeddings")))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(as_long(summed("error")).alias("label_error"))
    found = coded.join(sized(cut(by_label)), F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(n: int) -> str:
    """Assignment of all parts to book{n}, and the book after it."""
    return f"""
near{n} AS (
  SELECT r, p, min(struct_pack(d := (x1-b1)*(x1-b1) + (x2-b2)*(x2-b2) + (x3-b3)*(x3-b3) + (x4-b4)*(x4-b4), e := e)) AS m, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3, any_value(x4) AS x4
  FROM cells JOIN book{n} USING (p) GROUP BY r, p),
mean{n} AS (
  SELECT p, m.e AS e, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(x4) AS s4 FROM near{n} GROUP BY p, m.e),
book{n + 1} AS (
  SELECT p, b.e AS e, """ + ", ".join(
        f"CAST(CASE WHEN n IS NULL THEN b{i} ELSE (s{i} - ((s{i} % n) + n) % n) / n END AS BIGINT) AS b{i}" for i in (1, 2, 3, 4)
    ) + f" FROM book{n} b LEFT JOIN mean{n} m USING (p, e))"


#: For vectors of 64 components.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS (SELECT r, vec_id, p, v[4*p+1] AS x1, v[4*p+2] AS x2, v[4*p+3] AS x3, v[4*p+4] AS x4 FROM kept, range(16) t(p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS (SELECT p, e, x1 AS b1, x2 AS b2, x3 AS b3, x4 AS b4 FROM cells JOIN first USING (r)),
{_round(0)},
{_round(1)},
{_round(2)},
sha AS (SELECT sha256(string_agg(concat_ws(',', b1, b2, b3, b4), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2),
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""
