"""Sharding by a hypergeometric communication matrix.

Rows fall into chunks by hash and are permuted within their chunk.  A matrix of
counts says how many rows each chunk sends to each cell (a cell is a slice of a
shard, small enough for one task); it is drawn from the multivariate
hypergeometric law with both margins fixed, by splitting the range of chunks in
halves, so every task draws the row of its own chunk from a seed alone.  There
are no more chunks, and about no more cells, than CHUNKS; beyond that they grow,
so that the matrix does not.  Rows
are exchanged to their cells and permuted again.  The outcome is a uniform
shuffle whose shard sizes are exact: counts differ by one at most (law `rows`).

Defined results: a null text has size 1 and the crc of the empty text; repeated
rows are rows like any other; an empty table gives an empty result.  Every
column is kept beside the added ones, whose names are parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import cut, table, unused

SHARDS = 8
#: Rows that one chunk or cell holds on average, until there are CHUNKS of them.
CHUNK_ROWS = 8192
CHUNKS = 4096
#: numpy draws exactly below this; above, see _one().
NUMPY_LIMIT = 1_000_000_000


def cell_sizes(rows: int, shards: int, chunk_rows: int) -> tuple[np.ndarray, int]:
    """Rows of each cell, and cells to a shard: shards differ by a row at most, as do a shard's cells."""
    per = max(1, -(-rows // (shards * chunk_rows)))
    shard = np.full(shards, rows // shards, np.int64)
    shard[: rows % shards] += 1
    cells = np.repeat(shard // per, per).reshape(shards, per)
    for s in range(shards):
        cells[s, : shard[s] % per] += 1
    return cells.ravel(), per


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Counts of a draw of n rows without replacement from cells with `left` rows."""
    total = int(left.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(left, n, method="marginals").astype(np.int64)
    out = np.zeros_like(left)
    for k, have in enumerate(left.tolist()):
        total -= have
        out[k] = n if total == 0 else _one(rng, have, total, n)
        n -= int(out[k])
    return out


def _one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Rows among `good` in a draw of n from good + bad, at any size.

    Beyond numpy's limit the law is inverted: its logarithm is summed up from
    the ratios of neighbouring values over 12 standard deviations around the
    mode, outside of which lies less than the rounding of a double.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high or good + bad < NUMPY_LIMIT:
        return int(low if low == high else rng.hypergeometric(good, bad, n))
    share = n / (good + bad)
    mode, sd = int((n + 1) * ((good + 1) / (good + bad + 2))), np.sqrt(good * share * (1 - share) * (bad / (good + bad))) + 1
    k = np.arange(max(low, mode - int(12 * sd) - 8), min(high, mode + int(12 * sd) + 8) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((n - k[:-1]) / (bad - n + k[:-1] + 1))
    law = np.concatenate([[0.0], np.cumsum(step)])
    law = np.cumsum(np.exp(law - law.max()))
    return int(k[np.searchsorted(law, rng.random() * law[-1], side="right")])


def matrix_row(chunk: int, counts: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Rows that `chunk` sends to each cell: at each halving, the left half's draw from what its range holds."""
    lo, hi, have = 0, len(counts), cells
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), have, int(counts[lo:mid].sum()))
        lo, hi, have = (lo, mid, left) if chunk < mid else (mid, hi, have - left)
    return have


def shard(
    df: DataFrame, shards: int = SHARDS, seed: int = 11, chunk_rows: int = CHUNK_ROWS,
    out: tuple[str, str] = ("shard", "slot"), key: list[str] | None = None,
) -> DataFrame:
    """df with a shard (0 .. shards-1) and a slot within it (gapless from 0).

    `key`: columns whose hash orders the rows (all by default); rows that agree
    in them are told apart by their place in the input.  `out`: names of the two
    columns; where df has one of that name already, underscores go before the new one.
    """
    spark = df.sparkSession
    out = tuple(unused(df, n) for n in out)
    names = list(df.columns)
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    keys = [f"c{names.index(k)}" for k in (key or names)]
    hashed = flat.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).withColumn("_tie", F.monotonically_increasing_id())
    hashed = cut(hashed)
    slim = hashed.select("_h", "_tie")
    rows = slim.count()
    chunk_rows = max(chunk_rows, -(-rows // CHUNKS))
    n_chunks = max(1, -(-rows // chunk_rows))
    slim = slim.withColumn("_chunk", F.pmod(F.xxhash64("_h", "_tie"), F.lit(n_chunks)).cast("int"))
    counts = np.zeros(n_chunks, np.int64)
    for r in slim.groupBy("_chunk").count().toLocalIterator():  # CHUNKS numbers at most
        counts[r["_chunk"]] = r["count"]
    cells, per = cell_sizes(rows, shards, chunk_rows)
    shared = spark.sparkContext.broadcast((counts, cells))
    first = np.concatenate([[0], np.cumsum(cells)[:-1]]).reshape(shards, per)
    start = spark.createDataFrame(pd.DataFrame({"_cell": np.arange(len(cells)), "_start": (first - first[:, :1]).ravel()}))
    local = slim.withColumn("_pos", F.row_number().over(W.partitionBy("_chunk").orderBy(F.xxhash64(F.lit(seed), "_h", "_tie"), "_tie")) - 1)

    def to_cells(batches):
        counts, cells = shared.value
        chunk, upto = None, None
        for pdf in batches:
            cell = np.empty(len(pdf), np.int32)
            chunks = pdf["_chunk"].to_numpy()
            for c in np.unique(chunks):
                if c != chunk:
                    chunk, upto = c, np.cumsum(matrix_row(int(c), counts, cells, seed))
                at = chunks == c
                cell[at] = np.searchsorted(upto, pdf["_pos"].to_numpy()[at], side="right")
            yield pdf[["_h", "_tie"]].assign(_cell=cell)

    # row numbers alone are permuted and exchanged; the rows follow in one join
    dealt = local.mapInPandas(to_cells, "_h long, _tie long, _cell int")
    again = W.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 1), "_h", "_tie"), "_tie")
    placed = dealt.withColumn("_pos", F.row_number().over(again) - 1).join(start, "_cell").select(
        "_tie", F.floor(F.col("_cell") / per).cast("int").alias(out[0]), (F.col("_start") + F.col("_pos")).cast("long").alias(out[1])
    )
    return hashed.join(placed, "_tie").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *out)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(slim).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
