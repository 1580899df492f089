"""Running sums and last values along long sequences, piece by piece, and tables of a checked size.

A sequence (a file's lines, a family's hours) may be longer than one task should sort.  It is cut into pieces: each piece
is folded to one row, the folds run over the few pieces, and what comes before a piece is added within it.  Rows are
shuffled once, by sequence and piece, and a piece is the most that one task sorts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are broadcast at most, after they have been counted.
BROADCAST_ROWS = 100_000


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="usagelake-")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows by count; else unchanged, so that Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settled(df: DataFrame, rows: int = 10_000) -> tuple[DataFrame, bool]:
    """(df computed once, whether it is small): as literal rows if it has at most `rows`, so that plans built on it stay short; else written."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return written(df), False
    return df.sparkSession.createDataFrame(found, df.schema), True


def walked(rows: DataFrame, by: str, order: list[str], state: Callable[[], Any], step: Callable[..., tuple], given: list[str], added: str) -> DataFrame:
    """rows with the columns `added` (DDL), which step(state, *values of `given`) gives for each row in turn; each sequence begins with a state().

    For what only a loop can say.  A sequence is one walk by its nature: sequences are dealt over the tasks and sorted by
    Spark, and a task holds one state and a batch of rows, never a sequence.  step changes the state in place.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(added).fields])
    names = StructType.fromDDL(added).fieldNames()
    kinds = to_arrow_schema(StructType.fromDDL(added))

    def walk(batches):
        at, now = None, None
        for batch in batches:
            out = []
            for where, *values in zip(*[batch.column(c).to_pylist() for c in (by, *given)], strict=True):
                if now is None or where != at:
                    at, now = where, state()
                out.append(step(now, *values))
            columns = [pa.array([r[i] for r in out], kinds.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(walk, schema)


def running(rows: DataFrame, by: list[str], piece: Column, order: list[str], sums: tuple[str, ...] = (), lasts: tuple[str, ...] = ()) -> DataFrame:
    """rows with `sums` as sums up to and with each row, and `lasts` as the last value that is not null up to it, in the sequence `by`.

    piece: grows with the order; the rows of one sequence and piece are sorted in one task.  `by` holds no nulls.
    """
    cut = rows.withColumn("_piece", piece)
    at = F.struct(*order)
    folds = [F.sum(c).alias(f"_{c}") for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in lasts]
    earlier = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = cut.groupBy(*by, "_piece").agg(*folds).select(
        *by, "_piece", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums], *[F.last(f"_{c}", ignorenulls=True).over(earlier).alias(f"_{c}") for c in lasts],
    )
    inside = W.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = cut.join(before, [*by, "_piece"])
    values = {c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums} | {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_{c}")) for c in lasts}
    return found.select(*[values.get(c, F.col(c)).alias(c) for c in rows.columns])
