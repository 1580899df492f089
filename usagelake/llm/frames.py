"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast after they have been counted.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a shuffle may bring to a task.
HOT_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset, a folder of its own in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            folder = jsc.getCheckpointDir().get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            folder = tempfile.mkdtemp(prefix="usagelake-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/usagelake/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows by count; unchanged otherwise, so that Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS, hot: int = HOT_ROWS, outer: bool = False, count: str = "n") -> DataFrame:
    """Inner join, or left join; right has a row for each key and, in `count`, the number of rows that left has of it.

    right is broadcast if it has few rows by count.  Otherwise the keys of more than `hot` rows are broadcast, of which
    left can hold no more than its rows / hot, and the others are shuffled: no task gets more than `hot` rows of a key.
    """
    how = "left" if outer else "inner"
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), keys, how)
    often = right.filter(F.col(count) > hot)
    # a left row of a hot key meets no other row of right
    others = left.join(F.broadcast(often.select(keys)), keys, "left_anti").join(right.filter(F.col(count) <= hot), keys, how)
    return left.join(F.broadcast(often), keys).unionByName(others)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int = 5) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
