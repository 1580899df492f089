"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of each source are shuffled by hash and laid end to end as a line
of words that is run through at most twice; the line is dealt out in blocks of
equal size.  Golden-ratio points, mapped through the cumulative targets, say
which source fills each slot; a slot's rank within its source says which of the
source's blocks it takes.  Each source fills exactly the blocks of its target;
slots beyond that are dropped, missing ones follow at the end.

Defined results: a null text has no words; null is a source of its own, last in
order; documents without words take nothing and give nothing; an empty table
gives an empty mix.  Rows that agree in id, source and size are
interchangeable.  Rows with a null or often repeated id are ordered in tasks of
bounded size like any others; which of them a mix takes may then depend on how
the input is partitioned.  Every column of the documents is kept; added names are
parameters or start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import cut, n_words, sized, spread_join, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Blocks that the whole corpus is dealt into at least, and words of the largest block.
BLOCKS = 20_000
MAX_BLOCK = 4096
#: Rows or slots that one task orders at a time.
ORDER_ROWS = 8_192
#: round(2**31 / golden ratio), made odd: multiples of it, modulo 2**31, are the golden-ratio points.
GOLDEN = 1_327_217_885
POINTS = 1 << 31


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = PASSES) -> DataFrame:
    """(source, source_size) -> with source_no (from 0) and target.

    Water filling: a source whose cap is below its weight's part of what is left
    takes its cap; the others share the rest by weight.  One row a source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    part = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    filled = W.orderBy("_ratio", "source_no")
    before, rest = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    numbered = sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("_w", part)
    level = numbered.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = level.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    open_ = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(W.partitionBy())
    return level.withColumn(
        "target", F.when(F.col("_ratio") > F.coalesce(open_, F.lit(float("inf"))), F.col("_w") * open_).otherwise(F.col("_cap"))
    ).select("source", "source_size", "source_no", "target")


def _running(df: DataFrame, group: str, bucket: Column, value: Column, order: list[Column], out: str) -> DataFrame:
    """Sum of `value` over the rows of `group` that come before each row, by bucket and then order.

    Two levels keep a hot group apart: sums of buckets first, then rows within a bucket.
    """
    df = df.withColumn("_bucket", bucket)
    ahead = df.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_sum").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(ahead.select(group, "_bucket", "_ahead"), [group, "_bucket"]).withColumn(out, F.col(out) + F.col("_ahead")).drop("_ahead", "_bucket")


def order_buckets(base: DataFrame, buckets: int, seed: int) -> DataFrame:
    """base with `_bucket`, by its id; a source's bucket that an id repeated many times has filled is split by row."""
    base = base.withColumn("_whole", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)))
    full = base.groupBy("source_no", "_whole").agg(F.count("*").alias("_n")).filter(F.col("_n") > 4 * ORDER_ROWS)
    full = cut(full.select("source_no", "_whole", F.ceil(F.col("_n") / ORDER_ROWS).alias("_splits")))
    part = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_splits")), F.lit(0))
    split = base.join(sized(full), ["source_no", "_whole"], "left").withColumn("_bucket", F.struct(F.col("_whole"), part.alias("_part")))
    return split.drop("_whole", "_splits")


def schedule(spark: SparkSession, sources: DataFrame, slots: int, block: int, seed: int) -> DataFrame:
    """(slot, source_no, rank): which block of which source fills each slot.

    `sources` holds source_no, target and quota (blocks); `slots` is the sum of quotas.
    """
    order = W.orderBy("source_no")
    whole = F.sum("target").over(W.partitionBy())
    spans = sources.filter("quota > 0").select(
        "source_no", "quota",
        (F.coalesce(F.sum("target").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / whole).alias("_from"),
        (F.sum("target").over(order) / whole).alias("_to"),
        F.lead("source_no").over(order).isNull().alias("_last"),
    )
    # sources are looked up by the part of [0, 1) that a point falls in, so that the join has a key
    parts = 1024
    keyed = spans.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_from") * parts), F.least(F.floor(F.col("_to") * parts), F.lit(parts - 1)))))
    point = ((F.col("id") % POINTS) * GOLDEN + seed % POINTS) % POINTS / F.lit(float(POINTS))
    drawn = spark.range(slots).withColumn("_point", point).withColumn("_part", F.floor(F.col("_point") * parts))
    drawn = drawn.join(sized(keyed), "_part").filter((F.col("_point") >= F.col("_from")) & ((F.col("_point") < F.col("_to")) | F.col("_last")))
    ranked = _running(drawn.select(F.col("id").alias("slot"), "source_no"), "source_no", F.floor(F.col("slot") / ORDER_ROWS), F.lit(1), [F.col("slot")], "rank")
    ranked = cut(ranked)
    had = ranked.groupBy("source_no").agg(F.count("*").alias("_had"))
    short = spans.join(had, "source_no", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).filter("_had < quota")
    more = short.select((F.lit(slots) + F.monotonically_increasing_id()).alias("slot"), "source_no", F.explode(F.sequence("_had", F.col("quota") - 1)).alias("rank"))
    kept = ranked.join(sized(spans.select("source_no", "quota")), "source_no").filter("rank < quota").select("slot", "source_no", "rank")
    return kept.unionByName(more)


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 17,
    size: str = "size", doc_id: str = "doc_id", source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of a mix of docs, which hold the number of words in `size`.

    rows: doc_id, source, size, source_no, source_size, target and a row key `_row`;
    pieces: slot, `_row`, pass, and first and n words that the slot takes of the row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(size).cast("long").alias("size"))
    base = cut(base.withColumn("_row", F.monotonically_increasing_id()))
    sources = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
    total, n_sources = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    rows = base.count()
    block = max(1, min(MAX_BLOCK, total // BLOCKS))
    quota = F.ceil(F.floor("target") / F.lit(block))
    sources = sources.withColumn("quota", quota)
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    keys = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    keys = F.broadcast(keys) if n_sources <= 100_000 else keys
    base = base.join(keys, base["source"].eqNullSafe(keys["_source"])).drop("_source")
    buckets = max(1, -(-rows // ORDER_ROWS))
    place = F.xxhash64(F.lit(seed), "doc_id", "size")
    laid = _running(
        order_buckets(base, buckets, seed + 1), "source_no", F.col("_bucket"), F.col("size"),
        [place, F.col("doc_id"), F.col("size"), F.col("_row")], "_at",
    ).filter("size > 0")
    once = laid.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(PASSES)]))).withColumn("_at", F.col("_at") + F.col("pass") * F.col("source_size"))
    once = once.withColumn("_end", F.least(F.col("_at") + F.col("size"), F.floor("target"))).filter("_at < _end")
    pieces = once.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_end") - 1) / block))))
    begin = F.greatest(F.col("_at"), F.col("rank") * block)
    pieces = pieces.select(
        "source_no", "rank", "_row", "pass", (begin - F.col("_at")).alias("first"),
        (F.least(F.col("_end"), (F.col("rank") + 1) * block) - begin).alias("n"),
    )
    slots_df = schedule(spark, sources, slots, block, seed)
    return base, pieces.join(slots_df, ["source_no", "rank"]).select("slot", "_row", "pass", "first", "n")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows, pieces = mix(docs)
    taken = pieces.groupBy("_row").agg(F.sum("n").alias("taken"))
    return rows.join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def taken_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 17, text: str = "text", source: str = "source") -> DataFrame:
    """The documents of a mix, each as often as it is taken, to the nearest whole number.

    A document is taken in part only where its source's target ends.  Rows that
    agree in all columns share what they take.
    """
    names = list(docs.columns)
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = lambda n: F.col(f"c{names.index(n)}")
    flat = cut(flat.withColumn("_size", n_words(own(text))).withColumn("_id", F.xxhash64(*flat.columns)))
    slim = flat.select(F.col("_id").alias("doc_id"), own(source).alias("source"), F.col("_size").alias("size"))
    rows, pieces = mix(slim, weights, share, seed)
    taken = rows.join(pieces.groupBy("_row").agg(F.sum("n").alias("taken")), "_row", "left").groupBy(F.col("doc_id").alias("_id")).agg(
        F.try_divide(F.sum(F.coalesce("taken", F.lit(0))), F.sum("size")).alias("_share"), F.count("*").alias("_rows")
    ).filter("_share > 0")
    many = spread_join(flat, cut(taken), ["_id"], count="_rows")
    copies = F.floor(F.col("_share") + 0.5).cast("int")
    many = many.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return many.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
