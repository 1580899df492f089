"""Measured and billed records of the same use: coverage, dedup and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, expr


def with_source(events: DataFrame) -> DataFrame:
    """events with family (fam) and grain of their source; other sources are of unknown family and request grain."""
    s = F.broadcast(dims.sources(events.sparkSession))
    return events.join(s, "source", "left").withColumn("fam", F.coalesce("fam", F.lit("unknown"))).withColumn("grain", F.coalesce("grain", F.lit("request")))


def local_coverage(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """(fam, day) that request-grain records cover."""
    return with_source(events).filter("grain = 'request'").select("fam", expr.day_key("ts_ms", tz).alias("day")).distinct()


def marked(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """events with `_covered`: whether a daily record's family and day are covered by request records.

    The cover is a row for each family and day: it grows with the calendar, not with the events, and is broadcast.
    """
    known = with_source(events).withColumn("_day", expr.day_key("ts_ms", tz))
    cover = known.filter("grain = 'request'").select("fam", "_day").distinct().withColumn("_seen", F.lit(True))
    known = known.join(F.broadcast(cover), ["fam", "_day"], "left")
    return known.select(*events.columns, ((F.col("grain") == "daily") & F.col("_seen").isNotNull()).alias("_covered"))


def split_families(events: DataFrame, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): daily records whose family and day are covered by request records are dropped."""
    each = marked(events, tz)
    return each.filter("NOT _covered").drop("_covered"), each.filter("_covered").drop("_covered")


def dedupe(events: DataFrame, tz: str = "UTC") -> DataFrame:
    return split_families(events, tz)[0]


def reconciliation_days(events: DataFrame, start: int, end: int, tz: str = "UTC") -> DataFrame:
    """(fam, day, local, billed) where both sides are positive; on records before any dedup."""
    known = with_source(events).filter(F.col("ts_ms").between(start, end)).withColumn("day", expr.day_key("ts_ms", tz))
    both = known.filter("fam <> 'unknown'").groupBy("fam", "day").agg(
        F.sum(F.when(F.col("grain") == "request", F.col("tok_total")).otherwise(0)).alias("local"),
        F.sum(F.when(F.col("grain") == "daily", F.col("tok_total")).otherwise(0)).alias("billed"),
    )
    return both.filter("local > 0 AND billed > 0")


def reconciliation(events: DataFrame, start: int, end: int, tz: str = "UTC") -> DataFrame:
    return reconciliation_days(events, start, end, tz).groupBy("fam").agg(
        F.count("*").alias("days"), F.sum("local").alias("local"), F.sum("billed").alias("billed")
    ).withColumn("delta_pct", F.when(F.col("local") > 0, (F.col("billed") - F.col("local")) / F.col("local") * 100))
