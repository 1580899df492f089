"""Documents made of small results: summary, snapshot, Markdown report, text views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims, expr, factors
from . import carbon, provenance, rollup

#: Everyday equivalents that a view shows.
SHOWN = 4


def default_period(events: DataFrame, now: int, days: int | None = 30, whole: bool = False) -> DataFrame:
    """(from_ms, to_ms): the last days, or everything since the oldest event."""
    if not whole:
        return events.sparkSession.range(1).select(F.lit(now - (days or 30) * expr.DAY_MS).alias("from_ms"), F.lit(now).alias("to_ms"))
    return events.agg(F.coalesce(F.min("ts_ms"), F.lit(now - 30 * expr.DAY_MS)).alias("from_ms"), F.lit(now).alias("to_ms"))


def label(model_id: str = "model_id") -> Column:
    names = F.create_map(*[F.lit(x) for pair in dims.LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.col(model_id)), F.col(model_id))


def labelled(models: DataFrame) -> DataFrame:
    """models (model, model_id, ...) with `label`; models that share one have their raw name added. A row for each model."""
    named = models.withColumn("label", label())
    shared = F.count("*").over(W.partitionBy("label")) > 1
    return named.withColumn("label", F.when(shared, F.concat("label", F.lit(" ("), "model", F.lit(")"))).otherwise(F.col("label")))


def model_rows(events: DataFrame, start: int, end: int) -> DataFrame:
    """Labelled models of a period, by falling tokens."""
    kept = rollup.period(provenance.dedupe(events), start, end)
    return labelled(rollup.slices(kept, F.lit(1))).orderBy(F.desc("tok_total"), "first_seq")


def money(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("–")).otherwise(F.format_string("$%.2f", c))


def table_lines(df: DataFrame, part: int, title: str, cells: dict[str, Column]) -> DataFrame:
    """(part, n, line): a Markdown table of the rows of df, in their order."""
    spark = df.sparkSession
    head = spark.createDataFrame([
        (part, -3, f"## {title}"), (part, -2, f"| {' | '.join(cells)} |"), (part, -1, f"|{' --- |' * len(cells)}")], "part int, n long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("–")), F.lit("|"), F.lit("\\|")) for c in cells.values()]), F.lit(" |"))
    return head.unionByName(df.select(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("n"), line.alias("line")))


def carbon_report(events: DataFrame, start: int, now: int, grid: str | None = None) -> DataFrame:
    """`line`: the footprint of a period as Markdown: totals, models, mixes, levers, equivalents, factors and citations."""
    spark = events.sparkSession
    kept = rollup.period(provenance.dedupe(events), start, now)
    t = rollup.totals(kept, grid=grid)
    grams = lambda c: F.format_string("%.1f", c)
    foot = {"low": grams("g_min"), "middle": grams("g_mid"), "high": grams("g_max")}
    parts = [
        spark.createDataFrame([(0, 0, "# Footprint")], "part int, n long, line string"),
        table_lines(t, 1, "Total (g CO2e)", {"tokens": F.col("tok_total"), **foot, "energy (Wh)": grams("wh_mid"), "water (L)": grams("l_mid")}),
        table_lines(labelled(rollup.slices(kept, F.lit(1), grid=grid)).orderBy(F.desc("tok_total"), "first_seq"), 2, "Models", {"model": F.col("label"), "tokens": F.col("tok_total"), **foot, "cost": money("cost")}),
        table_lines(carbon.grid_sensitivity(kept, grid), 3, "Electricity mixes", {"mix": F.col("grid"), **foot, "ratio": F.format_string("%.2f", "ratio")}),
        table_lines(carbon.uncertainty(kept, grid).orderBy(F.desc("ratio")), 4, "Uncertainty", {"lever": F.col("lever"), "ratio": F.format_string("x%.1f", "ratio")}),
        table_lines(carbon.equivalents(t).limit(SHOWN), 5, "Equivalents", {"item": F.col("item"), "units": F.format_string("%.2f", "units")}),
        table_lines(factors.factor_table(spark, grid), 6, "Factors", {c: F.col(c) for c in ("group", "key", "value", "unit", "citation")}),
        table_lines(factors.unpinned_sources(spark), 7, "Sources to be pinned", {"source": F.col("source"), "citation": F.col("citation")}),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.orderBy("part", "n").select("line")
