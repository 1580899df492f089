"""Text views: python -m usagelake.cli PLACE [--models | --carbon | --sources | --json | --report] [--days N].

PLACE holds a folder for each source, named after it.
"""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text
from .functions.expr import DAY_MS
from .operators import budget, carbon, document, limits, provenance, report, rollup
from .sources.collect import REGISTRY, collect


def view(spark: SparkSession, events: DataFrame, quota: DataFrame, status: DataFrame, now: int, days: int, kind: str, monthly: float) -> DataFrame:
    """The rows that one view shows."""
    start = now - days * DAY_MS
    kept = rollup.period(provenance.dedupe(events), start, now)
    if kind == "sources":
        found = events.groupBy("source").agg(F.count("*").alias("indexed"), F.count_if(F.col("ts_ms").between(start, now)).alias("in_range"))
        return status.join(found, "source", "left").orderBy("ord").select("source", "label", "available", "error", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("in_range", F.lit(0)).alias("in_range"))
    if kind == "models":
        return report.model_rows(events, start, now).select("label", "tok_total", "requests", report.money("cost").alias("cost"))
    if kind == "carbon":
        return carbon.grid_sensitivity(kept)
    if kind == "json":
        return document.snapshot(events, quota, start, now, monthly, status)
    if kind == "report":
        return report.carbon_report(events, start, now)
    return overview(events, quota, now, days, monthly)


def bar(percent: Column, width: int = 24) -> Column:
    full = F.least(F.lit(width), F.greatest(F.lit(0), F.round(percent / 100 * width).cast("int")))
    return F.when(percent.isNull(), F.repeat(F.lit("·"), F.lit(width))).otherwise(F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full)))


def overview(events: DataFrame, quota: DataFrame, now: int, days: int, monthly: float) -> DataFrame:
    """`line`: gauges with what is left of them, totals with their footprint, the month's budget, what was billed against what was measured."""
    start = now - days * DAY_MS
    folded = document.fold(events, start, now)
    kept = folded.filter("NOT covered")
    gauges = limits.project(*limits.readings(events, quota, now), now)
    percent = F.when(F.col("percent").isNull(), "   —").otherwise(F.concat(F.when(F.col("approximate"), "≈").otherwise(" "), F.lpad(F.round("percent").cast("int").cast("string"), 3, " "), F.lit("%")))
    left = text.until(F.col("resets_at") - now)
    note = F.when(left.isNotNull(), F.concat(F.lit("resets in "), left)).otherwise(F.coalesce("limit_source", F.lit("no limit known")))
    full = F.when(F.col("before_reset"), F.concat(F.lit("  full in "), F.coalesce(text.until(F.col("at") - now), F.lit("under a minute")), F.when(F.col("throttled"), " (held back by the session)").otherwise("")))
    name = F.concat(F.col("provider"), F.lit(" "), limits.window_label(F.col("window_hours")))
    rows = [gauges.select(F.lit(1).alias("part"), F.row_number().over(W.orderBy("provider", "window_hours", "gauge_id")).alias("n"),  # a row for each gauge
                          F.concat_ws(" ", F.rpad(name, 24, " "), bar(F.col("percent")), percent, F.concat(note, F.coalesce(full, F.lit("")))).alias("line"))]
    sums = document.summed(document.priced(folded, start, now).filter("dim = 'model' AND now"))
    cost = F.when(F.col("cost_unknown") & (F.col("cost") == 0), None).otherwise(F.col("cost"))
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows.append(sums.select(F.lit(2).alias("part"), F.lit(1).alias("n"), F.concat_ws("   ", F.lit(f"{days} days"), F.concat(text.tokens(at("tok_total")), F.lit(" tokens")), text.dollars(cost), F.concat(text.grams(at("g_mid")), F.lit(" CO2e"))).alias("line")))
    saved = F.greatest(F.lit(0.0), F.col("bare_cost") - F.col("cost"))
    rows.append(sums.select(F.lit(2).alias("part"), F.lit(2).alias("n"), F.concat_ws("   ", F.concat(text.number(at("requests")), F.lit(" requests")), F.concat(text.dollars(saved), F.lit(" saved by the cache")), F.concat(text.grams(at("g_min")), F.lit(" – "), text.grams(at("g_max"))), text.energy(at("wh_mid")), text.water(at("l_mid"))).alias("line")))
    spent = budget.status_of(kept, folded.agg(F.min("oldest").alias("oldest")), monthly, now)
    ahead = F.when(F.col("projected_usd").isNotNull(), F.concat(F.lit("  projected "), text.dollars(F.col("projected_usd"))))
    rows.append(spent.select(F.lit(3).alias("part"), F.lit(1).alias("n"), F.concat(F.lit("budget "), text.dollars(F.col("spent_usd")), F.lit(" / "), text.dollars(F.col("limit_usd")), F.lit("  "), F.round("percent").cast("int").cast("string"), F.lit("%"), F.coalesce(ahead, F.lit(""))).alias("line")))
    billed = provenance.reconciliation(folded, start, now)
    rows.append(billed.select(F.lit(4).alias("part"), F.row_number().over(W.orderBy("fam")).alias("n"), F.concat(F.col("fam"), F.lit(": measured "), text.tokens(F.col("local")), F.lit(", billed "), text.tokens(F.col("billed")), F.lit(" ("), F.format_string("%+.1f", "delta_pct"), F.lit("%) on "), F.col("days").cast("string"), F.lit(" days")).alias("line")))  # a row for each family
    return reduce(DataFrame.unionByName, rows).orderBy("part", "n").select("line")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("place")
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--budget", type=float, default=100.0)
    for kind in ("models", "carbon", "sources", "json", "report"):
        p.add_argument(f"--{kind}", dest="kind", action="store_const", const=kind)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("usagelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = int(time.time() * 1000)
    places = {s.name: str(Path(a.place, s.name)) for s in REGISTRY if Path(a.place, s.name).exists()}
    events, quota, status = collect(spark, places, now)
    number = {c: F.monotonically_increasing_id() for c in ("seq",)}
    rows = view(spark, events.withColumns(number), quota.withColumns(number), status, now, a.days, a.kind or "totals", a.budget)
    if a.kind in (None, "json", "report"):
        sys.stdout.writelines(f"{r[0]}\n" for r in rows.toLocalIterator())
    else:
        rows.show(100, truncate=False)


if __name__ == "__main__":
    main()
