"""Monthly budget and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import DAY_MS, HOUR_MS
from .provenance import dedupe
from .rollup import resolved

# Fixed values.
PACE_DAYS, MIN_HISTORY_DAYS = 7, 3
DEFAULT_THRESHOLDS = (80.0, 95.0)
TRUSTED = ("live", "live-stale", "provider", "user", "configured")
TRAJECTORY = "trajectory"
# End of fixed values.


def costs_between(events: DataFrame, ranges: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row: cost_X of each range (X, from, to), both ends included, and whether a price is missing in any; one pass over the deduped events."""
    return costs_of(dedupe(events), ranges)


def costs_of(kept: DataFrame, ranges: list[tuple[str, Column, Column]]) -> DataFrame:
    """costs_between() of events that have been deduplicated."""
    inside = {n: F.col("ts_ms").between(a, b) for n, a, b in ranges}
    met = kept.withColumns({f"_in_{n}": c for n, c in inside.items()}).filter(" OR ".join(f"_in_{n}" for n in inside))
    sums = met.groupBy("model", *[f"_in_{n}" for n in inside]).agg(*[F.sum(c).alias(c) for c in expr.TOKENS])
    priced = resolved(sums).withColumn("cost", expr.cost())
    return priced.agg(
        *[F.coalesce(F.sum(F.when(F.col(f"_in_{n}"), F.col("cost"))), F.lit(0.0)).alias(f"cost_{n}") for n in inside],
        F.coalesce(F.bool_or(F.col("cost").isNull()), F.lit(False)).alias("cost_incomplete"),
    )


def month_bounds(now: int, tz: str = "UTC") -> tuple[Column, Column]:
    """First and last instant of the local month of now, in epoch milliseconds."""
    local = expr.local_time(str(now), tz)
    start = F.date_trunc("MONTH", local).cast("timestamp_ntz")
    ms = lambda c: F.expr("0") + F.unix_millis(F.to_utc_timestamp(c.cast("timestamp"), tz))
    return ms(start), ms(F.add_months(start.cast("date"), 1).cast("timestamp_ntz"))


def status(events: DataFrame, limit: float, now: int, tz: str = "UTC") -> DataFrame:
    """One row: spent, percent, projection at the pace of the last days, state."""
    return status_of(dedupe(events), events.agg(F.min("ts_ms").alias("oldest")), limit, now, tz)


def status_of(kept: DataFrame, oldest: DataFrame, limit: float, now: int, tz: str = "UTC") -> DataFrame:
    """status() of deduplicated events, and one row (oldest) of all."""
    spark = kept.sparkSession
    start, end = month_bounds(now, tz)
    bounds = spark.range(1).select(start.alias("month_start"), end.alias("month_end"))
    costs = costs_of(kept, [("month", start, F.lit(now)), ("pace", F.lit(now - PACE_DAYS * DAY_MS), F.lit(now))])
    costs = costs.select(F.col("cost_month").alias("spent"), F.col("cost_pace").alias("recent"), "cost_incomplete")
    row = bounds.join(costs).join(oldest).withColumn("history_days", F.coalesce(F.floor((F.lit(now) - F.col("oldest")) / DAY_MS), F.lit(0)))
    span = F.least(F.greatest(F.col("history_days"), F.lit(MIN_HISTORY_DAYS)), F.lit(PACE_DAYS)).cast("double")
    left = F.greatest(F.col("month_end") - now, F.lit(0)) / float(DAY_MS)
    projected = F.when((F.col("history_days") >= MIN_HISTORY_DAYS) & (F.col("recent") > 0), F.col("spent") + F.col("recent") / span * left)
    row = row.withColumn("projected", projected)
    state = F.when(F.col("spent") >= limit, "over").when(F.col("projected") > limit, "projected-over").otherwise("ok")
    return row.select(
        F.lit(float(limit)).alias("limit_usd"), F.col("spent").alias("spent_usd"), (F.col("spent") / limit * 100).alias("percent"), F.col("projected").alias("projected_usd"),
        (F.col("projected") / limit * 100).alias("projected_percent"), "cost_incomplete", "month_start", "month_end", state.alias("state"),
    )


def thresholds(given) -> list[float]:
    """Valid thresholds in order; the defaults if none is."""
    return sorted(t for t in given if t == t and 0 < t <= 100) or list(DEFAULT_THRESHOLDS)


def text_of(t: float) -> str:
    return str(int(t)) if t == int(t) else str(t)


def window_key() -> Column:
    """A window's identity: its gauge at its reset, or at the hour it starts."""
    return F.when(F.col("resets_at").isNotNull() & (F.col("resets_at") != 0), F.concat_ws("@", "gauge_id", F.col("resets_at").cast("string"))).otherwise(
        F.concat_ws("~", "gauge_id", F.floor(F.col("starts_at") / HOUR_MS).cast("string"))
    )


def alerts(rows: DataFrame, state: DataFrame | None = None, given=DEFAULT_THRESHOLDS, projection: bool = True) -> DataFrame:
    """rows (key, gauge_id, percent, projects) -> with the notices due (threshold texts) and the state that follows.

    A threshold fires once for each key, the highest alone; a trajectory fires
    below the first threshold, once.  state: (key, fired).  Keys that are not in
    rows are forgotten.
    """
    ts = thresholds(given)
    none = F.array().cast("array<string>")
    if state is None:
        df = rows.withColumn("_had", none)
    else:
        df = rows.join(state.select("key", F.col("fired").alias("_had")), "key", "left").withColumn("_had", F.coalesce("_had", none))
    due = F.lit(projection) & ~F.array_contains("_had", TRAJECTORY) & (F.col("percent") < ts[0]) & F.col("projects")
    crossed = F.array_compact(F.array(*[F.when((F.col("percent") >= t) & ~F.array_contains("_had", text_of(t)), F.lit(text_of(t))) for t in ts]))
    df = df.withColumn("_crossed", crossed).withColumn("_due", F.coalesce(due, F.lit(False)))
    notices = F.concat(F.when(F.col("_due"), F.array(F.lit(TRAJECTORY))).otherwise(none), F.when(F.size("_crossed") > 0, F.array(F.element_at("_crossed", -1))).otherwise(none))
    fired = F.array_sort(F.array_distinct(F.concat("_had", F.when(F.col("_due"), F.array(F.lit(TRAJECTORY))).otherwise(none), "_crossed")))
    return df.withColumn("notices", notices).withColumn("fired", fired).drop("_had", "_crossed", "_due")


def gauge_alert_rows(gauges: DataFrame) -> DataFrame:
    """Gauges that alerts may trust: a percentage, not approximate, of a trusted source."""
    trusted = gauges.filter(F.col("percent").isNotNull() & ~F.col("approximate") & F.col("limit_source").isin(*TRUSTED))
    return trusted.select(window_key().alias("key"), "gauge_id", "percent", F.coalesce("before_reset", F.lit(False)).alias("projects"))


def budget_alert_rows(budget: DataFrame) -> DataFrame:
    over = F.coalesce(F.col("projected_usd") > F.col("limit_usd"), F.lit(False))
    return budget.select(F.concat(F.lit("budget@"), F.col("month_start").cast("string")).alias("key"), F.lit("budget").alias("gauge_id"), "percent", over.alias("projects"))
