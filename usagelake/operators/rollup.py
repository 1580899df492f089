"""Priced rollups of usage events.

Tokens are summed at (key, raw model) first, priced and estimated there, and only
then summed over models: medians of footprints do not add up over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, expr
from .scan import written

NO_PROJECT = "sans projet"


def resolved(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """df with what is known of its raw `model` names: id, family, provider, prices, parameters and infrastructure; null but for prices never.

    The patterns are tried in order as one conditional expression, so df is
    neither joined nor read again.  An override (model, family, provider, p_in,
    p_out) replaces the registry's entry as a whole.
    """
    # the place of the first pattern that fits, then that place's entry of a constant array
    low, raw, place = F.lower("model"), F.col("model"), F.when(F.col("model") == dims.SYNTHETIC, len(dims.MODELS))
    for i, (pattern, *_) in enumerate(dims.MODELS):
        place = place.when(F.rlike(low, F.lit(pattern)), i)
    df = df.withColumn("_place", place)
    entries = [*[m[1:] for m in dims.MODELS], (dims.SYNTHETIC, "synthetic", "unknown", 0.0, 0.0, None)]
    names = ("model_id", "family", "provider", "p_in", "p_out", "context")
    entry = lambda *v: F.struct(*[F.lit(x).cast(t).alias(n) for x, n, t in zip(v, names, ("string",) * 3 + ("double",) * 2 + ("long",), strict=True)])
    known = F.get(F.array(*[entry(*e) for e in entries]), F.col("_place"))
    other = F.struct(F.when(raw == "", "unknown").otherwise(raw).alias("model_id"), *[F.lit(x).cast(t).alias(n) for x, n, t in zip(("unknown", "unknown", None, None, None), names[1:], ("string", "string", "double", "double", "long"), strict=True)])
    found = F.coalesce(known, other)
    if overrides is not None:
        other = overrides.select("model", F.struct(
            F.col("model").alias("model_id"), F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("provider", F.lit("unknown")).alias("provider"),
            F.col("p_in").cast("double").alias("p_in"), F.col("p_out").cast("double").alias("p_out"), F.lit(None).cast("long").alias("context"),
        ).alias("_o"))
        df, found = df.join(other, "model", "left"), F.coalesce("_o", found)
    df = df.withColumn("_m", found).select(*[c for c in df.columns if c not in ("_o", "_place")], "_m.*")
    pick = lambda table, key: F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.struct(*[F.lit(y) for y in v]))]), F.col(key)))
    size, infra = pick({**dims.FAMILIES, "synthetic": (0.0,) * 4}, "family"), pick({k: (*v, dims.GRIDS[v[4]]) for k, v in dims.INFRA.items()}, "provider")
    df = df.withColumns({"_size": size, "_infra": infra})
    names = ("pue_lo", "pue_hi", "wue_lo", "wue_hi", "own_grid", "mem", "own_grid_g")
    return df.select(
        *[c for c in df.columns if c not in ("_size", "_infra")], *[F.col(f"_infra.col{i + 1}").alias(n) for i, n in enumerate(names)],
        *[F.col(f"_size.col{i + 1}").alias(n) for i, n in enumerate(("pt_lo", "pt_hi", "pa_lo", "pa_hi"))],
    )


def resolve_models(models: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The distinct raw `model` names, resolved."""
    return resolved(models.select("model").distinct(), overrides)


def token_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in expr.TOKENS] + [F.sum(expr.requests()).alias("requests")]


def slices(events: DataFrame, *keys: Column, grid: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One priced row for each (keys, raw model): tokens, cost (null if unknown), footprint, seq of the first event."""
    names = [f"key{i}" for i in range(len(keys))]
    keyed = events.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    sums = keyed.groupBy(*names, "model").agg(*token_sums(), F.count("*").alias("events"), F.min("seq").alias("first_seq"))
    return priced(sums, grid, overrides)


def priced(sums: DataFrame, grid: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Token sums by raw model (model, ...) with what is known of the model, costs and footprints."""
    known = resolved(sums, overrides)
    mix = F.col("own_grid_g") if grid is None else F.lit(dims.GRIDS.get(grid, dims.GRIDS["us-average"]))
    return known.withColumn("grid_g", mix).withColumns({"cost": expr.cost(), "bare_cost": expr.cost_without_cache(), **expr.footprint()})


MEASURES = ("g_min", "g_mid", "g_max", "wh_min", "wh_mid", "wh_max", "l_min", "l_mid", "l_max")


def rollup(events: DataFrame, *keys: Column, **how) -> DataFrame:
    """One row for each key: sums over its models; cost_unknown if a model has no price; models[] by tokens."""
    names = [f"key{i}" for i in range(len(keys))]
    s = slices(events, *keys, **how)
    part = F.struct((-F.col("tok_total")).alias("order"), F.col("first_seq"), "model", "model_id", "tok_total", "cost", "g_mid")
    return s.groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in (*expr.TOKENS, "requests", "events")],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("bare_cost"), F.lit(0.0)).alias("bare_cost"),
        F.bool_or(F.col("cost").isNull()).alias("cost_unknown"), F.min("first_seq").alias("first_seq"),
        *[F.sum(c).alias(c) for c in MEASURES], F.array_sort(F.collect_list(part)).alias("models"),
    )


def project() -> Column:
    return F.coalesce(F.col("project"), F.lit(NO_PROJECT))


def period(events: DataFrame, start: int, end: int) -> DataFrame:
    return events.filter(F.col("ts_ms").between(start, end))


def previous(events: DataFrame, start: int, end: int) -> DataFrame:
    return events.filter((F.col("ts_ms") >= 2 * start - end) & (F.col("ts_ms") < start))


def change(now: Column, before: Column) -> Column:
    """Percent change; null without a positive value before."""
    return F.when(before > 0, (now - before) / before * 100)


def versus_previous(events: DataFrame, start: int, *keys: Column) -> DataFrame:
    """Groups since `start` beside the same groups before it: change of tokens and cost in percent, and whether the change is worth showing.

    events: both periods.  A cost that is unknown on either side is not compared.
    One pass: groups are summed with their period, which is then folded.
    """
    names = [f"key{i}" for i in range(len(keys))]
    g = rollup(events, *keys, F.col("ts_ms") >= start).withColumnRenamed(f"key{len(keys)}", "_now")
    side = lambda c, now: F.max(F.when(F.col("_now") == now, F.col(c)))
    g = g.groupBy(*names).agg(*[side(c, now).alias(n) for c, now, n in (
        ("tok_total", True, "tok_total"), ("tok_total", False, "before"), ("cost", True, "_cost"), ("cost", False, "_cost0"), ("cost_unknown", True, "_u"), ("cost_unknown", False, "_u0"),
    )]).filter("tok_total IS NOT NULL")
    g = written(g)
    whole = g.agg(F.sum("tok_total")).first()[0] or 0
    level = F.when(F.col("before").isNull(), "new").when(F.col("before") > max(1000.0, 0.02 * whole), "shown").otherwise("small")
    return g.select(
        *names, "tok_total", "before", change(F.col("tok_total"), F.col("before")).alias("change_pct"),
        F.when(~F.col("_u") & ~F.col("_u0"), change(F.col("_cost"), F.col("_cost0"))).alias("cost_change_pct"), level.alias("significance"),
    )


def totals(events: DataFrame, **how) -> DataFrame:
    """One row over all models: tokens, cost, savings of the cache, hit ratio, footprint."""
    t = rollup(events, F.lit(1), **how).drop("key0", "models", "first_seq")
    seen = F.col("tok_cache_read") + F.col("tok_cache_write") + F.col("tok_input")
    return t.withColumn("cache_savings", F.greatest(F.lit(0.0), F.col("bare_cost") - F.col("cost"))).withColumn(
        "hit_ratio", F.when(seen > 0, F.col("tok_cache_read") / seen).otherwise(0.0)
    )


def daily_series(events: DataFrame, start: int, end: int, tz: str = "UTC", **how) -> DataFrame:
    """One row for each local day of the period, zero where nothing happened."""
    spark = events.sparkSession
    edge = spark.range(1).select(F.lit(start).alias("a"), F.lit(end).alias("b"))
    days = edge.select(F.explode(F.sequence(F.to_date(expr.local_time("a", tz)), F.to_date(expr.local_time("b", tz)))).alias("d"))
    days = days.select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    got = rollup(period(events, start, end), expr.day_key("ts_ms", tz), **how).withColumnRenamed("key0", "day")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tok_total", "requests")] + [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cost", "g_mid")]
    return days.join(got, "day", "left").select("day", *zero, "models")


def hour_profile(events: DataFrame, tz: str = "UTC", **how) -> DataFrame:
    """24 rows: usage by local hour of the day."""
    got = rollup(events, expr.hour_key("ts_ms", tz), **how).withColumnRenamed("key0", "hour")
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(got, "hour", "left").select("hour", F.coalesce("tok_total", F.lit(0)).alias("tok_total"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def cube(events: DataFrame) -> DataFrame:
    """Token sums by model, project, day and hour from one shared scan: four grouping sets over one pre-aggregate."""
    base = events.groupBy("model", project().alias("project"), expr.day_key().alias("day"), expr.hour_key().alias("hour")).agg(
        F.sum("tok_total").alias("tok_total"), F.sum(expr.requests()).alias("requests")
    )
    sets = [[F.col("model")], [F.col("project"), F.col("model")], [F.col("day"), F.col("model")], [F.col("hour"), F.col("model")]]
    return base.groupingSets(sets, "model", "project", "day", "hour").agg(
        F.grouping_id("model", "project", "day", "hour").cast("int").alias("gid"), F.sum("tok_total").alias("tok_total"), F.sum("requests").alias("requests")
    )
