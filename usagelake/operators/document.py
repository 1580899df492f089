"""The whole state of a period as one JSON document, from few passes over the events.

Events are folded once, to hours, sources, models and projects; whatever is older than all that a document shows becomes one row for
each source.  The fold's hours are cut where a period, a month or a pace begins, so every sum below is the sum of the events.  The
fold is priced once, over grouping sets of model, project, day and hour, and every part of the document is a small query on
that.  Parts are texts that one aggregate sets side by side, so an idle period gives a document of zeros, and arrays have a
stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, expr
from . import budget, carbon, limits, provenance, rollup
from .report import label
from .scan import written

#: Rows of the projects' list, and everyday equivalents that a view shows. Fixed values.
PROJECT_ROWS, SHOWN = 10, 4
#: Tokens before, that make a trend worth showing: at least so many, and this share of the period's.
LEAST_BEFORE, LEAST_SHARE = 1000.0, 0.02


def fold(events: DataFrame, start: int, now: int, tz: str = "UTC") -> DataFrame:
    """Events by hour, source, model and project: token sums, requests, `events`, seq and `oldest` (the least), and whether they are `covered` by request records.

    ts_ms: the hour, or the last edge before the event where one falls into its hour.  Events before every edge are one row for each
    source, of no model.  One pass, and one over the calendar for what is covered.
    """
    month, _ = budget.month_bounds(now, tz)
    edges = [F.lit(2 * start - now), F.lit(start), F.lit(now - budget.PACE_DAYS * expr.DAY_MS), month, F.lit(now + 1)]
    first, ts = F.least(*edges), F.col("ts_ms")
    old = ts < first
    hour = ts - F.pmod(ts, F.lit(expr.HOUR_MS))
    at = F.greatest(hour, *[F.when(ts >= e, e) for e in edges])
    rows = provenance.marked(events, tz).select(
        F.when(old, first - 1).otherwise(at).alias("at"), "source", F.when(~old, F.col("model")).alias("model"), F.when(~old, F.col("project")).alias("project"),
        F.col("_covered").alias("covered"), "ts_ms", "seq", "requests", *expr.TOKENS,
    )
    sums = [F.sum(c).alias(c) for c in expr.TOKENS] + [F.sum(expr.requests()).alias("requests"), F.count("*").alias("events"), F.min("seq").alias("seq"), F.min("ts_ms").alias("oldest")]
    return written(rows.groupBy("at", "source", "model", "project", "covered").agg(*sums).withColumnRenamed("at", "ts_ms"))


def priced(folded: DataFrame, start: int, now: int, tz: str = "UTC", grid: str | None = None) -> DataFrame:
    """Priced rows (dim, key, now, model, ...): for each dim, by its key and raw model, in the period and (now: false) in the one before."""
    kept = folded.filter(~F.col("covered") & F.col("ts_ms").between(2 * start - now, now))
    base = kept.withColumns({"now": F.col("ts_ms") >= start, "project": rollup.project(), "day": expr.day_key("ts_ms", tz), "hour": F.format_string("%02d", expr.hour_key("ts_ms", tz))})
    dims_of = ("project", "day", "hour")
    sets = [[F.col("now"), F.col("model")], *[[F.col("now"), F.col(d), F.col("model")] for d in dims_of]]
    sums = base.groupingSets(sets, "now", "model", *dims_of).agg(
        *[F.grouping(d).alias(f"_{d}") for d in dims_of], *rollup.token_sums(), F.sum("events").alias("events"), F.min("seq").alias("first_seq"),
    )
    dim = F.coalesce(*[F.when(F.col(f"_{d}") == 0, d) for d in dims_of], F.lit("model"))
    keyed = sums.withColumns({"dim": dim, "key": F.coalesce(*dims_of, "model")}).drop(*dims_of, *[f"_{d}" for d in dims_of])
    return written(rollup.priced(keyed, grid))


def triple(name: str, wrap=lambda c: c) -> Column:
    return F.struct(*[wrap(F.col(f"{name}_{k}")).alias(k) for k in ("min", "mid", "max")])


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def tokens() -> Column:
    names = {"input": "tok_input", "output": "tok_output", "cacheWrite": "tok_cache_write", "cacheWrite5m": "tok_cw5m", "cacheWrite1h": "tok_cw1h", "cacheRead": "tok_cache_read", "thinking": "tok_thinking", "total": "tok_total"}
    return F.struct(*[zero(F.col(c)).alias(n) for n, c in names.items()])


def footprint() -> Column:
    fill = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(triple("g", fill).alias("gramsCO2e"), triple("wh", fill).alias("energyWh"), triple("l", fill).alias("waterL"))


SUMS = (*expr.TOKENS, "requests", "events", "cost", "bare_cost", *rollup.MEASURES)


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of priced rows; a cost that is unknown counts as none and is told."""
    sums = [F.sum(c).alias(c) for c in SUMS] + [F.coalesce(F.bool_or(F.col("cost").isNull()), F.lit(False)).alias("cost_unknown"), F.min("first_seq").alias("first_seq")]
    part = F.struct((-F.col("tok_total")).alias("a"), F.col("first_seq").alias("b"), F.col("model").alias("id"), label().alias("label"), F.col("tok_total").alias("tokens"), F.col("cost").alias("costUSD"), F.col("g_mid").alias("gramsCO2e"))
    out = rows.groupBy(*keys).agg(*sums, F.array_sort(F.collect_list(part)).alias("models"))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cost", "bare_cost")})


def change(now: str, before: str) -> Column:
    return rollup.change(F.col(now), F.col(before))


def array(rows: DataFrame, name: str, order: list[Column], item: Column, most: int | None = None) -> DataFrame:
    """(name, text): the items as a JSON array in the stated order; `[]` without rows."""
    if most is not None:
        rows = rows.orderBy(*order, F.xxhash64(item)).limit(most)
    keys = [o.alias(f"_{i}") for i, o in enumerate(order)]
    whole = rows.agg(F.array_sort(F.collect_list(F.struct(*keys, item.alias("item")))).alias("a"))
    return whole.select(F.lit(name).alias("name"), F.to_json(F.transform("a", lambda x: x["item"])).alias("text"))


def single(rows: DataFrame, name: str, item: Column) -> DataFrame:
    """(name, text) of one row, or of none: null."""
    return rows.agg(F.max(item).alias("x")).select(F.lit(name).alias("name"), F.coalesce(F.to_json("x"), F.lit("null")).alias("text"))


def joined(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """`value`: the parts as one JSON object, in the order of their names; the part a.b becomes a field of a."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    texts = every.agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("m"))
    def cell(name: str) -> Column:
        text = F.element_at("m", name)
        for inner in [n for n in names if n.startswith(f"{name}.")]:
            text = F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(f',"{inner.split(".")[1]}":'), F.element_at("m", inner), F.lit("}"))
        return F.concat(F.lit(f'"{name}":'), text)

    cells = [cell(n) for n in names if "." not in n]
    return texts.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("value"))


def totals(p: DataFrame) -> DataFrame:
    """(name, text) of the totals and of the trend against the period before."""
    rows = summed(p.filter("dim = 'model'"), "now").withColumn("_c", F.lit(1))
    side = lambda now: F.max(F.when(F.col("now") == now, F.struct(*[c for c in rows.columns if c not in ("_c", "now", "models")])))
    both = rows.agg(side(True).alias("a"), side(False).alias("b"))

    seen = zero(F.col("tok_cache_read") + F.col("tok_cache_write") + F.col("tok_input"))
    money = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = both.select("a.*").select(
        tokens().alias("tokens"), zero(F.col("requests")).alias("requests"), money("cost").alias("costUSD"), F.coalesce("cost_unknown", F.lit(False)).alias("costUnknown"),
        money("bare_cost").alias("costWithoutCacheUSD"), F.greatest(F.lit(0.0), money("bare_cost") - money("cost")).alias("cacheSavingsUSD"),
        F.when(seen > 0, F.col("tok_cache_read") / seen).otherwise(0.0).alias("cacheHitRatio"), footprint().alias("carbon"), zero(F.col("events")).alias("eventCount"),
    )
    before = both.select("b.*").select(F.struct(tokens().alias("tokens"), money("cost").alias("costUSD"), footprint().alias("carbon")).alias("previous"))
    names = {"tokens": "tok_total", "cost": "cost", "carbon": "g_mid"}
    ends = both.select(*[F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in "ab" for n, c in names.items()])
    trend = ends.select(
        *[change(f"a_{n}", f"b_{n}").alias(n) for n in names],
        (zero(F.col("b_tokens")) > F.greatest(F.lit(LEAST_BEFORE), LEAST_SHARE * zero(F.col("a_tokens")))).alias("significant"),
    )
    whole = lambda df, name: df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("text"))
    return whole(total, "totals").unionByName(whole(trend, "trend")).unionByName(before.select(F.lit("trend.previous").alias("name"), F.to_json("previous").alias("text")))


def groups(p: DataFrame, dim: str) -> DataFrame:
    """Rows of a dimension in the period, beside those of the period before."""
    each = summed(p.filter(F.col("dim") == dim), "key", "now")
    then = each.filter("NOT now").select("key", F.col("tok_total").alias("_tokens"), F.col("cost").alias("_cost"), F.col("cost_unknown").alias("_unknown"))
    return each.filter("now").join(then, "key", "left")


def group_item() -> Column:
    before = F.when(F.col("_tokens").isNotNull(), F.struct(change("tok_total", "_tokens").alias("tokens"), F.when(~F.col("cost_unknown") & ~F.col("_unknown"), change("cost", "_cost")).alias("cost")))
    return F.struct(
        F.col("key"), tokens().alias("tokens"), F.col("requests"), F.col("cost").alias("costUSD"), F.col("cost_unknown").alias("costUnknown"), F.col("bare_cost").alias("costWithoutCacheUSD"),
        footprint().alias("carbon"), F.transform("models", lambda m: m.dropFields("a", "b")).alias("models"), before.alias("versusPrevious"),
    )


def series(p: DataFrame, dim: str, every: DataFrame) -> DataFrame:
    """`every` key of a dimension with its sums, zero where nothing happened."""
    return every.join(summed(p.filter((F.col("dim") == dim) & F.col("now")), "key"), "key", "left")


def point() -> Column:
    money = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return F.struct("key", zero(F.col("tok_total")).alias("tokens"), zero(F.col("requests")).alias("requests"), money("cost").alias("costUSD"), money("g_mid").alias("gramsCO2e"))


def calendar(events: DataFrame, start: int, now: int, tz: str = "UTC") -> DataFrame:
    edge = events.sparkSession.range(1).select(F.lit(start).alias("a"), F.lit(now).alias("b"))
    days = edge.select(F.explode(F.sequence(F.to_date(expr.local_time("a", tz)), F.to_date(expr.local_time("b", tz)))).alias("d"))
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("key"))


def gauge_item() -> Column:
    full = F.when(F.col("before_reset"), F.struct(F.col("at"), F.col("throttled"), F.col("rate_per_hour").alias("ratePerHour")))
    return F.struct(
        F.col("gauge_id").alias("id"), F.col("provider"), limits.window_label(F.col("window_hours")).alias("label"), F.col("percent"), F.col("tok_total").alias("tokens"), F.col("requests"), F.col("limit"),
        F.col("limit_source").alias("limitSource"), F.col("approximate"), F.col("resets_at").alias("resetsAt"), full.alias("projection"),
    )


PARTS = (
    "generatedAt", "range", "dataHorizon", "totals", "trend", "trend.previous", "byModel", "byProject", "daily", "hours", "equivalents", "carbonSensitivity", "carbonUncertainty",
    "gauges", "products", "budget", "reconciliation", "billedDaysDropped", "sources",
)


#: What a summary leaves out: the lists of a period's groups.
LISTS = ("byModel", "byProject", "daily", "hours", "equivalents", "products", "sources")


def summary(*args, **how) -> DataFrame:
    """`value`: the document without its lists."""
    return snapshot(*args, **how, leave=LISTS)


def snapshot(
    events: DataFrame, quota: DataFrame, start: int, now: int, monthly: float, status: DataFrame | None = None, tz: str = "UTC", grid: str | None = None, leave: tuple[str, ...] = (),
) -> DataFrame:
    """`value`: the document of the period [start, now] as JSON, but for the parts to leave out.  status: rows of collect()."""
    spark = events.sparkSession
    folded = fold(events, start, now, tz)
    p = priced(folded, start, now, tz, grid)
    pairs = p.filter("dim = 'model' AND now AND tok_total > 0")
    grams = pairs.agg(F.coalesce(F.sum("g_mid"), F.lit(0.0)).alias("g_mid"))
    gauges, paces = limits.readings(events, quota, now)
    g = limits.project(gauges, paces, now)
    fixed = spark.createDataFrame([("generatedAt", str(now)), ("range", f'{{"from":{start},"to":{now}}}')], "name string, text string")
    by_source = folded.groupBy("source").agg(F.min("oldest").alias("oldest"), F.sum("events").alias("indexed"), F.sum(F.when(F.col("ts_ms").between(start, now), F.col("events")).otherwise(0)).alias("in_range"))
    horizon = by_source.agg(F.min("oldest").alias("from"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "oldest")))).alias("bySource"))
    spent = budget.status_of(folded.filter(~F.col("covered")), folded.agg(F.min("oldest").alias("oldest")), monthly, now, tz)
    rec = provenance.reconciliation(folded, start, now, tz)
    # the status' own columns, if it is given, beside what the events tell
    known = by_source.select("source", "indexed", "in_range")
    sources = known.withColumns({"label": F.col("source"), "ord": F.lit(0), "available": F.lit(True), "error": F.lit(None).cast("string")}) if status is None else status.join(known, "source", "left")
    level = lambda c: F.when(F.isnan(c), None).otherwise(c)
    parts = [
        fixed, horizon.select(F.lit("dataHorizon").alias("name"), F.to_json(F.struct("from", "bySource"), {"ignoreNullFields": "false"}).alias("text")), totals(p),
        array(groups(p, "model"), "byModel", [-F.col("tok_total"), F.col("first_seq"), F.col("key")], group_item()),
        array(groups(p, "project"), "byProject", [-F.col("tok_total"), F.col("first_seq"), F.col("key")], group_item(), PROJECT_ROWS),
        array(series(p, "day", calendar(events, start, now, tz)), "daily", [F.col("key")], point()),
        array(series(p, "hour", spark.range(24).select(F.format_string("%02d", "id").alias("key"))), "hours", [F.col("key")], point()),
        array(carbon.equivalents(grams).join(F.broadcast(items(spark)), "item"), "equivalents", [F.col("ord")], F.struct("item", "units"), SHOWN),
        array(carbon.grid_sensitivity_of(pairs), "carbonSensitivity", [F.array_position(F.lit(list(dims.SENSITIVITY_GRIDS)), F.col("grid"))], F.struct("grid", triple("g").alias("gramsCO2e"), level(F.col("ratio")).alias("ratio"))),
        array(carbon.uncertainty_of(pairs), "carbonUncertainty", [-F.col("ratio")], F.struct("lever", "ratio")),
        array(g, "gauges", [F.col("provider"), F.col("window_hours"), F.col("gauge_id")], gauge_item()),
        array(limits.by_product(gauges), "products", [F.col("rank"), -F.col("peak"), F.col("product")], F.struct("product", "peak", "origin", F.col("n").alias("gauges"))),
        single(spent, "budget", F.struct(*[F.col(c).alias(n) for c, n in (("limit_usd", "limitUSD"), ("spent_usd", "spentUSD"), ("percent", "percent"), ("projected_usd", "projectedUSD"), ("cost_incomplete", "costIncomplete"), ("month_start", "monthStart"), ("month_end", "monthEnd"), ("state", "state"))])),
        array(rec, "reconciliation", [F.col("fam")], F.struct(F.col("fam").alias("family"), "local", "billed", F.col("delta_pct").alias("deltaPct"), "days")),
        folded.agg(F.coalesce(F.sum(F.when(F.col("covered"), F.col("events"))), F.lit(0)).cast("string").alias("text")).select(F.lit("billedDaysDropped").alias("name"), "text"),
        array(sources, "sources", [F.col("ord"), F.col("source")], F.struct("source", "label", "available", "error", zero(F.col("indexed")).alias("events"), zero(F.col("in_range")).alias("eventsInRange"))),
    ]
    own = [("generatedAt", "range"), ("dataHorizon",), ("totals", "trend", "trend.previous"), *[(n,) for n in PARTS[6:]]]
    shown = [n for n in PARTS if n not in leave]
    return joined([p for p, names in zip(parts, own, strict=True) if set(names) & set(shown)], shown)


def items(spark) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, (k, _) in enumerate(dims.EQUIVALENTS)], "item string, ord int")


def numbers(events: DataFrame, start: int, now: int, tz: str = "UTC") -> DataFrame:
    """(part, key, tokens, before, requests, cost, grams) of the document's sums, as rows."""
    p = priced(fold(events, start, now, tz), start, now, tz)
    out = None
    for dim in ("model", "project", "day", "hour"):
        each = summed(p.filter(F.col("dim") == dim), "key", "now")
        side = lambda c, is_now: F.max(F.when(F.col("now") == is_now, F.col(c)))
        rows = each.groupBy("key").agg(side("tok_total", True).alias("tokens"), side("tok_total", False).alias("before"), side("requests", True).alias("requests"), side("cost", True).alias("cost"), side("g_mid", True).alias("grams"))
        rows = rows.select(F.lit(dim).alias("part"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
