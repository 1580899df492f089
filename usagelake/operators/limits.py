"""Rate-limit gauges: consumption of windows, calibration, pace and projected saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import HOUR_MS
from .provenance import with_source
from .scan import counted, running, settled, written

# Fixed values.
WINDOWS = (("five_hour", 5.0, False), ("weekly", 168.0, False), ("weekly_opus", 168.0, True))
FRESH_MS, PACE_MS, OBSOLETE_MS, MAX_CYCLES = 45 * 60_000, 45 * 60_000, 24 * HOUR_MS, 40
FIVE_HOURS_MS = 5 * HOUR_MS
# End of fixed values.


def window_events(events: DataFrame) -> DataFrame:
    """Request-grain events with their family."""
    return with_source(events).filter("grain = 'request'")


COUNTS = ("tok_input", "tok_output", "tok_cache_write", "tok_cache_read", "tok_total", "requests")


def hour_of(ts_ms: str) -> Column:
    return F.col(ts_ms) - F.pmod(F.col(ts_ms), F.lit(HOUR_MS))


def cuts(windows: DataFrame) -> DataFrame:
    """(fam, hour, from_at, to_at): the hours that windows (fam, from_ms, to_ms) begin or end in, cut into the pieces between those edges."""
    edges = windows.select("fam", F.explode(F.array(F.col("from_ms"), F.col("to_ms") + 1)).alias("at"))
    edges = edges.withColumn("hour", hour_of("at"))
    edges = edges.unionByName(edges.withColumn("at", F.col("hour"))).distinct()
    following = F.lead("at").over(W.partitionBy("fam", "hour").orderBy("at"))
    return edges.select("fam", "hour", F.col("at").alias("from_at"), F.coalesce(following, F.col("hour") + HOUR_MS).alias("to_at"))


def buckets(events: DataFrame, windows: DataFrame, few: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Request events summed by family, keys and time: (fam, *keys, at, COUNTS).

    A bucket is an hour, or, in an hour that an edge of a window falls into, the time between two edges; so every bucket lies
    inside a window or outside.  There are as many as hours and edges, however many events.  Events are read once, and
    summed before they are shuffled.  few: windows are few by count, and their edges are broadcast.
    """
    pieces = F.broadcast(cuts(windows)) if few else counted(cuts(windows))
    p = pieces.select(F.col("fam").alias("_fam"), F.col("hour").alias("_hour"), "from_at", "to_at")
    each = window_events(events).withColumn("requests", expr.requests()).withColumn("hour", hour_of("ts_ms")).select("fam", *keys, "hour", "ts_ms", *COUNTS)
    met = each.join(p, (F.col("fam") == F.col("_fam")) & (F.col("hour") == F.col("_hour")) & (F.col("ts_ms") >= F.col("from_at")) & (F.col("ts_ms") < F.col("to_at")), "left")
    at = F.coalesce(F.col("from_at"), F.col("hour")).alias("at")
    return met.groupBy("fam", *keys, at).agg(*[F.sum(c).alias(c) for c in COUNTS])


def sums_inside(events: DataFrame, windows: DataFrame, few: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """(wid, *keys, COUNTS) of windows (wid, fam, from_ms, to_ms), both ends included, by the running sums at their ends."""
    found = written(buckets(events, windows, few, keys))
    ends = F.explode(F.array(F.struct(F.col("from_ms").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("to_ms") + 1).alias("at"), F.lit(1).alias("sign"))))
    marks = windows.select("wid", "fam", ends.alias("e")).select("wid", "fam", "e.*")
    if keys:
        marks = marks.join(found.select("fam", *keys).distinct(), "fam")
    line = found.withColumn("wid", F.lit(None).cast(windows.schema["wid"].dataType)).withColumn("sign", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    # a mark stands before the bucket that begins with it
    line = line.withColumn("side", F.when(F.col("sign") == 0, 1).otherwise(0)).withColumn("_key", F.to_json(F.struct("fam", *keys)))
    day = F.col("at") - F.pmod(F.col("at"), F.lit(expr.DAY_MS))
    line = running(line, ["_key"], day, ["at", "side"], sums=COUNTS)
    return line.filter("sign <> 0").groupBy("wid", *keys).agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS])


def spans_of(windows: DataFrame) -> tuple[DataFrame, bool]:
    """(wid, fam, from_ms, to_ms) of the windows that hold time at all, computed once, and whether they are few."""
    return settled(windows.select("wid", "fam", "from_ms", "to_ms").filter("from_ms <= to_ms"))


def consumption(events: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (wid, fam, from_ms, to_ms) with the use inside them, both ends included; zero where there is none.

    Any number of windows costs one pass over the events: the edges of few are broadcast, those of many meet the events by
    family and hour.  Windows that end before they begin hold nothing.
    """
    spans, few = spans_of(windows)
    sums = sums_inside(events, spans, few).withColumn("used", expr.weighted())
    keep = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tok_total", "requests")]
    return windows.join(sums, "wid", "left").select(*windows.columns, *keep, F.coalesce("used", F.lit(0.0)).alias("used"))


def consumption_by_model(events: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, tok_total, requests, models): the use inside each window, and a map of model to tokens; no row without use."""
    each = sums_inside(events, *spans_of(windows), ("model",)).filter("requests > 0")
    pairs = F.array_sort(F.collect_list(F.struct("model", F.col("tok_total").alias("t"))))
    return each.groupBy("wid").agg(F.sum("tok_total").alias("tok_total"), F.sum("requests").alias("requests"), F.map_from_entries(pairs).alias("models"))


def window_label(hours: Column) -> Column:
    """A window's name by its length: session, daily, weekly, monthly, else the number of days."""
    days = F.round(hours / 24).cast("int")
    return (
        F.when(hours < 24, F.concat(F.lit("session "), F.round(hours).cast("int").cast("string"), F.lit(" h"))).when(days == 1, "daily").when(days == 7, "weekly")
        .when(days.between(28, 31), "monthly").otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def by_product(gauge_rows: DataFrame) -> DataFrame:
    """(product, rank, peak, origin, n): gauges of a product; rank 0 with a live one, 1 with a percentage, else 2; origin if all share it."""
    origin = F.coalesce("limit_source", F.lit("none"))
    return gauge_rows.withColumn("_o", origin).groupBy(F.col("provider").alias("product")).agg(
        F.min(F.when(F.col("limit_source") == "live", 0).when(F.col("percent").isNotNull(), 1).otherwise(2)).alias("rank"),
        F.max(F.coalesce("percent", F.lit(0.0))).alias("peak"), F.when(F.min("_o") == F.max("_o"), F.min("_o")).alias("origin"), F.count("*").alias("n"),
    ).orderBy("rank", F.desc("peak"), "product")


def cadence(now: int, errors: Column, next_attempt_in: Column, reason: Column, reported_at: Column) -> Column:
    """struct(ok, waiting, pacing, error, age_ms, next_attempt_in) of a live source's polling."""
    waiting, pacing = (next_attempt_in > 0) & (reason == "backoff"), (next_attempt_in > 0) & (reason == "cadence")
    waiting, pacing = F.coalesce(waiting, F.lit(False)), F.coalesce(pacing, F.lit(False))
    first = F.get(errors, F.lit(0))
    return F.struct(
        ((F.size(errors) == 0) & ~waiting).alias("ok"), waiting.alias("waiting"), pacing.alias("pacing"), F.coalesce(first, F.when(waiting, "suspended")).alias("error"),
        (F.lit(now) - reported_at).alias("age_ms"), next_attempt_in.alias("next_attempt_in"),
    )


def observed_limit(used: Column, percent: Column) -> Column:
    """Ceiling that a percentage implies; null if it can't be told."""
    return F.when((percent > 0) & (percent <= 100) & (used > 0), used / (percent / 100))


def calibrate(events: DataFrame, quota: DataFrame, wid: str, hours: float) -> DataFrame:
    """(limit, observed_at, samples) of the rejections that a full window caused; no row if none had use."""
    r = quota.filter((F.col("source") == "claude-code") & (F.col("status") == "rejected") & (F.col("kind") == wid) & (F.col("resets_at_ms") != 0) & (F.col("cause") == "window"))
    windows = r.select(F.col("seq").alias("wid"), F.lit("anthropic").alias("fam"), (F.col("resets_at_ms") - int(hours * HOUR_MS)).alias("from_ms"), F.col("ts_ms").alias("to_ms"))
    used, had = consumption(events, windows), F.col("requests") > 0
    best = used.agg(
        F.max(F.when(had, F.col("used"))).alias("limit"), F.max_by("to_ms", F.when(had, F.struct("used", -F.col("to_ms")))).alias("observed_at"), F.count("*").alias("samples"),
    )
    return best.filter("limit > 0")


def user_calibration(events: DataFrame, quota: DataFrame, gauge_id: str, percent: float, now: int) -> DataFrame:
    """(kind, limit, at, from_percent): the ceiling implied by a percentage that the user reads elsewhere.

    No row if the window had no use or the percentage can't be one.  The row
    feeds `limits` of anthropic_gauges().
    """
    kind = gauge_id.removeprefix("anthropic-")
    hours = {w: h for w, h, _ in WINDOWS}.get(kind)
    if hours is None:
        raise ValueError(f"no such window: {gauge_id}")
    known = quota.filter((F.col("kind") == kind) & (F.col("ts_ms") <= now) & (F.col("resets_at_ms") > now))
    known = known.agg(F.max_by("resets_at_ms", F.struct("ts_ms", "seq")).alias("reset"))
    begin = F.coalesce("reset", F.lit(now)) - int(hours * HOUR_MS)
    window = known.select(F.lit(kind).alias("wid"), F.lit("anthropic").alias("fam"), begin.alias("from_ms"), F.lit(now).alias("to_ms"))
    limit = observed_limit(F.col("used"), F.lit(float(percent)))
    found = consumption(events, window).select(F.col("wid").alias("kind"), limit.alias("limit"), F.lit(now).alias("at"), F.lit(float(percent)).alias("from_percent"))
    return found.filter("limit IS NOT NULL")


def anthropic_windows(quota: DataFrame, now: int, limits: dict[str, tuple[float, bool]] | None = None) -> DataFrame:
    """The family's windows, and one of all time, with what was last observed of them."""
    spark = quota.sparkSession
    rows = [(w, h, o, *(limits or {}).get(w, (None, False))) for w, h, o in (*WINDOWS, ("_any", 0.0, False))]  # the last: all time
    spec = spark.createDataFrame(rows, "kind string, window_hours double, live_only boolean, limit double, by_user boolean")
    seen = quota.filter(F.col("ts_ms") <= now)
    at = F.struct("ts_ms", "seq")
    ahead, told = F.col("resets_at_ms") > now, (F.col("source") == "anthropic-oauth") & F.col("used_percent").isNotNull()
    state = seen.groupBy("kind").agg(  # rows without an order take no part
        F.max_by("resets_at_ms", F.when(ahead, at)).alias("known_reset"),
        F.max_by(F.struct("ts_ms", "resets_at_ms", "used_percent"), F.when(told, at)).alias("live"),
    )
    span = (F.col("window_hours") * HOUR_MS).cast("long")
    g = spec.join(state, "kind", "left").filter("NOT live_only OR live IS NOT NULL OR kind = '_any'")
    g = g.withColumn("wid", F.concat(F.lit("anthropic-"), "kind")).withColumn("fam", F.lit("anthropic")).withColumn("from_ms", F.coalesce(F.col("known_reset"), F.lit(now)) - span).withColumn("to_ms", F.lit(now))
    whole = F.col("kind") == "_any"
    return g.withColumn("from_ms", F.when(whole, F.lit(-(2**62))).otherwise(F.col("from_ms"))).withColumn("to_ms", F.when(whole, F.lit(2**62)).otherwise(F.col("to_ms")))


def anthropic_read(used: DataFrame, now: int) -> DataFrame:
    """Gauges of the family's windows with their use."""
    whole = F.col("kind") == "_any"
    g = used.withColumn("_any", F.max(F.when(whole, F.col("requests"))).over(W.partitionBy("fam"))).filter((F.col("_any") > 0) & ~whole)
    fresh = F.lit(now) - F.col("live.ts_ms") < FRESH_MS
    source = F.when(F.col("live").isNotNull(), F.when(fresh, "live").otherwise("live-stale")).when(F.col("limit").isNotNull(), F.when(F.col("by_user"), "user").otherwise("configured"))
    reset = F.when(F.col("live.resets_at_ms") != 0, F.col("live.resets_at_ms"))
    return g.select(
        F.concat(F.lit("anthropic-"), "kind").alias("gauge_id"), F.lit("anthropic").alias("provider"), "window_hours", F.col("from_ms").alias("starts_at"),
        F.coalesce(reset, "known_reset").alias("resets_at"), (reset.isNull() & F.col("known_reset").isNull()).alias("rolling"),
        "tok_total", "requests", "used", "limit", source.alias("limit_source"), F.lit(False).alias("approximate"),
        F.coalesce(F.col("live.used_percent"), F.least(F.col("used") / F.col("limit") * 100, F.lit(100.0))).alias("percent"),
        (F.col("live").isNotNull() & ~fresh).alias("stale"), F.col("live.ts_ms").alias("reported_at"),
    )


def codex_windows(quota: DataFrame, now: int) -> DataFrame:
    """Two windows a reported kind: as it is now, and as it was last reported."""
    seen = quota.filter((F.col("ts_ms") <= now) & (F.col("source") == "codex-cli") & F.col("used_percent").isNotNull())
    last = seen.groupBy("kind").agg(F.max_by(F.struct("ts_ms", "resets_at_ms", "used_percent", "window_minutes"), F.struct("ts_ms", -F.col("seq"))).alias("q"))
    last = last.select("kind", "q.*")
    newest = F.max("ts_ms").over(W.partitionBy())  # over a row for each kind
    last = last.withColumn("newest", newest).filter(F.col("newest") - F.col("ts_ms") <= OBSOLETE_MS).drop("newest")
    hours = F.coalesce(F.col("window_minutes") / 60, F.lit(5.0))
    last = last.withColumn("window_hours", hours).withColumn("span", (F.col("window_hours") * HOUR_MS).cast("long"))
    last = last.withColumn("reset", F.when(F.col("resets_at_ms") != 0, F.col("resets_at_ms")).otherwise(F.col("ts_ms") + F.col("span")))
    last = last.withColumn("expired", F.col("reset") <= now)
    named = last.withColumn("wid", F.col("kind")).withColumn("fam", F.lit("openai"))
    begin = F.when(F.col("expired"), F.lit(now) - F.col("span")).otherwise(F.col("reset") - F.col("span"))
    spans = F.array(  # the window now, and as it was reported
        F.struct(F.lit(False).alias("was"), begin.alias("from_ms"), F.lit(now).alias("to_ms")),
        F.struct(F.lit(True).alias("was"), (F.col("reset") - F.col("span")).alias("from_ms"), F.col("ts_ms").alias("to_ms")),
    )
    named = named.withColumn("s", F.explode(spans)).select(*named.columns, "s.*")
    return named.withColumn("wid", F.concat(F.lit("codex-"), "wid", F.when(F.col("was"), " as reported").otherwise("")))


def codex_read(used: DataFrame, now: int) -> DataFrame:
    """Gauges of the reported kinds; an expired one is derived from the ceiling that its last report implies."""
    g = used.withColumn("then", F.max(F.when(F.col("was"), F.col("used"))).over(W.partitionBy("kind"))).filter("NOT was")
    limit = F.when((F.col("used_percent") > 0) & (F.col("then") > 0), F.col("then") / (F.col("used_percent") / 100))
    g = g.withColumn("limit", limit)
    derived = F.col("expired") & F.col("limit").isNotNull()
    idle = F.col("expired") & F.col("limit").isNull() & (F.col("used") <= 0)
    return g.select(
        F.concat(F.lit("codex-"), "kind").alias("gauge_id"), F.lit("openai").alias("provider"), "window_hours", F.col("from_ms").alias("starts_at"),
        F.when(~F.col("expired"), F.col("reset")).alias("resets_at"), F.col("expired").alias("rolling"), "tok_total", "requests", "used", "limit",
        F.when(~F.col("expired"), "provider").when(derived, "derived").when(idle, "reset").alias("limit_source"), derived.alias("approximate"),
        F.when(~F.col("expired"), F.col("used_percent")).when(derived, F.least(F.col("used") / F.col("limit") * 100, F.lit(100.0))).when(idle, 0.0).alias("percent"),
        F.lit(False).alias("stale"), F.col("ts_ms").alias("reported_at"),
    )


def anthropic_gauges(events: DataFrame, quota: DataFrame, now: int, limits: dict[str, tuple[float, bool]] | None = None) -> DataFrame:
    """One row a window; none without any request event of the family.

    limits: window -> (weighted tokens, set by the user).  Observations after `now` are not seen.
    """
    windows, _ = settled(anthropic_windows(quota, now, limits))
    return anthropic_read(consumption(events, windows), now)


def codex_gauges(events: DataFrame, quota: DataFrame, now: int) -> DataFrame:
    """One row a reported kind; expired windows are derived from the ceiling that their last report implies."""
    windows, _ = settled(codex_windows(quota, now))
    return codex_read(consumption(events, windows), now)


def pace_windows(spark: SparkSession, now: int) -> DataFrame:
    return spark.createDataFrame([(f"pace-{f}", f, now - PACE_MS, now) for f in ("anthropic", "openai")], "wid string, fam string, from_ms long, to_ms long")


def pace_read(used: DataFrame) -> DataFrame:
    return used.select("fam", F.col("used").alias("pace_used"), (F.col("used") / PACE_MS * HOUR_MS).alias("rate_per_hour"))


def pace(events: DataFrame, now: int) -> DataFrame:
    """(fam, pace_used, rate_per_hour) over the last 45 minutes."""
    return pace_read(consumption(events, pace_windows(events.sparkSession, now)))


def readings(events: DataFrame, quota: DataFrame, now: int, limits: dict[str, tuple[float, bool]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all gauges, pace): every window of both families and the pace's, in one pass over the events.

    Windows and their use are a row for each kind, computed here.
    """
    a, _ = settled(anthropic_windows(quota, now, limits))
    c, _ = settled(codex_windows(quota, now))
    p = pace_windows(events.sparkSession, now)
    spans = [w.select("wid", "fam", "from_ms", "to_ms") for w in (a, c, p)]
    used, _ = settled(consumption(events, spans[0].unionByName(spans[1]).unionByName(spans[2])).select("wid", "tok_total", "requests", "used"))
    both = anthropic_read(a.join(used, "wid"), now).unionByName(codex_read(c.join(used, "wid"), now))
    return both, pace_read(p.join(used, "wid"))


def gauges(events: DataFrame, quota: DataFrame, now: int, limits: dict[str, tuple[float, bool]] | None = None) -> DataFrame:
    return readings(events, quota, now, limits)[0]


def scale(prefix: str = "") -> tuple[Column, Column]:
    """(limit, remaining) of a gauge's usable scale; null without one."""
    c = lambda n: F.col(prefix + n)
    limit = F.coalesce(c("limit"), F.when((c("used") > 0) & (c("percent") > 0), c("used") / (c("percent") / 100)))
    limit = F.when(c("percent").isNotNull() & (limit > 0), limit)
    return limit, F.greatest((100 - c("percent")) / 100 * limit, F.lit(0.0))


def throttled(left: Column, rate: Column, reset_in: Column, budget: Column, full: Column) -> Column:
    """struct(in_ms, throttled): time to use `left` at `rate` per ms when a short window interposes.

    Each cycle uses what the short window still allows, waits for its reset and
    starts with a full one; in_ms is null if 40 cycles are not enough.
    """
    zero = F.struct(left.alias("left"), F.lit(0.0).alias("elapsed"), budget.alias("budget"), reset_in.cast("double").alias("end"), F.lit(False).alias("throttled"), F.lit(None).cast("double").alias("in_ms"))

    def cycle(s: Column, _: Column) -> Column:
        room = (s["end"] - s["elapsed"]) * rate
        burn = F.least(s["budget"], room)
        done = s["in_ms"].isNotNull()
        ends = ~done & (s["left"] <= burn)
        go = ~done & ~ends
        return F.struct(
            F.when(go, s["left"] - burn).otherwise(s["left"]).alias("left"), F.when(go, s["end"]).otherwise(s["elapsed"]).alias("elapsed"),
            F.when(go, full).otherwise(s["budget"]).alias("budget"), F.when(go, s["end"] + FIVE_HOURS_MS).otherwise(s["end"]).alias("end"),
            (s["throttled"] | (go & (burn < room))).alias("throttled"), F.when(ends, s["elapsed"] + s["left"] / rate).otherwise(s["in_ms"]).alias("in_ms"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_CYCLES)), zero, cycle, lambda s: F.struct(s["in_ms"].alias("in_ms"), s["throttled"].alias("throttled")))


def project(gauge_rows: DataFrame, paces: DataFrame, now: int) -> DataFrame:
    """Gauges, at the paces (fam, pace_used, rate_per_hour; a row for each family), with in_ms, at, rate_per_hour, before_reset and throttled; null where nothing can be projected."""
    limit, remaining = scale()
    g = gauge_rows.withColumn("fam", F.col("provider")).join(F.broadcast(paces), "fam", "left").withColumn("_remaining", remaining)
    short_limit, short_left = scale("s_")
    own = F.struct(*[F.col(c).alias(f"s_{c}") for c in ("resets_at", "limit", "used", "percent")])
    five = F.min_by(own, F.when(F.col("window_hours") == 5, F.col("gauge_id"))).over(W.partitionBy("provider"))
    has_five = F.max(F.col("window_hours") == 5).over(W.partitionBy("provider"))
    g = g.withColumn("_s", F.when(has_five, five)).select("*", "_s.*").withColumn("_short_limit", short_limit).withColumn("_short_left", short_left)
    rate = F.col("pace_used") / PACE_MS
    ok = F.col("percent").isNotNull() & (F.col("percent") < 100) & F.col("_remaining").isNotNull() & (F.col("pace_used") > 0)
    simple = F.struct((F.col("_remaining") / rate).alias("in_ms"), F.lit(False).alias("throttled"))
    braked = (F.col("window_hours") > 5) & (F.col("s_resets_at") > now) & F.col("_short_limit").isNotNull()
    out = F.when(ok, F.when(braked, throttled(F.col("_remaining"), rate, F.col("s_resets_at") - now, F.col("_short_left"), F.col("_short_limit"))).otherwise(simple))
    g = g.withColumn("_p", out).withColumn("in_ms", F.when(F.col("_p.in_ms") > 0, F.col("_p.in_ms")))
    has = F.col("in_ms").isNotNull()
    at = F.lit(now) + F.col("in_ms").cast("long")
    return g.select(
        *gauge_rows.columns, "in_ms", at.alias("at"), F.when(has, F.col("rate_per_hour")).alias("rate_per_hour"),
        F.when(has, F.coalesce(at < F.col("resets_at"), F.lit(True))).alias("before_reset"), F.when(has, F.col("_p.throttled")).alias("throttled"),
    )


def primary(gauge_rows: DataFrame) -> DataFrame:
    """The shortest window, then the fullest, of the gauges with a percentage."""
    return gauge_rows.filter("percent IS NOT NULL").orderBy("window_hours", F.desc("percent"), "gauge_id").limit(1)
