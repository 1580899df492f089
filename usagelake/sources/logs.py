"""Parsers of usage logs and provider reports, as projections over JSON text.

Lines that are not JSON are dropped; absent fields count as zero.  Where a
timestamp can't be read, `now` stands in, which callers pass explicitly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running

USAGE = (
    "STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT, "
    "cache_creation: STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>, output_tokens_details: STRUCT<thinking_tokens: BIGINT>>"
)
LOG = (
    "type STRING, timestamp STRING, cwd STRING, sessionId STRING, requestId STRING, "
    "quotaLimits STRUCT<status: STRING, resetsAt: BIGINT, rateLimitType: STRING, isUsingOverage: BOOLEAN>, "
    f"message STRUCT<id: STRING, role: STRING, model: STRING, content: STRING, usage: {USAGE}>"
)
LIMIT = "STRUCT<used_percent: DOUBLE, window_minutes: DOUBLE, resets_at: BIGINT>"
COUNTS = "STRUCT<input_tokens: BIGINT, cached_input_tokens: BIGINT, cache_write_input_tokens: BIGINT, output_tokens: BIGINT, reasoning_output_tokens: BIGINT>"
ROLLOUT = (
    "timestamp STRING, type STRING, payload STRUCT<type: STRING, model: STRING, cwd: STRING, session_id: STRING, "
    f"info: STRUCT<last_token_usage: {COUNTS}>, rate_limits: STRUCT<primary: {LIMIT}, secondary: {LIMIT}, rate_limit_reached_type: STRING, plan_type: STRING>>"
)
BUCKET = (
    "starting_at STRING, start_time BIGINT, results ARRAY<STRUCT<model: STRING, workspace_id: STRING, project_id: STRING, "
    "uncached_input_tokens: BIGINT, input_tokens: BIGINT, input_cached_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT, "
    "cache_creation: STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>, num_requests: BIGINT, num_model_requests: BIGINT, amount: STRING>>"
)


def n(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0).cast("long"))


def time_ms(text: Column, now: int | None = None) -> Column:
    """RFC 3339 text as epoch milliseconds; `now` (or null) where it can't be read."""
    at = F.unix_millis(F.try_to_timestamp(text))
    return at if now is None else F.coalesce(at, F.lit(now))


def flexible_ms(text: Column) -> Column:
    """A number above 1e11 is milliseconds, any other seconds; else RFC 3339."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.when(number > 1e11, number).otherwise(number * 1000).cast("long")).otherwise(time_ms(text))


def project_name(path: Column) -> Column:
    """Last segment of a path; null if there is no path; the path itself if it has no segment."""
    segments = F.filter(F.split(path, "[/\\\\]"), lambda s: s != "")
    return F.when(path.isNull() | (path == ""), None).when(F.size(segments) == 0, path).otherwise(F.element_at(segments, -1))


def split_cache_write(total: Column, w5: Column, w1: Column) -> tuple[Column, Column, Column]:
    """(all, 5 minutes, 1 hour): without detail, all of it is kept for 5 minutes."""
    detail = (w5 + w1) > 0
    return F.when(total > 0, total).otherwise(w5 + w1), F.when(detail, w5).otherwise(total), F.when(detail, w1).otherwise(F.lit(0).cast("long"))


def usage_tokens(usage: str) -> dict[str, Column]:
    """Token columns of a log's usage struct."""
    w5, w1 = n(f"{usage}.cache_creation.ephemeral_5m_input_tokens"), n(f"{usage}.cache_creation.ephemeral_1h_input_tokens")
    total = F.when((w5 + w1) != 0, w5 + w1).otherwise(n(f"{usage}.cache_creation_input_tokens"))
    write, five, hour = split_cache_write(total, w5, w1)
    i, o, r = n(f"{usage}.input_tokens"), n(f"{usage}.output_tokens"), n(f"{usage}.cache_read_input_tokens")
    return {
        "tok_input": i, "tok_output": o, "tok_cache_write": write, "tok_cw5m": five, "tok_cw1h": hour, "tok_cache_read": r,
        "tok_thinking": n(f"{usage}.output_tokens_details.thinking_tokens"), "tok_total": i + o + r + write,
    }


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """lines (value, ...) with struct r; lines that are no JSON object are dropped."""
    return lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).filter("r IS NOT NULL AND try_parse_json(value) IS NOT NULL")


def assistant_usage(lines: DataFrame, now: int) -> DataFrame:
    """lines (value, file, pos) of an assistant's log -> usage events with write_id, before the dedup of rewrites."""
    rows = parsed(lines, LOG).filter("r.message.role = 'assistant' AND r.message.usage IS NOT NULL")
    return rows.select(
        "file", "pos", F.coalesce("r.message.id", "r.requestId").alias("write_id"), time_ms(F.col("r.timestamp"), now).alias("ts_ms"),
        F.lit("claude-code").alias("source"), F.coalesce("r.message.model", F.lit("unknown")).alias("model"), project_name(F.col("r.cwd")).alias("project"),
        F.col("r.sessionId").alias("session_id"), *[c.alias(k) for k, c in usage_tokens("r.message.usage").items()], F.lit(1).cast("long").alias("requests"),
    )


def rejection_cause(content: Column) -> Column:
    """Why a request was refused, by the text of the message's blocks (strings, or objects with text)."""
    blocks = F.from_json(content, "ARRAY<STRING>")
    text = F.lower(F.array_join(F.transform(blocks, lambda b: F.coalesce(F.get_json_object(b, "$.text"), F.when(F.get_json_object(b, "$").isNull(), b), F.lit(""))), " "))
    has = lambda *ps: F.coalesce(F.greatest(*[F.contains(text, F.lit(p)) for p in ps]) if len(ps) > 1 else F.contains(text, F.lit(ps[0])), F.lit(False))
    return (
        F.when(has("spend limit", "spending limit", "credit balance", "out of credits"), "spend").when(has("weekly limit"), "weekly")
        .when(has("session limit", "usage limit", "rate limit"), "window").otherwise("unknown")
    )


def rejections(lines: DataFrame, now: int) -> DataFrame:
    """Quota observations in an assistant's log; roles and rewrites do not matter."""
    return parsed(lines, LOG).filter("r.quotaLimits IS NOT NULL").select(
        F.lit("claude-code").alias("source"), time_ms(F.col("r.timestamp"), now).alias("ts_ms"), F.coalesce("r.quotaLimits.rateLimitType", F.lit("unknown")).alias("kind"),
        F.col("r.quotaLimits.status").alias("status"), (n("r.quotaLimits.resetsAt") * 1000).alias("resets_at_ms"),
        F.coalesce("r.quotaLimits.isUsingOverage", F.lit(False)).alias("using_overage"), rejection_cause(F.col("r.message.content")).alias("cause"),
    )


#: Positions of a file (bytes, where it is read from disk) whose lines one task sorts.
PIECE = 64_000_000
CARRIED = ("model", "cwd", "session_id")


def carried(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rollout lines with the model, directory and session last named before them in their file, a long file in many pieces."""
    named = parsed(lines, ROLLOUT).withColumns({c: F.col(f"r.payload.{c}") for c in CARRIED})
    found = running(named, ["file"], F.floor(F.col("pos") / piece), ["pos"], lasts=CARRIED)
    return found.withColumn("model", F.coalesce("model", F.lit("codex")))


def rollout_usage(lines: DataFrame, now: int, piece: int = PIECE) -> DataFrame:
    """lines (value, file, pos) of a rollout -> usage events: the last request's counts, never the running total."""
    return counted_usage(carried(lines, piece), now)


def rollout_counts(lines: DataFrame, now: int) -> DataFrame:
    """Rollout lines (file, pos, r, and the CARRIED columns) with their counts, and whether they are `counted`: a request's, of some tokens."""
    u = "r.payload.info.last_token_usage"
    cached, write, out = n(f"{u}.cached_input_tokens"), n(f"{u}.cache_write_input_tokens"), n(f"{u}.output_tokens")
    fresh = F.greatest(F.lit(0).cast("long"), n(f"{u}.input_tokens") - cached - write)
    total = fresh + out + write + cached
    return lines.select(
        "file", "pos", time_ms(F.col("r.timestamp"), now).alias("ts_ms"), *CARRIED, fresh.alias("tok_input"), out.alias("tok_output"), write.alias("tok_cache_write"),
        cached.alias("tok_cache_read"), n(f"{u}.reasoning_output_tokens").alias("tok_thinking"), total.alias("tok_total"),
        (F.coalesce(F.col("r.payload.type") == "token_count", F.lit(False)) & F.col(u).isNotNull() & (total > 0)).alias("counted"),
    )


def carried_columns(counts: DataFrame) -> DataFrame:
    """rollout_counts() that are counted, with what was carried to them -> usage events."""
    return counts.select(
        "file", "pos", "ts_ms", F.lit("codex-cli").alias("source"), "model", project_name(F.col("cwd")).alias("project"), "session_id",
        "tok_input", "tok_output", "tok_cache_write", F.col("tok_cache_write").alias("tok_cw5m"), F.lit(0).cast("long").alias("tok_cw1h"),
        "tok_cache_read", "tok_thinking", "tok_total", F.lit(1).cast("long").alias("requests"),
    )


def counted_usage(lines: DataFrame, now: int) -> DataFrame:
    """Rollout lines (file, pos, r, and what is carried to them) -> usage events; lines without counts are dropped."""
    return carried_columns(rollout_counts(lines, now).filter("counted"))


def rollout_quota(lines: DataFrame, now: int) -> DataFrame:
    """Quota observations of rollouts, one a slot; only where the counts' `info` is there."""
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"r.payload.rate_limits.{s}").alias("q")) for s in ("primary", "secondary")])
    rows = parsed(lines, ROLLOUT).filter("r.payload.type = 'token_count' AND r.payload.info IS NOT NULL").withColumn("s", F.explode(slots)).filter("s.q IS NOT NULL")
    return rows.select(
        F.lit("codex-cli").alias("source"), time_ms(F.col("r.timestamp"), now).alias("ts_ms"),
        F.coalesce(F.concat(F.col("s.q.window_minutes").cast("long").cast("string"), F.lit("min")), F.col("s.slot")).alias("kind"),
        F.when(F.col("r.payload.rate_limits.rate_limit_reached_type").isNotNull(), "rejected").otherwise("ok").alias("status"),
        (n("s.q.resets_at") * 1000).alias("resets_at_ms"), F.col("s.q.used_percent").alias("used_percent"), F.col("s.q.window_minutes").alias("window_minutes"),
        F.col("r.payload.rate_limits.plan_type").alias("plan"),
    )


def _bucket_ms(now: int) -> Column:
    return F.coalesce(time_ms(F.col("r.starting_at")), F.col("r.start_time") * 1000, F.lit(now))


def billing_usage(lines: DataFrame, provider: str, now: int, empty: bool = False) -> DataFrame:
    """lines (value: one bucket of a usage report) -> daily events; results without tokens are dropped unless `empty` keeps them."""
    b = parsed(lines, BUCKET).withColumn("u", F.explode("r.results"))
    zero = F.lit(0).cast("long")
    if provider == "anthropic":
        w5, w1 = n("u.cache_creation.ephemeral_5m_input_tokens"), n("u.cache_creation.ephemeral_1h_input_tokens")
        write, five, hour = split_cache_write(w5 + w1, w5, w1)
        fresh, cached, count, project = F.coalesce("u.uncached_input_tokens", n("u.input_tokens")), n("u.cache_read_input_tokens"), n("u.num_requests"), F.col("u.workspace_id")
    else:
        write = five = hour = zero
        cached = n("u.input_cached_tokens")
        fresh, count, project = F.greatest(zero, n("u.input_tokens") - cached), n("u.num_model_requests"), F.col("u.project_id")
    out = n("u.output_tokens")
    found = b.select(
        _bucket_ms(now).alias("ts_ms"), F.lit(f"{provider}-api").alias("source"), F.coalesce("u.model", F.lit("unknown")).alias("model"), project.alias("project"),
        F.lit(None).cast("string").alias("session_id"), fresh.alias("tok_input"), out.alias("tok_output"), write.alias("tok_cache_write"), five.alias("tok_cw5m"), hour.alias("tok_cw1h"),
        cached.alias("tok_cache_read"), zero.alias("tok_thinking"), (fresh + out + cached + write).alias("tok_total"), F.greatest(F.lit(1).cast("long"), count).alias("requests"),
    )
    return found if empty else found.filter("tok_total > 0")


def cost_report(lines: DataFrame, now: int) -> DataFrame:
    """(day, amount) of a cost report, and its total on the row of no day; amounts are finite numbers or their text, anything else is ignored."""
    b = parsed(lines, BUCKET).withColumn("u", F.explode("r.results"))
    amount = F.col("u.amount").try_cast("double")
    found = b.select(F.date_format(F.timestamp_millis(_bucket_ms(now)), "yyyy-MM-dd").alias("day"), amount.alias("amount")).filter(~F.isnan("amount") & (F.abs("amount") < float("inf")))
    return found.rollup("day").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))


def billed_costs(lines: DataFrame, now: int) -> DataFrame:
    """(day, amount) of a cost report."""
    return cost_report(lines, now).filter("day IS NOT NULL")


PERCENTS = ("utilization", "used_percent", "usedPercent", "percent_used", "percentUsed", "percent")
RESETS = ("resets_at", "resetsAt", "reset_at", "resetAt", "expires_at")
DEPTH = 12


def normal_window(key: Column) -> Column:
    k = F.lower(key)
    has = lambda *ps: k.rlike("|".join(ps))
    return (
        F.when(has("five_hour", "5h", "session", "fivehour"), "five_hour")
        .when(has("seven_day", "weekly", "week", "7d"), F.when(has("opus"), "weekly_opus").otherwise("weekly")).when(has("opus"), "weekly_opus")
    )


#: Objects and arrays at any depth to DEPTH, each with the key that holds it; elements of an array with the array's and their place.
NESTED = f"""
WITH RECURSIVE found (pid, label, v, depth) AS (
  SELECT pid, 'racine', try_parse_json(value), 0 FROM {{payloads}} WHERE try_parse_json(value) IS NOT NULL
  UNION ALL
  SELECT f.pid, coalesce(e.key, concat(f.label, '[', e.pos, ']')), e.value, f.depth + 1 FROM found f, LATERAL variant_explode(f.v) e
  WHERE f.depth < {DEPTH} AND schema_of_variant(f.v) RLIKE '^(OBJECT|ARRAY)' AND schema_of_variant(e.value) RLIKE '^(OBJECT|ARRAY)')
SELECT pid, label, v FROM found WHERE schema_of_variant(v) LIKE 'OBJECT%'"""


def extract_windows(payloads: DataFrame) -> DataFrame:
    """payloads (pid, value) -> (pid, key, kind, percent, resets_at_ms) of every object, at any depth to 12, that states a percentage.

    A value in [0, 1] is a fraction; an object is named by its type, name or
    window, else by the key that holds it.  One recursive query reads the payloads once; the session's limit
    of a recursion's rows, which would fail a large table, is lifted.
    """
    spark = payloads.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    objects = spark.sql(NESTED, payloads=payloads.select("pid", "value"))

    def field(key: str, fits: Callable[[Column], Column], as_type: str) -> Column:
        kind = F.schema_of_variant(F.coalesce(F.try_variant_get("v", f"$.{key}", "variant"), F.parse_json(F.lit("null"))))
        return F.when(fits(kind), F.try_variant_get("v", f"$.{key}", as_type))

    pct = F.coalesce(*[field(k, lambda kind: ~kind.isin("STRING", "VOID", "BOOLEAN"), "double") for k in PERCENTS])
    name = F.coalesce(*[field(k, lambda kind: kind == "STRING", "string") for k in ("type", "name", "window")], F.col("label"))
    reset = F.coalesce(*[flexible_ms(F.try_variant_get("v", f"$.{k}", "string")) for k in RESETS])
    found = objects.select("pid", name.alias("key"), pct.alias("p"), reset.alias("resets_at_ms")).filter("p IS NOT NULL")
    p = F.when(F.col("p").between(0, 1), F.col("p") * 100).otherwise(F.col("p"))
    return found.select("pid", "key", normal_window(F.col("key")).alias("kind"), F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0)).alias("percent"), "resets_at_ms")
