"""Usage events and quota observations derived from the `events` table (deterministic, synthetic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_706_659_200_000
MODEL_NAMES = (
    "claude-opus-5", "claude-opus-4-5-20251101", "claude-opus-4-20250101", "CLAUDE-SONNET-5", "claude-sonnet-4-5-20250929",
    "claude-3-5-haiku-x", "gpt-5", "gpt-5-mini", "gpt-4.1", "o3-pro", "<synthetic>", "never-seen-model",
)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS seq", "user_id", "event_type", "value",
        "unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS ms", "day(ts) AS dom",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "CAST(round(value * 100) AS BIGINT) AS v",
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = (
        F.when(F.col("event_type") == "click", F.when(F.col("dom") % 5 == 0, "other-tool").otherwise("claude-code"))
        .when(F.col("event_type") == "view", F.when(F.col("dom") % 7 == 0, "other-tool").otherwise("codex-cli"))
        .when(F.col("event_type") == "purchase", "anthropic-api").when(F.col("event_type") == "signup", "openai-api")
    )
    api = F.col("source").endswith("-api")
    names = F.array(*[F.lit(m) for m in MODEL_NAMES])
    df = _base(spark, sf_dir).filter("event_type <> 'error'").withColumn("source", source)
    return df.select(
        "seq", F.when(api, F.col("ms") - F.col("ms") % 86_400_000).otherwise(F.col("ms")).alias("ts_ms"), "source",
        F.element_at(names, (F.col("user_id") % 12 + 1).cast("int")).alias("model"),
        F.when(F.col("k") % 10 != 0, F.concat(F.lit("proj-"), (F.col("user_id") % 13).cast("string"))).alias("project"),
        F.when(~api, F.concat(F.lit("s-"), F.col("user_id").cast("string"))).alias("session_id"),
        F.col("v").alias("tok_input"), F.expr("v div 4 + k").alias("tok_output"),
        F.expr("k * 7 + CASE WHEN k % 4 = 0 THEN k * 3 ELSE 0 END").alias("tok_cache_write"),
        F.expr("k * 7").alias("tok_cw5m"), F.expr("CASE WHEN k % 4 = 0 THEN k * 3 ELSE CAST(0 AS BIGINT) END").alias("tok_cw1h"),
        F.expr("v * 10 * (k % 3)").alias("tok_cache_read"), F.col("k").alias("tok_thinking"),
        F.expr("v + (v div 4 + k) + v * 10 * (k % 3) + k * 7 + CASE WHEN k % 4 = 0 THEN k * 3 ELSE 0 END").alias("tok_total"),
        F.when(api, F.col("k") % 5).otherwise(F.lit(1).cast("long")).alias("requests"),
        F.lit(None).cast("string").alias("compacted"),
    )


def quota_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("k") % 3
    causes = F.array(*[F.lit(c) for c in ("window", "spend", "weekly", "unknown")])
    short = F.col("user_id") % 2 == 0
    return _base(spark, sf_dir).filter("event_type = 'error'").select(
        "seq", F.when(kind == 0, "claude-code").when(kind == 1, "anthropic-oauth").otherwise("codex-cli").alias("source"),
        F.col("ms").alias("ts_ms"),
        F.when(kind == 2, F.when(short, "300min").otherwise("10080min")).otherwise(F.when(short, "five_hour").otherwise("weekly")).alias("kind"),
        F.when(kind == 0, "rejected").otherwise("ok").alias("status"),
        F.when(F.col("k") % 10 == 0, F.lit(0).cast("long")).otherwise(F.col("ms") + (F.col("user_id") % 5) * 3_600_000).alias("resets_at_ms"),
        F.lit(False).alias("using_overage"),
        F.when(kind == 0, F.element_at(causes, (F.col("k") % 4 + 1).cast("int"))).otherwise("window").alias("cause"),
        F.when(kind != 0, F.least(F.col("value"), F.lit(100.0))).alias("used_percent"),
        F.when(kind == 2, F.when(short, 300.0).otherwise(10080.0)).alias("window_minutes"),
        F.lit(None).cast("string").alias("plan"),
    )
