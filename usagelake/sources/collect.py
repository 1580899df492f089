"""The registry of sources, and one collection over all of them with isolated failures."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.scan import written
from . import logs

EVENT = (
    "ts_ms long, source string, model string, project string, session_id string, tok_input long, tok_output long, tok_cache_write long, tok_cw5m long, "
    "tok_cw1h long, tok_cache_read long, tok_thinking long, tok_total long, requests long"
)
QUOTA = "source string, ts_ms long, kind string, status string, resets_at_ms long, using_overage boolean, cause string, used_percent double, window_minutes double, plan string"


@dataclass(frozen=True)
class Source:
    """A source of events and quota observations; read(spark, place, now) gives both, either may be None."""

    name: str
    label: str
    order: int
    read: Callable[[SparkSession, str, int], tuple[DataFrame | None, DataFrame | None]]


def lines(spark: SparkSession, *folders: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, pos, value) of the log files below folders; pos orders the lines of a file."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True).text(list(folders))
    # a split's lines are numbered from where it begins, which is beyond the number of lines before it
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return text.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + number).alias("pos"), "value")


def assistant(spark: SparkSession, folder: str, now: int):
    read = lines(spark, folder)
    # an id is remembered even where its record has no tokens
    return merge.remembered_writes(logs.assistant_usage(read, now)).filter("tok_total <> 0"), logs.rejections(read, now)


def rollouts(spark: SparkSession, folder: str, now: int):
    """Live and archived rollouts; one of the two folders may be missing."""
    found, missing = [], None
    for part in ("sessions", "archived_sessions"):
        try:
            found.append(lines(spark, f"{folder}/{part}", pattern="rollout-*.jsonl"))
        except PySparkException as e:
            missing = e
    if not found:
        raise missing
    read = reduce(DataFrame.unionByName, found)
    return logs.rollout_usage(read, now), logs.rollout_quota(read, now)


def billing(provider: str):
    def read(spark: SparkSession, folder: str, now: int):
        return logs.billing_usage(spark.read.text(folder), provider, now), None
    return read


def live(spark: SparkSession, folder: str, now: int):
    """Saved answers of the live endpoint, a JSON document a file, observed when the file was written."""
    read = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    answers = read.select("value", F.unix_millis("_metadata.file_modification_time").alias("ts_ms"), F.col("_metadata.file_path").alias("file"))
    found = logs.extract_windows(answers.select(F.struct("file", "ts_ms").alias("pid"), "value")).filter("kind IS NOT NULL")
    return None, found.select(
        F.lit("anthropic-oauth").alias("source"), F.col("pid.ts_ms").alias("ts_ms"), "kind", F.when(F.col("percent") >= 100, "rejected").otherwise("ok").alias("status"),
        F.coalesce("resets_at_ms", F.lit(0)).alias("resets_at_ms"), F.lit(False).alias("using_overage"), F.lit("window").alias("cause"), F.col("percent").alias("used_percent"),
    )


REGISTRY = (
    Source("claude-code", "assistant logs", 1, assistant), Source("anthropic-oauth", "live usage", 2, live), Source("anthropic-api", "provider bill", 3, billing("anthropic")),
    Source("codex-cli", "rollout logs", 4, rollouts), Source("openai-api", "provider bill", 5, billing("openai")),
)


def fit(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of schema, null where it has none."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def told(error: Exception) -> str:
    """A short name of what went wrong, with the file where the error tells one."""
    text = str(error)
    name = (error.getCondition() if isinstance(error, PySparkException) else None) or next(iter(re.findall(r"\[([A-Z_]+(?:\.[A-Z_]+)*)\]", text)), type(error).__name__)
    file = next(iter(re.findall(r"(?:[a-z0-9]+:/|/)[^\s'\"]+/[^\s'\"]+\.[a-z0-9.]+[a-z0-9]", text)), None)
    return f"{name}: {file}" if file else name


def collect_one(spark: SparkSession, source: Source, place: str, now: int) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """(events, quota, error) of a source, read to its end and written, so that what can't be read is known here."""
    spark.sparkContext.setJobGroup(f"collect-{source.name}-{uuid.uuid4().hex[:8]}", f"{source.name}: {place}", interruptOnCancel=True)
    try:
        found = source.read(spark, place, now)
        return *(df if df is None else written(fit(df, schema)) for df, schema in zip(found, (EVENT, QUOTA), strict=True)), None
    except (PySparkException, Py4JJavaError) as e:
        return None, None, told(e)


def collect(spark: SparkSession, places: dict[str, str], now: int, registry=REGISTRY, boundary: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, quota, status) of all sources that have a place, each read by a thread and a job group of its own.

    A source that can't be read, at its start or anywhere in its files, gives no rows and an error in its status row; the
    others are read all the same.  Events older than what has been compacted are dropped.
    status: (source, label, ord, available, error), by order.
    """
    asked = [s for s in registry if s.name in places]
    with ThreadPoolExecutor(max(1, len(asked))) as pool:
        jobs = {s.name: pool.submit(inheritable_thread_target(spark)(collect_one), spark, s, places[s.name], now) for s in asked}
        got = {name: job.result() for name, job in jobs.items()}
    events = [spark.createDataFrame([], EVENT), *[e for e, _, _ in got.values() if e is not None]]
    quota = [spark.createDataFrame([], QUOTA), *[q for _, q, _ in got.values() if q is not None]]
    status = [(s.name, s.label, s.order, s.name in got and got[s.name][2] is None, got[s.name][2] if s.name in got else None) for s in registry]
    told_of = spark.createDataFrame(status, "source string, label string, ord int, available boolean, error string").orderBy("ord")
    return merge.late_gate(reduce(DataFrame.unionByName, events), boundary), reduce(DataFrame.unionByName, quota), told_of
