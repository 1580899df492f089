"""Streaming queries over the driver tables, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators.scan import scratch
from ..plans import oracle as o
from ..plans import queries as plans
from ..sources import logs, tail
from ..sources.driver_tables import NOW, usage_events
from . import stateful
from .ingest import fold_hours

STEPS = 3


def in_steps(lines: DataFrame, transform, work: str) -> DataFrame:
    """What transform makes of the stream of lines that grows by positions in STEPS steps, the stream starting again for each."""
    spark = lines.sparkSession
    ends = lines.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    step = ((ends["hi"] or 0) - (ends["lo"] or 0)) // STEPS + 1
    for i in range(STEPS):
        lo = (ends["lo"] or 0) + i * step
        lines.filter(F.col("pos").between(lo, lo + step - 1)).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{work}/in")
        with stateful.keyed_state(spark):
            run = transform(stream).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.parquet(f"{work}/out")


def stream_fifo_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's log as a stream: an id is dropped while its file's memory holds it, across restarts."""
    lines = plans.assistant_lines(spark, sf_dir, plans.APART)
    found = in_steps(lines, lambda s: stateful.remembered_writes(logs.assistant_usage(s, NOW), plans.SLOTS), scratch(spark, "stream"))
    return found.select("pos", "ts_ms", "model", "session_id", "tok_total")


def stream_rollout_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as a stream: what earlier steps named is carried to later ones; equal to the batch parse."""
    found = in_steps(plans.rollout_lines(spark, sf_dir), lambda s: stateful.carried_usage(s, NOW), scratch(spark, "stream"))
    return plans.carried_columns(found)


#: Bytes of a micro-batch of the tailed log; while it lags behind they double, up to a task's piece for each core.
BUDGET = 1_000_000


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's log, tailed as files by bytes in bounded micro-batches, parsed; equal to the batch parse."""
    work = scratch(spark, "stream")
    lines = plans.assistant_lines(spark, sf_dir)
    lines.repartition("file").sortWithinPartitions("file", "pos").select("value").write.text(f"{work}/logs")
    tail.register(spark)
    here = work.removeprefix("file://").removeprefix("file:")
    behind = tail.PIECE * spark.sparkContext.defaultParallelism
    stream = spark.readStream.format("jsonl_tail").options(suffix=".txt", maxBytesPerTrigger=BUDGET, catchUpBytesPerTrigger=behind, progress=f"{here}/progress/tail.json").load(f"{here}/logs")
    run = logs.assistant_usage(stream, NOW).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.parquet(f"{work}/out").select("ts_ms", "model", "project", "session_id", *expr.TOKENS)


def stream_hourly_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events as a file stream, folded to hours; equal to the batch fold when no row is late."""
    work = scratch(spark, "stream")
    usage_events(spark, sf_dir).write.parquet(f"{work}/in")
    schema = spark.read.parquet(f"{work}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{work}/in")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch_id={batch_id}")

    done = fold_hours(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    rows = spark.read.parquet(f"{work}/out")
    key = ["hour_ms", "source", "model"]  # the last update of an hour holds its sums
    return rows.groupBy(*key).agg(F.max_by("tok_total", "batch_id").alias("tok_total"), F.max_by("requests", "batch_id").alias("requests"))


QUERIES = {"stream_tail": stream_tail, "stream_hourly_fold": stream_hourly_fold, "stream_fifo_rewrites": stream_fifo_rewrites, "stream_rollout_carry": stream_rollout_carry}
SQL = {"stream_tail": plans.P(o.U, f"SELECT ts_ms, {plans.PARSED} FROM u, (VALUES (0), (1)) t(t) WHERE source = 'claude-code'"), "stream_fifo_rewrites": plans.FIFO, "stream_rollout_carry": plans.SQL["parse_rollout_carry"], "stream_hourly_fold": o.sql(o.U, "SELECT ts_ms - ts_ms % 3600000 AS hour_ms, source, model, sum(tok_total)::BIGINT AS tok_total, sum(CASE WHEN requests <> 0 THEN requests ELSE 1 END)::BIGINT AS requests FROM u GROUP BY 1, 2, 3")}
