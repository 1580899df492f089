"""Incremental ingestion: micro-batches appended without repeats, hourly folds of late data, stateful alerts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import merge
from ..operators.scan import written


def fold_hours(events: DataFrame, lateness: str = "90 days") -> DataFrame:
    """Streaming fold of usage events to (hour, source, model); rows older than the watermark are dropped."""
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 hour"), "source", "model").agg(
        F.sum("tok_total").alias("tok_total"), F.sum(expr.requests()).alias("requests")
    ).select(F.unix_millis("window.start").alias("hour_ms"), "source", "model", "tok_total", "requests")


def append_batch(incoming: DataFrame, target: str, batch_id: int) -> None:
    """Append a batch's rows that the table at target lacks; a batch that is run again replaces itself.

    The table lies in folders by day and batch.  A row's key holds its time, so only the batch's own days are looked at: the
    cost follows the batch, whatever the history.
    """
    spark = incoming.sparkSession
    day = expr.day_key()
    batch = written(incoming.withColumn("day", day))
    days = batch.select("day").distinct()
    try:
        existing = merge.on_days(spark.read.parquet(target).filter(F.col("batch_id") < batch_id).withColumn("day", F.col("day").cast("string")), F.col("day"), days)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the table is made by the first batch
            raise
        existing = batch.limit(0)
    new = merge._anti(batch, existing, merge.REQUEST_KEY).withColumn("batch_id", F.lit(batch_id))
    new.write.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").mode("overwrite").parquet(target)


def append_batches(stream: DataFrame, target: str, checkpoint: str, boundary: int = 0):
    """Append each micro-batch's new rows to the parquet table at target."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(merge.late_gate(batch, boundary), target, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
