"""Per-file state of tailed logs: the memory of written ids, and what a rollout's lines carry forward.

Both keep one small state for each file in Spark's state store, so a file may go on in any later micro-batch, after a
restart as well.  Rows of a file are put in order within a micro-batch; micro-batches follow the file, as a tail's do.
Files are dealt to DEALT groups by hash; a group's files share a call and its frame, and only states of files that have
rows are read or written.  A micro-batch's rows of one group are held by one task: bound them where the stream is read.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import SLOTS, Memory
from ..sources import logs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams with a keyed state are to be started inside; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


#: Groups that files are dealt to by hash. A stream keeps the number that it began with: its state is laid out by it.
DEALT = 512


def in_order(rows) -> tuple[pd.DataFrame, list[tuple[str | None, int, int]]]:
    """(a group's rows by file and position, (file, first row, end) of each file)."""
    found = pd.concat(list(rows), ignore_index=True)
    code = found["file"].factorize(use_na_sentinel=False)[0]
    order = np.lexsort((found["pos"].to_numpy(), code))
    found, code = found.iloc[order].reset_index(drop=True), code[order]
    edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    names = found["file"].iloc[edges[:-1]]
    return found, [(None if pd.isna(f) else f, a, b) for f, a, b in zip(names, edges[:-1], edges[1:], strict=True)]


class Remember(StatefulProcessor):
    """Drops records whose id is in their file's memory."""

    def __init__(self, slots: int):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "file string", "ids array<string>")

    def handleInputRows(self, key, rows, timerValues):
        found, files = in_order(rows)
        names = [None if pd.isna(x) else x for x in found["write_id"]]
        keep = []
        for file, a, b in files:
            before = self.ids.getValue((file,))
            memory = Memory(self.slots, before[0] if before else ())
            new = [memory.new(x) for x in names[a:b]]
            keep += new
            if any(x is not None and kept for x, kept in zip(names[a:b], new, strict=True)):
                self.ids.updateValue((file,), (list(memory.queue),))
        yield found.loc[keep]

    def close(self) -> None:
        pass


class Carry(StatefulProcessor):
    """Gives each line the model, directory and session last named in its file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "file string", ", ".join(f"{c} string" for c in logs.CARRIED))

    def handleInputRows(self, key, rows, timerValues):
        found, files = in_order(rows)
        names = list(logs.CARRIED)
        value = found[names].astype(object).where(found[names].notna(), None).to_numpy()
        for file, a, b in files:
            before = self.last.getValue((file,))
            now = before = tuple(before) if before else (None,) * len(names)
            for i in range(a, b):
                now = value[i] = tuple(x if y is None else y for x, y in zip(now, value[i], strict=True))
            if now != before:
                self.last.updateValue((file,), now)
        found[names] = value
        yield found[found["counted"]].drop(columns="counted")

    def close(self) -> None:
        pass


def dealt(rows: DataFrame):
    """rows grouped for a state that is kept by file: a group is many files, so that what a group costs is not paid for each file."""
    return rows.withColumn("_group", F.pmod(F.xxhash64("file"), F.lit(DEALT)).cast("int")).groupBy("_group")


def remembered_writes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Streamed usage records (file, pos, write_id, ...) without those whose id is in their file's memory of `slots` ids."""
    return dealt(records).transformWithStateInPandas(Remember(slots), records.schema, "Append", "None")


def carried_usage(lines: DataFrame, now: int) -> DataFrame:
    """Streamed rollout lines (file, pos, value) -> usage events, with what earlier micro-batches of the file named."""
    named = logs.parsed(lines, logs.ROLLOUT).withColumns({c: F.col(f"r.payload.{c}") for c in logs.CARRIED})
    rows = logs.rollout_counts(named, now).filter("counted OR " + " OR ".join(f"{c} IS NOT NULL" for c in logs.CARRIED))
    found = dealt(rows).transformWithStateInPandas(Carry(), rows.drop("counted").schema, "Append", "None")
    return logs.carried_columns(found.withColumn("model", F.coalesce("model", F.lit("codex"))))
