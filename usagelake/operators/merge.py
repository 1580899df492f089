"""State maintenance: three merge regimes, retention, compaction, multiset sync."""

from __future__ import annotations

from collections import deque

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr
from .scan import settled, walked, written


REQUEST_KEY = ("source", "ts_ms", "session_id", "tok_total")
DAILY_KEY = ("source", "day", "model", "project")
HISTORY_KEY = ("source", "ts_ms", "kind", "resets_at_ms")


def _anti(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of left whose key is not in right; null keys equal each other."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = left[k].eqNullSafe(r[f"_{k}"])
        on = same if on is None else on & same
    return left.join(r, on, "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, keys=REQUEST_KEY) -> DataFrame:
    """existing and the incoming rows whose key it lacks; repeats within the batch stay."""
    return existing.unionByName(_anti(incoming, existing, keys))


def replace_daily(existing: DataFrame, incoming: DataFrame, tz: str = "UTC") -> DataFrame:
    """existing without the keys that incoming holds, and all of incoming with its multiplicity."""
    day = expr.day_key("ts_ms", tz)
    old, new = existing.withColumn("day", day), incoming.withColumn("day", day)
    return _anti(old, new, DAILY_KEY).unionByName(new).drop("day")


def late_gate(incoming: DataFrame, boundary: int) -> DataFrame:
    """Rows that are not older than what has been compacted."""
    return incoming.filter(F.col("ts_ms") >= boundary)


def latest_quota(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest observation of each kind; an existing one wins a tie."""
    both = existing.withColumn("_o", F.lit(0)).unionByName(incoming.withColumn("_o", F.lit(1)))
    first = W.partitionBy("kind").orderBy(F.desc("ts_ms"), "_o", "seq")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_o")


def merge_quota(existing: DataFrame, incoming: DataFrame, live_source: str = "anthropic-oauth") -> DataFrame:
    """Live observations: the newest of each kind. All others are history: new keys are appended."""
    live = F.col("source") == live_source
    history = append_new(existing.filter(~live), incoming.filter(~live), HISTORY_KEY)
    return history.unionByName(latest_quota(existing.filter(live), incoming.filter(live)))


def retain(df: DataFrame, now: int, days: int) -> DataFrame:
    return df.filter(F.col("ts_ms") >= now - days * expr.DAY_MS)


def compact(events: DataFrame, now: int, days: int, tz: str = "UTC") -> DataFrame:
    """Rows older than `days` folded to local hours; session null; marked 'hour'. Rows marked 'day' stay; 0 days: nothing."""
    if days == 0:
        return events
    old = (F.col("ts_ms") < now - days * expr.DAY_MS) & ~F.coalesce(F.col("compacted") == "day", F.lit(False))
    minute = F.minute(expr.local_time("ts_ms", tz)).cast("long") * 60_000 + F.col("ts_ms") % 60_000
    folded = events.filter(old).withColumn("ts_ms", F.col("ts_ms") - minute).groupBy("ts_ms", "source", "model", "project").agg(
        F.min("seq").alias("seq"), *[F.sum(c).alias(c) for c in expr.TOKENS], F.sum(expr.requests()).alias("requests")
    ).withColumn("session_id", F.lit(None).cast("string")).withColumn("compacted", F.lit("hour"))
    return events.filter(~old).unionByName(folded.select(events.columns))


def digests(rows: DataFrame, day: Column) -> DataFrame:
    """(day, n, sum, other): a digest of each day's rows as a multiset: their number, and sums of two hashes of all columns.

    Days with equal digests hold the same rows as often; two times 64 bits leave no room for chance.  A table of them may be
    kept beside the rows, so that the rows are not read.
    """
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  sums of hashes never overflow
    all_of = [F.col(c) for c in rows.columns]
    return rows.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"), F.sum(wide(F.xxhash64(*all_of))).alias("sum"), F.sum(wide(F.xxhash64(F.lit("again"), *reversed(all_of)))).alias("other"),
    )


def changed_days(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(day) of the digests that differ, or stand on one side only."""
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("n", "sum", "other")]
    both = stored.alias("s").join(wanted.alias("w"), F.col("s.day").eqNullSafe(F.col("w.day")), "full")
    return both.filter(~(same[0] & same[1] & same[2])).select(F.coalesce("s.day", "w.day").alias("day"))


def on_days(rows: DataFrame, day: Column, days: DataFrame) -> DataFrame:
    """rows of the days: few days are written into the filter, so that days in folders are not opened; null is a day."""
    few, small = settled(days)
    if small:
        found = [r["day"] for r in few.collect()]
        return rows.filter(day.isin([d for d in found if d is not None]) | (day.isNull() if None in found else F.lit(False)))
    return rows.join(days.select(F.col("day").alias("_day")), day.eqNullSafe(F.col("_day")), "left_semi")


def sync(stored: DataFrame, wanted: DataFrame, day: Column | None = None, stored_digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(to delete, to insert) so that stored becomes wanted, as multisets.

    day: what the rows are compared by first; only days whose digests differ are then compared row by row.  Without it
    all rows are.  stored_digests: what was kept of `stored` when it was written.
    """
    if day is not None:
        known = digests(stored, day) if stored_digests is None else stored_digests
        days, _ = settled(changed_days(known, digests(wanted, day)))
        stored, wanted = on_days(stored, day, days), on_days(wanted, day, days)
    return stored.exceptAll(wanted), wanted.exceptAll(stored)


def first_writes(lines: DataFrame, keys=("file", "write_id"), order: str = "pos") -> DataFrame:
    """The first of each file's rewritten records, whatever lies between; rows without an id all stay."""
    named = lines.filter(F.col(keys[-1]).isNotNull())
    first = W.partitionBy(*keys).orderBy(order)
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").unionByName(lines.filter(F.col(keys[-1]).isNull()))


def folded_count(events: DataFrame, now: int, days: int) -> DataFrame:
    """(rows, folded, hours): events, those that compact() folds, and the rows that they become; one pass."""
    if days == 0:
        return events.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("folded"), F.lit(0).cast("long").alias("hours"))
    old = (F.col("ts_ms") < now - days * expr.DAY_MS) & ~F.coalesce(F.col("compacted") == "day", F.lit(False))
    hour = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(expr.HOUR_MS))
    each = events.groupBy(F.when(old, F.struct(hour, "source", "model", "project")).alias("k")).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("folded"), F.count("k").alias("hours"))


def signature(events: DataFrame, quota: DataFrame) -> str:
    """A digest of both tables as multisets, whatever their order: equal if nothing is to be stored anew."""
    parts = []
    for df in (events, quota):
        r = digests(df, F.lit(0)).drop("day").first()
        parts.append("-" if r is None else ":".join(str(x) for x in r))
    return "/".join(parts)


#: Ids that a file's memory holds. Fixed value.
SLOTS = 500


class Memory:
    """The last `slots` ids that were new when they came; the oldest goes first, however often it is met again."""

    def __init__(self, slots: int, ids=()):
        self.slots, self.queue = slots, deque(ids)
        self.held = set(self.queue)

    def new(self, name: str | None) -> bool:
        """Whether a record of that id is kept; records without an id always are, and are not remembered."""
        if name is None:
            return True
        if name in self.held:
            return False
        self.held.add(name)
        self.queue.append(name)
        if len(self.queue) > self.slots:
            self.held.discard(self.queue.popleft())
        return True


def remembered_writes(lines: DataFrame, slots: int = SLOTS, file: str = "file", name: str = "write_id", order: str = "pos") -> DataFrame:
    """lines without the records whose id is still in their file's memory of `slots` ids: an id that returns later than that is kept again.

    The memory makes a file one sequence: a task walks through its files and holds one memory, never a file.
    """
    kept = walked(lines, file, [order], lambda: Memory(slots), lambda memory, what: (memory.new(what),), [name], "_kept boolean")
    return kept.filter("_kept").drop("_kept")


VERSION = 1


def save_chain(events: DataFrame, quota: DataFrame, now: int, retention_days: int, compact_days: int, boundary: int = 0, tz: str = "UTC") -> tuple[DataFrame, DataFrame, int]:
    """(events, quota, boundary) as they are stored: old rows go, older ones than compact_days are folded, the boundary never falls."""
    kept = compact(retain(events, now, retention_days), now, compact_days, tz)
    through = now - compact_days * expr.DAY_MS if compact_days else 0
    return kept, retain(quota, now, retention_days), max(boundary, through)


def save_index(folder: str, events: DataFrame, quota: DataFrame, now: int, retention_days: int, compact_days: int, boundary: int = 0, tz: str = "UTC") -> str:
    """Writes the chain's result as a new version below folder, then its meta row, which makes it the one to load; returns its path.

    A version is never overwritten, so what is read may be what is being replaced.  Where the last version holds the same rows, as
    multisets, under the same settings, nothing is written and its path is returned.
    """
    spark = events.sparkSession
    kept, seen, boundary = save_chain(events, quota, now, retention_days, compact_days, boundary, tz)
    kept, seen = written(kept), written(seen)
    sign = signature(kept, seen)
    last = last_meta(spark, folder)
    if last is not None and (last["version"], last["signature"], last["retention_days"], last["compact_days"], last["compacted_through"]) == (VERSION, sign, retention_days, compact_days, boundary):
        return last["path"]
    path = f"{folder}/v{now}"
    kept.withColumn("day", expr.day_key("ts_ms", tz)).write.mode("overwrite").partitionBy("day").parquet(f"{path}/events")
    seen.write.mode("overwrite").parquet(f"{path}/quota")
    meta = spark.createDataFrame([(VERSION, now, retention_days, compact_days, boundary, path, sign)], META)
    meta.coalesce(1).write.mode("append").parquet(f"{folder}/meta")
    return path


META = "version int, updated_at long, retention_days int, compact_days int, compacted_through long, path string, signature string"


def last_meta(spark: SparkSession, folder: str):
    """The newest meta row, if there is any."""
    try:
        return spark.read.schema(META).parquet(f"{folder}/meta").orderBy(F.desc("updated_at")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_index(spark: SparkSession, folder: str, retention_days: int) -> tuple[DataFrame | None, DataFrame | None, int, bool]:
    """(events, quota, boundary, reread) last stored; reread: retention was widened, so sources are to be read from their beginnings.

    Without an index, or with one of another version, there are no tables and everything is to be read.
    """
    last = last_meta(spark, folder)
    if last is None or last["version"] != VERSION:
        return None, None, 0, True
    events = spark.read.parquet(f"{last['path']}/events").drop("day")
    return events, spark.read.parquet(f"{last['path']}/quota"), last["compacted_through"], retention_days > last["retention_days"]
