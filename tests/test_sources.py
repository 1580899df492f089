"""Sinks that commit or leave nothing, sources that fail alone, bounded tails, synced and appended tables, SQL functions, polling."""

import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from usagelake.functions import expr
from usagelake.functions import sql as functions_sql
from usagelake.operators import limits, merge, rollup, schedule
from usagelake.plans.queries import usage_events
from usagelake.sources import collect, sinks, tail, text_sink
from usagelake.streaming import ingest

NOW = 1_706_659_200_000
DAY = expr.DAY_MS


@pytest.fixture
def lines(spark):
    text_sink.register(spark)
    return lambda n, parts=5: spark.range(n).select("id", F.concat(F.lit('é "'), "id", F.lit('"')).alias("line")).repartitionByRange(parts, "id").sortWithinPartitions("id")


def text_of(n, first=0):
    return "\n".join(f'é "{i}"' for i in range(first, first + n))


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_text_is_whole_and_ends_without_a_line_feed(lines, tmp_path, n):
    lines(n).select("line").write.format("ordered_text").mode("append").save(f"{tmp_path}/a")
    assert text_sink.read_text(f"{tmp_path}/a").decode() == text_of(n)
    lines(n).select("line").write.format("ordered_text").option("header", "h;1").mode("overwrite").save(f"{tmp_path}/a")
    assert text_sink.read_text(f"{tmp_path}/a").decode() == ("h;1\n" + text_of(n) if n else "h;1")
    lines(n).select("line").write.format("ordered_text").mode("append").save(f"{tmp_path}/a")
    assert text_sink.read_text(f"{tmp_path}/a").decode() == "\n".join(["h;1", *([text_of(n)] * 2 if n else [])])


def test_failed_job_leaves_what_was_there(spark, lines, tmp_path):
    lines(20).select("line").write.format("ordered_text").mode("overwrite").save(f"{tmp_path}/a")
    before = {f.name for f in (tmp_path / "a").glob("part-*")}
    broken = lines(1000).select(F.when(F.col("id") == 990, F.raise_error(F.lit("killed"))).otherwise(F.col("line")).alias("line"))
    for mode in ("overwrite", "append"):
        with pytest.raises(PySparkException):
            broken.write.format("ordered_text").mode(mode).save(f"{tmp_path}/a")
        assert text_sink.read_text(f"{tmp_path}/a").decode() == text_of(20)
    assert not [f for f in (tmp_path / "a").glob("part-*") if f.name not in before]


def test_only_attempts_that_counted_are_published(tmp_path):
    (tmp_path / "a/_staged/j").mkdir(parents=True)
    for name, text in (("000000-1", "\nlost"), ("000000-2", "\nkept"), ("000002-3", "\nlast")):
        (tmp_path / "a/_staged/j" / name).write_text(text)
    sink = text_sink.Stream({"path": str(tmp_path / "a")}, "j", False)
    parts = [text_sink.Part(2, str(tmp_path / "a/_staged/j/000002-3"), 1), None, text_sink.Part(1, None, 0), text_sink.Part(0, str(tmp_path / "a/_staged/j/000000-2"), 1)]
    sink.commit(parts, 4)
    assert text_sink.read_text(str(tmp_path / "a")) == b"kept\nlast" and not (tmp_path / "a/_staged/j").exists()
    (tmp_path / "a/_staged/j").mkdir()
    (tmp_path / "a/_staged/j/000000-9").write_text("\nagain")
    sink.commit([text_sink.Part(0, str(tmp_path / "a/_staged/j/000000-9"), 1)], 4)  # the batch is run again
    assert text_sink.read_text(str(tmp_path / "a")) == b"kept\nlast"


def test_commit_that_broke_off_is_done_again(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/part-batch-000000007-000001").write_text("half")
    (tmp_path / "a/_staged/j").mkdir(parents=True)
    (tmp_path / "a/_staged/j/x").write_text("\nwhole")
    text_sink.Stream({"path": str(tmp_path / "a")}, "j", False).commit([text_sink.Part(0, str(tmp_path / "a/_staged/j/x"), 1)], 7)
    assert text_sink.read_text(str(tmp_path / "a")) == b"whole"


def test_streamed_text(spark, lines, tmp_path):
    for i in range(2):
        lines(30).filter(F.col("id") % 2 == i).select("line").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("line string").parquet(f"{tmp_path}/in").writeStream.format("ordered_text")
        s.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(text_sink.read_text(f"{tmp_path}/out").decode().split("\n")) == sorted(text_of(30).split("\n"))


def test_export_as_one_text(spark, sf, tmp_path):
    e = usage_events(spark, sf)
    sinks.write_text(sinks.export_lines(e, NOW - 3 * DAY, NOW), f"{tmp_path}/x")
    want = [r[0] for r in sinks.export_lines(e, NOW - 3 * DAY, NOW).collect()]
    assert text_sink.read_text(f"{tmp_path}/x").decode() == "\n".join(want) and len(want) > 5


def test_sources_fail_alone(spark, tmp_path):
    for name in ("claude-code", "anthropic-api", "openai-api", "anthropic-oauth", "codex-cli/sessions"):
        (tmp_path / name).mkdir(parents=True)
    usage = {"input_tokens": 5, "output_tokens": 2}
    say = lambda i, u: json.dumps({"timestamp": "2024-01-30T00:00:00Z", "message": {"id": i, "role": "assistant", "model": "m", "usage": u}})
    (tmp_path / "claude-code/a.jsonl").write_text("\n".join([say("a", usage), say("a", usage), say("z", {"input_tokens": 0}), say("z", usage), say(None, usage)]) + "\n")
    good = gzip.compress(b'{"starting_at": "2024-01-30T00:00:00Z", "results": [{"uncached_input_tokens": 9}]}\n' * 4000)
    (tmp_path / "anthropic-api/b.json.gz").write_bytes(good[: len(good) // 2] + b"\x00\x01rotten")
    (tmp_path / "openai-api/c.json").write_text('{"start_time": 1706572800, "results": [{"input_tokens": 7, "num_model_requests": 1}]}\n')
    (tmp_path / "anthropic-oauth/now.json").write_text('{\n "five_hour": {"utilization": 0.5, "resets_at": 1706660000},\n "seven_day": {"utilization": 100.0}, "other": {"percent": 3}\n}')
    places = {s.name: str(tmp_path / s.name) for s in collect.REGISTRY if s.name != "codex-cli"} | {"codex-cli": str(tmp_path / "nowhere")}
    events, quota, status = collect.collect(spark, places, NOW)
    assert Counter((r["source"], r["tok_total"]) for r in events.collect()) == Counter({("claude-code", 7): 2, ("openai-api", 7): 1})  # z is remembered without tokens
    assert {(r["source"], r["kind"], r["used_percent"], r["status"], r["resets_at_ms"]) for r in quota.collect()} == {
        ("anthropic-oauth", "five_hour", 50.0, "ok", 1_706_660_000_000), ("anthropic-oauth", "weekly", 100.0, "rejected", 0)}
    told = {r["source"]: (r["available"], r["error"]) for r in status.collect()}
    assert [r["ord"] for r in status.collect()] == [1, 2, 3, 4, 5]
    assert {s for s, (ok, _) in told.items() if ok} == {"claude-code", "anthropic-oauth", "openai-api"}
    assert "b.json.gz" in told["anthropic-api"][1] and told["codex-cli"][1].startswith("PATH_NOT_FOUND")


def test_shares_are_fair():
    assert tail.shares({"a": 5, "b": 100, "c": 100}, 65) == {"a": 5, "b": 30, "c": 30}
    assert tail.shares({"a": 5}, 100) == {"a": 5} and sum(tail.shares({c: 7 for c in "abcdef"}, 4).values()) == 4


@pytest.mark.parametrize("budget", [1, 30, 10_000])
def test_bounded_tail_reads_each_line_once_across_restarts(tmp_path, budget):
    rng = random.Random(budget)
    (tmp_path / "logs").mkdir()
    texts = {f"{c}.jsonl": [f"{c}{i}" + "x" * rng.randrange(40) for i in range(n)] for c, n in (("a", 40), ("b", 3), ("c", 0))}
    for name, ls in texts.items():
        (tmp_path / "logs" / name).write_text("".join(f"{x}\n" for x in ls))
    options = {"path": str(tmp_path / "logs"), "maxBytesPerTrigger": str(budget), "progress": str(tmp_path / "p/tail.json")}
    reader, got, rounds = tail.TailReader(options), [], 0
    start = reader.initialOffset()
    while True:
        end = reader.latestOffset()
        if json.loads(end["files"]) == {p: n for p, n in json.loads(start["files"]).items()} or rounds > 500:
            break
        parts = reader.partitions(start, end)
        part = [x for p in parts for x in reader.read(p)]
        assert sum(len(x[2]) + 1 for x in part) <= max(budget, 200)
        got += part
        start, rounds = end, rounds + 1
        if rounds == 3:
            with (tmp_path / "logs/b.jsonl").open("a") as f:
                f.write("late\n")
            texts["b.jsonl"].append("late")
        if rounds % 4 == 0:
            reader = tail.TailReader(options)  # a restart
    assert Counter(x[2] for x in got) == Counter(x for ls in texts.values() for x in ls) and (rounds > 5 or budget > 100)
    with pytest.raises(ValueError):
        tail.TailReader({"path": "x", "maxBytesPerTrigger": "5"})


def test_tail_that_lags_behind_doubles_its_batches(tmp_path):
    (tmp_path / "logs").mkdir()
    files = [tmp_path / f"logs/{c}.jsonl" for c in "ab"]
    for f in files:
        f.write_text("".join(f"{i:09d}\n" for i in range(5_000)))
    options = {"path": str(tmp_path / "logs"), "maxBytesPerTrigger": "100", "catchUpBytesPerTrigger": "20000", "progress": str(tmp_path / "p/tail.json")}
    reader, sizes, got = tail.TailReader(options), [], []

    def batch(start):
        end = reader.latestOffset()
        part = [x for p in reader.partitions(start, end) for x in reader.read(p)]
        sizes.append(10 * len(part))
        got.extend(part)
        return end

    start = reader.initialOffset()
    while not sizes or sizes[-1]:
        start = batch(start)
    assert max(sizes) <= 20_000 and sizes[0] <= 100 and len(sizes) < 16  # 1,000 of a hundred bytes each
    assert Counter(x[2] for x in got) == Counter({f"{i:09d}": 2 for i in range(5_000)})
    with files[0].open("a") as f:
        f.write("late 4567\n" * 100)
    batch(start)
    assert sizes[-1] == 100  # it had caught up, so it begins small again


SYNCED = "source string, ts_ms long, model string"


def test_sync_compares_changed_days_only(spark, tmp_path):
    rng = random.Random(4)
    a = [(rng.choice(["x", None]), d * DAY + rng.randrange(3), "m") for d in range(12) for _ in range(30)]
    b = [r for r in a if r[1] // DAY != 3]  # a day gone
    b.remove(next(r for r in b if r[1] // DAY == 5))  # one of several equal rows gone
    b += [("y", 7 * DAY, "m"), ("y", 7 * DAY, "m"), ("n", 40 * DAY, None), (None, None, "m")]
    stored, wanted = spark.createDataFrame(a, SYNCED), spark.createDataFrame(b, SYNCED)
    ca, cb = Counter(a), Counter(b)
    kept = merge.digests(stored, expr.day_key())
    for how in ({}, {"day": expr.day_key()}, {"day": expr.day_key(), "stored_digests": kept}):
        gone, new = merge.sync(stored, wanted, **how)
        assert Counter(map(tuple, gone.collect())) == ca - cb and Counter(map(tuple, new.collect())) == cb - ca
    days = {r["day"] for r in merge.changed_days(kept, merge.digests(wanted, expr.day_key())).collect()}
    assert days == {"1970-01-04", "1970-01-06", "1970-01-08", "1970-02-10", None}
    wanted.withColumn("day", F.coalesce(expr.day_key(), F.lit("none"))).write.partitionBy("day").parquet(f"{tmp_path}/w")
    table = spark.read.parquet(f"{tmp_path}/w").withColumn("day", F.col("day").cast("string"))
    some = merge.on_days(table, F.col("day"), spark.createDataFrame([("1970-01-06",)], "day string"))
    assert len(some.inputFiles()) and "PartitionFilters: [" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 29


KEYED = "source string, ts_ms long, session_id string, tok_total long, seq long"


def test_append_looks_at_its_own_days(spark, tmp_path, monkeypatch):
    target, seen = f"{tmp_path}/t", []
    inner = merge.on_days
    monkeypatch.setattr(merge, "on_days", lambda rows, day, days: seen.append(inner(rows, day, days)) or seen[-1])
    batches = [[("s", d * DAY + i, None if i % 3 else "a", 5, 100 * d + i) for d in range(6) for i in range(4)],
               [("s", 2 * DAY + i, None if i % 3 else "a", 5, 900 + i) for i in range(6)] + [("s", 9 * DAY, "z", 1, 990), ("s", 9 * DAY, "z", 1, 991)],
               [("s", 9 * DAY, "z", 1, 995), ("t", 9 * DAY, "z", 1, 996)]]
    want, keys = [], set()
    for b in batches:
        new = [r for r in b if r[:4] not in keys]
        want += new
        keys |= {r[:4] for r in new}
    for n, b in enumerate([*batches, batches[2]]):  # the last one runs again
        ingest.append_batch(spark.createDataFrame(b, KEYED), target, min(n, 2))
    assert Counter(r["seq"] for r in spark.read.parquet(target).collect()) == Counter(r[4] for r in want)
    assert "isin" in str(seen[-1]._jdf.queryExecution().analyzed()).lower() or "day" in seen[-1]._jdf.queryExecution().executedPlan().toString()
    read = {r["d"] for r in seen[-1].select(F.col("day").alias("d")).collect()}
    assert read == {"1970-01-10"}  # of nine days


def test_sql_functions_equal_the_operators(spark, sf):
    e = usage_events(spark, sf)
    functions_sql.register(spark, e)
    want = {(r["model"]): r for r in rollup.slices(e, F.lit(1)).collect()}
    got = {r["model"]: r for r in spark.sql(f"SELECT * FROM usage_slices('model', 0, {2 * NOW})").collect()}
    assert set(got) == set(want)
    for m, r in got.items():
        for c in ("tok_total", "requests", "cost", *functions_sql.FEET):
            assert r[c] == pytest.approx(want[m][c], rel=1e-12) if want[m][c] is not None else r[c] is None
    hours = [0.4, 5, 23.4, 24, 100, 168, 700, 720, 2000]
    df = spark.createDataFrame([(float(h),) for h in hours], "h double").select("h", limits.window_label(F.col("h")).alias("a"), F.expr("usage_window(CAST(h * 3600 AS BIGINT))").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    one = spark.sql("SELECT usage_requests(0) AS a, usage_requests(4) AS b, usage_weighted(1, 2, 4, 10) AS w, usage_mid(0, 4) AS m, usage_grid('nowhere') AS g, usage_model('').model_id AS u, usage_model(NULL).family AS f, "
                    "usage_cost(1000000, 0, 0, 0, 0, NULL, NULL, 'local') AS l, usage_cost(1, 0, 0, 0, 0, NULL, NULL, 'openai') AS n").first()
    assert (one["a"], one["b"], one["w"], one["m"], one["g"], one["u"], one["f"], one["l"], one["n"]) == (1, 4, 17.0, 2.0, 369.0, "unknown", "unknown", 0.0, None)


def test_polling(spark):
    minute = 60_000
    rows = [  # at, forced, status, retry after -> called, failures, next, reason
        (0 + 1, False, 200, None, True, 0, 15 * minute + 1, "cadence"), (minute, False, 200, None, False, 0, 15 * minute + 1, "cadence"),
        (2 * minute, True, 429, None, True, 1, 15 * minute + 1, "backoff"), (3 * minute, True, 200, None, False, 1, 15 * minute + 1, "backoff"),
        (20 * minute, False, 429, None, True, 2, 40 * minute, "backoff"), (41 * minute, None, 429, None, True, 3, 81 * minute, "backoff"),
        (90 * minute, False, 429, None, True, 4, 150 * minute, "backoff"), (151 * minute, False, 500, 30, True, 5, 151 * minute + 30_000, "backoff"),
        (152 * minute, False, None, 99, True, 6, 152 * minute + 45_000 * 32, "backoff"), (180 * minute, False, 200, None, True, 0, 195 * minute, "cadence"),
        (200 * minute, False, None, None, True, 1, 200 * minute + 45_000, "backoff"), (201 * minute, False, 200, None, True, 0, 216 * minute, "cadence"),
    ]
    ticks = [(s, i, *r[:4]) for s in ("a", "b") for i, r in enumerate(rows)]
    random.Random(3).shuffle(ticks)
    got = schedule.schedule(spark.createDataFrame(ticks, "source string, seq long, at_ms long, forced boolean, status long, retry_after_s long"))
    for s in ("a", "b"):
        assert [tuple(r[c] for c in ("called", "failures", "next_at", "reason")) for r in got.filter(F.col("source") == s).orderBy("seq").collect()] == [r[4:] for r in rows]
