"""Windows, running values, id memories, carried values and nested payloads against plain loops."""

import json
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from usagelake.functions import expr
from usagelake.operators import limits, merge, scan
from usagelake.plans import queries as plans
from usagelake.sources import logs
from usagelake.streaming import stateful

HOUR = 3_600_000
NOW = 1_700_000_000_000
EVENT = "seq long, source string, ts_ms long, model string, tok_input long, tok_output long, tok_cache_write long, tok_cache_read long, tok_total long, requests long"
SOURCES = {"claude-code": "anthropic", "codex-cli": "openai", "other-tool": "unknown", "anthropic-api": None}  # None: no request grain


def usage(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([*SOURCES, "claude-code", "claude-code"])  # one family holds most
        counts = [rng.randrange(1000) for _ in range(4)]
        ts = rng.choice([NOW, NOW - 5 * HOUR, NOW - rng.randrange(40 * HOUR), -rng.randrange(3 * HOUR)])
        rows.append((i, source, ts, rng.choice(["a", "b"]), *counts, sum(counts), rng.choice([0, 1, 3])))
    return rows + rows[:50]  # repeated rows count again


def spans(seed=2, n=60):
    rng = random.Random(seed)
    rows = [(f"w{i}", rng.choice(["anthropic", "openai", "unknown", "nobody"]), *sorted(NOW - rng.choice([0, 5 * HOUR, rng.randrange(45 * HOUR)]) for _ in range(2))) for i in range(n)]
    return [*rows, ("all", "anthropic", -(2**62), 2**62), ("never", "anthropic", NOW, NOW - 1), ("one", "anthropic", NOW, NOW), ("early", "openai", -2 * HOUR, -1)]


def used_in(events, fam, lo, hi, model=None):
    return [e for e in events if SOURCES[e[1]] == fam and lo <= e[2] <= hi and (model is None or e[3] == model)]


@pytest.mark.parametrize("few", [True, False])
def test_consumption_equals_a_loop(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(scan, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(limits, "settled", lambda df: scan.settled(df, 5))
    rows, windows = usage(), spans()
    e, w = spark.createDataFrame(rows, EVENT), spark.createDataFrame(windows, "wid string, fam string, from_ms long, to_ms long")
    got = {r["wid"]: (r["tok_total"], r["requests"], round(r["used"], 6)) for r in limits.consumption(e, w).collect()}
    want = {}
    for wid, fam, lo, hi in windows:
        on = used_in(rows, fam, lo, hi)
        want[wid] = (sum(r[8] for r in on), sum(r[9] or 1 for r in on), round(sum(r[4] + 5 * r[5] + 1.25 * r[6] + 0.1 * r[7] for r in on), 6))
    assert got == want
    models = {r["wid"]: (r["tok_total"], r["requests"], r["models"]) for r in limits.consumption_by_model(e, w).collect()}
    assert models == {
        wid: (want[wid][0], want[wid][1], {m: sum(r[8] for r in on) for m in "ab" if (on := used_in(rows, fam, lo, hi, m))}) for wid, fam, lo, hi in windows if used_in(rows, fam, lo, hi)
    }
    none = limits.consumption(e, w.limit(0)), limits.consumption(e.limit(0), w)
    assert none[0].count() == 0 and {r["used"] for r in none[1].collect()} == {0.0}


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["window_consumption", "consumption_by_model", "pace_45min", "gauges_anthropic", "gauges_codex", "throttle_projection", "alerts_batch", "rejection_calibration"])
def test_windows_without_a_product(spark, sf, name):
    plan = plan_of(plans.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_events_are_summed_before_they_are_shuffled(spark, sf):
    plan = plan_of(limits.buckets(plans.usage_events(spark, sf), plans.windows(spark), True)).split("== Initial Plan ==")[0]
    lines = [x.strip(" :+-*()0123456789") for x in plan.split("\n")]
    assert plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan
    shuffles = [i for i, x in enumerate(lines) if x.startswith("Exchange hashpartitioning")]
    assert shuffles and all("partial_sum" in lines[i + 1] or "functions=[]" in lines[i + 1] or "at#" in lines[i] for i in shuffles)


def test_gauges_read_events_once(spark, sf, monkeypatch):
    seen = []
    inner = limits.window_events
    monkeypatch.setattr(limits, "window_events", lambda e: seen.append(1) or inner(e))
    assert plans.QUERIES["throttle_projection"](spark, sf).count() and len(seen) == 1


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_running_values(spark, piece):
    rng = random.Random(piece)
    rows = [(f"f{rng.randrange(3)}", i, rng.choice([None, rng.randrange(9)]), rng.choice([None, None, f"m{i}"])) for i in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "file string, pos long, n long, name string")
    got = scan.running(df, ["file"], F.floor(F.col("pos") / piece), ["pos"], sums=("n",), lasts=("name",))
    total, last, want = defaultdict(int), {}, set()
    for f, pos, n, name in sorted(rows, key=lambda r: r[1]):
        total[f] += n or 0
        last[f] = name or last.get(f)
        want.add((f, pos, total[f], last[f]))
    assert {tuple(r) for r in got.collect()} == want


def memory_loop(rows, slots):
    """rows (file, pos, id) -> the (file, pos) that are kept."""
    queue, kept = defaultdict(list), set()
    for f, pos, name in sorted(rows, key=lambda r: r[1]):
        if name is not None:
            if name in queue[f]:
                continue
            queue[f] = [*queue[f], name][-slots:]
        kept.add((f, pos))
    return kept


def returning(slots, seed):
    """Ids that return within the memory, just outside it, and often; many files, one of them hot; ids that are null."""
    rng = random.Random(seed)
    rows = [("hot", i, f"m{i % (slots + 1)}") for i in range(3 * slots)]  # each returns after as many others as there are slots
    rows += [("edge", i, f"m{i % slots}") for i in range(2 * slots)]  # each returns while it is held
    rows += [("edge", 10 * slots, "late"), ("edge", 10 * slots + 1, None), ("edge", 10 * slots + 2, None)]
    rows += [(f"f{rng.randrange(4)}", 20 * slots + i, rng.choice([None, f"m{rng.randrange(2 * slots)}"])) for i in range(6 * slots)]
    return rows


RECORD = "file string, pos long, write_id string"


def test_memory_of_500_ids_equals_a_loop(spark):
    rows = returning(merge.SLOTS, 1)
    assert merge.SLOTS == 500
    want = memory_loop(rows, 500)
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), RECORD).repartition(5)
    assert {(r["file"], r["pos"]) for r in merge.remembered_writes(df).collect()} == want
    assert len([p for f, p in want if f == "hot"]) == 1500  # ids return after 500 others: all are kept again
    first = {(r["file"], r["pos"]) for r in merge.first_writes(df).collect()}
    assert first < want
    assert merge.remembered_writes(df.limit(0)).count() == 0


def streamed(spark, tmp_path, rows, schema, steps, transform):
    """The stream's rows after steps, each in a run of its own that goes on where the last one ended."""
    for i, part in enumerate(steps):
        spark.createDataFrame([r for r in rows if part[0] <= r[1] < part[1]], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        with stateful.keyed_state(spark):
            q = transform(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_streamed_memory_of_500_ids_equals_a_loop(spark, tmp_path):
    rows = returning(500, 3)
    steps = [(0, 400), (400, 1100), (1100, 11_000), (11_000, 10**9)]
    before = spark.conf.get(stateful.PROVIDER, None)
    got = streamed(spark, tmp_path, rows, RECORD, steps, stateful.remembered_writes)
    assert {(r["file"], r["pos"]) for r in got.collect()} == memory_loop(rows, 500)
    assert got.count() == len(memory_loop(rows, 500)) and spark.conf.get(stateful.PROVIDER, None) == before


def rollout(seed=5, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["model", "cwd", "session", "count", "count", "bad"])
        payload = {"model": {"type": "turn_context", "model": f"gpt-{i}"}, "cwd": {"cwd": f"/w/p{i}"}, "session": {"session_id": f"s{i}"},
                   "count": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10 + i, "output_tokens": i}}}}.get(kind)
        rows.append((f"f{rng.randrange(2)}", i, "no json" if kind == "bad" else json.dumps({"timestamp": "2024-01-02T03:04:05Z", "payload": payload})))
    return rows


def carry_loop(rows):
    state, want = defaultdict(dict), Counter()
    for f, pos, value in sorted(rows, key=lambda r: r[1]):
        p = {} if value == "no json" else json.loads(value)["payload"]
        state[f] |= {k: p[k] for k in ("model", "cwd", "session_id") if k in p}
        if p.get("type") == "token_count":
            cwd = state[f].get("cwd")
            want[f, pos, state[f].get("model", "codex"), cwd and cwd.split("/")[-1], state[f].get("session_id")] += 1
    return want


def carried(df):
    return Counter((r["file"], r["pos"], r["model"], r["project"], r["session_id"]) for r in df.collect())


@pytest.mark.parametrize("piece", [1, 10, logs.PIECE])
def test_carried_values_cross_pieces(spark, piece):
    rows = rollout()
    df = spark.createDataFrame(rows, "file string, pos long, value string")
    assert carried(logs.rollout_usage(df, NOW, piece)) == carry_loop(rows)


def test_one_long_file_is_many_tasks(spark):
    rows = [("f", i, json.dumps({"payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 1}}}})) for i in range(400)]
    df = spark.createDataFrame(rows, "file string, pos long, value string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = logs.rollout_usage(df, NOW, 10).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1


def test_streamed_carry_goes_on_after_restarts(spark, tmp_path):
    rows = rollout(7)
    got = streamed(spark, tmp_path, rows, "file string, pos long, value string", [(0, 20), (20, 21), (21, 60), (60, 90)], lambda s: stateful.carried_usage(s, NOW))
    assert carried(got) == carry_loop(rows)


class Held(dict):
    """A map state in memory, and the handle that gives it."""

    def getMapState(self, *_):
        return self

    getValue, updateValue = dict.get, dict.__setitem__


def test_a_call_carries_many_files():
    rows = [(f, i, f"m{f}{i}" if i % 3 == 0 else None, None, None if f == "b" else f"s{f}", i % 2 == 1) for i in range(12) for f in ("a", "b", None)]
    random.Random(1).shuffle(rows)
    columns = ["file", "pos", "model", "cwd", "session_id", "counted"]
    carry, held, got = stateful.Carry(), Held(), {}
    carry.init(held)
    for lo, hi in ((0, 5), (5, 12)):
        part = pd.DataFrame([r for r in rows if lo <= r[1] < hi], columns=columns)
        for out in carry.handleInputRows((7,), iter([part.iloc[:4], part.iloc[4:]]), None):
            got |= {(r.file, r.pos): (r.model, r.cwd, r.session_id) for r in out.itertuples()}
    assert got == {(f, i): (f"m{f}{i - i % 3}", None, None if f == "b" else f"s{f}") for i in range(1, 12, 2) for f in ("a", "b", None)}
    assert set(held) == {("a",), ("b",), (None,)}


def test_a_call_remembers_for_many_files():
    rng = random.Random(6)
    rows = [(f, i, rng.choice([None, *"uvwxyz"])) for i in range(60) for f in ("a", "b", None)]
    memory, held, got = stateful.Remember(3), Held(), []
    memory.init(held)
    for lo, hi in ((0, 25), (25, 26), (26, 60)):
        part = pd.DataFrame(rng.sample([r for r in rows if lo <= r[1] < hi], 3 * (hi - lo)), columns=["file", "pos", "write_id"])
        got += [(r.file, r.pos) for out in memory.handleInputRows((7,), iter([part.iloc[:2], part.iloc[2:]]), None) for r in out.itertuples()]
    assert Counter(got) == Counter(memory_loop(rows, 3)) and len(held) == 3


def random_json(rng, depth=0):
    kind = rng.random()
    if depth > 5 or kind < 0.35:
        return rng.choice([None, True, 0.4, 1, 55, 140.5, -3, "12", "x", ""])
    if kind < 0.55:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    keys = ["utilization", "used_percent", "percent", "type", "name", "window", "a", "five_hour", "weekly_opus", "resets_at"]
    return {k: random_json(rng, depth + 1) for k in rng.sample(keys, rng.randrange(6))}


def walk(v, label="racine", depth=0):
    """(key, percent) of each object that states a percentage."""
    if depth > 12:
        return
    if isinstance(v, dict):
        number = next((v[k] for k in logs.PERCENTS if isinstance(v.get(k), int | float) and not isinstance(v.get(k), bool)), None)
        if number is not None:
            name = next((v[k] for k in ("type", "name", "window") if isinstance(v.get(k), str)), label)
            p = number * 100 if 0 <= number <= 1 else number
            yield name, round(min(max(p, 0), 100), 6)
        for k, x in v.items():
            yield from walk(x, k, depth + 1)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{label}[{i}]", depth + 1)


def test_nested_windows_equal_a_walk(spark):
    rng = random.Random(11)
    rows = [(i, json.dumps(random_json(rng))) for i in range(300)]
    deep = '{"percent": 7}'
    for _ in range(12):
        deep = '{"k": ' + deep + "}"
    rows += [(900, deep), (901, '{"k": ' + deep + "}"), (902, "no json"), (903, None), (904, "[]"), (905, ""), (906, '{"percent": 3}'), (906, '{"percent": 3}')]
    got = logs.extract_windows(spark.createDataFrame(rows, "pid long, value string").withColumn("v", F.lit(1)))
    want = Counter((i, *w) for i, x in rows if x and x != "no json" for w in walk(json.loads(x)))
    assert Counter((r["pid"], r["key"], round(r["percent"], 6)) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") <= 1 and (900, "k", 7.0) in want and not any(w[0] == 901 for w in want)
