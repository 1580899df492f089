"""Usage operators on small hand-made rows."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from usagelake.functions import dims, expr
from usagelake.operators import budget, carbon, limits, merge, provenance, rollup
from usagelake.sources import logs, sinks

NOW = 1_706_659_200_000
DAY, HOUR = 86_400_000, 3_600_000
SCHEMA = (
    "seq long, ts_ms long, source string, model string, project string, session_id string, tok_input long, tok_output long, tok_cache_write long, "
    "tok_cw5m long, tok_cw1h long, tok_cache_read long, tok_thinking long, tok_total long, requests long, compacted string"
)


def event(seq, ts, model="claude-opus-5", source="claude-code", i=0, o=0, w5=0, w1=0, r=0, project="p", session="s", requests=1, compacted=None):
    return (seq, ts, source, model, project, session, i, o, w5 + w1, w5, w1, r, 0, i + o + w5 + w1 + r, requests, compacted)


@pytest.fixture
def events(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def test_prices(events):
    m = 1_000_000
    rows = rollup.slices(events(event(1, NOW, i=m, r=m, w5=m, w1=m), event(2, NOW, "nothing-known", i=m), event(3, NOW, dims.SYNTHETIC, i=m)), F.lit(1)).collect()
    cost = {r["model"]: r["cost"] for r in rows}
    assert cost["claude-opus-5"] == pytest.approx(21.75) and cost["nothing-known"] is None and cost[dims.SYNTHETIC] == 0
    one_hour = rollup.slices(events(event(1, NOW, w1=m)), F.lit(1)).first()
    assert one_hour["cost"] == pytest.approx(10.0) and one_hour["bare_cost"] == pytest.approx(5.0)


def test_overrides_replace_entries(spark, events):
    own = spark.createDataFrame([("claude-opus-5", None, None, None, None)], "model string, family string, provider string, p_in double, p_out double")
    row = rollup.slices(events(event(1, NOW, i=10)), F.lit(1), overrides=own).first()
    assert row["cost"] is None and row["family"] == "unknown"


GOLDEN = [  # family's model, (in, out, cache read, cache write), grams min, mid, max, Wh mid
    ("claude-opus-5", (1000, 500, 0, 0), 1.98903, 4.70284, 11.1193, 11.4058), ("claude-opus-5", (0, 10000, 0, 0), 38.8483, 87.8276, 198.559, 213.009),
    ("claude-opus-5", (50000, 1200, 3_000_000, 45000), 16.4328, 85.3964, 443.779, 207.112), ("gpt-5", (50000, 1200, 3_000_000, 45000), 19.5977, 121.247, 750.129, 293.416),
    ("nothing-known", (50000, 1200, 3_000_000, 45000), 10.1219, 62.29, 383.332, 122.889),
]


@pytest.mark.parametrize("model, tokens, low, mid, high, wh", GOLDEN)
def test_footprint(events, model, tokens, low, mid, high, wh):
    i, o, r, w = tokens
    row = rollup.slices(events(event(1, NOW, model, i=i, o=o, r=r, w5=w)), F.lit(1)).first()
    assert row["wh_mid"] == pytest.approx(wh, rel=1e-4)
    if model == "nothing-known":  # the golden grams are those of the unknown provider's default mix
        assert row["grid_g"] == dims.GRIDS["world"]
    assert (row["g_min"], row["g_mid"], row["g_max"]) == pytest.approx((low, mid, high), rel=1e-4)
    assert row["g_min"] <= row["g_mid"] <= row["g_max"]


def test_sensitivity_and_levers(events):
    e = events(*[event(k, NOW, m, i=120_000, o=8000, r=5_000_000, w5=90_000) for k, m in enumerate(("claude-opus-5", "gpt-5", "nothing-known"))])
    grids = {r["grid"]: (r["g_mid"], r["ratio"]) for r in carbon.grid_sensitivity(e).collect()}
    assert grids["france"] == pytest.approx((155.876, 0.223284), rel=1e-4) and grids["world"] == pytest.approx((842.348, 1.20662), rel=1e-4)
    levers = {r["lever"]: r["ratio"] for r in carbon.uncertainty(e).collect()}
    assert levers == pytest.approx({"model": 6.46795, "grid": 5.24118, "weights": 3.86998, "infra": 1.14019}, rel=1e-4)


def test_medians_are_not_additive(events):
    """Totals by model are the reference: the mid of a sum is not the sum of mids."""
    e = events(event(1, NOW, o=10_000), event(2, NOW - DAY, r=10_000_000))
    whole = rollup.totals(e).first()["g_mid"]
    days = sum(r["g_mid"] for r in rollup.rollup(e, expr.day_key()).collect())
    assert whole == pytest.approx(272.124, rel=1e-3) and days == pytest.approx(239.949, rel=1e-3)


def test_period_comparison(events):
    start = NOW - 10 * DAY
    m = 1_000_000
    e = events(event(1, NOW - DAY, i=2 * m, project="alpha"), event(2, NOW - DAY, i=m, project="beta"), event(3, NOW - DAY, i=m, project="gamma"), event(4, start - DAY, i=m, project="alpha"), event(5, start - DAY, i=m, project="beta"))
    now, before = (rollup.rollup(p, rollup.project()).select("key0", "tok_total") for p in (rollup.period(e, start, NOW), rollup.previous(e, start, NOW)))
    got = now.join(before.withColumnRenamed("tok_total", "b"), "key0", "left").select("key0", rollup.change(F.col("tok_total"), F.col("b")).alias("c")).collect()
    assert {r["key0"]: r["c"] for r in got} == {"alpha": 100.0, "beta": 0.0, "gamma": None}


def test_days_are_local(events):
    e = events(event(1, NOW - 30 * 60_000, i=5))  # half past eleven in the evening, UTC
    assert rollup.rollup(e, expr.day_key("ts_ms", "Europe/Paris")).first()["key0"] == "2024-01-31"
    assert rollup.rollup(e, expr.day_key()).first()["key0"] == "2024-01-30"


def test_billed_days_are_dropped_where_measured(events):
    midnight = NOW - NOW % DAY
    e = events(event(1, midnight + 5, i=10), event(2, midnight, source="anthropic-api", i=30), event(3, midnight - DAY, source="anthropic-api", i=40), event(4, midnight, source="openai-api", i=7))
    kept, dropped = provenance.split_families(e)
    assert {r["seq"] for r in kept.collect()} == {1, 3, 4} and [r["seq"] for r in dropped.collect()] == [2]
    assert {r["seq"] for r in provenance.dedupe(kept).collect()} == {1, 3, 4}
    r = provenance.reconciliation(e, NOW - 5 * DAY, NOW + DAY).collect()
    assert [(x["fam"], x["days"], x["local"], x["billed"], x["delta_pct"]) for x in r] == [("anthropic", 1, 10, 30, 200.0)]


def test_merge_regimes(events):
    a = events(event(1, NOW, i=5), event(2, NOW, i=5))
    twice = merge.append_new(a, events(event(3, NOW, i=5), event(4, NOW + 1, i=5), event(5, NOW + 1, i=5)))
    assert sorted(r["seq"] for r in twice.collect()) == [1, 2, 4, 5]  # repeats in a batch stay
    null = merge.append_new(events(event(1, NOW, i=5, session=None)), events(event(2, NOW, i=5, session=None)))
    assert [r["seq"] for r in null.collect()] == [1]
    day = merge.replace_daily(events(event(1, NOW, i=1), event(2, NOW - 2 * DAY, i=1)), events(event(3, NOW, i=9), event(4, NOW, i=9)))
    assert sorted(r["seq"] for r in day.collect()) == [2, 3, 4]


def test_compaction(events):
    old = (NOW - 200 * DAY) // HOUR * HOUR
    e = events(event(1, old, i=100), event(2, old + 60_000, i=50), event(3, old + 120_000, i=25), event(4, NOW, i=7), event(5, old, i=3, compacted="day"))
    got = merge.compact(e, NOW, 90)
    assert sorted((r["tok_total"], r["requests"], r["compacted"]) for r in got.collect()) == [(3, 1, "day"), (7, 1, None), (175, 3, "hour")]
    assert got.agg(F.sum("tok_total")).first()[0] == e.agg(F.sum("tok_total")).first()[0]
    assert merge.compact(e, NOW, 0).count() == 5


QUOTA = "seq long, source string, ts_ms long, kind string, status string, resets_at_ms long, using_overage boolean, cause string, used_percent double, window_minutes double, plan string"


def test_gauges(spark, events):
    e = events(event(1, NOW - 2 * HOUR, o=100_000))
    none = spark.createDataFrame([], QUOTA)
    used = 500_000.0
    g = {r["gauge_id"]: r for r in limits.anthropic_gauges(e, none, NOW, {"five_hour": (used / 0.72, True)}).collect()}
    assert g["anthropic-five_hour"]["percent"] == pytest.approx(72) and g["anthropic-five_hour"]["limit_source"] == "user" and "anthropic-weekly_opus" not in g
    live = spark.createDataFrame([(1, "anthropic-oauth", NOW - 60_000, "five_hour", "ok", NOW + HOUR, False, "window", 15.0, None, None)], QUOTA)
    g = {r["gauge_id"]: r for r in limits.anthropic_gauges(e, live, NOW, {"five_hour": (used / 0.72, True)}).collect()}
    assert g["anthropic-five_hour"]["percent"] == 15 and g["anthropic-five_hour"]["limit_source"] == "live"
    assert limits.anthropic_gauges(events(event(1, NOW, source="codex-cli", i=5)), live, NOW).count() == 0


def test_user_calibration(spark, events):
    e = events(event(1, NOW - 2 * HOUR, o=100_000), event(2, NOW - 6 * HOUR, o=100_000))
    none = spark.createDataFrame([], QUOTA)
    got = limits.user_calibration(e, none, "anthropic-five_hour", 72, NOW).first()
    assert (got["kind"], got["at"], got["from_percent"]) == ("five_hour", NOW, 72.0) and got["limit"] == pytest.approx(500_000 / 0.72)
    gauge = limits.anthropic_gauges(e, none, NOW, {got["kind"]: (got["limit"], True)}).filter("gauge_id = 'anthropic-five_hour'").first()
    assert gauge["percent"] == pytest.approx(72) and gauge["limit_source"] == "user"
    known = spark.createDataFrame([(1, "claude-code", NOW - HOUR, "five_hour", "rejected", NOW + 4 * HOUR, False, "window", None, None, None)], QUOTA)
    assert limits.user_calibration(e, known, "five_hour", 72, NOW).count() == 0  # the window began an hour ago
    for percent in (0, 101):
        assert limits.user_calibration(e, none, "five_hour", percent, NOW).count() == 0
    with pytest.raises(ValueError):
        limits.user_calibration(e, none, "anthropic-month", 50, NOW)


def test_export_lines(events, tmp_path):
    midnight = NOW - NOW % DAY
    e = events(
        event(1, NOW, i=5, project="c"), event(2, NOW, i=1_000_000, project='a;"b'), event(3, NOW - DAY, "nothing-known", i=5, project=None),
        event(4, midnight, source="anthropic-api", i=9), event(5, NOW - 9 * DAY, i=7),
    )
    lines = sinks.export_lines(e, NOW - 5 * DAY, NOW)
    sinks.write_lines(lines, f"{tmp_path}/out")
    got = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert got == [r["line"] for r in lines.collect()] and len(got) == 4
    rows = list(csv.reader(got))
    assert tuple(rows[0]) == sinks.HEADER and {len(r) for r in rows} == {18} and '"a;""b"' in got[2]
    assert (rows[1][0], rows[1][2], rows[1][4], rows[1][11], rows[1][12]) == ("2024-01-30", "nothing-known", "", "", "0.000000")
    assert [(r[2], r[4], r[10], r[11]) for r in rows[2:]] == [("Claude Opus 5", 'a;"b', "1000000", "5.000000"), ("Claude Opus 5", "c", "5", "0.000025")]


def test_export_lines_of_nothing(events):
    assert [r["line"] for r in sinks.export_lines(events(), NOW - DAY, NOW).collect()] == [",".join(sinks.HEADER)]


def test_expired_and_obsolete_windows(spark, events):
    e = events(event(1, NOW - 30 * HOUR, "gpt-5", "codex-cli", i=10))
    q = spark.createDataFrame([
        (1, "codex-cli", NOW - 10 * HOUR, "300min", "ok", NOW - 5 * HOUR, False, "window", 80.0, 300.0, None),
        (2, "codex-cli", NOW - 54 * DAY, "10080min", "ok", NOW - 50 * DAY, False, "window", 9.0, 10080.0, None),
    ], QUOTA)
    g = limits.codex_gauges(e, q, NOW).collect()
    assert [(r["gauge_id"], r["percent"], r["limit_source"]) for r in g] == [("codex-300min", 0.0, "reset")]


def plain_throttle(left, rate, reset_in, budget_, full):
    elapsed, end, slow = 0.0, float(reset_in), False
    for _ in range(limits.MAX_CYCLES):
        room = (end - elapsed) * rate
        burn = min(budget_, room)
        if left <= burn:
            return elapsed + left / rate, slow
        slow |= burn < room
        left, elapsed, budget_, end = left - burn, end, full, end + limits.FIVE_HOURS_MS
    return None, slow


@pytest.mark.parametrize("args", [(800_000.0, 1.0, HOUR, 100_000.0, 200_000.0), (10.0, 1.0, HOUR, 100.0, 100.0), (1e12, 1.0, HOUR, 5.0, 5.0)])
def test_throttle(spark, args):
    s = spark.range(1).select(limits.throttled(*[F.lit(a) for a in args]).alias("s")).select("s.*").first()
    want = plain_throttle(*args)
    assert (s["in_ms"], s["throttled"]) == (pytest.approx(want[0]), want[1]) if want[0] is not None else s["in_ms"] is None


def test_alert_sequence(spark):
    state, got = None, []
    for percent in (40.0, 82.0, 84.0, 96.0, 97.0):
        rows = spark.createDataFrame([("k", "g", percent, False)], "key string, gauge_id string, percent double, projects boolean")
        out = budget.alerts(rows, state)
        got.append(out.first()["notices"])
        state = spark.createDataFrame([("k", out.first()["fired"])], "key string, fired array<string>")
    assert got == [[], ["80"], [], ["95"], []]
    assert budget.thresholds([float("nan"), -1, 400]) == [80.0, 95.0] and budget.thresholds([90, 50.5]) == [50.5, 90]


def test_budget(events):
    e = events(*[event(d, NOW - d * DAY, i=1_000_000) for d in range(10)])
    got = budget.status(e, 100.0, NOW).first()
    assert got["spent_usd"] == pytest.approx(50.0) and got["projected_usd"] == pytest.approx(50 + 8 * 5 / 7) and got["state"] == "ok"
    assert budget.status(e, 52.0, NOW).first()["state"] == "projected-over" and budget.status(e, 50.0, NOW).first()["state"] == "over"


def line(i, **more):
    usage = {"input_tokens": 5, "output_tokens": 2, "cache_creation_input_tokens": 700, "cache_creation": {"ephemeral_5m_input_tokens": 200, "ephemeral_1h_input_tokens": 500}}
    return json.dumps({"type": "assistant", "timestamp": "2024-01-30T10:00:00Z", "cwd": "/home/me/proj/", "sessionId": "s", "message": {"id": i, "role": "assistant", "model": "claude-opus-5", "usage": usage}} | more)


def test_log_parsing(spark):
    values = [line("A"), line("A"), "{broken", "", line("A"), line("B", timestamp="junk"), line(None), line(None), json.dumps({"message": {"role": "user"}})]
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(values)], "file string, pos long, value string")
    got = logs.assistant_usage(lines, NOW).collect()
    assert len(got) == 6 and {(r["tok_cache_write"], r["tok_cw5m"], r["tok_cw1h"], r["tok_total"], r["project"]) for r in got} == {(700, 200, 500, 707, "proj")}
    assert {r["ts_ms"] for r in got} == {1_706_608_800_000, NOW}
    assert sorted(r["pos"] for r in merge.first_writes(logs.assistant_usage(lines, NOW)).collect()) == [0, 5, 6, 7]


def test_rollout_carries_the_model(spark):
    turn = lambda **p: json.dumps({"timestamp": "2024-01-30T10:00:00Z", "type": "event_msg", "payload": p})
    counts = {"input_tokens": 100, "cached_input_tokens": 70, "cache_write_input_tokens": 10, "output_tokens": 5, "reasoning_output_tokens": 1}
    count = turn(type="token_count", info={"last_token_usage": counts}, rate_limits={"primary": {"used_percent": 12.0, "window_minutes": 300, "resets_at": 1_706_700_000}})
    values = [count, turn(type="turn_context", model="gpt-5", cwd="/w/x"), count, turn(type="token_count", rate_limits={"primary": {"used_percent": 99.0}})]
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(values)], "file string, pos long, value string")
    got = logs.rollout_usage(lines, NOW).orderBy("pos").collect()
    assert [(r["model"], r["project"], r["tok_input"], r["tok_total"]) for r in got] == [("codex", None, 20, 105), ("gpt-5", "x", 20, 105)]
    assert [(r["kind"], r["resets_at_ms"], r["used_percent"]) for r in logs.rollout_quota(lines, NOW).collect()] == [("300min", 1_706_700_000_000, 12.0)] * 2


def test_billing_reports(spark):
    one = lambda **r: spark.createDataFrame([(json.dumps({"starting_at": "2024-01-30T00:00:00Z", "results": [r]}),)], "value string")
    got = logs.billing_usage(one(model="gpt-5", input_tokens=12_000, input_cached_tokens=10_000, output_tokens=500), "openai", NOW).first()
    assert (got["tok_input"], got["tok_cache_read"], got["tok_total"], got["requests"]) == (2000, 10_000, 12_500, 1)
    assert logs.billing_usage(one(model="x"), "anthropic", NOW).count() == 0
    costs = spark.createDataFrame([(json.dumps({"starting_at": "2024-01-30T00:00:00Z", "results": [{"amount": a} for a in (1.25, "2.75", 4.0, "junk")]}),)], "value string")
    assert [(r["day"], r["amount"]) for r in logs.billed_costs(costs, NOW).collect()] == [("2024-01-30", 8.0)]


def test_windows_in_any_json(spark):
    deep = inner = {}
    for _ in range(40):
        inner["a"] = {}
        inner = inner["a"]
    inner["utilization"] = 50
    values = [{"five_hour": {"utilization": 0.5, "resets_at": "2024-01-30T10:00:00Z"}}, {"limits": [{"type": "seven_day_opus", "used_percent": 250}]}, deep, [1, "x"]]
    got = logs.extract_windows(spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "pid long, value string")).collect()
    assert sorted((r["pid"], r["kind"], r["percent"], r["resets_at_ms"]) for r in got) == [(0, "five_hour", 50.0, 1_706_608_800_000), (1, "weekly_opus", 100.0, None)]


@pytest.mark.parametrize("text, cause", [("Spending limit hit", "spend"), ("weekly limit", "weekly"), ("You hit your session limit", "window"), ("oh no", "unknown")])
def test_rejection_cause(spark, text, cause):
    for content in (json.dumps([{"type": "text", "text": text}]), json.dumps([text])):
        got = spark.createDataFrame([(content,)], "c string").select(logs.rejection_cause(F.col("c"))).first()[0]
        assert got == cause


def test_tail_reads_whole_lines_once(tmp_path):
    from usagelake.sources.tail import TailReader

    folder = tmp_path / "logs"
    os.makedirs(folder / "deep")
    path = folder / "deep" / "a.jsonl"
    path.write_bytes(b'{"a":1}\n\n\xff\xfe\n{"a":2}\n{"par')
    r = TailReader({"path": str(folder)})
    zero, one = r.initialOffset(), r.latestOffset()
    read = lambda a, b: [x[2] for p in r.partitions(a, b) for x in r.read(p)]
    assert read(zero, one) == ['{"a":1}', '{"a":2}']
    with path.open("ab") as f:
        f.write(b'tial":3}\n')
    two = r.latestOffset()
    assert read(one, two) == ['{"partial":3}'] and read(two, r.latestOffset()) == []
    path.write_bytes(b"[9]\n")
    assert read(two, r.latestOffset()) == ["[9]"]


def test_streamed_append_and_alerts(spark, tmp_path, events):
    from usagelake.streaming.alerting import threshold_alerts
    from usagelake.streaming.ingest import append_batches

    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    events(event(1, NOW, i=5), event(2, NOW - 9 * DAY, i=6)).coalesce(1).write.parquet(source)
    run = lambda: append_batches(spark.readStream.schema(SCHEMA).parquet(source), target, f"{tmp_path}/c", NOW - DAY).trigger(availableNow=True).start().awaitTermination()
    run()
    events(event(3, NOW, i=5), event(4, NOW + 1, i=5)).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r["seq"] for r in spark.read.parquet(target).collect()) == [1, 4]  # late and known rows are left out
    readings = spark.createDataFrame([("w", float(p), k) for k, p in enumerate((40, 82, 84, 96, 97))], "key string, percent double, seq long")
    readings.coalesce(1).write.parquet(f"{tmp_path}/r")
    out = threshold_alerts(spark.readStream.schema(readings.schema).parquet(f"{tmp_path}/r")).writeStream.format("parquet")
    out.option("path", f"{tmp_path}/alerts").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) == [("w", 1, "80"), ("w", 3, "95")]


def test_factor_table_and_methodology(spark):
    from usagelake.functions import factors
    from usagelake.sources import sinks

    rows = factors.factor_table(spark).collect()
    assert len(rows) == 44 and factors.factor_table(spark, "france").count() == 30
    by = {(r["group"], r["key"]): r for r in rows}
    assert by["method", "GPU_ENERGY_ALPHA"]["value"] == "0.0000891" and by["method", "HARDWARE_LIFESPAN_S"]["value"] == "157680000"
    assert by["weights", "cacheRead"]["value"] == "0.0006 – 0.005" and by["weights", "cacheRead"]["pinned"] and not by["grid", "france"]["pinned"]
    assert by["infrastructure", "local water on site"]["source"] == "providerInfra" and by["grid", "france"]["value"] == "56"
    lines = [r[0] for r in sinks.methodology_lines(spark, "france").collect()]
    assert len(lines) == 31 and lines[0].startswith("groupe,facteur,valeur") and lines[1].startswith("method,MODEL_QUANTIZATION_BITS,4,bits,ecologits,")
    assert {r["source"] for r in factors.unpinned_sources(spark).collect()} == set(factors.SOURCES) - {"derived", "inferredFromBehaviour"}
    assert {r["group"]: r["factors"] for r in factors.by_group(spark).collect()}["infrastructure"] == 12


def test_documents(spark, sf):
    from usagelake.operators import document
    from usagelake.plans import queries as plans

    s = json.loads(plans.snapshot_json(spark, sf).first()[0])
    assert list(s) == [n for n in document.PARTS if "." not in n] and "previous" in s["trend"]
    total = s["totals"]["tokens"]["total"]
    assert sum(m["tokens"]["total"] for m in s["byModel"]) == total == sum(d["tokens"] for d in s["daily"]) == sum(h["tokens"] for h in s["hours"]) and len(s["hours"]) == 24 and len(s["carbonSensitivity"]) == 4
    brief = json.loads(plans.summary_json(spark, sf).first()[0])
    assert brief == {k: v for k, v in s.items() if k not in document.LISTS}
    lines = [r[0] for r in plans.carbon_report(spark, sf).collect()]
    assert lines[0] == "# Footprint" and sum(x.startswith("## ") for x in lines) == 7 and len([x for x in lines if x.startswith("| infrastructure")]) == 12


def test_collect_isolates_failures(spark, tmp_path):
    import json

    from usagelake.sources.collect import collect

    (tmp_path / "a").mkdir()
    usage = {"input_tokens": 5, "output_tokens": 7}
    line = json.dumps({"timestamp": "2024-01-02T03:04:05Z", "sessionId": "s", "message": {"id": "m", "role": "assistant", "model": "gpt-5", "usage": usage}})
    (tmp_path / "a" / "x.jsonl").write_text(line + "\n" + line + "\nnot json\n")
    (tmp_path / "c" / "archived_sessions").mkdir(parents=True)
    (tmp_path / "c" / "archived_sessions" / "rollout-1.jsonl").write_text(json.dumps({"timestamp": "2024-01-02T03:04:05Z", "type": "e", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9, "output_tokens": 1}}}}) + "\n")
    e, q, status = collect(spark, {"claude-code": str(tmp_path / "a"), "codex-cli": str(tmp_path / "c"), "openai-api": str(tmp_path / "missing")}, 0)
    assert sorted((r["source"], r["tok_total"]) for r in e.collect()) == [("claude-code", 12), ("codex-cli", 10)] and q.count() == 0
    assert [(r["source"], r["available"], r["error"]) for r in status.collect()] == [
        ("claude-code", True, None), ("anthropic-oauth", False, None), ("anthropic-api", False, None), ("codex-cli", True, None), ("openai-api", False, "PATH_NOT_FOUND")]


def test_index_is_saved_and_loaded(spark, sf, tmp_path):
    from usagelake.operators import merge
    from usagelake.sources.driver_tables import NOW, quota_obs, usage_events

    folder = str(tmp_path)
    assert merge.load_index(spark, folder, 90) == (None, None, 0, True)
    merge.save_index(folder, usage_events(spark, sf), quota_obs(spark, sf), NOW, 20, 10, 5)
    e, q, boundary, reread = merge.load_index(spark, folder, 20)
    assert boundary == NOW - 10 * 86_400_000 and not reread and e.agg({"ts_ms": "min"}).first()[0] >= NOW - 20 * 86_400_000 and q.count() > 0
    merge.save_index(folder, e, q, NOW + 1, 20, 0, boundary)
    e2, _, later, reread = merge.load_index(spark, folder, 21)
    assert later == boundary and reread and e2.count() == e.filter(f"ts_ms >= {NOW + 1 - 20 * 86_400_000}").count()


def test_tail_reads_long_files_in_pieces(tmp_path, monkeypatch):
    from usagelake.sources import tail

    monkeypatch.setattr(tail, "PIECE", 7)
    monkeypatch.setattr(tail, "STEP", 3)
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"first line\nb\n\nccc\n" + b"\xff\xfe\n" + b"last\nunfinished")
    reader = tail.TailReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == 4 and [x[2] for p in parts for x in reader.read(p)] == ["first line", "b", "ccc", "last"]
    path.unlink()
    assert reader.latestOffset() == end and [x for p in parts for x in reader.read(p)] == []


def test_streamed_trajectory_and_null_percent(spark, tmp_path):
    from usagelake.streaming.alerting import threshold_alerts

    rows = [("a", 40.0, 1, True), ("a", None, 2, True), ("a", 50.0, 3, True), ("a", 96.0, 4, False), ("b", 40.0, 1, False), ("c", 85.0, 1, True)]
    data = spark.createDataFrame(rows, "key string, percent double, seq long, before_reset boolean")
    data.write.parquet(f"{tmp_path}/r")
    out = threshold_alerts(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/r")).writeStream.format("parquet")
    out.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert got == [("a", 1, "trajectory"), ("a", 4, "95"), ("c", 1, "80")]
