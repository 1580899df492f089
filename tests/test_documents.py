"""Documents of a period against the operators, on edges, idle periods and ties; views and formats."""

import json

import pytest
from pyspark.sql import functions as F

from usagelake import cli
from usagelake.functions import expr, text
from usagelake.operators import budget, carbon, document, merge, provenance, rollup
from usagelake.sources import logs
from usagelake.sources.driver_tables import NOW, quota_obs, usage_events

DAY, HOUR = expr.DAY_MS, expr.HOUR_MS
#: Not on an hour, so that every edge falls inside one.
LATE = NOW - 25 * 60_000 - 7
START = LATE - 9 * DAY - 11 * 60_000


def at_edges(e):
    """Events moved onto and beside the edges of the period, the period before, the pace and the month."""
    edges = [START, 2 * START - LATE, LATE, LATE - 7 * DAY, NOW - 30 * DAY]
    moved = F.element_at(F.array(*[F.lit(x + d) for x in edges for d in (-1, 0, 1)]), (F.col("seq") % (3 * len(edges)) + 1).cast("int"))
    return e.withColumn("ts_ms", F.when(F.col("seq") % 4 == 0, moved).otherwise(F.col("ts_ms")))


@pytest.fixture(scope="module")
def doc(spark, sf):
    e = at_edges(usage_events(spark, sf))
    return e, json.loads(document.snapshot(e, quota_obs(spark, sf), START, LATE, 240.0).first()[0])


def test_parts_equal_the_operators(spark, doc):
    e, s = doc
    kept = rollup.period(provenance.dedupe(e), START, LATE)
    t = rollup.totals(kept).first()
    assert s["totals"]["tokens"]["total"] == t["tok_total"] and s["totals"]["requests"] == t["requests"] and s["totals"]["eventCount"] == t["events"]
    assert s["totals"]["costUSD"] == pytest.approx(t["cost"]) and s["totals"]["cacheSavingsUSD"] == pytest.approx(t["cache_savings"]) and s["totals"]["cacheHitRatio"] == pytest.approx(t["hit_ratio"])
    assert s["totals"]["carbon"]["gramsCO2e"]["mid"] == pytest.approx(t["g_mid"]) and s["totals"]["carbon"]["waterL"]["max"] == pytest.approx(t["l_max"])
    before = rollup.totals(rollup.previous(provenance.dedupe(e), START, LATE)).first()
    assert s["trend"]["previous"]["tokens"]["total"] == before["tok_total"] and s["trend"]["tokens"] == pytest.approx((t["tok_total"] - before["tok_total"]) / before["tok_total"] * 100)
    assert s["trend"]["significant"] is (before["tok_total"] > max(1000, 0.02 * t["tok_total"]))
    want = [(r["key0"], r["tok_total"], pytest.approx(r["cost"])) for r in rollup.rollup(kept, rollup.project()).orderBy(F.desc("tok_total"), "first_seq").limit(10).collect()]
    assert [(p["key"], p["tokens"]["total"], p["costUSD"]) for p in s["byProject"]] == want
    assert [(d["key"], d["tokens"]) for d in s["daily"]] == [(r["day"], r["tok_total"]) for r in rollup.daily_series(provenance.dedupe(e), START, LATE).orderBy("day").collect()]
    assert [(int(h["key"]), h["tokens"]) for h in s["hours"]] == [(r["hour"], r["tok_total"]) for r in rollup.hour_profile(kept).orderBy("hour").collect()]
    assert {g["grid"]: g["gramsCO2e"]["mid"] for g in s["carbonSensitivity"]} == {r["grid"]: pytest.approx(r["g_mid"]) for r in carbon.grid_sensitivity(kept).collect()}
    assert {x["lever"]: x["ratio"] for x in s["carbonUncertainty"]} == {r["lever"]: pytest.approx(r["ratio"]) for r in carbon.uncertainty(kept).collect()}
    b = budget.status(e, 240.0, LATE).first()
    assert s["budget"]["spentUSD"] == pytest.approx(b["spent_usd"]) and s["budget"]["projectedUSD"] == pytest.approx(b["projected_usd"]) and s["budget"]["state"] == b["state"]
    assert {r["family"]: (r["local"], r["billed"]) for r in s["reconciliation"]} == {r["fam"]: (r["local"], r["billed"]) for r in provenance.reconciliation(e, START, LATE).collect()}
    assert s["dataHorizon"]["from"] == e.agg(F.min("ts_ms")).first()[0] and s["billedDaysDropped"] == provenance.split_families(e)[1].count()
    assert sum(x["events"] for x in s["sources"]) == e.count() and sum(x["eventsInRange"] for x in s["sources"]) == rollup.period(e, START, LATE).count()


def test_order_and_changes(spark, doc):
    _, s = doc
    assert [m["tokens"]["total"] for m in s["byModel"]] == sorted((m["tokens"]["total"] for m in s["byModel"]), reverse=True)
    assert all([x["tokens"] for x in p["models"]] == sorted((x["tokens"] for x in p["models"]), reverse=True) and sum(x["tokens"] for x in p["models"]) == p["tokens"]["total"] for p in s["byProject"])
    assert any("versusPrevious" in m for m in s["byModel"]) and [x["ratio"] for x in s["carbonUncertainty"]] == sorted((x["ratio"] for x in s["carbonUncertainty"]), reverse=True)


@pytest.mark.parametrize("empty", [False, True])
def test_idle_period_gives_zeros(spark, sf, empty):
    e, q = usage_events(spark, sf), quota_obs(spark, sf)
    e, q = (e.limit(0), q.limit(0)) if empty else (e, q)
    late = NOW + 400 * DAY
    s = json.loads(document.snapshot(e, q, late - DAY, late, 240.0).first()[0])
    assert s["totals"]["tokens"]["total"] == s["totals"]["costUSD"] == s["totals"]["carbon"]["gramsCO2e"]["mid"] == 0 and s["trend"]["tokens"] is None and s["trend"]["significant"] is False
    assert s["reconciliation"] == [] and s["budget"]["spentUSD"] == 0 and s["carbonSensitivity"] == [] and s["daily"][0]["tokens"] == 0
    if empty:
        lines = [r[0] for r in cli.overview(e, q, late, 1, 100.0).collect()]
        assert any(x.startswith("1 days   0 tokens   $0.00") for x in lines) and any(x.startswith("budget $0.00 / $100.00  0%") for x in lines)


def test_overview(spark, sf):
    lines = [r[0] for r in cli.overview(usage_events(spark, sf), quota_obs(spark, sf), 1_706_540_400_000, 15, 100.0).collect()]
    assert any("anthropic weekly" in x and "%" in x for x in lines) and any(" tokens   $" in x for x in lines) and any(x.startswith("budget $") for x in lines) and any(x.startswith("anthropic: measured ") for x in lines)


@pytest.mark.parametrize("f, tongue, value, said", [
    ("tokens", "en", 1_234_567_890.0, "1.23 Md"), ("tokens", "fr", 1_250_000.0, "1,3 M"), ("tokens", "en", 999.0, "999"), ("tokens", "en", 1500.0, "1.5 k"), ("grams", "en", 1_234_000.0, "1.23 t"),
    ("grams", "fr", 12_345.0, "12,3 kg"), ("grams", "en", 0.04, "0.0 g"), ("water", "en", 0.012, "12 mL"), ("water", "en", 2500.0, "2.5 m³"), ("water", "en", 3.25, "3.3 L"), ("energy", "en", 1530.0, "1.53 kWh"),
    ("dollars", "en", None, "—"), ("dollars", "en", 1234.5, "$1,235"), ("dollars", "fr", 9.5, "$9,50"),
])
def test_formats(spark, f, tongue, value, said):
    assert spark.createDataFrame([(value,)], "x double").select(getattr(text, f)(F.col("x"), tongue)).first()[0] == said


def test_numbers_and_times(spark):
    df = spark.createDataFrame([(1234567.891, 90 * HOUR), (-12.5, 61 * 60_000), (0.0, 59_999), (999.0, -5)], "x double, ms long")
    assert [tuple(r) for r in df.select(text.number(F.col("x"), 1), text.number(F.col("x"), 1, "fr"), text.until(F.col("ms"))).collect()] == [
        ("1,234,567.9", "1 234 567,9", "3 d 18 h"), ("-12.5", "-12,5", "1 h 01 min"), ("0.0", "0,0", "0 min"), ("999.0", "999,0", None)]


def test_billed_total_and_folded_count(spark, sf):
    bucket = lambda day, *amounts: (json.dumps({"starting_at": f"2024-01-{day}T00:00:00Z", "results": [{"amount": a} for a in amounts]}),)
    costs = spark.createDataFrame([bucket(30, 1.25, "2.75", "junk", "NaN"), bucket(31, 4)], "value string")
    assert {r["day"]: r["amount"] for r in logs.cost_report(costs, NOW).collect()} == {"2024-01-30": 4.0, "2024-01-31": 4.0, None: 8.0}
    e = usage_events(spark, sf)
    r = merge.folded_count(e, NOW, 10).first()
    after = merge.compact(e, NOW, 10)
    assert (r["rows"], r["rows"] - r["folded"] + r["hours"]) == (e.count(), after.count()) and r["hours"] == after.filter("compacted = 'hour'").count()
    assert tuple(merge.folded_count(e, NOW, 0).first()) == (e.count(), 0, 0)


def test_unchanged_index_is_not_written_again(spark, sf, tmp_path):
    e, q, folder = usage_events(spark, sf), quota_obs(spark, sf), f"{tmp_path}/index"
    one = merge.save_index(folder, e, q, NOW, 20, 0)
    again = merge.save_index(folder, e.repartition(7), q, NOW + 0, 20, 0)
    more = merge.save_index(folder, e.unionByName(e.orderBy(F.desc("ts_ms")).limit(1)), q, NOW + 1, 20, 0)  # one row more, of equal rows
    assert one == again != more and spark.read.parquet(f"{folder}/meta").count() == 2
