"""The engine's formulas as SQL functions of a session, scalar and table-valued.

    register(spark, events)
    spark.sql("SELECT project, sum(cost) FROM usage_slices('project', 0, unix_millis(now())) GROUP BY project")

Functions are temporary and built on each other; Spark inlines them, so they cost what their expressions cost.

| function | what |
|---|---|
| `usage_requests(n)` | a count of 0 stands for one request |
| `usage_weighted(input, output, cache_write, cache_read)` | use as rate limits weigh it |
| `usage_model(raw)` | id, family, provider and prices of a raw model name |
| `usage_cost(input, output, cache_read, write_5m, write_1h, p_in, p_out, provider)` | USD, null where the price is unknown |
| `usage_mid(a, b)` | the middle of a range |
| `usage_footprint(output, input, cache_write, cache_read, family, provider, grid_g)` | min, mid and max of grams, energy and water |
| `usage_grid(name)` | grams of CO2e a kWh |
| `usage_window(seconds)` | a window's name by its length |
| `usage_slices(by, from_ms, to_ms)` | table: priced rows by key and model of the registered events |
| `usage_windows(at_ms)` | table: weighted use of each family in the 5 hours and the week before |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dims

VIEW = "usage_events"
FEET = ("g_min", "g_mid", "g_max", "wh_min", "wh_mid", "wh_max", "l_min", "l_mid", "l_max")
COUNTS = ("tok_input", "tok_output", "tok_cache_write", "tok_cw5m", "tok_cw1h", "tok_cache_read", "tok_thinking", "tok_total")


def _value(v) -> str:
    return "NULL" if v is None else f"{v!r}D" if isinstance(v, float) else f"{v}L" if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'"


def _struct(**fields) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _choice(on: str, cases: dict[str, str], other: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {_value(k)} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _model() -> str:
    def entry(model_id, family, provider, p_in, p_out):
        return _struct(model_id=model_id, family=_value(family), provider=_value(provider), p_in=f"CAST({_value(p_in)} AS DOUBLE)", p_out=f"CAST({_value(p_out)} AS DOUBLE)")

    fits = "".join(f" WHEN lower(raw) RLIKE r'{pattern}' THEN {entry(_value(i), f, p, a, b)}" for pattern, i, f, p, a, b, _ in dims.MODELS)
    own = "CASE WHEN raw = '' THEN 'unknown' ELSE raw END"
    return f"CASE WHEN raw = {_value(dims.SYNTHETIC)} THEN {entry('raw', 'synthetic', 'unknown', 0.0, 0.0)}{fits} ELSE {entry(own, 'unknown', 'unknown', None, None)} END"


def _footprint() -> str:
    """Both bounds from the family's and the provider's figures, then the middle of each pair."""
    def bound(side: int) -> dict[str, str]:
        s, w = ("lo", "hi")[side], {k: f"{v[side]!r}D" for k, v in dims.WEIGHTS.items()}
        tokens = f"(output * {w['output']} + input * {w['input']} + cache_write * {w['cache_write']} + cache_read * {w['cache_read']})"
        size, place = f"usage_family(family).a_{s}", "usage_provider(provider)"
        servers = f"greatest(1D, CAST(ceil(usage_family(family).t_{s} * {dims.QUANT_BITS!r}D / 8 / {place}.mem) AS DOUBLE))"
        seconds = f"({tokens} * ({size} * {dims.LATENCY_A!r}D + {dims.LATENCY_B!r}D))"
        it = f"({tokens} * ({size} * {dims.ENERGY_A!r}D + {dims.ENERGY_B!r}D) + {seconds} / 3600 * {dims.SERVER_WATTS!r}D * {servers} / {dims.GPUS!r}D)"
        wh = f"({it} * {place}.pue_{s})"
        made = f"(({dims.SERVER_KG!r}D / {dims.GPUS!r}D + {dims.GPU_KG!r}D) * {servers} * ({seconds} / {dims.LIFE_S!r}D) * 1000)"
        return {"g": f"({wh} / 1000 * grid_g + {made})", "wh": wh, "l": f"({it} / 1000 * {place}.wue_{s} + {wh} / 1000 * {dims.OFFSITE[side]!r}D)"}

    low, high = bound(0), bound(1)
    return _struct(**{f"{k}_{x}": v for k in low for x, v in (("min", low[k]), ("mid", f"usage_mid({low[k]}, {high[k]})"), ("max", high[k]))})


def definitions(view: str = VIEW) -> list[tuple[str, str]]:
    """(signature, body) of each function, in the order of their use."""
    families = {k: _struct(t_lo=_value(v[0]), t_hi=_value(v[1]), a_lo=_value(v[2]), a_hi=_value(v[3])) for k, v in {**dims.FAMILIES, "synthetic": (0.0,) * 4}.items()}
    infra = {k: _struct(pue_lo=_value(v[0]), pue_hi=_value(v[1]), wue_lo=_value(v[2]), wue_hi=_value(v[3]), grid=_value(v[4]), mem=_value(v[5])) for k, v in dims.INFRA.items()}
    sources = {s: _struct(family=_value(f), grain=_value(g)) for s, f, g, _, _ in dims.SOURCES}
    longs = lambda *names: ", ".join(f"{n} BIGINT" for n in names)
    sums = ", ".join(f"sum({c}) AS {c}" for c in COUNTS)
    key = "CASE by WHEN 'model' THEN model WHEN 'project' THEN coalesce(project, 'sans projet') WHEN 'source' THEN source WHEN 'day' THEN date_format(timestamp_millis(ts_ms), 'yyyy-MM-dd') WHEN 'hour' THEN date_format(timestamp_millis(ts_ms), 'HH') END"
    paid = f"(input * p_in + output * p_out + cache_read * p_in * {dims.CACHE_READ!r}D + write_5m * p_in * {dims.CACHE_5M!r}D + write_1h * p_in * {dims.CACHE_1H!r}D) / 1e6D"
    return [
        ("usage_requests(n BIGINT) RETURNS BIGINT", "CASE WHEN n <> 0 THEN n ELSE 1 END"),
        (f"usage_weighted({longs('input', 'output', 'cache_write', 'cache_read')}) RETURNS DOUBLE", "input + output * 5D + cache_write * 1.25D + cache_read * 0.1D"),
        ("usage_mid(a DOUBLE, b DOUBLE) RETURNS DOUBLE", "CASE WHEN a > 0 AND b > 0 THEN sqrt(a * b) ELSE (a + b) / 2 END"),
        ("usage_grid(name STRING) RETURNS DOUBLE", _choice("name", {k: _value(v) for k, v in dims.GRIDS.items()}, _value(dims.GRIDS["us-average"]))),
        ("usage_model(raw STRING) RETURNS STRUCT<model_id: STRING, family: STRING, provider: STRING, p_in: DOUBLE, p_out: DOUBLE>", _model()),
        ("usage_family(name STRING) RETURNS STRUCT<t_lo: DOUBLE, t_hi: DOUBLE, a_lo: DOUBLE, a_hi: DOUBLE>", _choice("name", families, families["unknown"])),
        ("usage_provider(name STRING) RETURNS STRUCT<pue_lo: DOUBLE, pue_hi: DOUBLE, wue_lo: DOUBLE, wue_hi: DOUBLE, grid: STRING, mem: DOUBLE>", _choice("name", infra, infra["unknown"])),
        ("usage_source(name STRING) RETURNS STRUCT<family: STRING, grain: STRING>", _choice("name", sources, _struct(family="'unknown'", grain="'request'"))),
        (f"usage_cost({longs('input', 'output', 'cache_read', 'write_5m', 'write_1h')}, p_in DOUBLE, p_out DOUBLE, provider STRING) RETURNS DOUBLE", f"CASE WHEN p_in IS NULL AND provider = 'local' THEN 0D ELSE {paid} END"),
        (f"usage_footprint({longs('output', 'input', 'cache_write', 'cache_read')}, family STRING, provider STRING, grid_g DOUBLE) RETURNS STRUCT<{', '.join(f'{f}: DOUBLE' for f in FEET)}>", _footprint()),
        ("usage_window(seconds BIGINT) RETURNS STRING", """CASE WHEN seconds < 86400 THEN concat('session ', CAST(round(seconds / 3600D) AS INT), ' h') WHEN round(seconds / 86400D) = 1 THEN 'daily' WHEN round(seconds / 86400D) = 7 THEN 'weekly'
  WHEN round(seconds / 86400D) BETWEEN 28 AND 31 THEN 'monthly' ELSE concat(CAST(round(seconds / 86400D) AS INT), ' days') END"""),
        (f"usage_slices(by STRING, from_ms BIGINT, to_ms BIGINT) RETURNS TABLE(key STRING, model STRING, model_id STRING, {longs(*COUNTS, 'requests')}, cost DOUBLE, {', '.join(f'{f} DOUBLE' for f in FEET)})",
         f"""SELECT key, model, m.model_id, {', '.join(COUNTS)}, requests, usage_cost(tok_input, tok_output, tok_cache_read, tok_cw5m, tok_cw1h, m.p_in, m.p_out, m.provider), {', '.join(f'f.{x}' for x in FEET)}
  FROM (SELECT *, usage_footprint(tok_output, tok_input, tok_cache_write, tok_cache_read, m.family, m.provider, usage_grid(usage_provider(m.provider).grid)) AS f
    FROM (SELECT *, usage_model(model) AS m FROM (SELECT {key} AS key, model, {sums}, sum(usage_requests(requests)) AS requests FROM {view} WHERE ts_ms BETWEEN from_ms AND to_ms GROUP BY ALL)))"""),
        ("usage_windows(at_ms BIGINT) RETURNS TABLE(family STRING, session DOUBLE, week DOUBLE)",
         f"""SELECT family, sum(CASE WHEN recent THEN w ELSE 0D END), sum(w)
  FROM (SELECT usage_source(source).family AS family, ts_ms >= at_ms - 18000000 AS recent, usage_weighted(tok_input, tok_output, tok_cache_write, tok_cache_read) AS w
    FROM {view} WHERE usage_source(source).grain = 'request' AND ts_ms BETWEEN at_ms - 604800000 AND at_ms) GROUP BY family"""),
    ]


def register(spark: SparkSession, events: DataFrame, view: str = VIEW) -> None:
    """Define the functions in the session, the table-valued ones over `events`, which get the name `view`."""
    events.createOrReplaceTempView(view)
    for signature, body in definitions(view):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
