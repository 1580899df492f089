"""Independent DuckDB SQL for the queries: building blocks as common table expressions."""

from __future__ import annotations

from ..functions import dims
from ..sources.driver_tables import MODEL_NAMES, NOW

DAY = 86_400_000


def lit(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v).upper() if isinstance(v, bool) else str(v)


def values(name: str, cols: str, rows) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


EV = """ev AS (SELECT event_id AS seq, event_type, user_id, epoch_us(ts) // 1000 AS ms, value, day(ts) AS dom,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events)"""
NAMES = "[" + ", ".join(f"'{m}'" for m in MODEL_NAMES) + "]"
U = EV + f""", s AS (SELECT *, CASE event_type WHEN 'click' THEN CASE WHEN dom % 5 = 0 THEN 'other-tool' ELSE 'claude-code' END
    WHEN 'view' THEN CASE WHEN dom % 7 = 0 THEN 'other-tool' ELSE 'codex-cli' END
    WHEN 'purchase' THEN 'anthropic-api' WHEN 'signup' THEN 'openai-api' END AS source FROM ev WHERE event_type <> 'error'),
u AS (SELECT seq, CASE WHEN source LIKE '%-api' THEN ms - ms % {DAY} ELSE ms END AS ts_ms, source, {NAMES}[(user_id % 12 + 1)::INT] AS model,
    CASE WHEN k % 10 <> 0 THEN 'proj-' || (user_id % 13) END AS project, CASE WHEN source NOT LIKE '%-api' THEN 's-' || user_id END AS session_id,
    v AS tok_input, v // 4 + k AS tok_output, k * 7 + CASE WHEN k % 4 = 0 THEN k * 3 ELSE 0 END AS tok_cache_write, k * 7 AS tok_cw5m,
    CASE WHEN k % 4 = 0 THEN k * 3 ELSE 0 END AS tok_cw1h, v * 10 * (k % 3) AS tok_cache_read, k AS tok_thinking,
    v + v // 4 + k + v * 10 * (k % 3) + k * 7 + CASE WHEN k % 4 = 0 THEN k * 3 ELSE 0 END AS tok_total,
    CASE WHEN source LIKE '%-api' THEN k % 5 ELSE 1 END AS requests, NULL::VARCHAR AS compacted FROM s)"""
Q = """q AS (SELECT seq, CASE k % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'anthropic-oauth' ELSE 'codex-cli' END AS source, ms AS ts_ms,
    CASE WHEN k % 3 = 2 THEN CASE WHEN user_id % 2 = 0 THEN '300min' ELSE '10080min' END ELSE CASE WHEN user_id % 2 = 0 THEN 'five_hour' ELSE 'weekly' END END AS kind,
    CASE WHEN k % 3 = 0 THEN 'rejected' ELSE 'ok' END AS status, CASE WHEN k % 10 = 0 THEN 0 ELSE ms + (user_id % 5) * 3600000 END AS resets_at_ms,
    CASE WHEN k % 3 = 0 THEN ['window', 'spend', 'weekly', 'unknown'][(k % 4 + 1)::INT] ELSE 'window' END AS cause,
    CASE WHEN k % 3 <> 0 THEN least(value, 100.0) END AS used_percent,
    CASE WHEN k % 3 = 2 THEN CASE WHEN user_id % 2 = 0 THEN 300.0 ELSE 10080.0 END END::DOUBLE AS window_minutes FROM ev WHERE event_type = 'error')"""
SRC = values("src", "source, fam, grain, authoritative, ord", dims.SOURCES)
F = SRC + """, f AS (SELECT u.*, coalesce(src.fam, 'unknown') AS fam, coalesce(src.grain, 'request') AS grain,
    strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, hour(make_timestamp(ts_ms * 1000)) AS hr, CASE WHEN requests <> 0 THEN requests ELSE 1 END AS req
    FROM u LEFT JOIN src USING (source))"""
D = """cov AS (SELECT DISTINCT fam, day FROM f WHERE grain = 'request'),
d AS (SELECT f.* FROM f LEFT JOIN cov USING (fam, day) WHERE NOT (f.grain = 'daily' AND cov.fam IS NOT NULL)),
dropped AS (SELECT f.* FROM f JOIN cov USING (fam, day) WHERE f.grain = 'daily')"""
M = ", ".join([
    values("reg", "pri, pattern, model_id, family, provider, p_in, p_out, context", [(i, *m) for i, m in enumerate(dims.MODELS)]),
    values("fams", "family, pt_lo, pt_hi, pa_lo, pa_hi", [(k, *v) for k, v in dims.FAMILIES.items()]),
    values("inf", "provider, pue_lo, pue_hi, wue_lo, wue_hi, own_grid, mem, own_grid_g", [(k, *v, dims.GRIDS[v[4]]) for k, v in dims.INFRA.items()]),
    values("grids", "grid, g", [(g, dims.GRIDS[g]) for g in dims.SENSITIVITY_GRIDS]),
    f"""m0 AS (SELECT n.model, arg_min({{'i': model_id, 'f': family, 'p': provider, 'a': p_in, 'b': p_out}}, pri) AS r
      FROM (SELECT DISTINCT model FROM u) n LEFT JOIN reg ON regexp_matches(lower(n.model), reg.pattern) GROUP BY n.model)""",
    f"""m1 AS (SELECT model, CASE WHEN model = '{dims.SYNTHETIC}' THEN model ELSE coalesce(r.i, CASE WHEN model = '' THEN 'unknown' ELSE model END) END AS model_id,
      CASE WHEN model = '{dims.SYNTHETIC}' THEN 'synthetic' ELSE coalesce(r.f, 'unknown') END AS family, coalesce(r.p, 'unknown') AS provider,
      CASE WHEN model = '{dims.SYNTHETIC}' THEN 0.0 ELSE r.a END AS p_in, CASE WHEN model = '{dims.SYNTHETIC}' THEN 0.0 ELSE r.b END AS p_out FROM m0)""",
    """m AS (SELECT m1.*, CASE WHEN family = 'synthetic' THEN 0.0 ELSE pt_lo END AS pt_lo, CASE WHEN family = 'synthetic' THEN 0.0 ELSE pt_hi END AS pt_hi,
      CASE WHEN family = 'synthetic' THEN 0.0 ELSE pa_lo END AS pa_lo, CASE WHEN family = 'synthetic' THEN 0.0 ELSE pa_hi END AS pa_hi,
      pue_lo, pue_hi, wue_lo, wue_hi, mem, own_grid_g FROM m1 LEFT JOIN fams USING (family) LEFT JOIN inf USING (provider))""",
])
COST = "((tok_input * p_in + tok_output * p_out + tok_cache_read * p_in * 0.1::DOUBLE + tok_cw5m * p_in * 1.25::DOUBLE + tok_cw1h * p_in * 2.0::DOUBLE) / 1e6::DOUBLE)"
BARE = "(((tok_input + tok_cache_read + tok_cache_write) * p_in + tok_output * p_out) / 1e6::DOUBLE)"
WEIGHT = "(tok_input + 5.0::DOUBLE * tok_output + 1.25::DOUBLE * tok_cache_write + 0.1::DOUBLE * tok_cache_read)"
TOK = ("tok_input", "tok_output", "tok_cache_write", "tok_cw5m", "tok_cw1h", "tok_cache_read", "tok_thinking", "tok_total")
SUMS = ", ".join(f"sum({t})::BIGINT AS {t}" for t in TOK) + ", sum(CASE WHEN requests <> 0 THEN requests ELSE 1 END)::BIGINT AS requests, count(*) AS events, min(seq) AS first_seq"


def mid(a: str, b: str) -> str:
    return f"(CASE WHEN {a} > 0 AND {b} > 0 THEN sqrt({a} * {b}) ELSE ({a} + {b}) / 2 END)"


def bound(side: int, pinned_params=False, pinned_weights=False, pue: str | None = None, grid: str = "grid_g") -> dict[str, str]:
    s = ("lo", "hi")[side]
    total, active = (mid("pt_lo", "pt_hi"), mid("pa_lo", "pa_hi")) if pinned_params else (f"pt_{s}", f"pa_{s}")
    w = {k: repr((v[0] * v[1]) ** 0.5 if pinned_weights else v[side]) + "::DOUBLE" for k, v in dims.WEIGHTS.items()}
    n = f"greatest(1.0::DOUBLE, ceil({total} * 4.0::DOUBLE / 8 / mem))"
    eq = f"(tok_output * {w['output']} + tok_input * {w['input']} + tok_cache_write * {w['cache_write']} + tok_cache_read * {w['cache_read']})"
    lat = f"({eq} * ({active} * 8.02e-4::DOUBLE + 2.23e-2::DOUBLE))"
    it = f"({eq} * ({active} * 8.91e-5::DOUBLE + 1.43e-3::DOUBLE) + {lat} / 3600 * 1000 * {n} / 8)"
    e = f"({it} * {pue or 'pue_' + s})"
    emb = f"((3000.0::DOUBLE * {n} / 8 + 143.0::DOUBLE * {n}) * ({lat} / 157680000.0::DOUBLE) * 1000)"
    return {"g": f"({e} / 1000 * {grid} + {emb})", "wh": e, "l": f"({it} / 1000 * wue_{s} + {e} / 1000 * {(1.2, 3.1)[side]}::DOUBLE)"}


def footprint(**how) -> dict[str, str]:
    lo, hi = bound(0, **how), bound(1, **how)
    return {f"{k}_{x}": e for k in ("g", "wh", "l") for x, e in (("min", lo[k]), ("mid", mid(lo[k], hi[k])), ("max", hi[k]))}


FOOT = ", ".join(f"{e} AS {k}" for k, e in footprint().items())
START, PREV = NOW - 15 * DAY, NOW - 30 * DAY


def slices(key: str, where: str = f"ts_ms BETWEEN {START} AND {NOW}", table: str = "d", name: str = "x") -> str:
    """CTE of priced rows by key and raw model."""
    return f"""{name}0 AS (SELECT {key} AS key, model, {SUMS} FROM {table} WHERE {where} GROUP BY 1, 2),
{name}1 AS (SELECT {name}0.*, m.* EXCLUDE (model), own_grid_g AS grid_g FROM {name}0 JOIN m USING (model)),
{name} AS (SELECT *, {COST} AS cost, {BARE} AS bare_cost, {FOOT} FROM {name}1)"""


def sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
