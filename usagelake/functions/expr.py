"""Column builders: keys, cost, weighted usage and the footprint model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
TOKENS = ("tok_input", "tok_output", "tok_cache_write", "tok_cw5m", "tok_cw1h", "tok_cache_read", "tok_thinking", "tok_total")


def local_time(ts_ms: str, tz: str = "UTC") -> Column:
    """Wall-clock time of an epoch-millisecond column in a zone, whatever the session's zone."""
    at = f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({ts_ms} AS DECIMAL(18,3)) / 1000)"
    return F.expr(f"convert_timezone('UTC', '{tz}', {at})") if tz != "UTC" else F.expr(at)


def day_key(ts_ms: str = "ts_ms", tz: str = "UTC") -> Column:
    return F.date_format(F.to_date(local_time(ts_ms, tz)), "yyyy-MM-dd")


def hour_key(ts_ms: str = "ts_ms", tz: str = "UTC") -> Column:
    return F.hour(local_time(ts_ms, tz))


def requests(col: str = "requests") -> Column:
    """A count of 0 stands for one request."""
    return F.when(F.col(col) != 0, F.col(col)).otherwise(F.lit(1))


def cost() -> Column:
    """USD of the token columns at p_in and p_out per million; null if the price is unknown."""
    paid = (
        F.col("tok_input") * F.col("p_in") + F.col("tok_output") * F.col("p_out")
        + F.col("tok_cache_read") * F.col("p_in") * dims.CACHE_READ
        + F.col("tok_cw5m") * F.col("p_in") * dims.CACHE_5M + F.col("tok_cw1h") * F.col("p_in") * dims.CACHE_1H
    ) / 1e6
    return F.when(F.col("p_in").isNull() & (F.col("provider") == "local"), F.lit(0.0)).otherwise(paid)


def cost_without_cache() -> Column:
    seen = F.col("tok_input") + F.col("tok_cache_read") + F.col("tok_cache_write")
    return (seen * F.col("p_in") + F.col("tok_output") * F.col("p_out")) / 1e6


def weighted(prefix: str = "tok_") -> Column:
    """Usage as rate limits weigh it."""
    t = lambda n: F.col(prefix + n)
    return t("input") + t("output") * 5.0 + t("cache_write") * 1.25 + t("cache_read") * 0.1


def mid(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.sqrt(a * b)).otherwise((a + b) / 2)


def pinned(lo: str, hi: str) -> Column:
    return mid(F.col(lo), F.col(hi))


def weights(side: int) -> dict[str, Column]:
    return {k: F.lit(v[side]) for k, v in dims.WEIGHTS.items()}


def bound(side: int, params=None, token_weights=None, pue: Column | None = None, mix: Column | None = None) -> dict[str, Column]:
    """One bound of the footprint: n, latency, IT energy, energy, embodied and total grams, water; grid_g is the mix unless one is given."""
    s = ("lo", "hi")[side]
    total, active = params or (F.col(f"pt_{s}"), F.col(f"pa_{s}"))
    w = token_weights or weights(side)
    n = F.greatest(F.lit(1.0), F.ceil(total * dims.QUANT_BITS / 8 / F.col("mem")).cast("double"))
    eq = sum((F.col(f"tok_{k}") * w[k] for k in ("input", "cache_write", "cache_read")), F.col("tok_output") * w["output"])
    latency = eq * (active * dims.LATENCY_A + dims.LATENCY_B)
    it = eq * (active * dims.ENERGY_A + dims.ENERGY_B) + latency / 3600 * dims.SERVER_WATTS * n / dims.GPUS
    energy = it * (F.col(f"pue_{s}") if pue is None else pue)
    embodied = (dims.SERVER_KG * n / dims.GPUS + dims.GPU_KG * n) * (latency / dims.LIFE_S) * 1000
    return {
        "n": n, "latency": latency, "energy": energy, "embodied": embodied,
        "grams": energy / 1000 * (F.col("grid_g") if mix is None else mix) + embodied,
        "water": it / 1000 * F.col(f"wue_{s}") + energy / 1000 * dims.OFFSITE[side],
    }


def footprint(**how) -> dict[str, Column]:
    """min, mid and max of grams, energy and water."""
    lo, hi = bound(0, **how), bound(1, **how)
    out = {}
    for name, key in (("g", "grams"), ("wh", "energy"), ("l", "water")):
        out |= {f"{name}_min": lo[key], f"{name}_mid": mid(lo[key], hi[key]), f"{name}_max": hi[key]}
    return out
