"""Sensitivity, uncertainty and everyday equivalents of the footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, expr
from .rollup import slices


def _pairs(events: DataFrame, **how) -> DataFrame:
    """Priced rows by raw model that have tokens."""
    return slices(events, F.lit(1), **how).filter("tok_total > 0")


def grid_sensitivity(events: DataFrame, grid: str | None = None) -> DataFrame:
    """(grid, g_min, g_mid, g_max, ratio): the same use under four mixes, against the reference total."""
    return grid_sensitivity_of(_pairs(events, grid=grid))


def grid_sensitivity_of(pairs: DataFrame) -> DataFrame:
    """grid_sensitivity() of priced rows by raw model.

    All are sums of one pass over the priced rows; the one row of sums is then unfolded.
    """
    kinds = ("g_min", "g_mid", "g_max")
    each = {k: expr.footprint(mix=F.lit(dims.GRIDS[k])) for k in dims.SENSITIVITY_GRIDS}
    sums = [F.sum(f[c]).alias(f"{i}_{c}") for i, f in enumerate(each.values()) for c in kinds]
    row = pairs.agg(F.sum("g_mid").alias("reference"), *sums).filter("reference IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(k).alias("grid"), *[F.col(f"{i}_{c}").alias(c) for c in kinds]) for i, k in enumerate(each)])
    return row.select("reference", F.explode(rows).alias("r")).select("r.*", F.when(F.col("reference") > 0, F.col("r.g_mid") / F.col("reference")).alias("ratio"))


def uncertainty(events: DataFrame, grid: str | None = None) -> DataFrame:
    """(lever, ratio): high over low when one assumption varies and the others are pinned."""
    return uncertainty_of(_pairs(events, grid=grid))


def uncertainty_of(pairs: DataFrame) -> DataFrame:
    """uncertainty() of priced rows by raw model, in one pass.

    PUE stays free in all levers but its own.
    """
    still = {k: F.lit((lo * hi) ** 0.5) for k, (lo, hi) in dims.WEIGHTS.items()}
    params = (expr.pinned("pt_lo", "pt_hi"), expr.pinned("pa_lo", "pa_hi"))
    size, weight = expr.footprint(token_weights=still), expr.footprint(params=params)
    side = {s: expr.footprint(params=params, token_weights=still, pue=F.col(f"pue_{s}"))["g_mid"] for s in ("lo", "hi")}
    pinned = [expr.footprint(params=params, token_weights=still, mix=F.lit(dims.GRIDS[k]))["g_mid"] for k in dims.SENSITIVITY_GRIDS]
    row = pairs.drop(*expr.footprint()).agg(
        F.sum(size["g_min"]).alias("model_lo"), F.sum(size["g_max"]).alias("model_hi"),
        F.sum(weight["g_min"]).alias("weights_lo"), F.sum(weight["g_max"]).alias("weights_hi"),
        F.sum(side["lo"]).alias("infra_lo"), F.sum(side["hi"]).alias("infra_hi"),
        F.least(*map(F.sum, pinned)).alias("grid_lo"), F.greatest(*map(F.sum, pinned)).alias("grid_hi"),
    )
    levers = F.array(*[
        F.struct(F.lit(k).alias("lever"), F.when(F.col(f"{k}_lo") > 0, F.col(f"{k}_hi") / F.col(f"{k}_lo")).alias("ratio")) for k in ("model", "weights", "grid", "infra")
    ])
    return row.select(F.explode(levers).alias("l")).select("l.*").filter("ratio IS NOT NULL")


def equivalents(grams: DataFrame) -> DataFrame:
    """(item, units) of one row with g_mid."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.lit(v).alias("g")) for k, v in dims.EQUIVALENTS]))
    return grams.select("g_mid", each.alias("e")).select("e.item", (F.col("g_mid") / F.col("e.g")).alias("units"))
