"""The factors behind a footprint, with their citations, as an annex that travels with the figures."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims

# Names of the sources, their publishers and of the factors.
#: id: (publisher, title, version; null if it was not recorded)
SOURCES = {
    "ecologits": ("EcoLogits (GenAI Impact)", "LLM inference methodology", None), "boavizta": ("Boavizta", "Manufacturing impact of servers and GPUs", None),
    "ademe": ("ADEME", "Base Carbone", None), "epaEgrid": ("U.S. Environmental Protection Agency", "eGRID", None), "ember": ("Ember", "Yearly Electricity Data", None),
    "derived": ("usagelake", "Derived from operation counts", "0.1.0"), "providerInfra": ("Amazon Web Services, Google, Microsoft", "Environmental reports of data centre operators", None),
    "waterFootprint": ("Li et al. (UC Riverside / UT Arlington), arXiv:2304.03271", "Making AI Less Thirsty", None),
    "providerPricing": ("Anthropic, OpenAI", "Public price lists", None), "inferredFromBehaviour": ("usagelake", "Estimated by analogy", "0.1.0"),
}
#: (factor, value, unit, source)
METHOD = (
    ("MODEL_QUANTIZATION_BITS", dims.QUANT_BITS, "bits", "ecologits"), ("GPU_ENERGY_ALPHA", dims.ENERGY_A, "Wh/token/B parameters", "ecologits"),
    ("GPU_ENERGY_BETA", dims.ENERGY_B, "Wh/token", "ecologits"), ("GPU_LATENCY_ALPHA", dims.LATENCY_A, "s/token/B parameters", "ecologits"),
    ("GPU_LATENCY_BETA", dims.LATENCY_B, "s/token", "ecologits"), ("GPU_MEMORY_GB", 80.0, "GB", "ecologits"), ("SERVER_GPU_COUNT", dims.GPUS, "GPU", "ecologits"),
    ("SERVER_POWER_W", dims.SERVER_WATTS, "W", "ecologits"), ("GPU_EMBODIED_GWP_KG", dims.GPU_KG, "kgCO2e/GPU", "boavizta"),
    ("SERVER_EMBODIED_GWP_KG", dims.SERVER_KG, "kgCO2e/server", "boavizta"), ("HARDWARE_LIFESPAN_S", dims.LIFE_S, "s", "boavizta"),
)
WEIGHT_NAMES = {"output": "output", "input": "input", "cache_write": "cacheWrite", "cache_read": "cacheRead"}
GRID_SOURCE = {"france": "ademe", "us-west": "epaEgrid", "us-east": "epaEgrid", "us-average": "epaEgrid"}
EQUIVALENT_SOURCE = "ademe"
GROUPS = ("method", "weights", "grid", "infrastructure", "water", "equivalents")
HEADER = ("groupe", "facteur", "valeur", "unite", "source", "citation", "version_figee", "reserve")
NOT_RECORDED = "version and date of consultation not recorded"
# End of fixed values.

#: What is to be said of a group's values.
CAVEATS = {
    "method": "fitted to open models on one kind of GPU", "weights": "no provider publishes it", "grid": "a yearly average, whatever the hour",
    "infrastructure": "of the provider's fleet, not of the site", "water": "bounds of published estimates", "equivalents": "an order of magnitude",
}

SCHEMA = "`group` string, key string, value string, unit string, source string"


def number(x: float) -> str:
    """A number without exponent or trailing zeros."""
    text = format(Decimal(repr(float(x))), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def span(lo: float, hi: float) -> str:
    return f"{number(lo)} – {number(hi)}"


def citations(spark: SparkSession) -> DataFrame:
    """(source, citation, pinned): publisher, title and version of each source, and a warning where it is not pinned."""
    rows = [(k, p, t, v) for k, (p, t, v) in SOURCES.items()]
    df = spark.createDataFrame(rows, "source string, publisher string, title string, version string")
    pinned = F.col("version").isNotNull()
    bits = [F.col("publisher"), F.col("title"), F.concat(F.lit("v"), "version"), F.when(~pinned, NOT_RECORDED)]
    return df.select("source", "publisher", F.concat_ws(", ", *bits).alias("citation"), pinned.alias("pinned"))


def unpinned_sources(spark: SparkSession) -> DataFrame:
    """Sources whose version is still to be recorded; an audited report has none."""
    return citations(spark).filter("NOT pinned").select("source", "citation")


def factor_table(spark: SparkSession, grid: str | None = None) -> DataFrame:
    """(group, key, value, unit, source, citation, pinned) of every constant in use, in order.

    With a grid, it alone is cited; without, all are, and each provider's default.
    """
    rows = [("method", k, number(v), u, s) for k, v, u, s in METHOD]
    rows += [("weights", WEIGHT_NAMES[k], span(*v), "output tokens", "derived") for k, v in dims.WEIGHTS.items()]
    rows += [("grid", k, number(v), "gCO2e/kWh", GRID_SOURCE.get(k, "ember")) for k, v in dims.GRIDS.items() if grid in (None, k)]
    for k, v in dims.INFRA.items():
        rows.append(("infrastructure", f"{k} PUE", span(*v[:2]), "ratio", "providerInfra"))
        rows.append(("infrastructure", f"{k} water on site", span(*v[2:4]), "L/kWh", "waterFootprint" if v[3] > 0 else "providerInfra"))
        if grid is None:
            rows.append(("infrastructure", f"{k} default grid", v[4], "zone", "providerInfra"))
    rows.append(("water", "OFFSITE_L_PER_KWH", span(*dims.OFFSITE), "L/kWh", "waterFootprint"))
    rows += [("equivalents", k, number(v), "gCO2e/unit", EQUIVALENT_SOURCE) for k, v in dims.EQUIVALENTS]
    ordered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {SCHEMA}")
    cited = ordered.join(F.broadcast(citations(spark)), "source", "left")  # a row for each source
    return cited.orderBy("ord").select("group", "key", "value", "unit", "source", F.coalesce("citation", F.concat(F.lit("unknown source: "), "source")).alias("citation"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


def by_group(spark: SparkSession, grid: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """(group, factors, unpinned): number of factors and the publishers whose versions are missing."""
    publisher = F.trim(F.get(F.split("publisher", r"[,(]"), F.lit(0)))
    known = (factor_table(spark, grid) if table is None else table).join(F.broadcast(citations(spark).select("source", "publisher")), "source", "left")
    return known.groupBy("group").agg(F.count("*").alias("factors"), F.array_sort(F.collect_set(F.when(~F.col("pinned"), publisher))).alias("unpinned"))


def methodology_cells() -> list[Column]:
    """Cells of a line of the methodology file; the last is what is to be said against the value."""
    caveats = F.create_map(*[F.lit(x) for pair in CAVEATS.items() for x in pair])
    reserve = F.concat_ws("; ", caveats[F.col("group")], F.when(~F.col("pinned"), NOT_RECORDED))
    return [F.col(c) for c in ("group", "key", "value", "unit", "source", "citation")] + [F.when(F.col("pinned"), "oui").otherwise("non"), reserve]


def in_use(models: DataFrame) -> DataFrame:
    """factor_table() with tok_total, the tokens whose footprint rests on each factor; factors that none rests on are left out.

    models: a row for each raw model (provider, own_grid, tok_total), as priced.  A grid is used where it is a provider's own.
    """
    spark = models.sparkSession
    whole = models.agg(F.sum("tok_total").alias("tok_total")).select(F.lit("*").alias("owner"), "tok_total")
    owners = whole.unionByName(models.groupBy(F.col("provider").alias("owner")).agg(F.sum("tok_total").alias("tok_total")))
    owners = owners.unionByName(models.groupBy(F.concat(F.lit("grid "), "own_grid").alias("owner")).agg(F.sum("tok_total").alias("tok_total")))
    of = spark.createDataFrame(owned(), "`group` string, key string, owner string")
    return factor_table(spark).join(F.broadcast(of), ["group", "key"]).join(owners.filter("tok_total > 0"), "owner").drop("owner")


def owned() -> list[tuple[str, str, str]]:
    """(group, key, owner) of each factor: a provider, a grid, or * for all use."""
    out = [("method", k, "*") for k, *_ in METHOD] + [("weights", WEIGHT_NAMES[k], "*") for k in dims.WEIGHTS] + [("grid", k, f"grid {k}") for k in dims.GRIDS]
    out += [("infrastructure", f"{k} {what}", k) for k in dims.INFRA for what in ("PUE", "water on site", "default grid")]
    return [*out, ("water", "OFFSITE_L_PER_KWH", "*"), *[("equivalents", k, "*") for k, _ in dims.EQUIVALENTS]]
