"""Text sinks: the long export as CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, expr, factors
from ..operators import provenance, rollup
from . import text_sink

# The header of the long export.
HEADER = (
    "date", "source", "modele", "fournisseur", "projet", "requetes", "tokens_entree", "tokens_sortie", "cache_ecrit", "cache_lu",
    "tokens_total", "cout_usd", "cout_sans_cache_usd", "gco2e_min", "gco2e_median", "gco2e_max", "energie_wh", "eau_l",
)
# End of fixed values.


def csv_line(*cells: Column) -> Column:
    """One RFC 4180 line; cells with a semicolon are quoted too, null is an empty cell."""
    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.rlike(c, F.lit('[,";\n\r]')), quoted).otherwise(c)

    return F.concat_ws(",", *[cell(c) for c in cells])


def export_lines(events: DataFrame, start: int, end: int, tz: str = "UTC", **how) -> DataFrame:
    """`line`: the header, then one line for each (day, source, model, project), by day and then by falling tokens.

    Billed days that were measured are dropped before the period is cut out.  An
    unknown cost is an empty cell, never 0.  Costs have 6 decimals, footprints 3.
    """
    kept = rollup.period(provenance.dedupe(events), start, end)
    s = rollup.slices(kept, expr.day_key("ts_ms", tz), F.col("source"), F.coalesce("project", F.lit("")), **how)
    fixed = lambda c, n: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", c))
    bare = F.format_string("%.6f", F.coalesce("bare_cost", F.lit(0.0)))
    labels = F.create_map(*[F.lit(x) for pair in dims.LABELS.items() for x in pair])
    line = csv_line(
        F.col("key0"), F.col("key1"), F.coalesce(labels[F.col("model_id")], "model_id"), F.col("provider"), F.col("key2"), F.col("requests"), F.col("tok_input"), F.col("tok_output"),
        F.col("tok_cache_write"), F.col("tok_cache_read"), F.col("tok_total"), fixed("cost", 6), bare,
        *[fixed(c, 3) for c in ("g_min", "g_mid", "g_max", "wh_mid", "l_mid")],
    )
    body = s.select(F.lit(1).alias("part"), F.col("key0").alias("day"), "tok_total", "first_seq", line.alias("line"))
    head = events.sparkSession.createDataFrame([(0, "", 0, 0, ",".join(HEADER))], body.schema)
    return head.unionByName(body).orderBy("part", "day", F.desc("tok_total"), "first_seq").select("line")


def methodology_lines(spark: SparkSession, grid: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """`line`: the header, then one line for each factor of the table (all by default), with its citation and caveat."""
    table = factors.factor_table(spark, grid) if table is None else table.orderBy(F.array_position(F.lit(list(factors.GROUPS)), F.col("group")), "key")
    body = table.select(csv_line(*factors.methodology_cells()).alias("line"))
    body = body.withColumn("n", F.monotonically_increasing_id() + 1)
    head = spark.createDataFrame([(",".join(factors.HEADER), 0)], "line string, n long")
    return head.unionByName(body).orderBy("n").select("line")


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (line) as one text in the folder `path`: all of it or, if the job fails, what was there before."""
    text_sink.register(lines.sparkSession)
    lines.select("line").write.format("ordered_text").mode("overwrite").save(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Part files of `path`, in order; joined, they are the whole text."""
    lines.write.mode("overwrite").text(path)
