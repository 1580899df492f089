"""URL filters: rules first, then a path-template tree learned from ruled pages.

A rule is a host, a slash and a path prefix; it fits its host and all
subdomains.  Pages that a rule decides are the labelled pages.  For the others,
each host has a tree of path templates, grown level by level with grouped
counts: what all paths of a node share is skipped; under each node a segment
whose siblings are many and mostly rare is generalised into a wildcard; a node
with a single path is a leaf.  Sibling branches whose labels are alike are
merged, their counts pooled; a template is rejected if its purity, smoothed by
its parent's, is over one half.  The tree is as deep as its paths branch.
Every look-up goes by counted rows, so that a hot host, template or url is dealt
to many tasks.

Defined results: a null url, or one without `://`, has empty host and path, fits
no rule and gets the verdict of the whole corpus; an empty table gives an empty
result; rows repeat with their pages; columns named host, path, rule, template,
purity or verdict are replaced, all others are kept.  All of it is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import cut, spread_join, table, unused

RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)
#: A segment position is variable if it has more values than this under a node ...
VARIABLE_VALUES = 8
#: ... and fewer pages to a value than this on average.
VARIABLE_PAGES = 20.0
#: Labelled pages that a parent counts for in its children's purity.
PRIOR = 4.0
#: Siblings meet in bins of purity (on the arcsine scale, where its noise is even); neighbouring bins within so many
#: standard errors of each other are merged.
BINS, ALIKE = 16, 2.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(df: DataFrame, url: str) -> DataFrame:
    """df with host and path: what follows the first `://`, up to `?`, `#` or the end, split at its first `/`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + F.lit(3), F.length(u))).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 0)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - F.lit(1))).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def ruled(df: DataFrame, rules=RULES, out: str = "ruled") -> DataFrame:
    """df with the longest rule that fits its host and path, and in `out` that rule's verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn(out, verdict)


def _shared(a: Column, b: Column) -> Column:
    """Number of leading elements that the arrays a and b share."""
    at = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    return F.array_min(F.filter(at, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i == F.least(F.size(a), F.size(b)))))


def templates(paths: DataFrame) -> DataFrame:
    """Distinct (host, path, n, labelled, blocked) -> with up, the templates from the host down to the path's leaf."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    open_ = cut(paths.withColumn("_rest", segments).withColumn("_t", F.col("host")).withColumn("up", F.array("host")))
    keep = [*paths.columns, "up"]
    done = None
    while True:
        end = open_.filter("size(_rest) = 0").select(keep)
        done = end if done is None else done.unionByName(end)
        open_ = open_.filter("size(_rest) > 0")
        if open_.isEmpty():
            return done
        # the least and the greatest path of a node share what all of them share
        nodes = open_.groupBy("_t").agg(F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi"), F.count("*").alias("_k"))
        nodes = cut(nodes.select("_t", _shared(F.col("_lo"), F.col("_hi")).alias("_same"), "_k"))
        df = spread_join(open_, nodes, ["_t"], count="_k").drop("_k")
        begun = F.slice("_rest", F.lit(1), F.col("_same"))
        df = df.withColumn("_stem", F.when(F.col("_same") > 0, F.concat(F.col("_t"), F.lit("/"), F.array_join(begun, "/"))).otherwise(F.col("_t")))
        df = cut(df.withColumn("_s", F.get("_rest", F.col("_same"))).withColumn("_rest", F.slice("_rest", F.col("_same") + 2, F.size("_rest"))).drop("_same", "_t"))
        kids = df.groupBy("_stem", "_s").agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
        pages = F.sum(F.when(F.col("_s").isNotNull(), F.col("_n")))
        wild = kids.groupBy("_stem").agg(F.count("_s").alias("_values"), pages.alias("_pages"), F.sum("_k").alias("_k"))
        variable = (F.col("_values") > VARIABLE_VALUES) & (F.col("_pages") < F.col("_values") * VARIABLE_PAGES)
        wild = cut(wild.filter(variable).select("_stem", F.lit("*").alias("_wild"), "_k"))
        df = spread_join(df, wild, ["_stem"], outer=True, count="_k").drop("_k")
        below = F.when(F.col("_s").isNull(), F.col("_stem")).otherwise(F.concat(F.col("_stem"), F.lit("/"), F.coalesce("_wild", "_s")))
        df = df.withColumn("_t", below).withColumn("up", F.array_distinct(F.concat("up", F.array("_stem", "_t")))).drop("_s", "_wild", "_stem")
        open_ = cut(df)


def pooled(kids: DataFrame) -> DataFrame:
    """(_up, _node, _l, _b, _p) of sibling branches -> with _pl and _pb, the labelled and blocked pages of all alike siblings."""
    bin_ = F.least(F.floor(F.asin(F.sqrt(F.col("_b") / F.col("_l"))) * F.lit(BINS / (math.pi / 2))), F.lit(BINS - 1)).cast("int")
    kids = kids.withColumn("_bin", F.when(F.col("_l") > 0, bin_))
    told = kids.filter("_l > 0")
    bins = told.groupBy("_up", "_bin").agg(F.sum("_l").alias("_bl"), F.sum("_b").alias("_bb"), F.count("*").alias("_kids"))  # BINS a parent
    along = W.partitionBy("_up").orderBy("_bin")
    l0, b0 = F.lag("_bl").over(along), F.lag("_bb").over(along)
    share = (F.col("_bb") + b0) / (F.col("_bl") + l0)
    error = F.sqrt(share * (1 - share) * (1 / F.col("_bl") + 1 / l0))
    apart = F.coalesce(F.abs(F.col("_bb") / F.col("_bl") - b0 / l0) > ALIKE * error, F.lit(False))
    bins = bins.withColumn("_apart", apart.cast("int")).withColumn("_branch", F.sum("_apart").over(along))
    alike = W.partitionBy("_up", "_branch")
    bins = cut(bins.select("_up", "_bin", "_kids", F.sum("_bl").over(alike).alias("_pl"), F.sum("_bb").over(alike).alias("_pb")))
    told = spread_join(told, bins, ["_up", "_bin"], count="_kids").drop("_kids")
    return told.unionByName(kids.filter("_l = 0"), allowMissingColumns=True).drop("_bin")


def purity(grown: DataFrame) -> DataFrame:
    """(up, purity, paths): blocked part of the labelled pages of each leaf's branch, smoothed from the root down; the leaf's paths."""
    leaves = cut(grown.groupBy("up").agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"), F.count("*").alias("paths")))
    depth, whole = leaves.agg(
        F.coalesce(F.max(F.size("up")), F.lit(0)),
        (F.coalesce(F.sum("_b"), F.lit(0)) + PRIOR / 2) / (F.coalesce(F.sum("_l"), F.lit(0)) + PRIOR),
    ).first()
    open_ = leaves.withColumn("_p", F.lit(float(whole)))
    done = open_.filter(F.lit(False))
    for i in range(depth):
        done = done.unionByName(open_.filter(F.size("up") <= i))
        open_ = open_.filter(F.size("up") > i).withColumn("_node", F.get("up", F.lit(i)))
        up = F.get("up", F.lit(i - 1)) if i else F.lit("")
        kids = open_.withColumn("_up", up).groupBy("_up", "_node").agg(
            F.sum("_l").alias("_l"), F.sum("_b").alias("_b"), F.max("_p").alias("_p"), F.count("*").alias("_k")
        )
        own = F.when(F.col("_pl") > 0, (F.col("_pb") + PRIOR * F.col("_p")) / (F.col("_pl") + PRIOR)).otherwise(F.col("_p"))
        judged = cut(pooled(cut(kids)).select("_node", "_k", own.alias("_own")))
        open_ = cut(spread_join(open_, judged, ["_node"], count="_k").withColumn("_p", F.col("_own")).drop("_node", "_own", "_k"))
    return done.unionByName(open_).select("up", F.col("_p").alias("purity"), "paths")


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict, which replace columns of those names."""
    says, many = unused(pages, "_ruled"), unused(pages, "_pages")
    seen = ruled(host_and_path(pages.drop("rule", "template", "purity", "verdict"), url), rules, says)
    known = F.col(says).isNotNull()
    paths = seen.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(known).alias("labelled"), F.count_if(F.col(says) == "block").alias("blocked")
    )
    grown = cut(templates(paths))
    leaf = spread_join(grown.select("host", "path", "up", F.col("n").alias(many)), cut(purity(grown)), ["up"], count="paths")
    leaf = cut(leaf.select("host", "path", F.element_at("up", -1).alias("template"), "purity", many))
    return spread_join(seen, leaf, ["host", "path"], outer=True, count=many).withColumn(
        "verdict", F.coalesce(says, F.when(F.col("purity") > 0.5, "block").otherwise("allow"))
    ).drop(says, many)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
