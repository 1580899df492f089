"""Centroid clustering by ball k-means, in exact integer arithmetic.

A cluster is a ball: its centroid and the largest distance of a member.  After the
centroids have moved, a member x of cluster i can be as near to centroid j only if
distance(c_i, c_j) <= 2 * distance(x, c_i).  So

- centroid j is a neighbour of cluster i only if half their distance is at most the
  ball's radius; other centroids are compared with no member at all;
- members nearer to c_i than half the way to its nearest neighbour are the stable
  core and stay without a comparison;
- the other members lie in annuli between the half distances of the neighbours,
  sorted: a member of the m-th annulus is compared with the m nearest neighbours only.

All comparisons are of squared integers, so ties are exact.  A ball's radius after a
move is bounded by its old radius and the length of the move.

Each round reads the rows with their clusters, writes them with the new ones to the
shared folder, and adds them up: tasks sum by cluster, and the driver gets one row
for a cluster.

Defined results: vectors that are null, of another length, or with null or non-finite
components are dropped; fewer vectors than clusters give as many clusters as
vectors; null ids never begin a cluster before others, equal ids are ordered by
their vectors; repeated rows all count and are all returned; equal centroids leave all
members to the smaller number; components are held within a bound that no squared
distance overflows; sums stop at the largest long; columns other than the two named
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, table
from .vectors import finite, first_rows, floored, matrices, mean_floor, summed

LENGTH, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64


class Balls:
    """Centroids, and for each cluster its neighbours in order of distance."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray):
        self.centroids = centroids
        between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        self.near, self.apart = [], []
        for i, row in enumerate(between):
            order = np.argsort(row, kind="stable")
            order = order[order != i]
            # radius is a rounded bound: the slack only adds neighbours
            near = order[np.sqrt(row[order].astype(np.float64)) <= 2 * radius[i] * (1 + 1e-9) + 1e-6]
            self.near.append(near)
            self.apart.append(row[near])

    def move(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of the rows of x, which belong to `cluster` so far."""
        own = ((x - self.centroids[cluster]) ** 2).sum(1)
        to, best = cluster.copy(), own.copy()
        for i in np.unique(cluster):
            members = np.flatnonzero(cluster == i)
            annulus = np.searchsorted(self.apart[i], 4 * own[members], "right")  # 0: the stable core
            for m, j in enumerate(self.near[i]):
                on = members[annulus > m]
                if not len(on):
                    break
                d = ((x[on] - self.centroids[j]) ** 2).sum(1)
                better = (d < best[on]) | ((d == best[on]) & (j < to[on]))
                best[on[better]], to[on[better]] = d[better], j
        return to, best


def assigned(rows: DataFrame, balls: Balls, length: int) -> DataFrame:
    """rows (id, v, cluster) with the cluster of the nearest centroid and the squared distance to it."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<int>, cluster int, distance long"

    def run(batches):
        for batch in batches:
            old = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            to, distance = np.zeros(len(old), np.int32), np.zeros(len(old), np.int64)
            for first, x in matrices(batch, "v", length):
                part = slice(first, first + len(x))
                to[part], distance[part] = balls.move(x, old[part])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(to), pa.array(distance)], names=["id", "v", "cluster", "distance"])

    return rows.select("id", "v", "cluster").mapInArrow(run, schema)


def added_up(rows: DataFrame, length: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """Number of members, radius and componentwise sum of each cluster that has members."""
    names = ["cluster", "n", "far", *[f"s{i}" for i in range(length)]]

    def add(batches):
        n, far, total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, length), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            distance = batch.column("distance").to_numpy(zero_copy_only=False)
            if len(cluster) and cluster.max() >= len(n):
                more = cluster.max() + 1 - len(n)
                n, far, total = np.pad(n, (0, more)), np.pad(far, (0, more)), np.pad(total, ((0, more), (0, 0)))
            for first, x in matrices(batch, "v", length):
                own = cluster[first : first + len(x)]
                n += np.bincount(own, minlength=len(n))
                np.maximum.at(far, own, distance[first : first + len(x)])
                np.add.at(total, own, x)
        used = np.flatnonzero(n)
        if len(used):
            columns = [used.astype(np.int32), n[used], far[used], *total[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    schema = ", ".join(["cluster int", *[f"{c} long" for c in names[1:]]])
    sums = rows.select("v", "cluster", "distance").mapInArrow(add, schema)
    sums = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *[F.sum(c).alias(c) for c in names[3:]])
    return {r["cluster"]: (r["n"], float(np.sqrt(float(r["far"]))), np.array(r[3:], np.int64)) for r in sums.collect()}  # a row a cluster


def cluster(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", length: int = LENGTH, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """((id, v, cluster, distance) of each vector kept, the centroids)."""
    v = F.col(vector)
    kept = rows.filter((F.size(vector) == length) & finite(v)).select(F.col(vec_id).alias("id"), floored(v, scale).alias("v"))
    rank = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    centroids = first_rows(kept, clusters, rank.asc_nulls_last())
    nowhere = kept.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
    if not len(centroids):
        return nowhere, centroids
    # at first all rows are in one ball without an end
    radius = np.full(len(centroids), np.inf)
    found = cut(assigned(nowhere, Balls(centroids, radius), length))
    for _ in range(rounds):
        radius, moved = np.zeros(len(centroids)), centroids.copy()
        for i, (n, far, total) in added_up(found, length).items():
            moved[i] = mean_floor(total, n)
            radius[i] = far + np.sqrt(float(((moved[i] - centroids[i]) ** 2).sum()))
        centroids = moved
        found = cut(assigned(found, Balls(centroids, radius), length))
    return found, centroids


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(summed("distance").alias("d")).collect()}  # a row a cluster
    most, inertia = 2**63 - 1, sum(sums.values())
    each = [(i, min(sums.get(i, 0), most), min(inertia, most), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = found.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(named), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """Assignment of all vectors to the centroids cent{n}, and the centroids after it."""
    return f"""
apart{n} AS (SELECT r, c, sum((x - y) * (x - y)) AS d FROM cells JOIN cent{n} USING (j) GROUP BY r, c),
near{n} AS (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM apart{n} GROUP BY r),
mean{n} AS (SELECT m.c AS c, j, sum(x) AS s, count(*) AS n FROM near{n} JOIN cells USING (r) GROUP BY m.c, j),
cent{n + 1} AS (SELECT c, j, CAST(CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) / n END AS BIGINT) AS y FROM cent{n} LEFT JOIN mean{n} USING (c, j))"""


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS (SELECT r, j, v[j] AS x FROM kept, range(1, 65) t(j)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256(concat('1:', CAST(vec_id AS VARCHAR))), v) - 1 AS c FROM kept QUALIFY c < 16),
cent0 AS (SELECT c, j, x AS y FROM cells JOIN first USING (r)),
{_round(0)},
{_round(1)},
{_round(2)},
{_round(3)},
sha AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM cent3 GROUP BY c)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near3 JOIN kept USING (r) JOIN sha ON sha.c = m.c
"""
