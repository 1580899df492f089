"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word of each of several full-dimensional codebooks.
Codebooks are fitted in turn to what the earlier ones leave (k-means on a
bounded sample) and vectors are encoded by beam search.  The norm of each sum is
stored with its codes, so a query's table of inner products scores every row by
look-ups; the best of each block of rows are merged and reranked exactly, in
double precision, on the original vectors.

Queries meet the rows in blocks: rows are encoded once and dealt into blocks,
and each block of queries is sent to each block of rows.  Equal vectors are
searched as one: it takes one place among the candidates and answers with its
smallest ids, so copies never crowd out other vectors.

Defined results: null vectors, zero vectors and vectors with null or non-finite
components neither ask nor answer; vectors are compared with those of their own
length, each length with codebooks of its own; rows with a null id take no part;
equal vectors tie and the smaller id is nearer; repeated ids are rows of their
own; components of any finite size neither overflow nor vanish; columns other than
the two named are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import cut, table

NEAREST = 5
EVERY = 50
#: Codebooks, words of each, paths kept while encoding, k-means rounds.
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 6
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8_000
#: Distinct vectors that are reranked exactly for a query, besides its own.
RERANK = 400
ROW_BLOCK, QUERY_BLOCK = 32_768, 1_024
SCORED = 256


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ words.T - 0.5 * (words**2).sum(1), axis=1)
        n = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(words))])
    return words


def fit_books(x: np.ndarray, books: int, words: int, rounds: int, seed: int = 5) -> np.ndarray:
    """(books, words, dimension) codebooks, each fitted to the residual of the ones before."""
    rng = np.random.default_rng(seed)
    left, out = x.astype(np.float32), []
    for _ in range(books):
        book = kmeans(left, words, rounds, rng)
        book = np.concatenate([book, np.zeros((words - len(book), x.shape[1]), np.float32)])
        left = left - book[np.argmax(left @ book.T - 0.5 * (book**2).sum(1), axis=1)]
        out.append(book)
    return np.stack(out).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the sums): at each book the `beam` best partial sums are kept."""
    n = len(x)
    left = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        cost = cost.reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        path, word = best // len(book), best % len(book)
        row = np.arange(n)[:, None]
        left = left[row, path] - book[word]
        codes = np.concatenate([codes[row, path], word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin((left**2).sum(2), axis=1)
    row = np.arange(n)
    total = x - left[row, best]
    return codes[row, best], (total**2).sum(1)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        on = np.flatnonzero(score >= edge)
    else:
        on = np.arange(len(score))
    return on[np.lexsort((ids[on], -score[on]))][:k]


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, row, v) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return df.filter(F.coalesce(fine, F.lit(False))).filter(F.exists("v", lambda x: x != 0.0)).withColumn("row", F.monotonically_increasing_id())


def distinct(known: DataFrame, most: int) -> DataFrame:
    """(vec_id, row, v, members) of each distinct vector: its `most` smallest (vec_id, row), the first of which names it."""
    known = known.withColumn("g", F.xxhash64("v"))
    least = W.partitionBy("g", "v").orderBy("vec_id", "row")  # Spark keeps `most` of each before it shuffles
    few = known.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= most)
    few = few.groupBy("g", "v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    return few.select(F.col("members")[0]["vec_id"].alias("vec_id"), F.col("members")[0]["row"].alias("row"), "v", "members")


def _scaled(column) -> np.ndarray:
    """Vectors of a column, each times a power of two that brings it near 1: cosines keep every bit, squares stay finite."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(column) -> np.ndarray:
    x = _scaled(column)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def nearest(
    rows: DataFrame, is_query, k: int = NEAREST, rerank: int = RERANK, vec_id: str = "vec_id", vector: str = "embedding",
    books: int = BOOKS, words: int = WORDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each row that is_query(vec_id) chooses.

    One search for each length that is asked for, so a table of very many lengths makes a long plan.
    """
    known = cut(valid(rows, vec_id, vector))
    asked = known.filter(is_query(F.col("vec_id"))).select(F.size("v").alias("n")).distinct().orderBy("n").collect()
    found = [nearest_alike(known.filter(F.size("v") == r["n"]), is_query, k, rerank, books, words) for r in asked]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def nearest_alike(known: DataFrame, is_query, k: int, rerank: int, books: int, words: int) -> DataFrame:
    """nearest() of the rows (vec_id, row, v), whose vectors have one length."""
    spark = known.sparkSession
    few = known.select("v").orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE)

    def learn(batches):
        x = _matrix(pd.concat([*batches])["v"])
        yield pd.DataFrame({"books": [pickle.dumps(fit_books(x, books, words, ROUNDS))]})

    shared = spark.sparkContext.broadcast(pickle.loads(few.coalesce(1).mapInPandas(learn, "books binary").first()["books"]))
    ids = cut(distinct(known, k + 1))  # the others of a vector's copies are never among the k nearest
    row_blocks = -(-ids.count() // ROW_BLOCK)

    def index(batches):
        for pdf in batches:
            for first in range(0, len(pdf), 1024):
                part = pdf[first : first + 1024]
                codes, norms = encode(_matrix(part["v"]).astype(np.float32), shared.value)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "row": part["row"].to_numpy(), "codes": [c.tobytes() for c in codes], "norm": norms})

    indexed = ids.mapInPandas(index, "vec_id long, row long, codes binary, norm float")
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int"))
    asks = known.filter(is_query(F.col("vec_id")))
    n_asks = asks.count()
    query_blocks = max(1, -(-n_asks // QUERY_BLOCK))
    asks = asks.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int"))
    sent = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).select("block", "q", "vec_id", "row", "v")
    coded = indexed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "row": [], "approx": []}
        if len(left) and len(right):
            right = right.sort_values(["vec_id", "row"])
            codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
            ids, place, norm = right["vec_id"].to_numpy(), right["row"].to_numpy(), np.sqrt(np.maximum(right["norm"].to_numpy(), 1e-12))
            x = _matrix(left["v"]).astype(np.float32)
            for first in range(0, len(x), SCORED):
                part = x[first : first + SCORED]
                score = np.zeros((len(part), len(right)), np.float32)
                for m, book in enumerate(shared.value):
                    score += (part @ book.T)[:, codes[:, m]]
                score /= norm
                for i, (s, own, own_id) in enumerate(zip(score, left["row"].iloc[first : first + SCORED], left["vec_id"].iloc[first : first + SCORED], strict=True)):
                    best = best_of(s, ids, rerank + 1)
                    out["query"].append(np.full(len(best), own))
                    out["query_id"].append(np.full(len(best), own_id))
                    out["row"].append(place[best])
                    out["approx"].append(s[best])
        return pd.DataFrame({n: np.concatenate(v) if v else [] for n, v in out.items()}).astype({"query": "int64", "query_id": "int64", "row": "int64", "approx": "float32"})

    found = sent.groupBy("block", "q").cogroup(coded.groupBy("block", "q")).applyInPandas(search, "query long, query_id long, row long, approx float")
    found = found.join(ids.select("row", "vec_id"), "row")
    top = W.partitionBy("query").orderBy(F.desc("approx"), "vec_id", "row")
    found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= rerank + 1).drop("n", "approx")
    pairs = found.join(ids.select("row", F.col("v").alias("b")), "row").join(asks.select(F.col("row").alias("query"), F.col("v").alias("a")), "query")

    def exact(batches):
        for pdf in batches:
            a, b = _scaled(pdf["a"]), _scaled(pdf["b"])
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pdf[["query", "query_id", "row", "vec_id"]].assign(score=score)

    scored = pairs.mapInPandas(exact, "query long, query_id long, row long, vec_id long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    # k + 1 vectors, the query's own perhaps among them, have k other rows
    scored = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("query", "query_id", "row", "score")
    members = scored.join(ids.select("row", F.explode("members").alias("m")), "row").select("query", "query_id", "score", "m.vec_id", "m.row")
    members = members.filter(F.col("row") != F.col("query"))
    return members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)
