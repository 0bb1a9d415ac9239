"""Approximate nearest neighbours by inner product: stable projections to a few dimensions, searched in kd-trees.

Largest inner product becomes smallest distance by one more coordinate: with M the largest norm, |(q, 0) - (x, sqrt(M² - |x|²))|²
= |q|² + M² - 2 q·x. A few Gaussian projections keep distances up to a chi-square factor: the squared projected distance over
the squared distance is chi-square with as many degrees of freedom. So candidates come in the order of projected distance,
each is verified on the original vectors, and the search stops as soon as a projected distance is so large that a nearer
neighbour than the k-th found would have come before with chance ``CONFIDENCE``.

Vectors are dealt by hash of their id to shards of bounded size, so repeated vectors spread evenly; every shard builds its
kd-tree and answers blocks of queries, and each query's shard answers are merged. A shard needs nothing but its own rows.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm.common import stored, table

PROJECTIONS = 8
#: Chance with which a true neighbour has been met when the search stops.
CONFIDENCE = 0.9
NEIGHBOURS = 20
#: Vectors per shard and queries per block, about.
SHARD, BLOCK = 8192, 1024
LEAF = 32


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable of that many degrees of freedom stays below with chance p."""
    def below(x: float) -> float:
        a, y, term, total = degrees / 2, x / 2, 1.0, 1.0
        for i in range(1, 1000):
            term *= y / (a + i)
            total += term
            if term < 1e-17 * total:
                break
        return total * exp(a * log(y) - y - lgamma(a + 1)) if y > 0 else 0.0

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected vectors: leaves of at most ``LEAF`` rows with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))] if len(points) else []
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            spread = np.ptp(points[rows], axis=0)
            axis, half = int(spread.argmax()), len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            stack += [rows[order[:half]], rows[order[half:]]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves]).reshape(len(self.leaves), points.shape[1])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves]).reshape(len(self.leaves), points.shape[1])

    def distances(self, query: np.ndarray) -> np.ndarray:
        """Squared distance from the query to each leaf's box."""
        out = np.maximum(self.low - query, 0) + np.maximum(query - self.high, 0)
        return (out * out).sum(axis=1)


def search(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
           query_points: np.ndarray, limit: float, k: int, quantile: float):
    """For each query its k best of the rows (best first, ties to smaller ids), and how many rows were verified.

    Leaves come in order of the projected distance of their boxes; a leaf's rows are verified together. ``limit`` is the
    squared largest norm; the stop test compares the next leaf with the k-th distance found so far."""
    tree = Tree(points)
    for q in range(len(query_ids)):
        box = tree.distances(query_points[q])
        order = np.argsort(box, kind="stable")
        best_ids, best = np.empty(0, dtype=np.int64), np.empty(0)
        own = float(queries[q] @ queries[q])
        seen, at, take = 0, 0, max(1, k // LEAF + 1)
        while at < len(order):
            if len(best) == k and box[order[at]] > quantile * max(own + limit - 2 * best[-1], 0.0):
                break
            rows = np.concatenate([tree.leaves[i] for i in order[at:at + take]])
            at, take = at + take, min(2 * take, 16)
            rows = rows[ids[rows] != query_ids[q]]
            seen += len(rows)
            best_ids = np.concatenate((best_ids, ids[rows]))
            # Each product is summed by itself, so its value does not depend on which rows are verified together.
            best = np.concatenate((best, np.einsum("ij,j->i", vectors[rows], queries[q])))
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
        yield best_ids, best, seen


def neighbours(df: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, confidence: float = CONFIDENCE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score, verified: for every row of ``queries`` its k rows of ``df`` of largest inner product.

    Both have vec_id and embedding. A row is no candidate of its own id. Vectors that are null, zero, without components, of
    another length than most, or hold null or non-finite components take no part, nor do rows without vec_id. If an id
    repeats, the row of the smallest vector counts. Without candidates there are no rows."""
    spark = df.sparkSession
    usable = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors, asked = stored(usable(df), "vectors"), stored(usable(queries), "queries")
    sizes = vectors.groupBy(F.size("vector").alias("width")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("top"))
    shape = sizes.orderBy(F.desc("n"), "width").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    width, limit = shape["width"], shape["top"]
    quantile = chi_square_quantile(confidence, PROJECTIONS)
    shards = ceil(shape["n"] / SHARD)
    blocks = ceil(asked.count() / BLOCK) or 1
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    side = lambda d, is_query, shard, block: d.where(F.size("vector") == width).select(
        F.lit(is_query).alias("is_query"), "vec_id", "vector", shard.alias("shard"), block.alias("block"))
    rows = side(vectors, False, place(shards), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).union(
        side(asked, True, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), place(blocks)))

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        axes = np.random.default_rng(seed).standard_normal((width + 1, PROJECTIONS))
        is_query = part["is_query"].to_numpy(dtype=bool)
        ids, data = part["vec_id"].to_numpy(dtype=np.int64), np.stack(part["vector"].to_numpy())
        rows, asked_ids, asked = data[~is_query], ids[is_query], data[is_query]
        rest = np.sqrt(np.maximum(limit - (rows * rows).sum(axis=1), 0))
        points = rows @ axes[:-1] + rest[:, None] * axes[-1]
        found = search(ids[~is_query], rows, points, asked_ids, asked, asked @ axes[:-1], limit, k, quantile)
        out = [(q, i, s, seen) for q, (best, scores, seen) in zip(asked_ids, found) for i, s in zip(best.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64", "verified": "int64"})

    met = rows.groupBy("shard", "block").applyInPandas(answer, "query_id long, vec_id long, score double, verified long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"))
