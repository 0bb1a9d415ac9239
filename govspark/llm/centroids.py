"""k-means over integer vectors with a VA-file.

1. Kept vectors become integers and are written once. Their count, mean, spread and range give each dimension a few cells.
2. The VA-file is a second table: a few bits per dimension, packed into bytes, beside the vector. Cells never change results,
   only how many vectors must be looked at.
3. A round adds up, byte by byte, two tables looked up by the packed cells: the least and the greatest squared distance that
   any vector of these cells has to every centroid. Where one centroid's greatest is below all others' least the vector is
   assigned unseen; else the vector is fetched and measured, exactly, against the centroids whose intervals overlap.
4. Every task adds up its vectors per centroid; only those sums are shuffled, and the new centroids (``k`` rows) are all that
   the driver holds. Arithmetic is on integers throughout, so reruns and other partitions agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from govspark.llm.common import over_batches, stored, table
from govspark.runtime import local_frame

#: Squared distances of vectors whose components are below this in size fit 64 bits (for up to 128 components).
LARGEST = 1 << 27
_SUMS = "cluster int, n long, sums array<long>"


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids in ``rounds`` rounds over vectors of ``dims`` components times ``scale``; cells of ``bits`` bits (a
    divisor of 8); ``seed`` picks the first centroids; ``rows`` vectors are worked on at once."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: int = 2
    bits: int = 4
    rows: int = 4096

    @property
    def per_byte(self) -> int:
        return 8 // self.bits

    @property
    def width(self) -> int:
        """Bytes of a vector's cells."""
        return -(-self.dims // self.per_byte)


def _integers(how: Clustering):
    """Kept vectors of a batch as little-endian 32-bit integers."""

    def run(batch: pa.RecordBatch):
        rows = batch.column("embedding")
        right = pc.fill_null(pc.equal(pc.list_value_length(rows), how.dims), False)
        ids, rows = batch.column("vec_id").filter(right), rows.filter(right)
        flat = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, how.dims)
        whole = np.floor(flat * how.scale)
        kept = (np.abs(whole) < LARGEST).all(axis=1)  # false for NaN, which also stands for null, and for infinities
        if kept.any():
            yield {"vec_id": ids.filter(pa.array(kept)), "vector": [v.tobytes() for v in whole[kept].astype("<i4")]}

    return run


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Equal binaries of a column as the rows of an array, without copying them one by one."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data.view(dtype).reshape(len(column), width)


def _over_task(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for functions from all batches of a task to dicts of columns."""
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _spread(how: Clustering):
    """Of a task's vectors, per dimension: count, sum, sum of squares, least and greatest."""

    def run(batches):
        n, total, square = 0, np.zeros(how.dims), np.zeros(how.dims)
        low, high = np.full(how.dims, LARGEST), np.full(how.dims, -LARGEST)
        for batch in batches:
            v = _matrix(batch.column("vector"), "<i4", how.dims)
            if len(v):
                n, total, square = n + len(v), total + v.sum(axis=0, dtype=np.float64), square + (v.astype(np.float64) ** 2).sum(axis=0)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        if n:
            yield {"dim": np.arange(how.dims, dtype=np.int32), "n": np.full(how.dims, n), "total": total, "square": square, "low": low, "high": high}

    return run


def cell_limits(vectors: DataFrame, how: Clustering) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest integer of every cell of every dimension; cells hold equal shares of a normal distribution."""
    spread = _over_task(vectors.select("vector"), _spread(how), "dim int, n long, total double, square double, low long, high long")
    rows = spread.groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "total", "square")), F.min("low").alias("low"), F.max("high").alias("high")) \
        .orderBy("dim").collect()
    if not rows:
        return None
    n, total, square, low, high = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("n", "total", "square", "low", "high"))
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean ** 2, 0))
    cells = 1 << how.bits
    inner = [NormalDist().inv_cdf(i / cells) for i in range(1, cells)]
    # First integers of the cells behind the first one; all of them inside the range, so that every cell has limits.
    starts = np.clip(np.ceil(mean[:, None] + deviation[:, None] * np.array(inner)), low[:, None], high[:, None] + 1).astype(np.int64)
    low, high = low.astype(np.int64)[:, None], high.astype(np.int64)[:, None]
    return np.concatenate((low, starts), axis=1), np.concatenate((starts - 1, high), axis=1)


def _approximations(how: Clustering, lows: np.ndarray):
    """The packed cells of a batch of vectors, beside them."""

    def run(batch: pa.RecordBatch):
        v = _matrix(batch.column("vector"), "<i4", how.dims)
        packed = np.zeros((len(v), how.width), dtype=np.uint8)
        for d in range(how.dims):
            cell = np.searchsorted(lows[d, 1:], v[:, d], side="right").astype(np.uint8)
            packed[:, d // how.per_byte] |= cell << np.uint8(how.bits * (d % how.per_byte))
        yield {"vec_id": batch.column("vec_id"), "cells": [row.tobytes() for row in packed], "vector": batch.column("vector")}

    return run


def distance_tables(centroids: np.ndarray, lows: np.ndarray, highs: np.ndarray, how: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance by (byte of cells, its value, centroid)."""
    low, high, at = lows[:, :, None], highs[:, :, None], centroids.T[:, None, :]
    near = np.maximum(np.maximum(low - at, at - high), 0) ** 2
    far = np.maximum(np.abs(at - low), np.abs(high - at)) ** 2
    values = np.arange(256)
    out = []
    for one in (near, far):
        whole = np.zeros((how.width, 256, len(centroids)), dtype=np.int64)
        for d in range(how.dims):
            cell = (values >> (how.bits * (d % how.per_byte))) & ((1 << how.bits) - 1)
            whole[d // how.per_byte] += one[d][cell]
        out.append(whole)
    return out[0], out[1]


class Assigner:
    """Nearest centroids of vectors given with their cells; ``fetched`` counts the vectors that were looked at."""

    def __init__(self, centroids: np.ndarray, lows: np.ndarray, highs: np.ndarray, how: Clustering):
        self.centroids, self.how, self.fetched = centroids, how, 0
        self.near, self.far = distance_tables(centroids, lows, highs, how)

    def assign(self, cells: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of every row, ties to the smaller number."""
        least = np.zeros((len(cells), len(self.centroids)), dtype=np.int64)
        most = np.zeros_like(least)
        for b in range(self.how.width):
            least += self.near[b][cells[:, b]]
            most += self.far[b][cells[:, b]]
        open_to = least <= most.min(axis=1)[:, None]
        out = open_to.argmax(axis=1).astype(np.int32)
        unsure = np.flatnonzero(open_to.sum(axis=1) > 1)
        self.fetched += len(unsure)
        for i in range(0, len(unsure), 256):
            rows = unsure[i:i + 256]
            who, which = np.nonzero(open_to[rows])
            exact = np.full((len(rows), len(self.centroids)), np.iinfo(np.int64).max)
            exact[who, which] = self.distance(vectors[rows[who]], which)
            out[rows] = exact.argmin(axis=1)
        return out

    def distance(self, vectors: np.ndarray, clusters: np.ndarray) -> np.ndarray:
        return ((vectors.astype(np.int64) - self.centroids[clusters]) ** 2).sum(axis=1)


def _parts(batches: Iterator[pa.RecordBatch], how: Clustering):
    for batch in batches:
        for i in range(0, batch.num_rows, how.rows):
            part = batch.slice(i, how.rows)
            yield part, _matrix(part.column("cells"), "u1", how.width), _matrix(part.column("vector"), "<i4", how.dims)


def _sums(centroids: np.ndarray, limits, how: Clustering):
    """Count and componentwise sum of the task's vectors of every centroid that has any."""

    def run(batches):
        assigner = Assigner(centroids, *limits, how)
        n, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for _, cells, vectors in _parts(batches, how):
            clusters = assigner.assign(cells, vectors)
            order = np.argsort(clusters, kind="stable")
            found, first = np.unique(clusters[order], return_index=True)
            sums[found] += np.add.reduceat(vectors[order].astype(np.int64), first, axis=0)
            n += np.bincount(clusters, minlength=len(centroids))
        used = np.flatnonzero(n)
        if len(used):
            yield {"cluster": used.astype(np.int32), "n": n[used], "sums": list(sums[used])}

    return run


def _assigned(centroids: np.ndarray, limits, how: Clustering):
    def run(batches):
        assigner = Assigner(centroids, *limits, how)
        for part, cells, vectors in _parts(batches, how):
            clusters = assigner.assign(cells, vectors)
            yield {"vec_id": part.column("vec_id"), "cluster": clusters, "distance": assigner.distance(vectors, clusters)}

    return run


def _moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The centroids after a round: the floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    parts = sums.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    rows = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def clustered(df: DataFrame, how: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept row of ``df`` (vec_id, embedding), and the final centroids.

    Rows whose embedding is null, of another length, or holds null or non-finite components, or components too large for
    64-bit distances (2**27 once scaled), take no part. Rows that repeat a vec_id are vectors of their own; a null vec_id is
    hashed as nothing. The first centroids are the rows of smallest SHA-256 of ``seed:vec_id``, equal ones by their bytes;
    all rows, if there are fewer than ``k``. An empty table gives an empty result. Other columns are not read."""
    spark = df.sparkSession
    vectors = stored(over_batches(df.select("vec_id", "embedding"), _integers(how), "vec_id long, vector binary"), "vectors")
    name = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(name.alias("name"), "vector").orderBy("name", F.hex("vector")).limit(how.k).collect()
    limits = cell_limits(vectors, how)
    if not first or limits is None:
        return local_frame(spark, [], "vec_id long, cluster int, distance long"), np.empty((0, how.dims), dtype=np.int64)
    centroids = np.array([np.frombuffer(r["vector"], "<i4") for r in first], dtype=np.int64)
    file = stored(over_batches(vectors, _approximations(how, limits[0]), "vec_id long, cells binary, vector binary"), "va_file")
    for _ in range(how.rounds):
        centroids = _moved(centroids, _over_task(file.select("cells", "vector"), _sums(centroids, limits, how), _SUMS))
    return stored(_over_task(file, _assigned(centroids, limits, how), "vec_id long, cluster int, distance long"), "clusters"), centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    rows = [(i, inertia.get(i, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = local_frame(spark, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
