import hashlib
import math

import numpy as np
import pytest

from govspark.llm import centroids as C
from govspark.llm.centroids import Assigner, Clustering, clustered
from govspark.runtime import local_frame

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, how):
    """k-means on Python integers: every vector against every centroid."""
    kept = [(i, [math.floor(how.scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == how.dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes().hex()))[:how.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(how.rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(column) // len(m) for column in zip(*m)] if m else c for m, c in zip(members, centroids)]
    return sorted((str(i), *nearest(v)[::-1]) for i, v in kept), centroids


def got(df, how):
    found, centroids = clustered(df, how)
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()), centroids.tolist()


@pytest.mark.parametrize("how", [Clustering(k=7, dims=5, rounds=3), Clustering(k=4, dims=6, bits=2, rounds=2, rows=16), Clustering(k=3, dims=3, bits=8),
                                 Clustering(k=3, dims=3, bits=1, rounds=0)])
def test_against_every_centroid(spark, how):
    rng = np.random.default_rng(how.k)
    rows = [(i, rng.normal(rng.integers(0, 3), 0.2, how.dims).round(2).tolist()) for i in range(200)]
    df = local_frame(spark, rows, SCHEMA).repartition(3)
    assert got(df, how) == plain(rows, how)


def test_awkward_rows(spark):
    how = Clustering(k=6, dims=2, rounds=4)
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]),
            (7, [-1.0, 3.0]), (None, [2.0, 2.0]), (None, [5.0, 5.0]), (8, [-0.0, 0.0]), (9, [1.0, 1.0]), (10, [1.0, -1.0]), (11, [-1.0, 1.0]),
            (12, [1000.0, -1000.0]), (13, [1.0, 1.0, 1.0])]
    df = local_frame(spark, rows, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS vector", "2 AS cells")
    assert got(df, how) == plain(rows, how)
    assert got(df, Clustering(k=50, dims=2)) == plain(rows, Clustering(k=50, dims=2))
    far = local_frame(spark, [(1, [1e30, 0.0]), (2, [1.0, 2.0])], SCHEMA)
    assert [r.vec_id for r in clustered(far, how)[0].collect()] == [2]
    for nothing in (df.limit(0), df.where("vec_id < 7")):
        found, centroids = clustered(nothing, how)
        assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 0 and len(centroids) == 0


def test_one_vector_holds_most_rows(spark):
    how = Clustering(k=5, dims=3, rounds=3)
    rng = np.random.default_rng(0)
    rows = [(i, [0.5, 0.5, 0.5] if i % 3 else rng.normal(size=3).tolist()) for i in range(300)]
    assert got(local_frame(spark, rows, SCHEMA).repartition(5), how) == plain(rows, how)


def test_intervals_hold_and_spare_fetches():
    """Every distance lies in its interval, and well apart groups are assigned by their cells alone."""
    how = Clustering(k=8, dims=16)
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (8, 16))
    v = (centres[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int32)
    edges = np.sort(np.concatenate((v.min(axis=0)[:, None], rng.integers(v.min(), v.max(), (16, 15)).clip(v.min(axis=0)[:, None], v.max(axis=0)[:, None])), axis=1), axis=1)
    lows, highs = edges, np.concatenate((edges[:, 1:] - 1, v.max(axis=0)[:, None]), axis=1)
    cell = np.stack([np.searchsorted(lows[d, 1:], v[:, d], side="right") for d in range(16)], axis=1)
    packed = (cell[:, 0::2] | (cell[:, 1::2] << 4)).astype(np.uint8)
    near, far = C.distance_tables(centres, lows, highs, how)
    least = sum(near[b][packed[:, b]] for b in range(8))
    most = sum(far[b][packed[:, b]] for b in range(8))
    exact = ((v[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    assigner = Assigner(centres, lows, highs, how)
    assert (assigner.assign(packed, v) == exact.argmin(axis=1)).all()
    assert assigner.fetched < len(v)
