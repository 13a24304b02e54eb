"""Clustering over pivot distances against plain Python on whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from mirrorframe.llm import centroids


def plain(rows, dims, k, rounds, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    points = [r[1] for r in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q, _ in kept]
        for c in range(len(points)):
            members = [q for (_, q, _), o in zip(kept, own, strict=True) if o == c]
            if members:
                points[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return [(i, *reversed(nearest(q))) for i, q, _ in kept], points


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_plain_rounds(spark, rng, partitions):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)) + 3 * rng.integers(0, 4, size=(300, 1)))]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(partitions)
    found, points = centroids.cluster_vectors(df, dims=6, k=5, rounds=4)
    want, expected = plain(rows, 6, 5, 4)
    assert points.tolist() == expected
    assert ordered(map(tuple, found.collect())) == ordered(want)


def test_odd_vectors_ties_and_repeats(spark):
    """Two equal first centroids: the second keeps its place, as ties go to the first and an empty cluster isn't moved."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, -1.0]), (None, [-0.0005, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.5, -0.5])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id LONG, embedding ARRAY<FLOAT>, cluster STRING, `a.b` INT")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (2, 4, 20):
        found, points = centroids.cluster_vectors(df, dims=2, k=k, rounds=3)
        want, expected = plain(rows, 2, k, 3)
        assert points.tolist() == expected
        assert ordered(map(tuple, found.collect())) == ordered(want)
    summed = centroids.summarize(found, points).toPandas()
    assert (summed["inertia"] == summed["distance"].sum()).all()
    assert (summed.groupby("cluster")["distance"].transform("sum") == summed["cluster_inertia"]).all()


def test_empty_table(spark):
    found, points = centroids.cluster_vectors(spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>"))
    assert points.shape == (0, 64)
    assert centroids.summarize(found, points).collect() == []


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="would not fit 64 bits"):
        centroids.cluster_vectors(df, dims=2)


def test_bounds_spare_distances_and_change_nothing(rng):
    """On vectors with clusters most distances are never measured; the result is that of measuring all."""
    q = (rng.integers(0, 20, size=(2000, 1)) * 5000 + rng.integers(-400, 400, size=(2000, 16))).astype(np.int64)
    points, pivots = q[:12], centroids.far_pivots(q[:200], 8)
    cluster, best, measured = centroids.assign(q, centroids.pivot_distances(q, pivots), points, pivots)
    all_of_them = np.array([centroids.squared(q, p) for p in points])
    assert (best == all_of_them.min(axis=0)).all() and (cluster == all_of_them.argmin(axis=0)).all()
    assert measured < 0.3 * all_of_them.size


def test_pivots_are_distinct_rows(rng):
    q = np.repeat(rng.integers(0, 9, size=(5, 3)), 4, axis=0).astype(np.int64)
    assert len(centroids.far_pivots(q, 16)) == len(np.unique(q, axis=0))
