"""Centroid clustering on whole numbers with a table of pivot distances.

1. Every vector with all components is turned into whole numbers and packed into
   blocks, with its distances to a few fixed pivots, once.
2. A round measures the distances of the centroids to the pivots.  By the triangle
   inequality the difference of two distances to one pivot bounds the distance of
   vector and centroid from below.  A vector is measured against the centroid of
   the least bound, then against those alone whose bound does not pass the least
   distance found.  Measured distances are exact whole numbers.
3. Tasks add up the vectors of each cluster; only these sums, k rows of whole numbers,
   are merged and reach the driver, which divides them into the next centroids.

Pivots are chosen far from one another in a sample of ``PIVOT_SAMPLE`` vectors.  They
decide how many distances are measured, never the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm.frames import named, release_memory, written

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
PIVOTS, PIVOT_SAMPLE = 16, 512
#: Vectors in a block; a block of 64 components and 16 pivots takes 1.5 MB.
BLOCK_ROWS = 4096
#: Relative slack of bounds made of rounded square roots; far above their rounding.
SLACK = 1e-9


def largest_component(dims: int) -> int:
    """Whole components up to this size, as all of ``dims`` are, give squared distances within 64 bits."""
    return math.isqrt((2**63 - 1) // max(dims, 1)) // 2


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers; larger ones than squared distances allow are an error."""
    q = np.floor(scale * x.astype(np.float64))
    if q.size and np.abs(q).max() > largest_component(x.shape[-1]):
        raise ValueError(f"a component is beyond {largest_component(x.shape[-1]) // scale}: squared distances would not fit 64 bits")
    return q.astype(np.int64)


def squared(q: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``q`` to a point."""
    d = q - point
    return np.einsum("ij,ij->i", d, d)


def far_pivots(q: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``q``, each the farthest from those before; equal rows count once."""
    chosen = q[:1]
    least = squared(q, q[0]) if len(q) else np.zeros(0, np.int64)
    while len(chosen) < n and least.size and least.max() > 0:
        chosen = np.vstack([chosen, q[least.argmax()]])
        least = np.minimum(least, squared(q, chosen[-1]))
    return chosen


def pivot_distances(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.array([squared(q, p) for p in pivots], np.float64).reshape(len(pivots), len(q)).T)


def assign(q: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of every row of ``q`` and how many distances were measured for them.

    ``table`` are the rows' distances to the pivots.  Of equally near centroids the
    smallest number wins.
    """
    own = pivot_distances(centroids, pivots)
    bound = np.zeros((len(q), len(centroids)))
    for p in range(len(pivots)):
        gap = np.abs(table[:, p, None] - own[None, :, p]) - SLACK * (table[:, p, None] + own[None, :, p])
        np.maximum(bound, gap, out=bound)
    first = bound.argmin(axis=1)
    cluster, best = first.copy(), np.empty(len(q), np.int64)
    for c in range(len(centroids)):
        at = np.flatnonzero(first == c)
        best[at] = squared(q[at], centroids[c])
    measured = len(q)
    for c in range(len(centroids)):
        at = np.flatnonzero((first != c) & (bound[:, c] ** 2 <= best * (1 + SLACK)))
        d = squared(q[at], centroids[c])
        nearer = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
        cluster[at[nearer]], best[at[nearer]] = c, d[nearer]
        measured += len(at)
    return cluster, best, measured


def _kept(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, x) of the rows whose vector has ``dims`` components, all of them finite numbers."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(named(key).alias("key"), named(vector).cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == dims) & F.coalesce(finite, F.lit(False)))


def _matrix(rows, scale: int, dims: int) -> np.ndarray:
    return whole(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), dims), scale)


def pack(kept: DataFrame, pivots: np.ndarray, scale: int) -> DataFrame:
    """(keys, q, table) blocks: the keys, the whole components and the pivot distances of up to ``BLOCK_ROWS`` vectors."""
    keys = T.ArrayType(kept.schema["key"].dataType)
    schema = T.StructType([T.StructField("keys", keys), T.StructField("q", T.BinaryType()), T.StructField("table", T.BinaryType())])
    dims = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(at, BLOCK_ROWS)
                q = whole(rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                column = rows.column("key")
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column),
                    pa.array([q.astype(np.int32).tobytes()], pa.binary()), pa.array([pivot_distances(q, pivots).tobytes()], pa.binary()),
                ], names=["keys", "q", "table"])
        release_memory()

    return kept.mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch, dims: int, pivots: int):
    for k in range(batch.num_rows):
        q = np.frombuffer(batch.column("q")[k].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
        yield batch.column("keys")[k].values, q, np.frombuffer(batch.column("table")[k].as_buffer(), np.float64).reshape(len(q), pivots)


def next_centroids(blocks: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: the floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    k, dims = centroids.shape

    def run(batches):
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, q, table in _blocks(batch, dims, len(pivots)):
                cluster, _, _ = assign(q, table, centroids, pivots)
                for c in range(k):
                    own = q[cluster == c]
                    sums[c, :dims] += own.sum(axis=0)
                    sums[c, dims] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "sums"])
        release_memory()

    partial = blocks.select("q", "table", "keys").mapInArrow(run, "cluster INT, sums ARRAY<LONG>")
    cells = partial.select("cluster", F.posexplode("sums").alias("pos", "v")).groupBy("cluster", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    totals = [[0] * (dims + 1) for _ in range(k)]
    for r in cells.collect():  # k * (dims + 1) numbers
        totals[r["cluster"]][r["pos"]] = int(r["v"])
    return np.array([[v // t[dims] for v in t[:dims]] if t[dims] else c for t, c in zip(totals, centroids.tolist(), strict=True)], np.int64).reshape(k, dims)


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS,
                    seed: int = SEED, scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every vector, centroids) after ``rounds`` rounds and a last assignment.

    Vectors of another length, null, or with a null or non-finite component take no
    part.  Component x counts as ``floor(scale * x)``; beyond ``largest_component`` it is
    an error.  The first centroids are the vectors with the least sha256 of
    ``seed:key``, a null key written as nothing, equal ones in the order of their components;
    fewer vectors than ``k`` give fewer centroids.  Rows of one key are vectors of their
    own.  An empty table gives no rows and no centroids.  Other columns are not read.
    """
    kept = _kept(df, key, vector, dims)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    centroids = _matrix(kept.orderBy(digest, "x").limit(k).select("x").collect(), scale, dims)
    sample = _matrix(kept.orderBy(F.xxhash64("x"), "x").limit(PIVOT_SAMPLE).select("x").collect(), scale, dims)
    points = far_pivots(sample, pivots)
    blocks = written(pack(kept, points, scale), "vector-blocks")
    if len(centroids):
        for _ in range(rounds):
            centroids = next_centroids(blocks, centroids, points)

    def run(batches):
        for batch in batches:
            for keys, q, table in _blocks(batch, dims, len(points)):
                cluster, distance, _ = assign(q, table, centroids, points)
                yield pa.RecordBatch.from_arrays([keys, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["key", "cluster", "distance"])
        release_memory()

    schema = T.StructType([T.StructField("key", kept.schema["key"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return blocks.mapInArrow(run, schema).withColumnRenamed("key", key), centroids


def summarize(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with their cluster's inertia, the whole inertia, and the digest of their centroid."""
    assigned = written(assigned, "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")
    own = dict(assigned.groupBy("cluster").agg(total).collect())  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids.tolist()]
    facts = [(c, n, sum(own.values()), digests[c]) for c, n in sorted(own.items())]
    facts = assigned.sparkSession.createDataFrame(facts, "cluster INT, cluster_inertia LONG, inertia LONG, centroid_sha256 STRING")
    return assigned.join(F.broadcast(facts), "cluster").select(*[named(c) for c in assigned.columns], "cluster_inertia", "inertia", "centroid_sha256")
