"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample of vectors is cut into parts of equal size
with few edges between them.  A small network learns from it in which parts the
neighbours of a vector lie; it files every vector under its most probable part and
sends a query to several.  Within these parts all distances are computed.  The
number of parts probed is calibrated on sample vectors that the network has not seen;
a query whose parts hold too few rows goes on to the next ones in its order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mirrorframe.llm.frames import written

#: Sampled vectors that the partition is learned from, at most; rows that a part shall have about; parts at most.
SAMPLE, PART_ROWS, MAX_PARTS = 4096, 2048, 256
#: Edges of each node of the neighbour graph; share of true neighbours that the calibrated probes must reach.
EDGES, REACH = 10, 0.95
#: Vectors and queries in one tile of work.
TILE_ROWS, TILE_QUERIES = 8192, 2048


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_in(x: np.ndarray, y: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Places in ``y`` of the k nearest of each row of ``x``, in blocks."""
    out, yy = [], (y**2).sum(axis=1)
    for a in range(0, len(x), 512):
        d = yy - 2 * x[a : a + 512] @ y.T
        if skip_self:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(n: int, i: np.ndarray, j: np.ndarray, rng) -> np.ndarray:
    """Two sides of equal size with few edges (i, j) between them: the median of the second eigenvector, then swaps."""
    degree = np.maximum(np.bincount(i, minlength=n) + np.bincount(j, minlength=n), 1e-9)
    root = np.sqrt(degree)
    top = root / np.linalg.norm(root)

    def spread(v):
        return np.bincount(i, weights=v[j], minlength=n) + np.bincount(j, weights=v[i], minlength=n)

    v = rng.standard_normal(n)
    for _ in range(80):
        v -= top * (top @ v)
        v = 0.5 * (v + spread(v / root) / root)
        v /= max(np.linalg.norm(v), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * spread(sign)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b), max(1, n // 20))
        swap = int((gain[a[:pairs]] + gain[b[:pairs]] > 2).sum())
        if not swap:
            break
        side[a[:swap]], side[b[:swap]] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int, rng) -> np.ndarray:
    """Part of each node of a neighbour graph (places of its neighbours), by repeated bisection; ``parts`` is a power of two."""
    label = np.zeros(len(graph), np.int64)
    i, j = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    done = 1
    while done < parts:
        split = np.zeros(len(graph), np.int64)
        for part in range(done):
            nodes = np.flatnonzero(label == part)
            place = np.full(len(graph), -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[i] >= 0) & (place[j] >= 0)
            split[nodes] = bisect(len(nodes), place[i[inside]], place[j[inside]], rng)
        label, done = label * 2 + split, done * 2
    return label


class Router:
    """A network with one hidden layer that gives each part a probability."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng, hidden: int = 128, epochs: int = 60, rate: float = 3e-3):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        d, m = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, m)) * np.sqrt(1 / hidden), np.zeros(m)]
        z = (x - self.mean) / self.scale
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 256):
                b = order[a : a + 256]
                h = np.maximum(z[b] @ self.w[0] + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                g = (p - target[b]) / len(b)
                back = (g @ self.w[2].T) * (h > 0)
                step += 1
                for w, m1, m2, d_ in zip(self.w, first, second, (z[b].T @ back, back.sum(0), h.T @ g, g.sum(0)), strict=True):
                    m1 += 0.1 * (d_ - m1)
                    m2 += 0.001 * (d_**2 - m2)
                    w -= rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(s):
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts from the most to the least probable."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def learn(x: np.ndarray, parts: int, k: int, seed: int = 3) -> tuple[Router | None, int]:
    """The router and the probes that reach ``REACH`` of the k nearest; (None, 1) for a single part."""
    if parts < 2 or len(x) < 4 * parts:
        return None, 1
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    test, fit = x[: len(x) // 5], x[len(x) // 5 :]
    graph = nearest_in(fit, fit, min(EDGES, len(fit) - 1), skip_self=True)
    label = balanced_parts(graph, parts, rng)
    target = np.zeros((len(fit), parts))
    np.add.at(target, (np.arange(len(fit)), label), 1)
    for c in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(fit)), label[graph[:, c]]), 1)
    router = Router(fit, target / target.sum(axis=1, keepdims=True), rng)
    filed = router.ranked(fit)[:, 0]
    near = filed[nearest_in(test, fit, min(k, len(fit)))]
    place = np.argsort(router.ranked(test), axis=1)  # the rank of each part
    needed = np.take_along_axis(place, near, axis=1) + 1
    probes = next(t for t in range(1, parts + 1) if (needed <= t).mean() >= REACH)
    return router, probes


def reached(ranked: np.ndarray, held: np.ndarray, probes: int, least: int) -> list[np.ndarray]:
    """The parts of each query: the first ``probes`` in its order, and further ones until they hold ``least`` rows or none is left."""
    enough = np.cumsum(held[ranked], axis=1) >= least
    needed = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, ranked.shape[1])
    return [r[: max(n, probes)].astype(np.int32) for r, n in zip(ranked, needed.tolist(), strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _top(query_ids, queries, ids, rows, k: int):
    """(query, id, distance) of the k nearest rows of each query, ties to the smaller id; the query's own id doesn't count.

    Rows of one id and one distance are one.
    """
    qq, rr = (queries**2).sum(axis=1), (rows**2).sum(axis=1)
    most = k + len(ids) - len(np.unique(ids))
    out = ([], [], [])
    for a in range(0, len(queries), 256):
        rough = qq[a : a + 256, None] + rr - 2 * queries[a : a + 256] @ rows.T
        slack = 1e-9 * (qq[a : a + 256] + rr.max())
        rough[query_ids[a : a + 256, None] == ids] = np.inf
        take = min(most, rough.shape[1])
        edge = np.partition(rough, take - 1, axis=1)[:, take - 1]
        for r in range(len(rough)):
            near = np.flatnonzero((rough[r] <= edge[r] + slack[r]) & np.isfinite(rough[r]))
            d = np.sqrt(((rows[near] - queries[a + r]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))
            again = (np.diff(ids[near][best]) == 0) & (np.diff(d[best]) == 0)
            best = best[np.concatenate([[True], ~again])[: len(best)]][:k]
            out[0].append(np.full(len(best), query_ids[a + r]))
            out[1].append(ids[near][best])
            out[2].append(d[best])
    return [np.concatenate(x) if x else np.zeros(0) for x in out]


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = SAMPLE, probes: int | None = None) -> DataFrame:
    """The k nearest found for each query: (query_id, rank, vec_id, score), score the Euclidean distance in double precision.

    Queries are the rows that ``is_query`` holds for; candidates all rows but those
    of the query's own id.  Ties go to the smaller id.  Rows without an id or with a
    vector that is not ``usable``, or not of the commonest length (ties: the longest), take
    no part.  Repeated rows are one.  Only fewer candidates than k in the whole table
    give fewer rows; no usable row gives none.

    ``sample`` bounds the rows that the partition is learned from (those of smallest
    hash); every row is indexed.  The parts grow in number with the table up to
    ``MAX_PARTS``; a part is dealt out in tiles of bounded rows and queries.
    """
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims, n = (size["size"], size["count"]) if size else (0, 0)
    rows = rows.filter(F.size("v") == dims)
    drawn = rows.select("v").orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()
    parts = 1
    while parts < MAX_PARTS and parts * PART_ROWS < n:
        parts *= 2
    parts = max(parts, 8 if len(drawn) >= 256 else 1)
    router, calibrated = learn(np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), dims), parts, k)
    probed = min(probes or calibrated, parts)
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def file(batches):
        router = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                part = router.ranked(x)[:, 0] if router else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "v", "q", "part"])

    single = rows.groupBy("id", "v").agg(F.max("q").alias("q"))
    filed = written(single.mapInArrow(file, "id LONG, v ARRAY<DOUBLE>, q BOOLEAN, part INT"), "filed")
    # ids that each part holds (at most MAX_PARTS numbers); an id of several rows counts in one part
    held = np.zeros(parts, np.int64)
    for part, count in filed.groupBy("id").agg(F.min("part").alias("part")).groupBy("part").count().collect():
        held[part] = count

    def route(batches):
        router = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                ranked = router.ranked(x) if router else np.zeros((len(x), 1), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached(ranked, held, probed, k + 1), pa.list_(pa.int32()))], names=["query_id", "v", "parts"])

    routed = written(filed.filter("q").select(F.col("id").alias("query_id"), "v").mapInArrow(route, "query_id LONG, v ARRAY<DOUBLE>, parts ARRAY<INT>"), "routed")
    asked = routed.select("query_id", "v", F.explode("parts").alias("part"))
    stored = filed.select("id", "v", "part")
    # of each part: how many tiles of rows and of queries (at most MAX_PARTS rows, so broadcast)
    tiles = F.broadcast(
        stored.groupBy("part").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("across"))
        .join(asked.groupBy("part").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("down")), "part")
    )
    hash_of = lambda c: F.xxhash64(F.lit(17), c)
    r = stored.join(tiles, "part").select("part", "id", "v", F.pmod(hash_of("id"), F.col("across").cast("long")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    q = asked.join(tiles, "part").select(F.col("part").alias("qpart"), "query_id", F.col("v").alias("qv"), F.pmod(hash_of("query_id"), F.col("down").cast("long")).cast("int").alias("qy"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across").cast("long") - 1)).alias("qx"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = left.column("id").to_numpy(), right.column("query_id").to_numpy()
        found = _top(query_ids, _matrix(right.column("qv").combine_chunks()), ids, _matrix(left.column("v").combine_chunks()), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = r.groupBy("part", "x", "y").cogroup(q.groupBy("qpart", "qx", "qy")).applyInArrow(search, "query_id LONG, vec_id LONG, score DOUBLE")
    best = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
