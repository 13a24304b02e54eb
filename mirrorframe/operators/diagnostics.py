"""Quality of a table ``(key, x, xk)`` of features and knockoffs.

The three criteria of Romano, Sesia and Candes, "Deep Knockoffs" (2018), as
aggregates: second moments, decorrelation and the kernel distance under swaps;
each on its own, or all in one pass (``quality``).
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions import draws, ranges
from mirrorframe.functions.trimscan import add_moments, moments_of
from mirrorframe.functions.vectors import batch_matrix
from mirrorframe.operators.moments import mean_and_cov, merge_in_levels, vector_table
from mirrorframe.operators.sample import ROWS_PER_RANGE, neighbour_pairs

# Default kernel widths of the distance.
ALPHAS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)


def second_order_gap(pairs: DataFrame, x: str = "x", xk: str = "xk") -> DataFrame:
    """Distance of means, of covariances, and of the cross-covariance off the diagonal (one scan)."""
    _, mean, cov = mean_and_cov(pairs.select(F.concat(x, xk).alias("z")), "z")
    return _gap_table(pairs.sparkSession, mean, cov)


def _gap_table(spark: SparkSession, mean: np.ndarray, cov: np.ndarray) -> DataFrame:
    p = mean.size // 2
    cross = cov[:p, :p] - cov[:p, p:]
    np.fill_diagonal(cross, 0.0)
    row = (np.linalg.norm(mean[:p] - mean[p:]), np.linalg.norm(cov[:p, :p] - cov[p:, p:]), np.linalg.norm(cross))
    return spark.createDataFrame([tuple(float(v) for v in row)], "mean_gap DOUBLE, cov_gap DOUBLE, cross_gap DOUBLE")


def _paired_moments(pairs: DataFrame, x: str, xk: str) -> dict[str, np.ndarray]:
    """Per-feature means, variances and covariance of x and xk (times n), in one scan and O(p) state."""
    fields = ("ma", "mb", "aa", "bb", "ab")
    schema = pa.schema([("n", pa.float64())] + [(f, pa.list_(pa.float64())) for f in fields])

    def merge(acc, new):
        if acc is None:
            return new
        n0, n1 = acc["n"], new["n"]
        da, db, w = new["ma"] - acc["ma"], new["mb"] - acc["mb"], n0 * n1 / (n0 + n1)
        return {
            "n": n0 + n1, "ma": acc["ma"] + da * n1 / (n0 + n1), "mb": acc["mb"] + db * n1 / (n0 + n1),
            "aa": acc["aa"] + new["aa"] + da * da * w, "bb": acc["bb"] + new["bb"] + db * db * w, "ab": acc["ab"] + new["ab"] + da * db * w,
        }

    def emit(acc):
        if acc is not None:
            yield pa.RecordBatch.from_pylist([acc], schema=schema)

    def fold(batches):
        acc = None
        for batch in batches:
            a, b = batch_matrix(batch.column("a")), batch_matrix(batch.column("b"))
            if a.shape[0]:
                ma, mb = a.mean(axis=0), b.mean(axis=0)
                ca, cb = a - ma, b - mb
                acc = merge(acc, {"n": float(a.shape[0]), "ma": ma, "mb": mb, "aa": (ca * ca).sum(axis=0),
                                  "bb": (cb * cb).sum(axis=0), "ab": (ca * cb).sum(axis=0)})
        yield from emit(acc)

    def unpack(row):
        return {"n": row["n"], **{f: np.asarray(row[f]) for f in fields}}

    def combine(batches):
        acc = None
        for batch in batches:
            for row in batch.to_pylist():
                acc = merge(acc, unpack(row))
        yield from emit(acc)

    ddl = "n DOUBLE, " + ", ".join(f"{f} ARRAY<DOUBLE>" for f in fields)
    partials = pairs.select(F.col(x).alias("a"), F.col(xk).alias("b")).mapInArrow(fold, ddl)
    total = None
    for row in merge_in_levels(partials, lambda df: df.mapInArrow(combine, ddl)).collect():
        total = merge(total, unpack(row))
    if total is None:
        raise ValueError("no rows")
    return total


def decorrelation_gap(pairs: DataFrame, target_corr: DataFrame, x: str = "x", xk: str = "xk") -> DataFrame:
    """``corr(x_j, xk_j)`` against its target, per feature."""
    m = _paired_moments(pairs, x, xk)
    seen = vector_table(pairs.sparkSession, m["ab"] / np.sqrt(m["aa"] * m["bb"]), "corr")
    target = target_corr.select("i", F.col("v").alias("target"))
    return seen.join(target, "i").select("i", "corr", "target", (F.col("corr") - F.col("target")).alias("gap"))


def mmd(pairs: DataFrame, key: str, alphas: Sequence[float] = ALPHAS, seed: int = 0, x: str = "x", xk: str = "xk",
        rows_per_range: int = ROWS_PER_RANGE, keys: DataFrame | None = None) -> DataFrame:
    """Kernel distance between (X, Xk) and its swaps, in linear time.

    Rows are taken two by two in key order (a last odd row with the one before
    it); each pair gives one term of the estimate, so n rows cost n/2 kernel
    evaluations.  ``full_swap`` exchanges every feature with its knockoff,
    ``partial_swap`` a hash-chosen half of them.  ``keys`` may name a cheaper
    table with the same keys (the original features), so that finding the row
    order does not generate the knockoffs again.
    """
    two = neighbour_pairs(pairs.select(key, F.col(x).alias("x"), F.col(xk).alias("k")), key, ["x", "k"], rows_per_range, keys)
    # the same hash as draws.hash_bits(seed, j): one uniform per feature
    start = draws.hash_long_np(np.array([seed]), np.array([42], dtype=np.uint64))

    def distances(batches):
        """Squared distance of the two rows unswapped, swapped, and with the chosen features swapped."""
        for batch in batches:
            ax, ak, bx, bk = (batch_matrix(batch.column(c)) for c in ("ax", "ak", "bx", "bk"))
            if ax.shape[0] == 0:
                continue
            bits = draws.hash_long_np(np.arange(ax.shape[1]), start) >> np.uint64(11)
            chosen = bits.astype(np.float64) / draws.TWO_POW_53 < 0.5
            same = (ax - bx) ** 2 + (ak - bk) ** 2
            swap = (ax - bk) ** 2 + (ak - bx) ** 2
            sums = (same.sum(axis=1), swap.sum(axis=1), np.where(chosen, swap, same).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in sums], names=["same", "full", "part"])

    flat = two.select(F.col("a.x").alias("ax"), F.col("a.k").alias("ak"), F.col("b.x").alias("bx"), F.col("b.k").alias("bk"))
    terms = flat.mapInArrow(distances, "same DOUBLE, full DOUBLE, part DOUBLE")

    def kernel(d2):
        value = F.lit(0.0)
        for a in alphas:
            value = value + F.exp(-d2 / F.lit(2.0 * a * a))
        return value / F.lit(float(len(alphas)))

    # from a to swapped b is as far as from b to swapped a
    return terms.agg(
        F.avg(2.0 * kernel(F.col("same")) - 2.0 * kernel(F.col("full"))).alias("full_swap"),
        F.avg(2.0 * kernel(F.col("same")) - 2.0 * kernel(F.col("part"))).alias("partial_swap"),
        F.count("*").alias("n_pairs"),
    )


# -- all three in one pass ---------------------------------------------------------------


@dataclass(frozen=True)
class Quality:
    """The three criteria of one pass, each as the table its own operator gives."""

    second_order: DataFrame
    decorrelation: DataFrame
    kernel: DataFrame


def _block_kernels(x: np.ndarray, xk: np.ndarray, block: int, alphas: Sequence[float], start: np.ndarray) -> np.ndarray:
    """(sum of terms under the full swap, under the partial swap, pairs) over all pairs of rows of a block."""
    p = x.shape[1]
    centre = 0.5 * (x.mean(axis=0) + xk.mean(axis=0))  # distances don't change, and lose no digits to a common offset
    x, xk = x - centre, xk - centre
    block_hash = draws.hash_long_np(np.array([block]), start)
    chosen = (draws.hash_long_np(np.arange(p), block_hash) >> np.uint64(11)).astype(np.float64) / draws.TWO_POW_53 < 0.5
    z, full = np.hstack([x, xk]), np.hstack([xk, x])
    part = np.hstack([np.where(chosen, xk, x), np.where(chosen, x, xk)])
    length = (z * z).sum(axis=1)
    upper = np.triu_indices(len(z), 1)

    def kernel(other):
        d2 = np.maximum(length[:, None] + length - 2.0 * (z @ other.T), 0.0)[upper]
        return sum(np.exp(-d2 / (2.0 * a * a)).sum() for a in alphas) / len(alphas)

    same = kernel(z)
    return np.array([2.0 * (same - kernel(full)), 2.0 * (same - kernel(part)), float(len(upper[0]))])


def quality(pairs: DataFrame, key: str, target_corr: DataFrame, block_rows: int = 64, alphas: Sequence[float] = ALPHAS, seed: int = 0,
            x: str = "x", xk: str = "xk", rows_per_range: int = ROWS_PER_RANGE, keys: DataFrame | None = None) -> Quality:
    """``second_order_gap``, ``decorrelation_gap`` and a kernel distance over blocks from one pass over the pairs.

    The kernel distance is a U-statistic: rows are cut into blocks of ``block_rows`` in
    the order of the unique numeric key, and all pairs of rows in a block count, as
    matrix products.  Every block draws its own half of the features for the partial
    swap, by a hash of seed and block.  A last short block counts with the pairs it has.  So
    n rows give n (block_rows - 1) / 2 terms, where ``mmd`` has n / 2, for one
    shuffle of the rows by range.  The copies are generated once; ``keys`` may name
    a cheaper table with the same keys for finding the borders of ranges.
    """
    if block_rows < 2:
        raise ValueError("a block needs two rows")
    spark, keys = pairs.sparkSession, pairs if keys is None else keys
    edges = ranges.aligned_edges(keys, key, block_rows, rows_per_range)
    counts = dict(keys.groupBy(ranges.range_of(key, edges).alias("r")).count().collect()) if edges else {}
    first_block, before = {}, 0
    for r in range(len(edges) + 1):
        first_block[r] = before // block_rows
        before += counts.get(r, 0)
    start = draws.hash_long_np(np.array([seed]), np.array([42], dtype=np.uint64))
    placed = pairs.select(ranges.range_of(key, edges).alias("r"), F.col(key).alias("k"), F.col(x).alias("a"), F.col(xk).alias("b"))

    def packed(state):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    def add(u, v):
        return v if u is None else (add_moments(u[0], v[0]), u[1] + v[1])

    def fold(batches):
        state, at, block, rest = None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, r = batch_matrix(batch.column("a")), batch_matrix(batch.column("b")), batch.column("r").to_numpy()
            state = add(state, (moments_of(np.hstack([a, b])), np.zeros(3)))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if int(r[lo]) != at:
                    if rest is not None:
                        state = add(state, (None, _block_kernels(*rest, block, alphas, start)))
                    at, block, rest = int(r[lo]), first_block.get(int(r[lo]), 0), None
                own = (a[lo:hi], b[lo:hi]) if rest is None else (np.vstack([rest[0], a[lo:hi]]), np.vstack([rest[1], b[lo:hi]]))
                whole = len(own[0]) // block_rows * block_rows
                for k in range(0, whole, block_rows):
                    state = add(state, (None, _block_kernels(own[0][k : k + block_rows], own[1][k : k + block_rows], block, alphas, start)))
                    block += 1
                rest = (own[0][whole:], own[1][whole:]) if whole < len(own[0]) else None
        if rest is not None:
            state = add(state, (None, _block_kernels(*rest, block, alphas, start)))
        if state is not None:
            yield packed(state)

    def merge(batches):
        state = None
        for batch in batches:
            for v in batch.column("state"):
                state = add(state, pickle.loads(v.as_py()))
        if state is not None:
            yield packed(state)

    ordered = placed.repartition("r").sortWithinPartitions("r", "k").select("r", "a", "b") if edges else placed.repartition(1).sortWithinPartitions("k").select("r", "a", "b")
    total = None
    for row in merge_in_levels(ordered.mapInArrow(fold, "state BINARY"), lambda df: df.mapInArrow(merge, "state BINARY")).collect():
        total = add(total, pickle.loads(bytes(row["state"])))
    if total is None or total[0][0] < 2:
        raise ValueError("not enough rows")
    (n, mean, m2), (full, part, terms) = total
    cov, p = m2 / (n - 1), mean.size // 2
    sd = np.sqrt(np.diag(cov))
    target = target_corr.select("i", F.col("v").alias("target"))
    seen = vector_table(spark, np.diag(cov[:p, p:]) / (sd[:p] * sd[p:]), "corr")
    return Quality(
        _gap_table(spark, mean, cov),
        seen.join(target, "i").select("i", "corr", "target", (F.col("corr") - F.col("target")).alias("gap")),
        spark.createDataFrame([(float(full / terms), float(part / terms), int(terms))], "full_swap DOUBLE, partial_swap DOUBLE, n_pairs LONG"),
    )
