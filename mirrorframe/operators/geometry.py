"""The knockoff geometry: how far each copy may move from its original.

``s`` is reported on correlation scale (``s_corr``) and on covariance scale
(``s = s_corr * variance``).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions import smallmat
from mirrorframe.operators.grouping import group_labels_ward
from mirrorframe.operators.moments import collect_matrix, collect_vector, matrix_table, small_table


def _s_table(spark: SparkSession, s_corr: np.ndarray, sigma: np.ndarray) -> DataFrame:
    i = np.arange(s_corr.size, dtype=np.int32)
    return small_table(spark, {"i": i, "s_corr": s_corr, "s": s_corr * np.diag(sigma)})


def s_equi(cov: DataFrame, tol: float = 1e-3) -> DataFrame:
    """The same s for every feature: ``min(1, 2 (lambda_min - tol))``, not below 0."""
    sigma = collect_matrix(cov)
    s = min(1.0, max(0.0, 2.0 * (smallmat.lambda_min(smallmat.correlation(sigma)) - tol)))
    return _s_table(cov.sparkSession, np.full(sigma.shape[0], s), sigma)


def _solve_blocks(spark: SparkSession, corr: np.ndarray, block: np.ndarray, tol: float) -> np.ndarray:
    """Solve the diagonal blocks of a correlation matrix in parallel, one task each."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        members = np.sort(pdf["i"].unique())
        a = pdf.pivot(index="i", columns="j", values="v").loc[members, members].to_numpy()
        return pd.DataFrame({"i": members.astype(np.int32), "v": smallmat.max_sum_s(a, tol)})

    i, j = np.nonzero(block[:, None] == block[None, :])
    cells = small_table(spark, {"block": block[i].astype(np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": corr[i, j]})
    return collect_vector(cells.groupBy("block").applyInPandas(solve, "i INT, v DOUBLE"))


def s_sdp(cov: DataFrame, tol: float = 1e-3, reg: float = 1e-4) -> DataFrame:
    """Largest total s: the semidefinite program on the whole correlation matrix.

    ``reg`` goes on the diagonal first if the matrix has a negative eigenvalue
    beyond rounding.
    """
    sigma = collect_matrix(cov)
    s = _solve_blocks(cov.sparkSession, smallmat.correlation(_ridged(sigma, reg)), np.zeros(sigma.shape[0], dtype=int), tol)
    return _s_table(cov.sparkSession, s, sigma)


def _ridged(sigma: np.ndarray, reg: float) -> np.ndarray:
    return sigma + reg * np.eye(sigma.shape[0]) if smallmat.indefinite(sigma) else sigma


def _blocks(sigma: np.ndarray, block_size: int, method: str) -> np.ndarray:
    p = sigma.shape[0]
    if method == "selfblocks":
        return np.arange(p) // block_size
    if method == "cluster":
        return group_labels_ward(sigma, -(-p // block_size))
    raise ValueError(f"unknown method: {method}")


def s_asdp(cov: DataFrame, block_size: int = 50, method: str = "selfblocks") -> DataFrame:
    """Blockwise program: solve blocks in parallel, then shrink until feasible as a whole.

    Blocks are runs of ``block_size`` neighbouring features (``selfblocks``) or
    Ward groups of features (``cluster``).
    """
    sigma = collect_matrix(cov)
    corr = smallmat.correlation(sigma)
    s = _solve_blocks(cov.sparkSession, corr, _blocks(sigma, block_size, method), 0.0)
    return _s_table(cov.sparkSession, np.clip(smallmat.feasible_scale(corr, s) * s, 0.0, 1.0), sigma)


def local_s(sigma: np.ndarray, method: str, block_size: int, tol: float, reg: float = 1e-4, start: np.ndarray | None = None, count: list[int] | None = None) -> np.ndarray:
    """``s_corr`` by one of the programs inside a single task, with the same steps as the tables' operators.

    ``start`` may be what a similar matrix gave; ``count`` is given the Newton steps of each program.
    """
    corr = smallmat.correlation(sigma)
    if method == "equi":
        return np.full(len(corr), min(1.0, max(0.0, 2.0 * (smallmat.lambda_min(corr) - tol))))
    if method == "sdp":
        return smallmat.max_sum_s(smallmat.correlation(_ridged(sigma, reg)), tol, start, count)
    if method not in ("asdp", "cluster"):
        raise ValueError(f"unknown method: {method}")
    block = _blocks(sigma, block_size, "cluster" if method == "cluster" else "selfblocks")
    s = np.empty(len(corr))
    for b in np.unique(block):
        at = np.flatnonzero(block == b)
        s[at] = smallmat.max_sum_s(corr[np.ix_(at, at)], 0.0, None if start is None else start[at], count)
    return np.clip(smallmat.feasible_scale(corr, s) * s, 0.0, 1.0)


@dataclass(frozen=True)
class KnockoffPlan:
    """What every row needs to get its knockoff: p x p state, shipped to the tasks."""

    mu: np.ndarray
    projection: np.ndarray  # Sigma^-1 diag(s)
    cond_cov: np.ndarray  # V = 2 diag(s) - diag(s) Sigma^-1 diag(s)
    root: np.ndarray  # lower Cholesky factor of V

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The projection and the conditional covariance as matrix tables."""
        return matrix_table(spark, self.projection), matrix_table(spark, self.cond_cov)


def knockoff_plan(cov: DataFrame, s: DataFrame, mu: np.ndarray, tol: float = 1e-3, jitter: float = 1e-10) -> KnockoffPlan:
    sigma = collect_matrix(cov)
    d = np.diag(collect_vector(s, "s"))
    projection = np.linalg.lstsq(sigma, d, rcond=None)[0]
    v = 2.0 * d - d @ projection
    v = 0.5 * (v + v.T)
    sd = np.sqrt(np.diag(sigma))
    if smallmat.lambda_min(v / np.outer(sd, sd)) <= tol:
        warnings.warn("the conditional covariance of the knockoffs is nearly singular; they will have little power", stacklevel=2)
    floor = max(0.0, -smallmat.lambda_min(v))
    root = np.linalg.cholesky(v + (jitter + 2.0 * floor) * np.eye(v.shape[0]))
    return KnockoffPlan(np.asarray(mu, float), projection, v, root)


def target_correlation(cov: DataFrame, s: DataFrame) -> DataFrame:
    """``(Sigma_jj - s_j) / Sigma_jj`` per feature; features without variance are left out."""
    var = cov.where("i = j").where("v > 0").select("i", F.col("v").alias("var"))
    return var.join(s.select("i", "s"), "i").select("i", ((F.col("var") - F.col("s")) / F.col("var")).alias("v"))
