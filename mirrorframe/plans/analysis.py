"""Complete analyses: covariance to knockoff parameters, and sweeps over estimators."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorframe.functions import smallmat
from mirrorframe.functions.vectors import Features
from mirrorframe.operators import geometry, moments, robust

BLOCK_SIZE = 50
#: Runs of one estimator that one task solves, one from the other.
RUNS_PER_TASK = 8
METHODS = ("equi", "sdp", "asdp", "cluster")


@dataclass(frozen=True)
class SecondOrder:
    """Result of one second-order analysis; all tables have one row per feature or cell.

    ``kept`` are the positions of the features that vary; ``mu``, ``cov`` and ``s``
    are about these, numbered from 0.  ``target_corr`` has the original positions.
    ``constant`` are the positions of the others, which have no copy.
    """

    n: int
    mu: np.ndarray
    cov: DataFrame
    s: DataFrame
    target_corr: DataFrame
    mean_corr: float
    kept: tuple[int, ...]
    constant: tuple[int, ...]

    def plan(self) -> geometry.KnockoffPlan:
        return geometry.knockoff_plan(self.cov, self.s, self.mu)


def estimate(df: DataFrame, features: Features, estimator: str):
    """(n, mean, covariance array) by the plain or the robust estimator.

    The mean is the plain mean for both, as the knockoff formula wants it.
    """
    if estimator == "plain":
        return moments.mean_and_cov(df, features)
    if estimator == "mcd":
        fit = robust.mcd_fit(df, features)
        return fit.n, fit.mean, fit.covariance
    raise ValueError(f"unknown estimator: {estimator}")


def solve_s(spark: SparkSession, sigma: np.ndarray, method: str, block_size: int, tol: float, sdp_reg: float = 1e-4) -> DataFrame:
    """The s table of a covariance by one of the four programs."""
    cov = moments.matrix_table(spark, sigma)
    if method == "equi":
        return geometry.s_equi(cov, tol)
    if method == "sdp":
        return geometry.s_sdp(cov, tol, sdp_reg)
    if method in ("asdp", "cluster"):
        return geometry.s_asdp(cov, block_size, "cluster" if method == "cluster" else "selfblocks")
    raise ValueError(f"unknown method: {method}")


def second_order(df: DataFrame, features: Features, method: str, estimator: str = "plain", reg: float = 0.0,
                 reg_if_not_psd: bool = False, block_size: int = BLOCK_SIZE, tol: float = 1e-3, sdp_reg: float = 1e-4) -> SecondOrder:
    """Covariance, ridge, s vector and target correlations.

    ``method`` is ``equi``, ``sdp`` (one program), ``asdp`` (blocks of neighbours) or
    ``cluster`` (Ward blocks); the number of features doesn't choose it.  Features
    without variance are left out and reported.
    """
    n, mu, sigma = estimate(df, features, estimator)
    return solve(df.sparkSession, n, mu, sigma, method, reg, reg_if_not_psd, block_size, tol, sdp_reg)


def solve(spark: SparkSession, n: int, mu: np.ndarray, sigma: np.ndarray, method: str, reg: float = 0.0, reg_if_not_psd: bool = False,
          block_size: int = BLOCK_SIZE, tol: float = 1e-3, sdp_reg: float = 1e-4) -> SecondOrder:
    """The analysis from given moments, without a scan."""
    varies = np.diag(sigma) > 0
    kept, constant = np.flatnonzero(varies), np.flatnonzero(~varies)
    if not kept.size:
        raise ValueError("no feature has any variance")
    if constant.size:
        warnings.warn(f"features without variance are left out: positions {constant.tolist()}", stacklevel=3)
    mu, sigma = mu[kept], sigma[np.ix_(kept, kept)]
    if reg and (not reg_if_not_psd or smallmat.indefinite(sigma)):
        sigma = sigma + reg * np.eye(sigma.shape[0])
    s = solve_s(spark, sigma, method, block_size, tol, sdp_reg)
    target = 1.0 - moments.collect_vector(s, "s") / np.diag(sigma)
    table = moments.small_table(spark, {"i": kept.astype(np.int32), "v": target})
    return SecondOrder(n, mu, moments.matrix_table(spark, sigma), s, table, float(target.mean()), tuple(kept.tolist()), tuple(constant.tolist()))


def two_part_plan(df: DataFrame, catalog, method: str, estimator: str = "plain", reg: float = 1e-4, **options) -> DataFrame:
    """Independent analyses of the indicator part and of the continuous part; ``(data_type, feature, i, v)``.

    The plain moments of all features come from one scan; the robust estimate is
    one fit for each part, as its distances are about that part alone.
    """
    spark = df.sparkSession
    ordered = sorted(catalog)
    moments_of = None
    if estimator == "plain":
        n, mu, sigma = moments.mean_and_cov(df, [f.feature for f in ordered])
        moments_of = lambda at: (n, mu[at], sigma[np.ix_(at, at)])
    parts = []
    for data_type, kind in (("discrete", "cat"), ("continuous", "cont")):
        at = [k for k, f in enumerate(ordered) if f.kind == kind]
        if not at:
            continue
        names = [ordered[k].feature for k in at]
        result = solve(spark, *(moments_of(at) if moments_of else estimate(df, names, estimator)), method, reg, **options)
        labels = moments.vector_table(spark, np.array(names), "feature")
        parts.append(result.target_corr.join(F.broadcast(labels), "i").select(F.lit(data_type).alias("data_type"), "feature", "i", "v"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def estimator_sweep(df: DataFrame, features: Features, grid: Sequence[tuple[int, bool, float]] | DataFrame, method: str,
                    block_size: int = BLOCK_SIZE, tol: float = 1e-3) -> DataFrame:
    """Target correlations for every (run_id, robust_cov, reg_val); ``(run_id, i, v)``.

    Each estimator is fitted once for the whole grid.  The grid alone is then
    distributed, ``RUNS_PER_TASK`` neighbouring ridges of one estimator together: from the
    largest on, each solution starts the search for the next one.  The p x p matrices travel with the function.
    Features without variance are left out, as in ``second_order``; the others keep their
    positions.  Run ids that occur twice, and a method that isn't known, are errors.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    spark = df.sparkSession
    if not isinstance(grid, DataFrame):
        grid = spark.createDataFrame(list(grid), "run_id INT, robust_cov BOOLEAN, reg_val DOUBLE")
    facts = grid.groupBy("robust_cov").agg(F.count("*").alias("n")).collect()
    ids = grid.select("run_id").distinct().count()
    if ids < sum(r["n"] for r in facts):
        raise ValueError("a run_id occurs more than once")
    sigmas = {r["robust_cov"]: estimate(df, features, "mcd" if r["robust_cov"] else "plain")[2] for r in facts}
    varies = np.flatnonzero(np.all([np.diag(s) > 0 for s in sigmas.values()], axis=0)) if sigmas else np.zeros(0, int)
    constant = sorted(set(range(len(next(iter(sigmas.values()), [])))) - set(varies.tolist()))
    if constant:
        warnings.warn(f"features without variance are left out: positions {constant}", stacklevel=2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, s = [], None
        for row in pdf.sort_values(["reg_val", "run_id"], ascending=[False, True]).itertuples():
            sigma = sigmas[bool(row.robust_cov)][np.ix_(varies, varies)]
            s = geometry.local_s(sigma + float(row.reg_val) * np.eye(sigma.shape[0]), method, block_size, tol, start=s)
            out.append(pd.DataFrame({"run_id": int(row.run_id), "i": varies.astype(np.int32), "v": 1.0 - s}))
        return pd.concat(out)

    place = F.row_number().over(Window.partitionBy("robust_cov").orderBy(F.desc("reg_val"), "run_id"))
    chained = grid.withColumn("chain", F.floor((place - 1) / RUNS_PER_TASK))
    return chained.groupBy("robust_cov", "chain").applyInPandas(run, "run_id INT, i INT, v DOUBLE")
