"""Means, covariance matrices and the small matrix tables derived from them.

A matrix is a table ``(i INT, j INT, v DOUBLE)``.  Estimating one is an action:
a single distributed aggregate over the rows whose p x p result becomes a local
table, so that whatever is derived from it never scans the data again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorframe.functions import smallmat
from mirrorframe.functions.rankscan import merge_in_levels
from mirrorframe.functions.vectors import Features, checked, matrices, vectorize

EXPRESSION_WIDTH = 8


# -- conversions -----------------------------------------------------------------


def small_table(spark: SparkSession, columns: dict[str, object]) -> DataFrame:
    """A table of p or p x p rows from arrays; Arrow keeps their types."""
    return spark.createDataFrame(pa.table(columns))


def matrix_table(spark: SparkSession, a: np.ndarray) -> DataFrame:
    i, j = np.indices(a.shape, dtype=np.int32)
    return small_table(spark, {"i": i.ravel(), "j": j.ravel(), "v": np.ascontiguousarray(a).ravel()})


def vector_table(spark: SparkSession, v: Sequence[float], name: str = "v") -> DataFrame:
    v = np.asarray(v)
    return small_table(spark, {"i": np.arange(v.size, dtype=np.int32), name: v})


def collect_matrix(table: DataFrame) -> np.ndarray:
    """The p x p array of a matrix table; missing cells are an error."""
    t = table.select("i", "j", "v").toArrow()
    i, j, v = (t[c].to_numpy() for c in ("i", "j", "v"))
    p = int(round(np.sqrt(v.size)))
    if v.size == 0 or p * p != v.size or i.max() != p - 1 or j.max() != p - 1:
        raise ValueError("not a complete square matrix")
    a = np.full((p, p), np.nan)
    a[i, j] = v
    if np.isnan(a).any():
        raise ValueError("matrix has missing or undefined cells")
    return a


def collect_vector(table: DataFrame, value: str = "v") -> np.ndarray:
    t = table.select("i", value).toArrow()
    i = t["i"].to_numpy()
    v = np.full(i.size, np.nan)
    v[i] = t[value].to_numpy()
    return v


# -- one-pass moments --------------------------------------------------------------


def _merge(acc, n, mean, m2):
    """Pairwise update of (weight, mean, centred second moment)."""
    if n == 0:
        return acc
    if acc is None or acc[0] == 0:
        return n, mean, m2
    n0, mean0, m20 = acc
    total = n0 + n
    delta = mean - mean0
    if m2 is not None:
        m2 = m20 + m2 + np.outer(delta, delta) * (n0 * n / total)
    return total, mean0 + delta * (n / total), m2


def _pack(acc, k, p, second):
    if acc is None:
        acc = (0.0, np.zeros(p), np.zeros((p, p)) if second else None)
    n, mean, m2 = acc
    upper = m2[np.triu_indices(p)] if second else np.zeros(0)
    return {"k": k, "n": float(n), "mean": mean, "m2": upper}


def _unpack(mean, upper):
    p = mean.size
    if upper.size == 0:
        return mean, None
    m2 = np.zeros((p, p))
    m2[np.triu_indices(p)] = upper
    return mean, m2 + np.triu(m2, 1).T


PARTIAL = pa.schema([("k", pa.int32()), ("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])
PARTIAL_DDL = "k INT, n DOUBLE, mean ARRAY<DOUBLE>, m2 ARRAY<DOUBLE>"


def _emit(states, second):
    rows = [_pack(acc, k, len(acc[1]), second) for k, acc in sorted(states.items()) if acc is not None]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=PARTIAL)


def moment_partials(vectors: DataFrame, weigh: Callable[[np.ndarray], list[np.ndarray]] | None = None,
                    centred: bool = True, second: bool = True) -> DataFrame:
    """A bounded number of rows per state (k, n, mean, m2) of merged moments of ``x`` (vectors or packed blocks).

    One scan: each task folds its Arrow batches into one state of size p x p per
    weight set, so what is shuffled does not grow with the rows.  ``weigh`` maps
    an n x p batch to weight vectors, or to pairs of other rows and their weights
    (None: weight 1); one state is kept for each (default: one state, weight 1).
    ``centred=False`` sums ``w x x^T`` about zero.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple | None] = {}
        for x in (m for batch in batches for m in matrices(batch)):
            weights = weigh(x) if weigh else [None]
            for k, w in enumerate(weights):
                rows, w = w if isinstance(w, tuple) else (x, w)
                if w is None:
                    n = float(rows.shape[0])
                elif w.dtype == bool:
                    rows = rows[w]
                    n, w = float(rows.shape[0]), None
                else:
                    n = float(w.sum())
                if n == 0:
                    continue
                if not centred:
                    mean = np.zeros(rows.shape[1])
                else:
                    mean = rows.mean(axis=0) if w is None else (w @ rows) / n
                m2 = None
                if second:
                    c = rows - mean
                    m2 = c.T @ c if w is None else (c * w[:, None]).T @ c
                states[k] = _merge(states.get(k), n, mean, m2)
        yield from _emit(states, second)

    partials = vectors.mapInArrow(fold, PARTIAL_DDL)
    return merge_in_levels(partials, lambda df: merge_partials(df, second))


def merge_partials(partials: DataFrame, second: bool = True) -> DataFrame:
    def fold(batches):
        states: dict[int, tuple | None] = {}
        for batch in batches:
            ks, ns = batch.column("k").to_pylist(), batch.column("n").to_pylist()
            means, uppers = batch.column("mean"), batch.column("m2")
            for r, (k, n) in enumerate(zip(ks, ns, strict=True)):
                mean, m2 = _unpack(means[r].values.to_numpy(), uppers[r].values.to_numpy())
                states[k] = _merge(states.get(k), n, mean, m2)
        yield from _emit(states, second)

    return partials.mapInArrow(fold, PARTIAL_DDL)


def collect_moments(partials: DataFrame, second: bool = True) -> dict[int, tuple[float, np.ndarray, np.ndarray | None]]:
    """(n, mean, m2) per weight set on the driver; reads a bounded number of small rows per set."""
    states: dict[int, tuple | None] = {}
    for row in partials.collect():
        mean, m2 = _unpack(np.array(row["mean"]), np.array(row["m2"]))
        states[row["k"]] = _merge(states.get(row["k"]), row["n"], mean, m2)
    return states


def mean_and_cov(df: DataFrame, features: Features, ddof: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean vector and covariance in one scan.

    Up to ``EXPRESSION_WIDTH`` named columns the upper triangle is one aggregate
    of built-in covariances, without leaving the JVM.  Everything else uses
    one-pass Arrow moments, since the number of expressions grows with p squared.
    """
    if not isinstance(features, str) and len(features) <= EXPRESSION_WIDTH:
        return _mean_and_cov_expressions(df, features, ddof)
    state = collect_moments(moment_partials(vectorize(df, features))).get(0)
    if state is None or state[0] <= ddof:
        raise ValueError("not enough rows for a covariance")
    n, mean, m2 = state
    return int(n), mean, m2 / (n - ddof)


def _mean_and_cov_expressions(df, features, ddof):
    p = len(features)
    named = df.select(*[checked(F.col(c)).alias(f"f{j}") for j, c in enumerate(features)])
    stat = F.covar_samp if ddof == 1 else F.covar_pop
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    row = named.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"f{j}") for j in range(p)]).alias("mean"),
        F.array(*[stat(f"f{i}", f"f{j}") for i, j in cells]).alias("upper"),
    ).head()
    if row["n"] <= ddof:
        raise ValueError("not enough rows for a covariance")
    cov = np.empty((p, p))
    for (i, j), v in zip(cells, row["upper"], strict=True):
        cov[i, j] = cov[j, i] = v
    return int(row["n"]), np.array(row["mean"]), cov


def mean_only(df: DataFrame, features: Features) -> tuple[int, np.ndarray]:
    """Row count and mean vector in one scan."""
    if not isinstance(features, str) and len(features) <= EXPRESSION_WIDTH:
        cols = [checked(F.col(c)) for c in features]
        row = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("m")).head()
        return int(row["n"]), np.array(row["m"], dtype=float)
    state = collect_moments(moment_partials(vectorize(df, features), second=False)).get(0)
    if state is None:
        raise ValueError("no rows")
    return int(state[0]), state[1]


# -- operators ---------------------------------------------------------------------


def mean_vector(df: DataFrame, features: Features) -> DataFrame:
    """Column means as ``(i, v)``."""
    return vector_table(df.sparkSession, mean_only(df, features)[1])


def covariance(df: DataFrame, features: Features, ddof: int = 1) -> DataFrame:
    """Sample covariance matrix ``(i, j, v)``."""
    return matrix_table(df.sparkSession, mean_and_cov(df, features, ddof)[2])


def cov_to_corr(cov: DataFrame) -> DataFrame:
    """Correlation matrix; a feature without variance is an error."""
    variance = F.when(F.col("i") == F.col("j"), F.col("v"))
    both = cov.withColumns({
        "vi": F.max(variance).over(Window.partitionBy("i")),
        "vj": F.max(variance).over(Window.partitionBy("j")),
    })
    scale = F.sqrt(F.col("vi") * F.col("vj"))
    safe = F.when(scale > 0, F.col("v") / scale).otherwise(F.raise_error(F.lit("feature without variance")).cast("double"))
    return both.select("i", "j", safe.alias("v"))


def constant_features(cov: DataFrame) -> DataFrame:
    """Positions of features without variance, to be excluded before any correlation."""
    return cov.where((F.col("i") == F.col("j")) & (F.col("v") <= 0)).select("i")


def ridge(cov: DataFrame, reg: float | Sequence[float]) -> DataFrame:
    """Add ``reg`` (one number, or one per feature) to the diagonal."""
    diagonal = F.col("i") == F.col("j")
    if isinstance(reg, (int, float)):
        return cov.select("i", "j", (F.col("v") + F.when(diagonal, F.lit(float(reg))).otherwise(F.lit(0.0))).alias("v"))
    added = vector_table(cov.sparkSession, [float(r) for r in reg], "reg")
    return cov.join(F.broadcast(added), "i").select(
        "i", "j", (F.col("v") + F.when(diagonal, F.col("reg")).otherwise(F.lit(0.0))).alias("v")
    )


def ridge_by_kind(cov: DataFrame, catalog, cat: float, cont: float) -> DataFrame:
    """Different ridge for categorical and continuous features."""
    return ridge(cov, [cat if f.kind == "cat" else cont for f in sorted(catalog)])


def ridge_if_not_psd(cov: DataFrame, reg: float) -> DataFrame:
    """Ridge only when the smallest eigenvalue is negative by more than rounding."""
    return ridge(cov, reg) if smallmat.indefinite(collect_matrix(cov)) else cov


def correlation_summary(target_corr: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mean target correlation over all features and per kind.

    ``kinds`` is ``(i, kind)``; the overall row has kind ``all``.
    """
    joined = target_corr.join(kinds, "i")
    return (
        joined.rollup("kind")
        .agg(F.avg("v").alias("mean_corr"), F.count("v").alias("n_features"))
        .select(F.coalesce("kind", F.lit("all")).alias("kind"), "mean_corr", "n_features")
    )


def structured_corr(spark: SparkSession, p: int, rho: float | Sequence[float], shape: str = "ar1") -> DataFrame:
    """AR(1) (one rho, or one per gap between neighbours) or constant correlation matrix."""
    rhos = [float(rho)] * (p - 1) if isinstance(rho, (int, float)) else [float(r) for r in rho]
    if any(not 0 <= r <= 1 for r in rhos):
        raise ValueError("rho must lie in [0, 1]")
    if len(rhos) != p - 1:
        raise ValueError("one rho per gap is required")
    cells = spark.range(p).select(F.col("id").cast("int").alias("i"))
    cells = cells.select("i", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("j"))
    same = F.col("i") == F.col("j")
    if shape == "constant":
        value = F.when(same, F.lit(1.0)).otherwise(F.lit(rhos[0] if rhos else 1.0))
    elif shape == "ar1":
        gaps = F.slice(F.array(*[F.lit(r) for r in rhos]), F.least("i", "j") + 1, F.abs(F.col("i") - F.col("j")))
        value = F.lit(1.0) if p == 1 else F.aggregate(gaps, F.lit(1.0), lambda a, r: a * r)
    else:
        raise ValueError(f"unknown shape: {shape}")
    return cells.select("i", "j", value.alias("v"))


def corr_deviation(corr: DataFrame, reference: DataFrame) -> DataFrame:
    """Per-cell difference of an empirical matrix from a reference shape."""
    ref = reference.select("i", "j", F.col("v").alias("ref"))
    return corr.join(ref, ["i", "j"]).select("i", "j", "v", "ref", (F.col("v") - F.col("ref")).alias("deviation"))
