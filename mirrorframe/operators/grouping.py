"""Groups of correlated features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions import smallmat
from mirrorframe.functions.vectors import checked
from mirrorframe.operators.moments import collect_matrix, mean_and_cov, vector_table


def feature_distance(corr: DataFrame) -> DataFrame:
    """Euclidean distance between the matrix rows of every feature pair ``i < j``.

    The p x p matrix travels with the function; a task makes the rows of the features dealt to it.
    """
    a = collect_matrix(corr)

    def rows(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                d = np.sqrt(((a[i + 1 :] - a[i]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d.size, i), pa.int32()), pa.array(np.arange(i + 1, len(a)), pa.int32()), pa.array(d)], names=["i", "j", "d"])

    return corr.sparkSession.range(len(a)).mapInArrow(rows, "i INT, j INT, d DOUBLE")


def _label_table(spark: SparkSession, labels: np.ndarray) -> DataFrame:
    return vector_table(spark, labels.astype(np.int32), "group_id")


def _distances(matrix: DataFrame) -> np.ndarray:
    """All distances between the rows of a matrix table, found by the executors, as an array."""
    t = feature_distance(matrix).toArrow()
    i, j, d = (t[c].to_numpy() for c in ("i", "j", "d"))
    p = int(j.max()) + 1 if j.size else 1
    dist = np.zeros((p, p))
    dist[i, j] = d
    dist[j, i] = d
    return dist


def group_features(corr: DataFrame, cut: float = 0.5) -> DataFrame:
    """Complete-linkage groups cut at ``cut`` times the largest distance; ``(i, group_id)``.

    The distances come from Spark; only the merge order is worked out on the driver.
    """
    dist = _distances(corr)
    return _label_table(corr.sparkSession, smallmat.agglomerate(dist, "complete", cut=cut * dist.max()))


def group_labels_ward(sigma: np.ndarray, n_clusters: int) -> np.ndarray:
    return smallmat.agglomerate(smallmat.pairwise_distance(sigma), "ward", n_groups=n_clusters)


def group_features_ward(cov: DataFrame, n_clusters: int) -> DataFrame:
    """A fixed number of Ward groups of the rows of the matrix; ``(i, group_id)``."""
    return _label_table(cov.sparkSession, smallmat.agglomerate(_distances(cov), "ward", n_groups=n_clusters))


def group_sizes(groups: DataFrame) -> DataFrame:
    """Number of groups, size of the largest one and mean size."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_groups"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))


def group_representatives(groups: DataFrame) -> DataFrame:
    """The first feature of every group."""
    return groups.groupBy("group_id").agg(F.min("i").alias("i"))


def submatrix(matrix: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows and columns of the kept features, at their original positions."""
    kept = keep.select("i")
    return matrix.join(kept, "i", "left_semi").join(kept.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "v")


def renumber(matrix: DataFrame) -> DataFrame:
    """Positions 0.. of a submatrix, in the old order."""
    old = [r["i"] for r in matrix.where("i = j").select("i").orderBy("i").collect()]
    place = vector_table(matrix.sparkSession, np.array(old, dtype=np.int32), "old")
    a = F.broadcast(place.select(F.col("old").alias("i"), F.col("i").alias("ni")))
    b = F.broadcast(place.select(F.col("old").alias("j"), F.col("i").alias("nj")))
    return matrix.join(a, "i").join(b, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def max_offdiag(corr: DataFrame) -> DataFrame:
    """Largest absolute entry of the matrix minus the identity."""
    off = F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double"))
    return corr.agg(F.max(off).alias("max_offdiag"))


def groups_by_name(groups: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """A grouping ``(i, group_id)`` of positions as the mapping of names that ``group_first_pc`` takes."""
    of = {r["i"]: r["group_id"] for r in groups.select("i", "group_id").collect()}
    missing = [c for k, c in enumerate(names) if k not in of]
    if missing:
        raise ValueError(f"features without a group: {missing}")
    return {c: of[k] for k, c in enumerate(names)}


def representative_analysis(corr: DataFrame, cut: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grouping, representatives and the correlations of these, numbered from 0: the input of a program on fewer features."""
    groups = group_features(corr, cut)
    representatives = group_representatives(groups)
    return groups, representatives, renumber(submatrix(corr, representatives))


def group_first_pc(df: DataFrame, groups: dict[str, int], keep: Sequence[str] = ()) -> DataFrame:
    """Replace every group of several columns by its first principal component.

    Components are named ``group_{id}_pc`` and take the place of the first
    member; the largest loading is positive.  All groups share one covariance
    scan, and the projection itself moves no rows.
    """
    members: dict[int, list[str]] = {}
    for name, g in groups.items():
        members.setdefault(g, []).append(name)
    merged = {g: m for g, m in members.items() if len(m) > 1}
    cols = [c for m in merged.values() for c in m]
    component = {}
    if cols:
        _, mean, cov = mean_and_cov(df, cols)
        for g, m in merged.items():
            at = [cols.index(c) for c in m]
            loading = np.linalg.eigh(cov[np.ix_(at, at)])[1][:, -1]
            if loading[np.argmax(np.abs(loading))] < 0:
                loading = -loading
            terms = [(checked(F.col(c)) - F.lit(float(mean[k]))) * F.lit(float(w)) for c, k, w in zip(m, at, loading, strict=True)]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            component[m[0]] = total.alias(f"group_{g}_pc")
    out = []
    for name in groups:
        if name in component:
            out.append(component[name])
        elif name not in cols:
            out.append(F.col(name))
    return df.select(*keep, *out)
