"""Projections and row-wise predicates; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.vectors import checked, let


def drop_columns(df: DataFrame, cols: Sequence[str] = ("Y", "W")) -> DataFrame:
    """Remove outcome and treatment; a missing name is an error, as a silent typo would leak them."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}")
    return df.drop(*cols)


def split_by_kind(df: DataFrame, catalog, keep: Sequence[str] = ("row_id",)) -> tuple[DataFrame, DataFrame]:
    """The categorical and the continuous part, in catalog order."""
    validate_catalog(df, catalog)
    cat = [c.feature for c in catalog if c.kind == "cat"]
    cont = [c.feature for c in catalog if c.kind == "cont"]
    return df.select(*keep, *cat), df.select(*keep, *cont)


def validate_catalog(df: DataFrame, catalog) -> None:
    missing = [c.feature for c in catalog if c.feature not in df.columns]
    if missing:
        raise ValueError(f"catalog features not in table: {missing}")


def hconcat(left: DataFrame, right: DataFrame, on: str = "row_id") -> DataFrame:
    """Put two tables with the same row key side by side, left columns first.

    A key that only one of them has fails the job, as its row would vanish.  Parts of
    one table need no join: see ``hconcat_parts``.
    """
    clash = (set(left.columns) & set(right.columns)) - {on}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    l, r = left.withColumnRenamed(on, "_l"), right.withColumnRenamed(on, "_r")  # noqa: E741
    both = l.join(r, F.col("_l") == F.col("_r"), "full_outer")
    lone = F.raise_error(F.concat(F.lit("a key is on one side only: "), F.coalesce("_l", "_r").cast("string"))).cast(left.schema[on].dataType)
    key = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("_l")).otherwise(lone)
    out = {on: key.alias(on)}
    return both.select(*[out.get(c, F.col(c)) for c in left.columns], *[c for c in right.columns if c != on])


def hconcat_parts(parent: DataFrame, parts: Sequence[Sequence[str]], on: str = "row_id") -> DataFrame:
    """The same for column lists of one parent table: a projection, without a shuffle."""
    cols = [c for part in parts for c in part if c != on]
    twice = sorted({c for c in cols if cols.count(c) > 1})
    if twice:
        raise ValueError(f"columns in two parts: {twice}")
    return parent.select(on, *cols)


def cast_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bin codes to string labels."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def standardize(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - mu) / sqrt(variance)`` with supplied (mu, variance) per column."""
    out = {}
    for c, (mu, variance) in moments.items():
        if not variance > 0:
            raise ValueError(f"variance of {c} is not positive")
        out[c] = (F.col(c) - F.lit(float(mu))) / F.sqrt(F.lit(float(variance)))
    return df.withColumns(out)


def standardize_array(df: DataFrame, x: str, mu: Sequence[float], variance: Sequence[float]) -> DataFrame:
    """The same for an array column, with one mean and variance for each position."""
    wrong = [k for k, v in enumerate(variance) if not v > 0]
    if wrong:
        raise ValueError(f"variances at positions {wrong} are not positive")
    centre, scale = (F.array(*[F.lit(float(v)) for v in values]) for values in (mu, variance))
    scaled = F.transform(x, lambda v, i: (v.cast("double") - F.get(centre, i)) / F.sqrt(F.get(scale, i)))
    return df.withColumn(x, _of_length(x, len(mu), scaled))


def _of_length(x: str, p: int, value):
    wrong = F.raise_error(F.concat(F.lit(f"expected {p} features, found "), F.size(x).cast("string"))).cast("array<double>")
    return F.when(F.col(x).isNull() | (F.size(x) == p), value).otherwise(wrong)


def row_normalize(df: DataFrame, x: str) -> DataFrame:
    """Scale every vector to length 1; zero vectors stay as they are."""
    def scaled(v):
        squared = F.aggregate(v, F.lit(0.0), lambda acc, t: acc + t * t)
        return let(F.sqrt(squared), lambda length: F.when(length == 0.0, v).otherwise(F.transform(v, lambda t: t / length)))

    return df.withColumn(x, let(F.col(x).cast("array<double>"), scaled))


def linear_score(df: DataFrame, weights: dict[str, float], out: str = "xbeta") -> DataFrame:
    """Weighted sum of the listed features."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + checked(F.col(c)) * F.lit(float(w))
    return df.withColumn(out, total)


def linear_score_array(df: DataFrame, x: str, weights: Sequence[float], out: str = "xbeta") -> DataFrame:
    """Weighted sum of the positions of an array column."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    terms = _of_length(x, len(weights), F.zip_with(x, w, lambda v, c: checked(v) * c))
    return df.withColumn(out, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))


def logistic_label(df: DataFrame, weights: dict[str, float], xbeta: str = "xbeta") -> DataFrame:
    """``xbeta``, its logistic probability ``pr`` and the label ``pr >= 0.5``."""
    scored = linear_score(df, weights, xbeta)
    scored = scored.withColumn("pr", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(xbeta))))
    return binarize(scored, "pr", 0.5, "label")


def binarize(df: DataFrame, col: str, threshold: float = 0.5, out: str | None = None) -> DataFrame:
    """1 where the value is at or above the threshold."""
    return df.withColumn(out or col, (F.col(col) >= F.lit(float(threshold))).cast("int"))
