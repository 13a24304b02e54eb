"""Quantile binning, one-hot coding and the feature catalog."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorframe.functions.orderstats import exact_quantiles
from mirrorframe.functions.rankscan import exact_ranks
from mirrorframe.functions.vectors import checked, pack_blocks, vectorize
from mirrorframe.operators.moments import matrix_table, mean_and_cov


class Feature(NamedTuple):
    """One column of an encoded feature table."""

    pos: int
    feature: str
    kind: str  # "cont" or "cat"
    chunk_id: int | None = None
    category: str | None = None
    group_id: int | None = None


CATALOG_SCHEMA = "pos INT, feature STRING, kind STRING, chunk_id INT, category STRING, group_id INT"


def catalog_table(spark: SparkSession, catalog: Sequence[Feature]) -> DataFrame:
    return spark.createDataFrame([tuple(f) for f in catalog], CATALOG_SCHEMA)


def quantile_edges(df: DataFrame, bins: dict[str, int], duplicates: str = "raise", approx: bool = False,
                   accuracy: int = 100_000) -> dict[str, list[float]]:
    """All bin edges (minimum and maximum included) of every column.

    Exact by default, in a few column-pruned aggregates for all columns
    together; ``approx`` takes a single sketch instead.
    """
    probs = {c: [k / q for k in range(q + 1)] for c, q in bins.items()}
    if approx:
        row = df.agg(*[
            F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(v) for v in probs[c]]), accuracy).alias(f"q{k}")
            for k, c in enumerate(bins)
        ]).head()
        edges = {c: list(row[f"q{k}"]) for k, c in enumerate(bins)}
    else:
        edges = exact_quantiles(df.select(*bins), probs)
    for c, e in edges.items():
        distinct = sorted(set(e))
        if len(distinct) < len(e):
            if duplicates != "drop":
                raise ValueError(f"bin edges of {c} are not distinct: {e}")
            edges[c] = distinct
    return edges


def apply_edges(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Bin codes 0.. with intervals closed on the right; nulls and NaN get null."""
    out = {}
    for c, e in edges.items():
        code = F.lit(0)
        for edge in e[1:-1]:
            code = code + (F.col(c) > F.lit(edge)).cast("int")
        out[c] = F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), code)
    return df.withColumns(out)


def quantile_bin(df: DataFrame, cols: Sequence[str], q: int, **options) -> DataFrame:
    """Equal-frequency codes 0..q-1 for each column."""
    return quantile_bin_var(df, {c: q for c in cols}, **options)


def quantile_edges_array(df: DataFrame, x: str, q: int) -> np.ndarray:
    """The q - 1 inner edges of every position of an array column (edge, position), found by counting cells."""
    n, mean, cov = mean_and_cov(df, x, ddof=0)
    spread = 4.0 * np.sqrt(np.diag(cov))
    place = np.repeat(np.arange(1, q) / q * (n - 1), len(mean))
    ranks = np.concatenate([np.floor(place), np.ceil(place)]).astype(np.int64)
    times = 2 * (q - 1)
    found = exact_ranks(pack_blocks(vectorize(df, x)), lambda v: np.tile(v, times), ranks, np.tile(mean - spread, times), np.tile(mean + spread, times))
    low, high = found[: place.size], found[place.size :]
    return (low + (high - low) * (place - np.floor(place))).reshape(q - 1, -1)


def quantile_bin_array(df: DataFrame, x: str, q: int) -> DataFrame:
    """Equal-frequency codes 0..q-1 for every position of an array column; equal edges are an error."""
    edges = quantile_edges_array(df, x, q)
    same = np.flatnonzero((np.diff(edges, axis=0) <= 0).any(axis=0))
    if same.size:
        raise ValueError(f"bin edges at positions {same.tolist()} are not distinct")
    cuts = F.array(*[F.array(*[F.lit(float(v)) for v in column]) for column in edges.T])
    return df.withColumn(x, F.transform(x, lambda v, i: F.size(F.filter(F.get(cuts, i), lambda e: v.cast("double") > e))))


def quantile_bin_var(df: DataFrame, bins: dict[str, int], **options) -> DataFrame:
    """Equal-frequency codes with a bin count per column."""
    return apply_edges(df, quantile_edges(df, bins, **options))


def rebin_like(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Discretise generated columns with the edges of the original ones."""
    return apply_edges(df, edges)


def _distinct_categories(df, factors):
    """(factor number, category), every observed pair once; duplicates go before the shuffle."""
    cells = [e for k, c in enumerate(factors) for e in (F.lit(k), F.col(c).cast("string"))]
    return df.select(F.stack(F.lit(len(factors)), *cells).alias("factor", "category")).where("category is not null").distinct()


def category_table(df: DataFrame, factors: Sequence[str], max_categories: int | None = None) -> dict[str, list[str]]:
    """Sorted non-null categories of every factor, found in one pass.

    Every category becomes a column, so their list is read by the driver.  With
    ``max_categories`` they are counted first, and a factor with more is an error.
    """
    seen = _distinct_categories(df, factors)
    if max_categories is not None:
        counts = {r["factor"]: r["count"] for r in seen.groupBy("factor").count().collect()}
        wide = [c for k, c in enumerate(factors) if counts.get(k, 0) > max_categories]
        if wide:
            raise ValueError(f"more than {max_categories} categories in {wide}")
    rows = seen.collect()
    return {c: sorted(r["category"] for r in rows if r["factor"] == k) for k, c in enumerate(factors)}


def one_hot(df: DataFrame, cols: Sequence[str], prefixes: dict[str, str] | None = None, keep: Sequence[str] | None = None,
            categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Indicator columns ``{prefix}_{category}`` for all observed categories, after the ``keep`` columns."""
    categories = categories or category_table(df, cols)
    keep = [c for c in df.columns if c not in cols] if keep is None else list(keep)
    return df.select(*keep, *[e for c in cols for e in _indicators(c, categories[c], prefixes)])


def _indicators(col, values, prefixes=None):
    prefix = (prefixes or {}).get(col, col)
    text = F.col(col).cast("string")
    return [F.coalesce(text == F.lit(v), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in values]


def expand_factors(df: DataFrame, factors: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Append one-hot columns of every factor, drop the factors, and count columns per factor."""
    categories = category_table(df, factors)
    return one_hot(df, factors, categories=categories), [len(categories[c]) for c in factors]


def derive_catalog(categories: dict[str, list[str]], cont: Sequence[str], cat_first: bool = True) -> list[Feature]:
    """Positions, kinds and chunks of the encoded table."""
    cats = [(k, c, v) for k, (c, values) in enumerate(categories.items()) for v in values]
    start_cat = 0 if cat_first else len(cont)
    start_cont = len(cats) if cat_first else 0
    out = [Feature(start_cat + i, f"{c}_{v}", "cat", k, v) for i, (k, c, v) in enumerate(cats)]
    out += [Feature(start_cont + i, c, "cont") for i, c in enumerate(cont)]
    return sorted(out)


def chunk_positions(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Chunk size and first flat position of every factor, from the distinct categories."""
    names = F.array(*[F.lit(c) for c in factors])
    seen = _distinct_categories(df, factors).withColumnRenamed("factor", "chunk_id")
    sizes = seen.groupBy("chunk_id").agg(F.count("*").cast("int").alias("chunk_size"))
    sizes = sizes.select("chunk_id", F.get(names, "chunk_id").alias("factor"), "chunk_size")
    before = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row per factor
    return sizes.withColumn("first_pos", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).cast("int"))


# -- sparse rows -------------------------------------------------------------------------


def one_hot_sparse(df: DataFrame, factors: Sequence[str], cont: Sequence[str] = (), keep: Sequence[str] = (),
                   categories: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[Feature]]:
    """(*keep, codes) and the catalog: each row as the (pos, v) of its features that aren't zero.

    A row holds one entry for each factor, however many categories the factor has, and one
    for each continuous column; positions are those of ``derive_catalog`` with the
    indicators first.  A null category has no entry, as its indicators are all zero;
    a category that ``categories`` doesn't list is an error.
    """
    categories = categories or category_table(df, factors)
    catalog = derive_catalog(categories, cont)
    entries = []
    for chunk, c in enumerate(categories):
        at = F.create_map(*[F.lit(x) for f in catalog if f.chunk_id == chunk for x in (f.category, f.pos)]).cast("map<string,int>")
        text = F.col(c).cast("string")
        pos = F.coalesce(F.try_element_at(at, text), F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), text)).cast("int"))
        entries.append(F.when(text.isNotNull(), F.struct(pos.alias("pos"), F.lit(1.0).alias("v"))))
    entries += [F.struct(F.lit(f.pos).alias("pos"), checked(F.col(f.feature)).alias("v")) for f in catalog if f.kind == "cont"]
    return df.select(*keep, F.array_compact(F.array(*entries)).alias("codes")), catalog


def sparse_covariance(rows: DataFrame, catalog: Sequence[Feature], codes: str = "codes") -> DataFrame:
    """Sample covariance ``(i, j, v)`` of sparse rows, by counting which entries occur together.

    A row of k entries gives k (k + 1) / 2 products, where a dense one gives p (p + 1) / 2.  The products are
    summed by cell before they are shuffled; no more than the cells that occur reach the driver.  Values
    are taken about the mean of their feature's entries, which a first scan finds for continuous features,
    so large means cost no digits.
    """
    cont = [f.pos for f in catalog if f.kind == "cont"]
    means = {}
    if cont:
        entry = rows.select(F.explode(codes).alias("e")).where(F.col("e.pos").isin(cont))
        means = {r["pos"]: r["m"] for r in entry.groupBy("e.pos").agg(F.avg("e.v").alias("m")).collect()}
    centred = F.col(codes)
    if means:
        centred = F.transform(codes, lambda e: F.struct(e["pos"].alias("pos"), (e["v"] - _shift(e["pos"], means)).alias("v")))
    # a constant entry beside the others: its products are the sums and the number of rows
    with_one = F.concat(centred, F.array(F.struct(F.lit(len(catalog)).alias("pos"), F.lit(1.0).alias("v"))))
    pairs = F.expr("flatten(transform(c, (a, k) -> transform(slice(c, k + 1, size(c)), b -> struct(least(a.pos, b.pos) AS i, greatest(a.pos, b.pos) AS j, a.v * b.v AS v))))")
    cells = rows.select(with_one.alias("c")).select(F.explode(pairs).alias("x")).groupBy("x.i", "x.j").agg(F.sum("x.v").alias("v")).toArrow()
    p = len(catalog)
    gram = np.zeros((p + 1, p + 1))
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    gram[i, j] = gram[j, i] = cells["v"].to_numpy()
    n, sums = gram[p, p], gram[p, :p]
    if n < 2:
        raise ValueError("not enough rows for a covariance")
    return matrix_table(rows.sparkSession, (gram[:p, :p] - np.outer(sums, sums) / n) / (n - 1))


def _shift(pos, means: dict[int, float]):
    out = F.lit(0.0)
    for p, m in means.items():
        out = F.when(pos == p, F.lit(m)).otherwise(out)
    return out
