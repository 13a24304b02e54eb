"""Scores of a feature selection, confusion counts, ROC curves and histograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorframe.functions import ranges
from mirrorframe.functions.vectors import Features, width
from mirrorframe.operators.project import binarize

SCORES_PER_RANGE = 1_000_000


def selection_counts(selected: DataFrame, truth: DataFrame, universe: DataFrame | None = None, run: str = "run_id",
                     feature: str = "feature") -> DataFrame:
    """Sizes of the selected set, the true set, their overlap and the rest, per run.

    The sets are tagged and stacked, so one aggregate by (run, feature) does the
    work of all membership tests.  A run that occurs in any table is reported.
    """
    def tag(df, s, t, u):
        return df.select(run, feature, F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(u).alias("u"))

    stacked = tag(selected, 1, 0, 0).unionByName(tag(truth, 0, 1, 0))
    if universe is not None:
        stacked = stacked.unionByName(tag(universe, 0, 0, 1))
    member = stacked.groupBy(run, feature).agg(F.max("s").alias("s"), F.max("t").alias("t"), F.max("u").alias("u"))
    s, t, u = (F.col(c) == 1 for c in "stu")
    return member.groupBy(run).agg(
        F.count_if(s).alias("n_selected"),
        F.count_if(t).alias("n_true"),
        F.count_if(s & t).alias("n_hit"),
        F.count_if(u & ~s).alias("n_rest"),
        F.count_if(u & ~s & t).alias("n_missed"),
    )


def _share(part, whole):
    return F.bround(F.col(part) / F.greatest(F.lit(1), F.col(whole)), 2)


def fdr(selected: DataFrame, truth: DataFrame, run: str = "run_id", feature: str = "feature") -> DataFrame:
    """Share of selected features that are not true."""
    c = selection_counts(selected, truth, run=run, feature=feature)
    return c.withColumn("n_false", F.col("n_selected") - F.col("n_hit")).select(run, _share("n_false", "n_selected").alias("fdr"))


def power(selected: DataFrame, truth: DataFrame, run: str = "run_id", feature: str = "feature") -> DataFrame:
    """Share of true features that are selected."""
    return selection_counts(selected, truth, run=run, feature=feature).select(run, _share("n_hit", "n_true").alias("power"))


def fnp(selected: DataFrame, truth: DataFrame, universe: DataFrame, run: str = "run_id", feature: str = "feature") -> DataFrame:
    """Share of the features not selected that are true."""
    c = selection_counts(selected, truth, universe, run, feature)
    return c.select(run, _share("n_missed", "n_rest").alias("fnp"))


def confusion(df: DataFrame, y: str, t: str, threshold: float = 0.5) -> DataFrame:
    """Predicted against observed counts with sensitivity, specificity and accuracy in percent."""
    cat = binarize(df, y, threshold, "_cat").select(F.col("_cat").alias("c"), F.col(t).cast("int").alias("o"))
    n = cat.agg(
        F.count_if((F.col("c") == 1) & (F.col("o") == 1)).alias("a11"),
        F.count_if((F.col("c") == 1) & (F.col("o") == 0)).alias("a12"),
        F.count_if((F.col("c") == 0) & (F.col("o") == 1)).alias("a21"),
        F.count_if((F.col("c") == 0) & (F.col("o") == 0)).alias("a22"),
    )

    def percent(part, whole):
        return F.bround(F.try_divide(100.0 * part, whole), 1)

    a11, a12, a21, a22 = (F.col(c) for c in ("a11", "a12", "a21", "a22"))
    return n.select(
        "a11", "a12", "a21", "a22",
        percent(a11, a11 + a21).alias("sensitivity"),
        percent(a22, a22 + a12).alias("specificity"),
        percent(a11 + a22, a11 + a12 + a21 + a22).alias("accuracy"),
    )


def _cumulated(df: DataFrame, prob: str, observed: str, scores_per_range: int):
    """Cumulated true and false positives per distinct score, from the highest down.

    Equal scores are aggregated first, so a very frequent score is one row.  The
    distinct scores are then split into ranges; totals per range (a small table)
    carry the sums over range borders.
    """
    label = F.col(observed).cast("int")
    scored = df.select(F.col(prob).cast("double").alias("score"), (label == 1).cast("int").alias("one"), (label == 0).cast("int").alias("zero"))
    step = scored.groupBy("score").agg(F.sum("one").alias("pos"), F.sum("zero").alias("neg"))
    # edges from the plain rows: the aggregated table is then shuffled only once,
    # as both the totals and the running sums read the same exchange
    edges = ranges.range_edges(scored, "score", scores_per_range)
    step = step.withColumn("_range", ranges.range_of("score", edges))
    totals = step.groupBy("_range").agg(
        F.sum("pos").alias("rp"), F.sum("neg").alias("rn"), F.max_by("pos", "score").alias("top_pos"), F.max_by("neg", "score").alias("top_neg")
    )
    down = Window.orderBy(F.desc("_range"))  # one row per range
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("n0"),
        F.sum("rp").over(whole).alias("P"),
        F.sum("rn").over(whole).alias("N"),
        F.lag("_range").over(down).isNull().alias("first_range"),
        F.lead("top_pos").over(down).alias("below_pos"),
        F.lead("top_neg").over(down).alias("below_neg"),
    )
    local = Window.partitionBy("_range").orderBy(F.desc("score"))
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    # a left join: an inner one would push "range is not null" below the aggregate
    # of one side only, and the two sides would no longer share their exchange
    joined = step.join(F.broadcast(offsets), "_range", "left")
    return joined.select(
        "score", "pos", "neg", "P", "N",
        (F.col("p0") + F.sum("pos").over(run)).alias("tp"),
        (F.col("n0") + F.sum("neg").over(run)).alias("fp"),
        (F.col("first_range") & (F.row_number().over(local) == 1)).alias("is_first"),
        F.coalesce(F.lead("pos").over(local), F.col("below_pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(local), F.col("below_neg")).alias("next_neg"),
    )


def roc_curve(df: DataFrame, prob: str, observed: str, drop_intermediate: bool = True,
              scores_per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, after the start point (0, 0).

    ``drop_intermediate`` leaves out inner points on a straight line.  The start
    point carries the highest score plus one as its threshold.
    """
    c = _cumulated(df, prob, observed, scores_per_range)
    fpr, tpr = F.try_divide(F.col("fp"), F.col("N")), F.try_divide(F.col("tp"), F.col("P"))
    start = F.struct((F.col("score") + 1.0).alias("threshold"), F.try_divide(F.lit(0), F.col("N")).alias("fpr"),
                     F.try_divide(F.lit(0), F.col("P")).alias("tpr"))
    point = F.struct(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    if drop_intermediate:
        c = c.where(F.col("is_first") | last | bend)
    points = F.when(F.col("is_first"), F.array(start, point)).otherwise(F.array(point))
    return c.select(F.inline(points))


def roc_auc(df: DataFrame, prob: str, observed: str, scores_per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores share one step."""
    c = _cumulated(df, prob, observed, scores_per_range)
    slab = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0)
    total = c.agg(F.sum(slab).alias("area"), F.max("P").alias("P"), F.max("N").alias("N"))
    area = F.try_divide(F.col("area"), F.col("P").cast("double") * F.col("N"))
    return total.select(F.col("P").alias("n_pos"), F.col("N").alias("n_neg"), area.alias("auc"))


def feature_histogram(df: DataFrame, cols: Features, bins: int = 10) -> DataFrame:
    """Equal-width histogram of every column, or of every position of an array column: ``(feature, bin, low, high, n)``.

    Empty bins are included.  Nulls, NaN and infinities are in no bin and don't set
    the range.  A feature with one value gets a range of width one around it; one
    without any finite value is an error.  Two scans: each task keeps the range, then
    p x bins counts, of the rows it reads.
    """
    names = [f"{cols}_{k}" for k in range(width(df, cols))] if isinstance(cols, str) else list(cols)
    p = len(names)
    x = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    vectors = df.select(x.alias("x"))

    def values(batch):
        lists = batch.column("x")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        if lists.null_count or len(flat) != p * len(lists):
            raise ValueError(f"every row needs {p} features")
        flat = flat.reshape(-1, p)
        return flat, np.isfinite(flat)

    def extremes(batches):
        low, high = np.full(p, np.inf), np.full(p, -np.inf)
        for batch in batches:
            if batch.num_rows:
                v, ok = values(batch)
                low, high = np.minimum(low, np.where(ok, v, np.inf).min(axis=0)), np.maximum(high, np.where(ok, v, -np.inf).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p), pa.int32()), pa.array(low), pa.array(high)], names=["k", "low", "high"])

    ends = {r["k"]: (r["low"], r["high"]) for r in vectors.mapInArrow(extremes, "k INT, low DOUBLE, high DOUBLE").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    ends = [ends.get(k, (np.inf, -np.inf)) for k in range(p)]
    empty = [c for c, (low, high) in zip(names, ends, strict=True) if low > high]
    if empty:
        raise ValueError(f"no values in {empty}")
    low, high = np.array([(a - 0.5, b + 0.5) if a == b else (a, b) for a, b in ends]).T
    step = (high - low) / bins

    def count(batches):
        total = np.zeros(p * bins, np.int64)
        for batch in batches:
            if batch.num_rows:
                v, ok = values(batch)
                bin_ = np.minimum(np.floor((np.where(ok, v, low) - low) / step).astype(np.int64), bins - 1) + np.arange(p) * bins
                total += np.bincount(bin_[ok], minlength=p * bins)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // bins, pa.int32()), pa.array(at % bins, pa.int32()), pa.array(total[at])], names=["k", "bin", "n"])

    counts = vectors.mapInArrow(count, "k INT, bin INT, n LONG").groupBy("k", "bin").agg(F.sum("n").alias("n"))
    k, b = np.repeat(np.arange(p, dtype=np.int32), bins), np.tile(np.arange(bins, dtype=np.int32), p)
    frame = df.sparkSession.createDataFrame(pa.table({
        "k": k, "feature": pa.array([names[i] for i in k]), "bin": b, "low": low[k] + b * (high - low)[k] / bins, "high": low[k] + (b + 1) * (high - low)[k] / bins,
    }))
    return frame.join(counts, ["k", "bin"], "left").select("feature", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))
