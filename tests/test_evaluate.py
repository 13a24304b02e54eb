import numpy as np
import pytest

from mirrorframe.operators import evaluate


def _set(spark, rows):
    return spark.createDataFrame(rows, "run_id INT, feature INT")


def _value(df):
    return {r[0]: r[1] for r in df.collect()}


def test_selection_scores(spark):
    s = _set(spark, [(0, 1), (0, 2), (0, 3), (2, 1)])
    t = _set(spark, [(0, 2), (0, 9), (1, 1), (2, 1)])
    u = _set(spark, [(r, f) for r in range(3) for f in range(10)])
    assert _value(evaluate.fdr(s, t)) == {0: 0.67, 1: 0.0, 2: 0.0}
    assert _value(evaluate.power(s, t)) == {0: 0.5, 1: 0.0, 2: 1.0}
    assert _value(evaluate.fnp(s, t, u)) == {0: 0.14, 1: 0.1, 2: 0.0}


def test_empty_sets(spark):
    none, some = _set(spark, []), _set(spark, [(0, 1)])
    assert _value(evaluate.fdr(none, some)) == {0: 0.0}
    assert _value(evaluate.power(some, none)) == {0: 0.0}
    assert _value(evaluate.fdr(some, none)) == {0: 1.0}


def _scored(spark, score, label):
    return spark.createDataFrame(list(zip(map(float, score), map(int, label), strict=True)), "s DOUBLE, y INT").repartition(3)


def test_confusion(spark):
    r = evaluate.confusion(_scored(spark, [0.5, 0.9, 0.1, 0.7, 0.2], [1, 1, 1, 0, 0]), "s", "y").head()
    assert (r["a11"], r["a12"], r["a21"], r["a22"]) == (2, 1, 1, 1)
    assert (r["sensitivity"], r["specificity"], r["accuracy"]) == (66.7, 50.0, 60.0)


def test_area_of_trivial_scores(spark):
    assert evaluate.roc_auc(_scored(spark, [1, 1, 1, 1], [0, 1, 0, 1]), "s", "y").head()["auc"] == 0.5
    assert evaluate.roc_auc(_scored(spark, [1, 2, 3, 4], [0, 0, 1, 1]), "s", "y").head()["auc"] == 1.0
    assert evaluate.roc_auc(_scored(spark, [1, 2], [1, 1]), "s", "y").head()["auc"] is None


def _brute_curve(score, label):
    points = [(0.0, 0.0)]
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        points.append(((hit & (label == 0)).sum() / (label == 0).sum(), (hit & (label == 1)).sum() / (label == 1).sum()))
    return points


@pytest.mark.parametrize("per_range", [10**6, 20])
def test_curve_and_area(spark, rng, per_range):
    score = np.round(rng.random(400), 2)
    score[:130] = 0.4
    label = (rng.random(400) < score).astype(int)
    df = _scored(spark, score, label)
    want = _brute_curve(score, label)
    got = evaluate.roc_curve(df, "s", "y", drop_intermediate=False, scores_per_range=per_range).orderBy("threshold", ascending=False).collect()
    assert np.allclose([(r["fpr"], r["tpr"]) for r in got], want)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(want, want[1:]))
    assert evaluate.roc_auc(df, "s", "y", scores_per_range=per_range).head()["auc"] == pytest.approx(area)
    short = evaluate.roc_curve(df, "s", "y", scores_per_range=per_range).orderBy("threshold", ascending=False).collect()
    pts = [(r["fpr"], r["tpr"]) for r in short]
    assert len(pts) <= len(want)
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:])) == pytest.approx(area)


def test_histogram(spark, rng):
    x = rng.normal(size=500)
    df = spark.createDataFrame([(float(v), 2.0) for v in x], "a DOUBLE, c DOUBLE")
    rows = evaluate.feature_histogram(df, ["a", "c"], 8).orderBy("feature", "bin").collect()
    assert [r["n"] for r in rows[:8]] == np.histogram(x, 8)[0].tolist()
    assert [r["n"] for r in rows[8:]] == np.histogram(np.full(500, 2.0), 8)[0].tolist()


def test_histogram_leaves_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "a DOUBLE")
    rows = evaluate.feature_histogram(df, ["a"], 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["n"]) for r in rows] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]
    both = df.selectExpr("array(a, a * 2) AS x")
    assert [r["n"] for r in evaluate.feature_histogram(both, "x", 2).orderBy("feature", "bin").collect()] == [1, 2, 1, 2]
    with pytest.raises(ValueError, match="no values"):
        evaluate.feature_histogram(df.where("isnan(a)"), ["a"])
