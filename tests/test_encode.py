import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirrorframe.operators import encode, moments, project


def _codes(spark, values, q, **options):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "id INT, v DOUBLE")
    return [r["v"] for r in encode.quantile_bin(df, ["v"], q, **options).orderBy("id").collect()]


@pytest.mark.parametrize("q", [2, 3, 4, 5])
def test_codes_equal_qcut(spark, rng, q):
    for values in (rng.normal(size=203), rng.integers(0, 40, size=203)):
        want = pd.qcut(pd.Series(values), q, labels=False).tolist()
        assert _codes(spark, values, q) == want


def test_tied_edges(spark):
    values = [1, 1, 1, 1, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        _codes(spark, values, 4)
    assert _codes(spark, values, 4, duplicates="drop") == pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop").tolist()


def test_constant_column_is_rejected(spark):
    with pytest.raises(ValueError):
        _codes(spark, [3, 3, 3], 2)


def test_null_has_no_code(spark):
    assert _codes(spark, [1, 2, None, 3, 4, float("nan")], 2) == [0, 0, None, 1, 1, None]


def test_approximate_edges_are_close(spark, rng):
    values = rng.normal(size=2000)
    codes = np.array(_codes(spark, values, 4, approx=True))
    assert np.abs(np.bincount(codes) - 500).max() <= 2


def test_one_hot_chunks(spark):
    df = spark.createDataFrame([(0, "b", "x"), (1, "a", "y"), (2, None, "x")], "id INT, f STRING, g STRING")
    table, chunk_list = encode.expand_factors(df, ["f", "g"])
    assert table.columns == ["id", "f_a", "f_b", "g_x", "g_y"] and chunk_list == [2, 2]
    rows = {r["id"]: tuple(r)[1:] for r in table.collect()}
    assert rows == {0: (0, 1, 1, 0), 1: (1, 0, 0, 1), 2: (0, 0, 1, 0)}


def test_too_many_categories_is_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("f"))
    with pytest.raises(ValueError):
        encode.category_table(df, ["f"], max_categories=49)
    assert len(encode.category_table(df, ["f"], max_categories=50)["f"]) == 50


def test_catalog_positions(spark):
    categories = {"f": ["a", "b"], "g": ["x", "y", "z"]}
    first = encode.derive_catalog(categories, ["u", "v"])
    assert [(f.pos, f.feature, f.kind, f.chunk_id) for f in first] == [
        (0, "f_a", "cat", 0), (1, "f_b", "cat", 0), (2, "g_x", "cat", 1), (3, "g_y", "cat", 1), (4, "g_z", "cat", 1), (5, "u", "cont", None), (6, "v", "cont", None)]
    last = encode.derive_catalog(categories, ["u", "v"], cat_first=False)
    assert [f.feature for f in last][:2] == ["u", "v"]
    assert encode.catalog_table(spark, first).count() == 7
    with pytest.raises(ValueError):
        project.validate_catalog(spark.range(1), first)


def test_hconcat_and_drop_reject_bad_names(spark):
    df = spark.range(3).withColumnRenamed("id", "row_id").withColumn("a", F.lit(1))
    with pytest.raises(ValueError):
        project.hconcat(df, df)
    with pytest.raises(ValueError):
        project.drop_columns(df, ["Y"])


def test_row_normalize_keeps_zero_rows(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "x ARRAY<DOUBLE>")
    assert [r["x"] for r in project.row_normalize(df, "x").collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_hconcat_needs_the_same_keys(spark):
    left, right = (spark.range(a, a + 5).withColumnRenamed("id", "row_id").withColumn(c, F.lit(1)) for a, c in ((0, "x"), (1, "y")))
    with pytest.raises(Exception, match="on one side only"):
        project.hconcat(left, right).collect()
    assert project.hconcat(left, left.withColumnRenamed("x", "y")).columns == ["row_id", "x", "y"]
    parent = left.withColumn("y", F.lit(2))
    joined = project.hconcat_parts(parent, [["y"], ["x"]])
    assert joined.columns == ["row_id", "y", "x"] and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_array_forms_equal_the_named_ones(spark, rng):
    x = rng.normal(size=(301, 3))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    arrays = df.select("id", F.array("a", "b", "c").alias("x")).repartition(4)
    named = {r["id"]: list(r)[1:] for r in encode.quantile_bin(df, ["a", "b", "c"], 4).collect()}
    assert {r["id"]: r["x"] for r in encode.quantile_bin_array(arrays, "x", 4).collect()} == named
    scaled = {r["id"]: r["x"] for r in project.standardize_array(arrays, "x", [0.5, 0, 0], [4.0, 1.0, 9.0]).collect()}
    assert np.allclose([scaled[k] for k in range(301)], (x - [0.5, 0, 0]) / [2, 1, 3])
    score = {r["id"]: r["xbeta"] for r in project.linear_score_array(arrays, "x", [1.0, 2.0, 3.0]).collect()}
    assert np.allclose([score[k] for k in range(301)], x @ [1, 2, 3])
    with pytest.raises(Exception, match="expected 2 features"):
        project.linear_score_array(arrays, "x", [1.0, 2.0]).collect()
    with pytest.raises(ValueError, match="not distinct"):
        encode.quantile_bin_array(df.selectExpr("array(a, 1.0D) AS x"), "x", 4)


def test_sparse_rows_and_their_covariance(spark, rng):
    n = 400
    rows = [(int(i), None if rng.uniform() < 0.1 else str(rng.choice(["a", "b_c", "c"])), int(rng.integers(0, 30)), float(1e6 + rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id LONG, f STRING, g INT, x DOUBLE").repartition(3)
    sparse, catalog = encode.one_hot_sparse(df, ["f", "g"], ["x"], keep=["id"])
    names = [f.feature for f in catalog]
    dense = encode.one_hot(df, ["f", "g"], keep=["id", "x"]).select("id", *names)
    want = {r["id"]: {k: float(v) for k, v in enumerate(r[1:]) if v} for r in dense.collect()}
    assert {r["id"]: {e["pos"]: e["v"] for e in r["codes"]} for r in sparse.collect()} == want
    table = np.array([r[1:] for r in dense.collect()], float)
    got = moments.collect_matrix(encode.sparse_covariance(sparse, catalog))
    assert np.allclose(got, np.cov(table, rowvar=False), atol=1e-9)
    with pytest.raises(Exception, match="unknown category of f: b_c"):
        encode.one_hot_sparse(df, ["f"], categories={"f": ["a", "c"]})[0].collect()
    with pytest.raises(ValueError, match="not enough rows"):
        encode.sparse_covariance(sparse.limit(1), catalog)
