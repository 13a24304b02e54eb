import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions.vectors import drop_incomplete
from mirrorframe.operators import moments


def test_known_covariance(spark):
    # Eight rows of two features with variances 6 and 6 and covariance 30/7.
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 6.0), (6.0, 5.0), (7.0, 8.0), (8.0, 7.0)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE")
    got = moments.collect_matrix(moments.covariance(df, ["a", "b"]))
    assert np.allclose(got, np.cov(np.array(rows), rowvar=False))
    assert np.allclose(got, [[6, 38 / 7], [38 / 7, 6]])


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_moments_do_not_depend_on_the_layout(vectors, rng, partitions):
    x = rng.normal(size=(500, 12)) * 2 + 1e6
    n, mean, cov = moments.mean_and_cov(vectors(x, partitions), "x")
    assert n == 500
    assert np.allclose(mean, x.mean(axis=0), rtol=1e-12)
    assert np.allclose(cov, np.cov(x, rowvar=False), rtol=1e-7, atol=1e-7)
    assert np.allclose(moments.collect_vector(moments.mean_vector(vectors(x, partitions), "x")), x.mean(axis=0), rtol=1e-12)


def test_named_columns_take_both_ways(spark, rng):
    x = rng.normal(size=(200, 10))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{k} DOUBLE" for k in range(10)))
    few = moments.mean_and_cov(df, ["c0", "c1", "c2"])
    many = moments.mean_and_cov(df, [f"c{k}" for k in range(10)])
    assert np.allclose(few[2], many[2][:3, :3])
    assert np.allclose(many[2], np.cov(x, rowvar=False))


def test_missing_values_fail_or_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, float("nan")), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    with pytest.raises(Exception, match="null or NaN"):
        moments.covariance(df, ["a", "b"])
    with pytest.raises(Exception, match="null or NaN"):
        moments.covariance(df.select(F.array("a", "b").alias("x")), "x")
    assert drop_incomplete(df, ["a", "b"]).count() == 2
    assert drop_incomplete(df.select(F.array("a", "b").alias("x")), "x").count() == 2


def test_ragged_vectors_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "x ARRAY<DOUBLE>")
    with pytest.raises(Exception):
        moments.covariance(df, "x")


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        moments.covariance(spark.createDataFrame([(1.0, 2.0)], "a DOUBLE, b DOUBLE"), ["a", "b"])


def test_correlation_needs_variance(spark):
    cov = moments.matrix_table(spark, np.array([[1.0, 0.0], [0.0, 0.0]]))
    assert [r["i"] for r in moments.constant_features(cov).collect()] == [1]
    with pytest.raises(Exception, match="without variance"):
        moments.cov_to_corr(cov).collect()


def test_ridge_variants(spark):
    a = np.array([[1.0, 2.0], [2.0, 1.0]])
    cov = moments.matrix_table(spark, a)
    assert np.allclose(moments.collect_matrix(moments.ridge(cov, 0.5)), a + 0.5 * np.eye(2))
    assert np.allclose(moments.collect_matrix(moments.ridge(cov, [1, 2])), a + np.diag([1, 2]))
    assert np.allclose(moments.collect_matrix(moments.ridge_if_not_psd(cov, 3.0)), a + 3 * np.eye(2))
    good = moments.matrix_table(spark, np.eye(2))
    assert np.allclose(moments.collect_matrix(moments.ridge_if_not_psd(good, 3.0)), np.eye(2))


def test_shapes(spark):
    got = moments.collect_matrix(moments.structured_corr(spark, 3, [0.5, 0.2]))
    assert np.allclose(got, [[1, 0.5, 0.1], [0.5, 1, 0.2], [0.1, 0.2, 1]])
    assert np.allclose(moments.collect_matrix(moments.structured_corr(spark, 3, 0.3, "constant")), 0.3 + 0.7 * np.eye(3))
    with pytest.raises(ValueError):
        moments.structured_corr(spark, 3, 1.5)
