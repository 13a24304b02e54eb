import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions.orderstats import exact_quantiles, order_statistics, rank_by_cells


def _table(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v DOUBLE").repartition(5)


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "geometric", "two"])
def test_ranks_match_a_sort(spark, rng, kind):
    n = 5000
    values = {
        "normal": rng.normal(size=n),
        "ties": rng.integers(0, 7, size=n).astype(float),
        "hot": np.where(rng.random(n) < 0.34, 0.5, rng.random(n)),
        "geometric": 2.0 ** -rng.integers(0, 900, size=n),
        "two": np.r_[np.zeros(n // 2), np.ones(n - n // 2)],
    }[kind]
    ranks = [0, 1, n // 4, n // 3, n // 2, n - 2, n - 1]
    got = order_statistics(_table(spark, values), {"v": ranks}, {"v": n}, collect_limit=20, sketch_size=256)["v"]
    assert [got[r] for r in ranks] == [np.sort(values)[r] for r in ranks]


def test_many_targets_over_several_columns(spark, rng):
    df = spark.range(3000).select(*[F.rand(k).alias(f"c{k}") for k in range(5)]).cache()
    ranks = {f"c{k}": list(range(0, 3000, 300)) for k in range(5)}
    got = order_statistics(df, ranks, dict.fromkeys(ranks, 3000), collect_limit=100, sketch_size=256)
    rows = df.toPandas()
    for c, rs in ranks.items():
        assert [got[c][r] for r in rs] == [np.sort(rows[c])[r] for r in rs]


def test_integer_keys_stay_integers(spark):
    df = spark.range(1000).select((F.col("id") * 3 + 2**53 + 1).alias("v"))
    assert order_statistics(df, {"v": [500]}, {"v": 1000}, collect_limit=10, sketch_size=256)["v"][500] == 500 * 3 + 2**53 + 1


def test_large_path_equals_small_path(spark, rng):
    values = list(rng.normal(size=999)) + [None, float("nan")]
    df = _table(spark, values)
    probs = {"v": [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]}
    a = exact_quantiles(df, probs)["v"]
    b = exact_quantiles(df, probs, collect_limit=10, sketch_size=256)["v"]
    assert np.allclose(a, b, rtol=0, atol=1e-12)
    assert np.allclose(a, np.quantile(values[:-2], probs["v"]), rtol=0, atol=1e-12)


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError):
        order_statistics(_table(spark, [1, 2]), {"v": [2]}, {"v": 2})


@pytest.mark.parametrize("guess", [(0.0, 20.0), (1e-3, 2e-3), (500.0, 501.0)])
def test_rank_by_cells(spark, rng, guess):
    n = 4000
    x = np.column_stack([rng.chisquare(4, size=n), np.where(rng.random(n) < 0.4, 3.0, rng.chisquare(4, size=n)), np.full(n, 2.5)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a DOUBLE, b DOUBLE, c DOUBLE").repartition(4)
    for rank in (0, 1999, 3999):
        got = rank_by_cells(df, ["a", "b", "c"], rank, n, dict.fromkeys("abc", guess), cells=16, collect_limit=30)
        assert [got[c] for c in "abc"] == [np.sort(x[:, k])[rank] for k in range(3)]
