import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import draws, ranges
from mirrorframe.operators import sample


def test_numpy_hash_equals_builtin(spark):
    rows = spark.range(50).select("id", draws.hash_key(9, "id").alias("h"), draws.hash_key(9, "id", F.lit(3).cast("long")).alias("h3")).collect()
    h = np.array([r["h"] for r in rows], dtype=np.int64)
    h3 = np.array([r["h3"] for r in rows], dtype=np.int64)
    assert (draws.hash_long_np(np.array([3]), h.view(np.uint64)).view(np.int64) == h3).all()


def test_normals_look_normal(spark):
    h = np.array([r[0] for r in spark.range(20000).select(draws.hash_key(1, "id")).collect()], dtype=np.int64)
    z = draws.normals_np(h, 5)
    assert z.shape == (20000, 5)
    assert np.abs(z.mean(axis=0)).max() < 0.03
    assert np.abs(np.cov(z, rowvar=False) - np.eye(5)).max() < 0.04


@pytest.mark.parametrize("n, want", [(5, 2), (7, 4), (3, 2), (1, 0)])
def test_half_even_count(spark, n, want):
    assert sample.sample_exact(spark.range(n), 0.5, "id").count() == want


def test_sample_is_exact_for_any_layout(spark):
    want = None
    for parts in (1, 3, 16):
        df = spark.range(0, 10000, 1, parts)
        ids = sorted(r["id"] for r in sample.sample_exact(df, 0.3, "id", 7).collect())
        assert len(ids) == 3000
        want = want or ids
        assert ids == want


def test_narrowing_rounds_agree_with_a_sort(spark):
    df = spark.range(20000)
    rows = sorted((r["h"], r["id"]) for r in df.select("id", draws.hash_bits(3, "id").alias("h")).collect())
    for k in (1, 777, 10000, 19999):
        cut = sample.sample_cut(df, "id", k=k, seed=3, boundary_rows=1)
        assert (cut.last_hash, cut.last_key) == rows[k - 1]
        assert df.where(cut.condition(df)).count() == k


def test_empty_and_full_sample(spark):
    df = spark.range(10)
    assert sample.sample_exact(df, 0.0, "id").count() == 0
    assert sample.sample_exact(df, 1.0, "id").count() == 10


def test_split_is_a_partition(spark):
    rows = sample.train_holdout_split(spark.range(1000), 0.8, "id").groupBy("is_train").count().collect()
    assert {r["is_train"]: r["count"] for r in rows} == {True: 800, False: 200}


def test_last_batch_is_short(spark):
    rows = sample.assign_batches(spark.range(7), "id", batch_size=3).orderBy("id").collect()
    assert [r["batch_id"] for r in rows] == [0, 0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("rows_per_range", [50, 7, 10**6])
def test_positions_with_many_ranges(spark, rows_per_range):
    keys = [k * k for k in range(1000)]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k LONG").repartition(6)
    rows = sample.with_position(df, "k", rows_per_range=rows_per_range).collect()
    assert {r["k"]: r["position"] for r in rows} == {k: i for i, k in enumerate(keys)}


def test_positions_with_more_ranges_than_a_sketch_separates(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SKETCH_RANGES", 10)
    monkeypatch.setattr(ranges, "SAMPLES_PER_RANGE", 4)
    df = spark.range(3000).select((F.col("id") * F.col("id")).alias("k"))
    edges = ranges.range_edges(df, "k", 20)
    assert 100 < len(edges) < 200 and edges == sorted(set(edges))
    rows = sample.with_position(df, "k", rows_per_range=20).collect()
    assert {r["k"]: r["position"] for r in rows} == {i * i: i for i in range(3000)}
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1.0)).otherwise(F.col("id").cast("double")).alias("s"))
    assert len(ranges.range_edges(hot, "s", 20)) < 150


def test_few_and_many_batches_agree(spark):
    df = spark.range(0, 3000, 3)
    few = {r["id"]: r["batch_id"] for r in sample.assign_batches(df, "id", batch_size=100).collect()}
    placed = sample.with_position(df, "id", rows_per_range=37).collect()
    assert few == {r["id"]: r["position"] // 100 for r in placed}


@pytest.mark.parametrize("n, rows_per_range", [(1000, 10**6), (1000, 31), (1001, 31), (1, 10)])
def test_neighbour_pairs(spark, n, rows_per_range):
    df = spark.range(n).select((F.col("id") * 7).alias("k"), F.col("id").alias("v")).repartition(5)
    pairs = sample.neighbour_pairs(df, "k", ["v"], rows_per_range).collect()
    odd = [(n - 2, n - 1)] if n % 2 and n > 1 else []  # the last one is paired with the row before it
    assert sorted((r["a"]["v"], r["b"]["v"]) for r in pairs) == sorted([(2 * i, 2 * i + 1) for i in range(n // 2)] + odd)


def test_shuffle_keeps_the_values(spark):
    df = spark.range(50).select("id", F.sequence(F.lit(0), F.lit(9)).alias("x"))
    rows = sample.shuffle_within_row(df, "x", "id", 1).collect()
    assert all(sorted(r["x"]) == list(range(10)) for r in rows)
    assert len({tuple(r["x"]) for r in rows}) > 40


def test_gumbel_frequencies_follow_the_logits(spark):
    p = np.array([0.5, 0.3, 0.2])
    df = spark.range(20000).select("id", F.array(*[F.lit(float(np.log(v))) for v in p], F.lit(0.0), F.lit(0.0)).alias("x"))
    rows = sample.gumbel_onehot(df, "x", "id", 1.0, 4, [3, 2]).select([F.avg(F.col("onehot")[k]) for k in range(5)]).head()
    assert np.abs(np.array(rows[:3]) - p).max() < 0.02
    assert np.abs(np.array(rows[3:]) - 0.5).max() < 0.02


def test_soft_probs_sum_to_one_and_agree_with_the_hard_draw(spark):
    df = spark.range(200).select("id", F.array(*[F.lit(v) for v in (300.0, -300.0, 0.0)]).alias("x"))
    both = sample.gumbel_onehot(sample.soft_probs(df, "x", "id", 0.3, 2), "x", "id", 0.3, 2).collect()
    for r in both:
        assert sum(r["probs"]) == pytest.approx(1.0)
        assert np.argmax(r["probs"]) == np.argmax(r["onehot"])


def test_draws_do_not_depend_on_the_width_of_the_key(spark):
    wide = spark.range(1000).select("id", F.array(*[F.lit(float(k)) for k in range(5)]).alias("x"))
    narrow = wide.withColumn("id", F.col("id").cast("int"))

    def ids(df):
        return sorted(r["id"] for r in df.collect())

    assert ids(sample.sample_exact(wide, 0.3, "id")) == ids(sample.sample_exact(narrow, 0.3, "id"))
    for draw in (lambda df: sample.shuffle_within_row(df, "x", "id", 4), lambda df: sample.soft_probs(df, "x", "id", 0.5, 4), lambda df: sample.gumbel_onehot(df, "x", "id", 0.5, 4)):
        a, b = (sorted(map(tuple, draw(df).collect())) for df in (wide, narrow))
        assert a == b
