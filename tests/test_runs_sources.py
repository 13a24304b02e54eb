import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.operators import moments, sample
from mirrorframe.plans import runs
from mirrorframe.sources import tables


def _csv(folder, name, header, values):
    path = folder / name
    path.write_text("\n".join([header, *map(str, values)]) + "\n")
    return str(path)


def _lists(tmp_path, chunks=(2, 3), index=(3, 4, 5, 6, 7)):
    return (_csv(tmp_path, "f.csv", "variable", ["sex", "site"]), _csv(tmp_path, "c.csv", "X1", chunks),
            _csv(tmp_path, "i.csv", "X1", index), _csv(tmp_path, "n.csv", "variable", ["age", "height"]))


def test_feature_lists(spark, tmp_path):
    groups = _csv(tmp_path, "g.csv", "var_names,groups", ["age,1", "height,2", "sex,2"])
    catalog = tables.read_feature_lists(spark, *_lists(tmp_path), groups=groups)
    assert [f.pos for f in catalog] == list(range(7))
    assert [f.kind for f in catalog] == ["cont"] * 2 + ["cat"] * 5
    assert [f.chunk_id for f in catalog] == [None, None, 0, 0, 1, 1, 1]
    assert [f.group_id for f in catalog] == [1, 2, 2, 2, None, None, None]
    named = tables.read_feature_lists(spark, *_lists(tmp_path), columns=["age", "height", "m", "f", "a", "b", "c"])
    assert [f.feature for f in named][2:] == ["m", "f", "a", "b", "c"]


def test_inconsistent_lists(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_feature_lists(spark, *_lists(tmp_path, chunks=(2, 2)))
    with pytest.raises(ValueError):
        tables.read_feature_lists(spark, *_lists(tmp_path, index=(2, 3, 4, 5, 6)))
    with pytest.raises(ValueError):
        tables.read_feature_lists(spark, *_lists(tmp_path), columns=["age", "weight", "m", "f", "a", "b", "c"])


def test_csv_features_and_train_index(spark, tmp_path):
    path = _csv(tmp_path, "t.csv", "id,a,b,Y,W", [f"{k},{k},{k * 2.5},0,1" for k in range(30)])
    with pytest.raises(ValueError, match="id_col"):
        tables.read_features(spark, path, "value STRING", fmt="text")
    for schema in (None, "id LONG, a DOUBLE, b DOUBLE, Y INT, W INT"):
        df = tables.read_features(spark, path, schema, id_col="id")
        assert df.columns == ["row_id", "a", "b", "Y", "W"]
        assert df.select("row_id").distinct().count() == 30
    out = str(tmp_path / "train")
    train = sample.sample_exact(df, 0.8, "row_id")
    tables.write_train_index(train, out)
    assert {r[0] for r in spark.read.parquet(out).collect()} == {r["row_id"] for r in train.collect()}


def test_grid(spark):
    grid = runs.param_grid(spark, (0.0055, 0.001, 3), (0.01, 0.001, 2)).orderBy("run_id").collect()
    assert [r["run_id"] for r in grid] == list(range(6))
    assert np.allclose([r["lambda"] for r in grid], np.repeat(np.linspace(0.0055, 0.001, 3), 2))
    assert np.allclose([r["delta"] for r in grid], np.tile(np.linspace(0.01, 0.001, 2), 3))
    both = runs.sweep_dimension(runs.listed_pairs(spark, [(0.001, 0.01), (0.0055, 0.0078)]), [50, 100])
    rows = both.orderBy("run_id").collect()
    assert [(r["run_id"], r["p"]) for r in rows] == [(0, 50), (1, 100), (2, 50), (3, 100)]


def test_unknown_model_fails(spark):
    df = spark.createDataFrame([(0, "weibull")], "run_id INT, model STRING")
    with pytest.raises(Exception, match="unknown model"):
        runs.lookup_params(df).collect()
    missing = spark.createDataFrame([(0, "mixed")], "run_id INT, model STRING")
    row = runs.override_params(runs.lookup_params(missing)).head()
    assert (row["lambda"], row["delta"], row["test_n"]) == (0.00324, 0.01, None)


def test_label(spark):
    df = spark.createDataFrame([("mixed", 0.00775, 1.0, 50, "2020-03-04 05:06:07.089")], "model STRING, lambda DOUBLE, delta DOUBLE, p INT, at STRING")
    df = df.withColumn("at", F.to_timestamp("at"))
    assert runs.run_label(df).head()["run_label"] == "mixed_0.0078_1.0"
    assert runs.run_label(df, with_p=True, at="at").head()["run_label"] == "mixed_0.0078_1.0_p_50_2020-03-04T05:06:07-08"
    tiny = spark.createDataFrame([("sparse", 0.0001, 0.0)], "model STRING, lambda DOUBLE, delta DOUBLE")
    assert runs.run_label(tiny).head()["run_label"] == "sparse_0.0001_0.0"


def test_record(spark):
    target = moments.vector_table(spark, [0.1, 0.2, 0.3])
    run = runs.override_params(runs.lookup_params(spark.createDataFrame([(0, "sparse")], "run_id INT, model STRING")))
    r = runs.assemble_run_config(spark.range(101), run, target, chunk_list=[2], cat_var_idx=[1, 2], batch_frac=0.2).head()
    assert (r["p"], r["n"], r["batch_size"], r["dim_h"], r["mixed_data"]) == (3, 101, 20, 30, True)
    assert r["target_corr"] == [0.1, 0.2, 0.3] and r["chunk_list"] == [2] and r["cat_var_idx"] == [1, 2]
    assert r["sparsity"] == 0 and r["alphas"][-1] == 128.0


def test_parquet_ids_survive_another_split_size(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5000).select(F.col("id").cast("double").alias("a")).repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    before = {r["row_id"]: r["a"] for r in tables.read_features(spark, path).collect()}
    assert len(before) == 5000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert {r["row_id"]: r["a"] for r in tables.read_features(spark, path).collect()} == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _with_split_size(spark, size, work):
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return work()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_csv_rows_are_numbered_by_place(spark, tmp_path):
    """The same numbers under four split sizes, over files of different lengths, with blank lines and an empty file; the order is that of the files."""
    folder = tmp_path / "t.csv"
    folder.mkdir()
    lines = iter(range(3000))
    for name, n in (("a.csv", 1700), ("b.csv", 0), ("c.csv", 1), ("d.csv", 1299)):
        rows = [f"{k},{k / 8}" for k in (next(lines) for _ in range(n))]
        (folder / name).write_text("k,x\n" + "\n\n".join(rows[:3]) + ("\n" if rows else "") + "".join(r + "\n" for r in rows[3:]))
    def read():
        df = tables.read_features(spark, str(folder), "k LONG, x DOUBLE")
        return df.rdd.getNumPartitions(), sorted(map(tuple, df.collect()))
    partitions = set()
    for size in ("700", "2500", "9000", "128m"):
        parts, rows = _with_split_size(spark, size, read)
        partitions.add(parts)
        assert rows == [(k, k, k / 8) for k in range(3000)]
    assert len(partitions) > 2


def test_a_saved_index_finds_its_rows_again(spark, tmp_path):
    path = _csv(tmp_path, "t.csv", "a,b.c,Y,W", [f"{k * 3},{k * 2.5},0,1" for k in range(500)])
    schema = "a LONG, `b.c` DOUBLE, Y INT, W INT"
    out = str(tmp_path / "train")
    df = tables.read_features(spark, path, schema)
    assert df.columns == ["row_id", "a", "b.c", "Y", "W"]
    tables.write_train_index(sample.sample_exact(df, 0.8, "row_id"), out)
    want = {r["a"] for r in sample.sample_exact(df, 0.8, "row_id").collect()}
    again = _with_split_size(spark, "600", lambda: {r["a"] for r in tables.read_features(spark, path, schema).join(spark.read.parquet(out), "row_id").collect()})
    assert again == want and len(want) == 400


def test_run_records_accumulate(spark, tmp_path):
    path = str(tmp_path / "runs")
    def record(label, value):
        return spark.createDataFrame([(label, value)], "run_label STRING, value INT")
    def stored():
        return sorted((r["run_label"], r["value"]) for r in spark.read.schema("run_label STRING, value INT").json(path).collect())
    tables.write_run_params(record("a", 1), path)
    tables.write_run_params(record("b", 2), path)
    assert stored() == [("a", 1), ("b", 2)]
    tables.write_run_params(record("a", 3).unionByName(record("c", 4)), path)  # a is complete
    assert stored() == [("a", 1), ("b", 2), ("c", 4)]
    tables.write_run_params(record("a", 3), path, replace=True)
    assert stored() == [("a", 3), ("b", 2), ("c", 4)]
