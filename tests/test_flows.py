"""Whole analyses, from a file to run records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import smallmat
from mirrorframe.operators import diagnostics, encode, generate, geometry, grouping, moments, project, sample
from mirrorframe.plans import analysis, runs
from mirrorframe.sources import tables


def _csv(path, header, rows):
    path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n")
    return str(path)


def test_survey_table(spark, tmp_path, rng):
    n = 400
    cont = rng.multivariate_normal([0, 0, 5], [[1, 0.6, 0], [0.6, 1, 0], [0, 0, 2]], size=n)
    site = rng.integers(0, 3, size=n)
    dummies = np.eye(3, dtype=int)[site]
    rows = np.column_stack([cont, dummies, rng.integers(0, 2, size=(n, 2))])
    data = _csv(tmp_path / "survey.csv", "id,age,height,weight,a,b,c,Y,W", [[k, *r] for k, r in enumerate(rows.tolist())])
    table = project.drop_columns(tables.read_features(spark, data, id_col="id"), ["Y", "W"])
    features = table.columns[1:]
    catalog = tables.read_feature_lists(
        spark, _csv(tmp_path / "f.csv", "variable", [["site"]]), _csv(tmp_path / "k.csv", "X1", [[3]]),
        _csv(tmp_path / "i.csv", "X1", [[4], [5], [6]]), _csv(tmp_path / "n.csv", "variable", [["age"], ["height"], ["weight"]]), columns=features)
    project.validate_catalog(table, catalog)

    train = sample.sample_exact(table, 0.8, "row_id").cache()
    tables.write_train_index(train, str(tmp_path / "train"))
    assert spark.read.parquet(str(tmp_path / "train")).count() == 320

    result = analysis.second_order(train, features, method="sdp", estimator="mcd", reg=1e-3)
    assert result.n == 320 and 0 <= result.mean_corr <= 1
    kinds = encode.catalog_table(spark, catalog).select(F.col("pos").alias("i"), "kind")
    summary = {r["kind"]: r for r in moments.correlation_summary(result.target_corr, kinds).collect()}
    assert summary["all"]["mean_corr"] == pytest.approx(result.mean_corr)
    assert summary["cat"]["n_features"] == 3 and summary["cont"]["n_features"] == 3
    # the indicators of one factor determine each other, so their copies stay close
    assert summary["cat"]["mean_corr"] > summary["cont"]["mean_corr"]

    grid = runs.param_grid(spark, (0.01, 0.001, 3), (0.01, 0.001, 3)).withColumn("model", F.lit("mixed_student"))
    labelled = runs.run_label(runs.override_params(runs.lookup_params(grid)))
    params = runs.assemble_run_config(train, labelled, result.target_corr, chunk_list=[3], cat_var_idx=[3, 4, 5])
    tables.write_run_params(params, str(tmp_path / "params"))
    back = spark.read.schema(params.schema).json(str(tmp_path / "params"))
    assert back.count() == 9 and {len(r["target_corr"]) for r in back.collect()} == {6}
    assert back.where("run_label = 'mixed_student_0.0055_0.001'").head()["batch_size"] == 160

    copies = generate.generate_knockoffs(train, features, result.plan(), "row_id", 1)
    gaps = diagnostics.decorrelation_gap(copies, result.target_corr).where("i < 3").collect()
    assert max(abs(r["gap"]) for r in gaps) < 0.2


def test_coded_table(spark, rng):
    n, p, bins = 600, 6, {"c0": 4, "c1": 3, "c2": 2}
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.3)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "row_id LONG, " + ", ".join(f"c{k} DOUBLE" for k in range(p)))
    coded = project.cast_labels(encode.quantile_bin_var(df, bins), list(bins))
    categories = encode.category_table(coded, list(bins))
    assert [len(categories[c]) for c in bins] == [4, 3, 2]
    catalog = encode.derive_catalog(categories, ["c3", "c4", "c5"])
    wide = encode.one_hot(coded, list(bins), keep=["row_id", "c3", "c4", "c5"], categories=categories)
    ordered = wide.select("row_id", *[f.feature for f in catalog])
    assert ordered.columns[1] == "c0_0" and len(ordered.columns) == 1 + 9 + 3
    both = project.split_by_kind(ordered, catalog)
    assert project.hconcat(*both).columns == ordered.columns

    features = [f.feature for f in catalog]
    sweep = analysis.estimator_sweep(ordered, features, [(0, False, 1e-3), (1, True, 1e-3), (2, False, 1e-1)], method="sdp")
    means = {r["run_id"]: r["m"] for r in sweep.groupBy("run_id").agg(F.avg("v").alias("m")).collect()}
    assert means[2] < means[0]  # a larger ridge leaves more room
    parts = analysis.two_part_plan(ordered, catalog, method="sdp", reg=1e-3).groupBy("data_type").count().collect()
    assert {r["data_type"]: r["count"] for r in parts} == {"discrete": 9, "continuous": 3}


def test_wide_table_in_blocks(spark, rng):
    p = 120
    shape = 0.5 ** np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
    x = rng.multivariate_normal(np.zeros(p), shape, size=1000)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id LONG, x ARRAY<DOUBLE>").cache()
    result = analysis.second_order(df, "x", method="asdp")
    s = moments.collect_vector(result.s, "s_corr")
    corr = smallmat.correlation(moments.collect_matrix(result.cov))
    assert s.size == p and smallmat.lambda_min(2 * corr - np.diag(s)) >= -1e-8
    assert np.allclose(s, moments.collect_vector(geometry.s_asdp(result.cov, 50), "s_corr"))
    # no feasible vector has a larger sum than the whole program
    assert s.sum() <= moments.collect_vector(geometry.s_sdp(result.cov, tol=0.0), "s_corr").sum() + 1e-4


def test_representatives_of_groups(spark, rng):
    base = rng.normal(size=(500, 4))
    x = np.hstack([base, base + 0.1 * rng.normal(size=(500, 4))])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id LONG, x ARRAY<DOUBLE>")
    corr = moments.cov_to_corr(moments.covariance(df, "x"))
    groups = grouping.group_features(corr)
    assert moments.collect_vector(groups, "group_id").tolist() == [1, 2, 3, 4, 1, 2, 3, 4]
    reduced = grouping.renumber(grouping.submatrix(corr, grouping.group_representatives(groups)))
    assert grouping.max_offdiag(reduced).head()[0] < 0.2
    assert geometry.s_asdp(reduced, 2).count() == 4


def test_string_keys(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), float(i % 7)) for i in range(50)], "k STRING, a DOUBLE, b DOUBLE")
    assert sample.sample_exact(df, 0.5, "k").count() == 25
    plan = analysis.second_order(df, ["a", "b"], method="sdp").plan()
    a = {r["k"]: r["xk"] for r in generate.generate_knockoffs(df, ["a", "b"], plan, "k").collect()}
    b = {r["k"]: r["xk"] for r in generate.generate_knockoffs(df.repartition(7), ["a", "b"], plan, "k").collect()}
    assert a == b


def test_sweep_leaves_out_constants_and_refuses_what_it_cannot_tell_apart(vectors, rng):
    x = np.column_stack([rng.normal(size=300), np.full(300, 2.0), rng.normal(size=300)])
    x[:, 2] += 0.5 * x[:, 0]
    df = vectors(x)
    with pytest.warns(UserWarning, match="positions \\[1\\]"):
        swept = analysis.estimator_sweep(df, "x", [(0, False, 0.0), (1, False, 0.1)], method="sdp").orderBy("run_id", "i").collect()
    with pytest.warns(UserWarning, match="positions \\[1\\]"):
        alone = analysis.second_order(df, "x", method="sdp").target_corr.orderBy("i").collect()
    assert [(r["run_id"], r["i"]) for r in swept] == [(0, 0), (0, 2), (1, 0), (1, 2)]
    assert np.allclose([r["v"] for r in swept[:2]], [r["v"] for r in alone], atol=1e-6)
    with pytest.raises(ValueError, match="more than once"):
        analysis.estimator_sweep(df, "x", [(0, False, 0.0), (0, False, 0.1)], method="sdp")
    with pytest.raises(ValueError, match="unknown method"):
        analysis.estimator_sweep(df, "x", [(0, False, 0.0)], method="spd")
    with pytest.raises(ValueError, match="unknown method"):
        geometry.local_s(np.eye(2), "selfblocks", 1, 1e-3)
