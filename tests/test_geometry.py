import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import smallmat
from mirrorframe.operators import diagnostics, generate, geometry, grouping, moments
from mirrorframe.plans import analysis


def _cov(rng, p):
    x = rng.normal(size=(400, p)) @ (np.eye(p) + 0.4 * rng.normal(size=(p, p)) / np.sqrt(p))
    return np.cov(x * np.linspace(0.5, 3, p), rowvar=False)


@pytest.mark.parametrize("solve", [geometry.s_equi, geometry.s_sdp, lambda c: geometry.s_asdp(c, 5), lambda c: geometry.s_asdp(c, 5, "cluster")])
def test_s_is_feasible(spark, rng, solve):
    sigma = _cov(rng, 12)
    s = solve(moments.matrix_table(spark, sigma))
    corr_scale = moments.collect_vector(s, "s_corr")
    assert (corr_scale >= 0).all() and (corr_scale <= 1).all()
    assert smallmat.lambda_min(2 * smallmat.correlation(sigma) - np.diag(corr_scale)) >= -1e-8
    assert np.allclose(moments.collect_vector(s, "s"), corr_scale * np.diag(sigma))


def test_blocks_of_a_block_matrix_equal_the_whole(spark):
    corr = np.eye(6)
    for b in (slice(0, 3), slice(3, 6)):
        corr[b, b] = 0.7
    np.fill_diagonal(corr, 1.0)
    cov = moments.matrix_table(spark, corr)
    whole = moments.collect_vector(geometry.s_sdp(cov, tol=0.0), "s_corr")
    blocks = moments.collect_vector(geometry.s_asdp(cov, 3), "s_corr")
    assert np.allclose(whole, blocks, atol=1e-4)
    labels = moments.collect_vector(grouping.group_features(cov), "group_id")
    assert labels.tolist() == [1, 1, 1, 2, 2, 2]
    assert moments.collect_vector(grouping.group_features_ward(cov, 2), "group_id").tolist() == [1, 1, 1, 2, 2, 2]


def test_equal_s_is_never_negative(spark):
    cov = moments.matrix_table(spark, np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert moments.collect_vector(geometry.s_equi(cov), "s").tolist() == [0.0, 0.0]


def test_plan_is_symmetric_and_psd(spark, rng):
    sigma = _cov(rng, 6)
    cov = moments.matrix_table(spark, sigma)
    plan = geometry.knockoff_plan(cov, geometry.s_equi(cov), np.zeros(6))
    assert np.allclose(plan.cond_cov, plan.cond_cov.T)
    assert smallmat.lambda_min(plan.cond_cov) >= -1e-10
    assert np.allclose(plan.root @ plan.root.T, plan.cond_cov, atol=1e-8)
    assert np.allclose(sigma @ plan.projection, np.diag(moments.collect_vector(geometry.s_equi(cov), "s")), atol=1e-9)


def test_constant_feature_is_named(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(9)], "a DOUBLE, b DOUBLE")
    with pytest.warns(UserWarning, match=r"without variance are left out: positions \[1\]"):
        result = analysis.second_order(df, ["a", "b"], method="sdp")
    assert result.kept == (0,) and result.constant == (1,) and result.plan().mu.tolist() == [4.0]
    assert [tuple(r) for r in result.target_corr.collect()] == [(0, pytest.approx(0.0, abs=1e-5))]
    with pytest.raises(ValueError, match="no feature has any variance"):
        analysis.second_order(df.select("b", F.lit(2.0).alias("c")), ["b", "c"], method="sdp")


def test_infeasible_program_is_named(spark):
    cov = moments.matrix_table(spark, np.array([[1.0, 0.9999], [0.9999, 1.0]]))
    with pytest.raises(Exception, match="no s is feasible"):
        geometry.s_sdp(cov, tol=1e-3).collect()


def test_definiteness_allows_for_rounding(vectors, rng):
    """A full set of indicators has an eigenvalue of zero, whose sign must not decide anything."""
    x = np.eye(5)[rng.integers(0, 5, size=400)] * rng.uniform(0.5, 1.5)
    for parts in (1, 3, 16):
        cov = moments.covariance(vectors(x, parts), "x")
        assert not smallmat.indefinite(moments.collect_matrix(cov))
        assert np.array_equal(moments.collect_matrix(moments.ridge_if_not_psd(cov, 0.5)), moments.collect_matrix(cov))
    assert smallmat.indefinite(np.diag([1.0, -1e-9]))


def test_constant_feature_has_no_target(spark):
    cov = moments.matrix_table(spark, np.diag([1.0, 0.0]))
    s = moments.small_table(spark, {"i": np.arange(2, dtype=np.int32), "s": np.array([0.5, 0.0])})
    assert [tuple(r) for r in geometry.target_correlation(cov, s).collect()] == [(0, 0.5)]


@pytest.mark.filterwarnings("ignore:the conditional covariance")
def test_copies_have_the_right_moments(vectors, rng):
    p, n = 4, 20000
    mix = np.array([[1, 0.5, 0, 0], [0, 1, 0.5, 0], [0, 0, 1, 0.5], [0, 0, 0, 1]])
    x = rng.normal(size=(n, p)) @ mix + 3.0
    df = vectors(x, 6).cache()
    result = analysis.second_order(df, "x", method="sdp")
    pairs = generate.generate_knockoffs(df, "x", result.plan(), "id", 11).cache()
    gap = diagnostics.second_order_gap(pairs).head()
    assert gap["mean_gap"] < 0.06 and gap["cov_gap"] < 0.12 and gap["cross_gap"] < 0.12
    deco = diagnostics.decorrelation_gap(pairs, result.target_corr).collect()
    assert max(abs(r["gap"]) for r in deco) < 0.03
    kernel = diagnostics.mmd(pairs, "id", alphas=(1.0, 2.0, 4.0), rows_per_range=999).head()
    assert abs(kernel["full_swap"]) < 0.02 and abs(kernel["partial_swap"]) < 0.02 and kernel["n_pairs"] == n // 2
    broken = pairs.selectExpr("id", "x", "transform(xk, v -> v * 2) AS xk")
    assert diagnostics.mmd(broken, "id", alphas=(1.0, 2.0, 4.0)).head()["full_swap"] > 0.01


@pytest.mark.filterwarnings("ignore:the conditional covariance")
def test_copies_do_not_depend_on_the_layout(vectors, rng):
    x = rng.normal(size=(300, 5))
    plan = analysis.second_order(vectors(x), "x", method="equi").plan()
    out = [{r["id"]: r["xk"] for r in generate.generate_knockoffs(vectors(x, k), "x", plan, "id", 3).collect()} for k in (1, 3, 16)]
    for other in out[1:]:
        assert all(np.allclose(out[0][k], other[k], atol=1e-12) for k in out[0])


@pytest.mark.filterwarnings("ignore:the conditional covariance")
def test_sweep_solves_like_a_single_analysis(spark, rng):
    x = rng.normal(size=(300, 12))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id LONG, x ARRAY<DOUBLE>")
    for method in ("equi", "sdp", "asdp", "cluster"):
        a = analysis.second_order(df, "x", method=method, block_size=5)
        assert 0 <= a.mean_corr <= 1
        sweep = analysis.estimator_sweep(df, "x", [(0, False, 0.0)], method=method, block_size=5)
        assert np.allclose(moments.collect_vector(sweep), moments.collect_vector(a.target_corr), atol=1e-9)
    with pytest.raises(ValueError, match="unknown method"):
        analysis.second_order(df, "x", method="auto")


def test_representatives_and_submatrix(spark):
    groups = moments.vector_table(spark, np.array([1, 1, 2, 1, 3], dtype=np.int32), "group_id")
    reps = grouping.group_representatives(groups)
    assert sorted((r["group_id"], r["i"]) for r in reps.collect()) == [(1, 0), (2, 2), (3, 4)]
    size = grouping.group_sizes(groups).head()
    assert (size["n_groups"], size["largest"]) == (3, 3) and size["mean_size"] == pytest.approx(5 / 3)
    a = np.arange(25.0).reshape(5, 5)
    sub = grouping.submatrix(moments.matrix_table(spark, a), reps)
    assert np.allclose(moments.collect_matrix(grouping.renumber(sub)), a[np.ix_([0, 2, 4], [0, 2, 4])])


def test_first_component(spark, rng):
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.9, 0], [0, 0.3, 0], [0, 0, 1]])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    out = grouping.group_first_pc(df, {"a": 3, "b": 3, "c": 1}, keep=["id"])
    assert out.columns == ["id", "group_3_pc", "c"]
    pc = np.array([r["group_3_pc"] for r in out.orderBy("id").collect()])
    lam, q = np.linalg.eigh(np.cov(x[:, :2], rowvar=False))
    assert pc.var(ddof=1) == pytest.approx(lam[-1])
    assert abs(abs(np.corrcoef(pc, x[:, :2] @ q[:, -1])[0, 1]) - 1) < 1e-9


def test_grouping_chain(spark, rng):
    base = rng.normal(size=(400, 3))
    x = np.column_stack([base, base[:, :2] + 0.05 * rng.normal(size=(400, 2))])
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id INT, " + ", ".join(f"{c} DOUBLE" for c in names))
    corr = moments.cov_to_corr(moments.covariance(df, names))
    groups, representatives, reduced = grouping.representative_analysis(corr)
    assert sorted(r["i"] for r in representatives.collect()) == [0, 1, 2] and reduced.count() == 9
    assert geometry.s_asdp(reduced, 2).count() == 3
    by_name = grouping.groups_by_name(groups, names)
    assert by_name["a"] == by_name["d"] and by_name["b"] == by_name["e"] and len(set(by_name.values())) == 3
    assert len(grouping.group_first_pc(df, by_name, keep=["id"]).columns) == 4
    with pytest.raises(ValueError, match="without a group"):
        grouping.groups_by_name(groups, [*names, "f"])


def _plain_block_kernel(x, xk, block, alphas, seed):
    """All pairs of every block, one by one."""
    from mirrorframe.functions import draws

    start = draws.hash_long_np(np.array([seed]), np.array([42], dtype=np.uint64))
    full, part = [], []
    k = lambda d2: np.mean([np.exp(-d2 / (2 * a * a)) for a in alphas])
    for at in range(0, len(x), block):
        h = draws.hash_long_np(np.array([at // block]), start)
        chosen = (draws.hash_long_np(np.arange(x.shape[1]), h) >> np.uint64(11)).astype(float) / 2**53 < 0.5
        for i in range(at, min(at + block, len(x))):
            for j in range(i + 1, min(at + block, len(x))):
                same = (x[i] - x[j]) ** 2 + (xk[i] - xk[j]) ** 2
                swap = (x[i] - xk[j]) ** 2 + (xk[i] - x[j]) ** 2
                full.append(2 * k(same.sum()) - 2 * k(swap.sum()))
                part.append(2 * k(same.sum()) - 2 * k(np.where(chosen, swap, same).sum()))
    return np.mean(full), np.mean(part), len(full)


@pytest.mark.parametrize("rows_per_range", [10**6, 37])
def test_quality_in_one_pass(spark, rng, rows_per_range):
    x = rng.normal(size=(203, 3)) + 5.0
    xk = x * [0.5, 1.0, -1.0] + rng.normal(size=(203, 3))
    ids = rng.permutation(1000)[:203]
    rows = [(int(i), [float(v) for v in a], [float(v) for v in b]) for i, a, b in zip(ids, x, xk, strict=True)]
    pairs = spark.createDataFrame(rows, "id LONG, x ARRAY<DOUBLE>, xk ARRAY<DOUBLE>").repartition(5)
    target = spark.createDataFrame([(k, 0.1 * k) for k in range(3)], "i INT, v DOUBLE")
    found = diagnostics.quality(pairs, "id", target, block_rows=10, seed=3, alphas=(1.0, 2.0), rows_per_range=rows_per_range)
    order = np.argsort(ids)
    want = _plain_block_kernel(x[order], xk[order], 10, (1.0, 2.0), 3)
    kernel = found.kernel.head()
    assert np.allclose([kernel["full_swap"], kernel["partial_swap"]], want[:2], atol=1e-10) and kernel["n_pairs"] == want[2]
    assert np.allclose(found.second_order.head(), diagnostics.second_order_gap(pairs).head())
    other = {r["i"]: r["gap"] for r in diagnostics.decorrelation_gap(pairs, target).collect()}
    assert all(abs(r["gap"] - other[r["i"]]) < 1e-10 for r in found.decorrelation.collect())


def test_blocks_vary_less_than_pairs(spark, rng):
    """The same rows in many orders: the block estimate moves far less than the one of two rows each."""
    x = rng.normal(size=(400, 2))
    xk = np.column_stack([x[:, 0] * 0.3 + rng.normal(size=400), x[:, 1] * 1.5])
    target = spark.createDataFrame([(0, 0.0), (1, 0.0)], "i INT, v DOUBLE")
    one, many = [], []
    for _ in range(6):
        ids = rng.permutation(400)
        rows = [(int(i), [float(v) for v in a], [float(v) for v in b]) for i, a, b in zip(ids, x, xk, strict=True)]
        pairs = spark.createDataFrame(rows, "id LONG, x ARRAY<DOUBLE>, xk ARRAY<DOUBLE>")
        one.append(diagnostics.mmd(pairs, "id", alphas=(1.0, 2.0)).head()["full_swap"])
        many.append(diagnostics.quality(pairs, "id", target, block_rows=64, alphas=(1.0, 2.0)).kernel.head()["full_swap"])
    assert np.var(many) < 0.25 * np.var(one)
