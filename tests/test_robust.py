import numpy as np
import pytest

from mirrorframe.functions import rankscan
from mirrorframe.functions.vectors import pack_blocks
from mirrorframe.operators import moments, robust


def contaminated(rng, n=900, p=8):
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.3)
    x[: 3 * n // 10] = rng.normal(size=(3 * n // 10, p)) * 0.2 + 15.0
    return x


def test_outliers_are_ignored(vectors, rng):
    x = rng.normal(size=(200, 3))
    x[:20] += 25.0
    df = vectors(x)
    fit = robust.mcd_fit(df, "x")
    clean = np.cov(x[20:], rowvar=False)
    assert np.abs(fit.covariance - clean).max() < 0.35
    assert np.abs(fit.location).max() < 0.3
    assert moments.mean_and_cov(df, "x")[2][0, 0] > 20
    assert all(a >= b - 1e-9 for a, b in zip(fit.log_dets, fit.log_dets[1:]))
    assert fit.h == robust.default_support(200, 3) == 102 and fit.converged and fit.ridge == 0


@pytest.mark.parametrize("start", robust.STARTS)
def test_every_start_finds_the_bulk(vectors, rng, start):
    x = contaminated(rng, 600, 4)
    fit = robust.mcd_fit(vectors(x), "x", starts=[start])
    assert np.abs(fit.covariance - np.cov(x[180:], rowvar=False)).max() < 1.0 and fit.converged


def test_units_do_not_matter(vectors, rng):
    x = contaminated(rng)
    base = robust.mcd_fit(vectors(x), "x")
    units = np.ones(8)
    units[2] = 1e9
    for scale in (units, np.full(8, 1e-17)):
        other = robust.mcd_fit(vectors(x * scale), "x")
        assert np.allclose(other.covariance / np.outer(scale, scale), base.covariance, rtol=1e-6)


def test_indicators_keep_their_variance(vectors, rng):
    x = (rng.uniform(size=(1000, 3)) < [0.5, 0.1, 0.03]).astype(float)
    with pytest.warns(UserWarning, match="hyperplane"):
        fit = robust.mcd_fit(vectors(x), "x")
    assert fit.converged and fit.ridge > 0 and np.isfinite(fit.covariance).all() and (np.diag(fit.covariance) > 0).all()


def test_relations_of_all_rows_stay(vectors, rng):
    dummies = np.eye(3)[rng.integers(0, 3, size=600)]
    x = np.column_stack([rng.normal(size=(600, 2)), dummies, np.full(600, 7.0)])
    fit = robust.mcd_fit(vectors(x), "x")
    assert np.allclose(fit.covariance[2:5].sum(axis=0), 0.0, atol=1e-9) and fit.location[2:5].sum() == pytest.approx(1.0)
    assert not fit.covariance[5].any() and fit.location[5] == 7.0


def test_ties_share_the_last_places(vectors):
    x = np.array([[float(a), float(b)] for a in range(-2, 3) for b in range(-2, 3)] * 4)
    fit = robust.mcd_fit(vectors(x), "x")
    assert np.allclose(fit.location, 0.0, atol=1e-9) and np.allclose(fit.covariance[0, 1], 0.0, atol=1e-9)


def test_same_fit_for_any_layout(vectors, rng):
    x = contaminated(rng, 400, 3)
    fits = [robust.mcd_fit(vectors(x, parts), "x") for parts in (1, 3, 16)]
    for f in fits[1:]:
        assert np.allclose(fits[0].covariance, f.covariance, atol=1e-9) and f.n_support == fits[0].n_support


def test_without_variance(vectors):
    with pytest.raises(ValueError, match="variance"):
        robust.mcd_fit(vectors(np.ones((9, 2))), "x")


def test_ranks_by_cells(vectors, rng):
    x = np.column_stack([rng.normal(size=1001) * 1e6, rng.integers(0, 3, size=1001), np.full(1001, 5.0)])
    blocks = pack_blocks(vectors(x, 5))
    ranks = [0, 500, 1000]
    for r in ranks:
        got = rankscan.exact_ranks(blocks, lambda v: v, [r] * 3, [-1.0] * 3, [1.0] * 3)
        assert got.tolist() == np.sort(x, axis=0)[r].tolist()
    assert np.allclose(rankscan.medians(pack_blocks(vectors(x[:1000])), lambda v: v, 1000, [0.0] * 3, [1.0] * 3), np.median(x[:1000], axis=0))


def test_tyler_fixed_point(vectors, rng):
    x = np.vstack([rng.standard_t(3, size=(400, 4)) @ np.diag([1, 2, 3, 4]), np.zeros((5, 4))])
    fit = robust.tyler_fit(vectors(x), "x", tol=1e-8, maxiter=200)
    assert fit.n == 400 and fit.error <= 1e-8 and fit.converged
    rows = x[:400] / np.linalg.norm(x[:400], axis=1, keepdims=True)
    w = 1 / np.einsum("ij,ij->i", rows @ np.linalg.inv(fit.scatter), rows)
    again = 4 / 400 * (rows * w[:, None]).T @ rows
    assert np.allclose(again, fit.scatter, atol=1e-7)


def test_tyler_first_step_has_trace_p(vectors, rng):
    fit = robust.tyler_fit(vectors(rng.normal(size=(100, 3))), "x", tol=0.0, maxiter=1)
    assert np.trace(fit.scatter) == pytest.approx(3.0)


def test_tyler_without_rows(vectors):
    with pytest.raises(ValueError):
        robust.tyler_fit(vectors(np.zeros((3, 2))), "x")
