import itertools

import numpy as np
import pytest

from mirrorframe.functions import smallmat


@pytest.mark.parametrize("rho", [-0.9, -0.4, 0.0, 0.3, 0.75])
def test_program_of_two_features_is_closed(rho):
    s = smallmat.max_sum_s(np.array([[1, rho], [rho, 1]]), tol=1e-3)
    want = min(1.0, 2 * (1 - abs(rho)) - 1e-3)
    assert np.allclose(s, want, atol=1e-6)


def test_program_is_feasible_and_beats_equal_s(rng):
    x = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    corr = np.corrcoef(x, rowvar=False)
    s = smallmat.max_sum_s(corr)
    assert (s >= 0).all() and (s <= 1).all()
    assert smallmat.lambda_min(2 * corr - np.diag(s)) >= -1e-8
    assert s.sum() >= 20 * min(1.0, 2 * smallmat.lambda_min(corr)) - 1e-6


def test_program_near_a_grid_optimum():
    corr = np.array([[1, 0.8, 0.1], [0.8, 1, 0.5], [0.1, 0.5, 1]])
    best = 0.0
    grid = np.linspace(0, 1, 41)
    for s in itertools.product(grid, repeat=3):
        if smallmat.lambda_min(2 * corr - np.diag(s)) >= 0:
            best = max(best, sum(s))
    got = smallmat.max_sum_s(corr).sum()
    assert best - 1e-6 <= got <= best + 3 * 0.025


def test_program_without_a_limit_reaches_one():
    assert smallmat.max_sum_s(np.eye(1)).tolist() == [1.0]
    assert smallmat.max_sum_s(np.eye(5) * 0.99 + 0.01).tolist() == [1.0] * 5


def test_feasible_scale():
    corr = np.array([[1, 0.9], [0.9, 1]])
    g = smallmat.feasible_scale(corr, np.ones(2))
    assert 0.2 - 0.011 <= g <= 0.2 + 1e-9
    assert smallmat.feasible_scale(np.eye(2), np.ones(2)) == 1.0


# Published chi-square quantiles (probability, degrees of freedom, quantile).
@pytest.mark.parametrize("prob, df, want", [(0.975, 1, 5.023886), (0.5, 2, 1.386294), (0.975, 10, 20.483177), (0.5, 50, 49.334937), (0.975, 100, 129.561197)])
def test_chi2_quantile(prob, df, want):
    assert smallmat.chi2_quantile(prob, df) == pytest.approx(want, abs=1e-5)


def _brute_complete(dist, cut):
    groups = [{k} for k in range(len(dist))]
    while len(groups) > 1:
        height, a, b = min((max(dist[i, j] for i in g for j in h), x, y)
                           for (x, g), (y, h) in itertools.combinations(enumerate(groups), 2))
        if height > cut:
            break
        groups[a] |= groups[b]
        del groups[b]
    return {frozenset(g) for g in groups}


def _brute_ward(x, k):
    def cost(g):
        rows = x[sorted(g)]
        return ((rows - rows.mean(axis=0)) ** 2).sum()

    groups = [{i} for i in range(len(x))]
    while len(groups) > k:
        _, a, b = min((cost(g | h) - cost(g) - cost(h), p, q)
                      for (p, g), (q, h) in itertools.combinations(enumerate(groups), 2))
        groups[a] |= groups[b]
        del groups[b]
    return {frozenset(g) for g in groups}


def _as_sets(labels):
    return {frozenset(np.flatnonzero(labels == g).tolist()) for g in set(labels)}


def test_complete_linkage(rng):
    dist = smallmat.pairwise_distance(rng.normal(size=(15, 3)))
    cut = 0.5 * dist.max()
    labels = smallmat.agglomerate(dist, "complete", cut=cut)
    assert _as_sets(labels) == _brute_complete(dist, cut)
    assert labels[0] == 1 and set(labels) == set(range(1, labels.max() + 1))


def test_ward_linkage(rng):
    x = rng.normal(size=(15, 3))
    labels = smallmat.agglomerate(smallmat.pairwise_distance(x), "ward", n_groups=4)
    assert _as_sets(labels) == _brute_ward(x, 4)


def _full_search(dist, method, n_groups=None, cut=None):
    """The textbook loop: the smallest of all distances in every step."""
    p = len(dist)
    d = dist**2 if method == "ward" else dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(p), np.arange(p)
    for _ in range(p - (n_groups or 1)):
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        height = np.sqrt(d[a, b]) if method == "ward" else d[a, b]
        if not np.isfinite(height) or (cut is not None and height > cut):
            break
        row = np.maximum(d[a], d[b]) if method == "complete" else ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        d[a], d[:, a] = row, row
        d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
        size[a] += size[b]
        member[member == b] = a
    return [frozenset(np.flatnonzero(member == m).tolist()) for m in dict.fromkeys(member.tolist())]


@pytest.mark.parametrize("method", ["complete", "ward"])
def test_grouping_equals_the_full_search_also_with_ties(rng, method):
    for trial in range(40):
        p = int(rng.integers(1, 60))
        x = rng.integers(0, 4, size=(p, 2)).astype(float) if trial % 2 else rng.normal(size=(p, 4))
        dist = smallmat.pairwise_distance(x)
        for options in ({"n_groups": int(rng.integers(1, p + 1))}, {"cut": 0.4 * dist.max()}):
            labels = smallmat.agglomerate(dist, method, **options)
            assert [frozenset(np.flatnonzero(labels == g).tolist()) for g in range(1, labels.max() + 1)] == _full_search(dist, method, **options)


def test_five_thousand_features_group_in_seconds(rng):
    import time

    x = rng.normal(size=(5000, 8)) + 6 * rng.integers(0, 40, size=(5000, 1))
    sums = (x**2).sum(axis=1)
    dist = np.sqrt(np.maximum(sums[:, None] + sums - 2 * x @ x.T, 0))
    started = time.process_time()
    labels = smallmat.agglomerate(dist, "ward", n_groups=40)
    assert labels.max() == 40 and time.process_time() - started < 60


def test_a_solution_nearby_saves_steps(rng):
    x = rng.normal(size=(300, 40)) @ (np.eye(40) + 0.3 * rng.normal(size=(40, 40)))
    sigma = np.cov(x, rowvar=False)
    start, cold, warm = None, [], []
    for reg in (1.0, 0.9, 0.8, 0.5, 0.2, 0.18, 0.16):
        corr = smallmat.correlation(sigma + reg * np.eye(40))
        alone = smallmat.max_sum_s(corr, 1e-3, count=cold)
        start = smallmat.max_sum_s(corr, 1e-3, start, warm)
        assert np.allclose(start, alone, atol=1e-6)
    assert warm[0] == cold[0] and sum(warm[1:]) < 0.75 * sum(cold[1:])


def test_a_useless_start_does_no_harm():
    corr = np.array([[1, 0.8, 0.1], [0.8, 1, 0.5], [0.1, 0.5, 1]])
    for start in (np.zeros(3), np.ones(3), np.array([1.0, 0.0, 1.0])):
        assert np.allclose(smallmat.max_sum_s(corr, start=start), smallmat.max_sum_s(corr), atol=1e-6)
