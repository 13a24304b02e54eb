"""Moments of the closest rows against sorting, and how many scans they take."""

import numpy as np
import pytest

from mirrorframe.functions import trimscan
from mirrorframe.functions.vectors import pack_blocks


def plain(x, d, h):
    cut = np.sort(d)[h - 1]
    w = np.where(d < cut * (1 - 1e-12), 1.0, 0.0)
    ties = np.abs(d - cut) <= cut * 1e-12
    w[ties] = (h - w.sum()) / ties.sum()
    mean = w @ x / h
    return mean, ((x - mean) * w[:, None]).T @ (x - mean) / h, cut


def distances(*centres):
    return lambda x: (x, np.column_stack([((x - c) ** 2).sum(axis=1) for c in centres]))


@pytest.mark.parametrize("partitions", [1, 9])
@pytest.mark.parametrize("right", [1.0, 0.98, 1.3, 40.0, 1e-6, None])
def test_any_guess_gives_the_same(spark, vectors, rng, partitions, right):
    x = rng.normal(size=(4000, 3)) * [1, 2, 3]
    centres = [np.zeros(3), np.array([1.0, 0.0, 5.0])]
    blocks = pack_blocks(vectors(x, partitions))
    want = [plain(x, ((x - c) ** 2).sum(axis=1), 2003) for c in centres]
    moved, cuts, scans = trimscan.closest_moments(blocks, distances(*centres), 3, 2003, [None if right is None else right * w[2] for w in want])
    for (mean, spread), cut, w in zip(moved, cuts, want, strict=True):
        assert cut == pytest.approx(w[2], rel=1e-12)
        assert np.allclose(mean, w[0], atol=1e-10) and np.allclose(spread, w[1], atol=1e-9)
    assert scans <= (2 if right in (1.0, 0.98, 1.3, None) else 3)


def test_ties_and_zero_distances(vectors):
    x = np.array([[float(a), float(b)] for a in range(-2, 3) for b in range(-2, 3)] * 40)
    blocks = pack_blocks(vectors(x, 4))
    d = (x ** 2).sum(axis=1)
    for h in (1, 30, 41, 500, 777, 1000):
        (got,), (cut,), scans = trimscan.closest_moments(blocks, distances(np.zeros(2)), 2, h, [2.0])
        mean, spread, c = plain(x, d, h)
        assert cut == pytest.approx(c) and np.allclose(got[0], mean) and np.allclose(got[1], spread) and scans <= 3


def test_more_rows_in_a_cell_than_the_driver_reads(vectors, rng, monkeypatch):
    monkeypatch.setattr(trimscan, "ROW_NUMBERS", 12)
    monkeypatch.setattr(trimscan, "FINE", 16)
    x = rng.normal(size=(3000, 2))
    (got,), (cut,), scans = trimscan.closest_moments(pack_blocks(vectors(x, 3)), distances(np.zeros(2)), 2, 1500, [1.4])
    mean, spread, c = plain(x, (x ** 2).sum(axis=1), 1500)
    assert cut == pytest.approx(c, rel=1e-12) and np.allclose(got[0], mean) and np.allclose(got[1], spread) and scans > 2


def test_too_few_rows(vectors, rng):
    with pytest.raises(ValueError, match="asked for"):
        trimscan.closest_moments(pack_blocks(vectors(rng.normal(size=(5, 2)))), distances(np.zeros(2)), 2, 9, [None])
