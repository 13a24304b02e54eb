"""Bounds that choose between two ways of finding one value: both ways give it."""

import numpy as np
import pytest

from mirrorframe.functions import orderstats, ranges
from mirrorframe.operators import moments, robust, sample


@pytest.fixture
def table(spark, rng):
    rows = [(int(k), float(a), float(b), float(c)) for k, (a, b, c) in zip(rng.permutation(3000)[:700], rng.normal(size=(700, 3)) * [1, 10, 100] + 5, strict=True)]
    return spark.createDataFrame(rows, "id LONG, a DOUBLE, b DOUBLE, c DOUBLE").repartition(4)


def test_covariance_by_expressions_and_by_batches(table, monkeypatch):
    one = moments.mean_and_cov(table, ["a", "b", "c"])
    monkeypatch.setattr(moments, "EXPRESSION_WIDTH", 0)
    two = moments.mean_and_cov(table, ["a", "b", "c"])
    assert one[0] == two[0] and np.allclose(one[1], two[1]) and np.allclose(one[2], two[2])
    assert np.allclose(moments.mean_only(table, ["a", "b"])[1], one[1][:2])


def test_batches_by_cuts_and_by_positions(table, monkeypatch):
    one = sorted(map(tuple, sample.assign_batches(table.select("id"), "id", batch_size=90).collect()))
    monkeypatch.setattr(sample, "FEW_BATCHES", 0)
    assert sorted(map(tuple, sample.assign_batches(table.select("id"), "id", batch_size=90).collect())) == one


def test_ranks_by_list_and_by_bracket(table):
    wanted = {"a": [0, 350, 699], "b": [17, 18]}
    one = orderstats.order_statistics(table, wanted, {"a": 700, "b": 700})
    two = orderstats.order_statistics(table, wanted, {"a": 700, "b": 700}, collect_limit=3, sketch_size=16)
    values = {c: np.sort([r[c] for r in table.collect()]) for c in wanted}
    assert one == two == {c: {r: values[c][r] for r in rs} for c, rs in wanted.items()}


def test_positions_by_any_ranges(table, monkeypatch):
    order = {k: n for n, k in enumerate(sorted(r["id"] for r in table.select("id").collect()))}
    for sketch_ranges, inline in ((500, 64), (4, 64), (500, 0)):
        monkeypatch.setattr(ranges, "SKETCH_RANGES", sketch_ranges)
        monkeypatch.setattr(ranges, "INLINE_EDGES", inline)
        placed = ranges.with_position(table.select("id"), "id", rows_per_range=60)
        assert {r["id"]: r["position"] for r in placed.collect()} == order


def test_aligned_ranges_begin_at_whole_blocks(table):
    order = sorted(r["id"] for r in table.select("id").collect())
    for rows in (30, 200, 10**6):
        edges = ranges.aligned_edges(table.select("id"), "id", 16, rows)
        assert all((order.index(e) + 1) % 16 == 0 for e in edges) and (rows > 700) == (not edges)


def test_finer_cells_of_the_starts_leave_the_fit(vectors, rng, monkeypatch):
    x = rng.normal(size=(500, 3)) @ (np.eye(3) + 0.4)
    x[:100] += 20.0
    df = vectors(x)
    one = robust.mcd_fit(df, "x")
    monkeypatch.setattr(robust, "CDF_CELLS", 2 * robust.CDF_CELLS)
    monkeypatch.setattr(robust, "PAIR_CELLS", 2 * robust.PAIR_CELLS)
    assert np.allclose(robust.mcd_fit(df, "x").covariance, one.covariance, atol=1e-9)
