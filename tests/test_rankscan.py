"""What a task of the rank scans holds at a time, and its cells against sorting."""

import numpy as np

from mirrorframe.functions import rankscan
from mirrorframe.functions.vectors import BATCH_BYTES, BLOCK_BYTES, pack_blocks


def test_cells_equal_sorted_values(rng):
    v = np.round(rng.normal(size=(500, 3)), 1)
    low, high = np.array([-1.0, 0.5, -9.0]), np.array([1.0, 0.5, 9.0])
    n, a, b = rankscan._count_cells(v, low, high, 16)
    assert (n.sum(axis=1) == 500).all()
    for k in range(3):
        s, at = np.sort(v[:, k]), 0
        for cell in np.flatnonzero(n[k]):
            part = s[at : at + n[k, cell]]
            assert (a[k, cell], b[k, cell]) == (part[0], part[-1])
            at += n[k, cell]
        assert np.isinf(a[k, n[k] == 0]).all()


def test_many_derived_columns_are_made_in_parts(vectors, rng):
    """A block of 4,096 rows makes 4,032 sums and differences of 64 features, but not all of them at once."""
    q, most = 4032, rankscan.AT_ONCE
    x = rng.normal(size=(2000, 2))

    def values(rows):
        if len(rows) * q > most:
            raise ValueError("too many numbers at a time")
        return np.repeat(rows[:, :1], q, axis=1)

    counts = rankscan.cell_counts(pack_blocks(vectors(x, 1)), values, q, -4.0, 4.0, 8)
    want = np.bincount(np.clip((x[:, 0] + 4.0), 0, 7).astype(int), minlength=8)
    assert (counts == want).all()


def test_batches_of_blocks_are_bounded(spark):
    """A worker gets a few blocks at a time, however many a partition has."""
    df = spark.range(0, 40_000, 1, 1).selectExpr("transform(sequence(1, 64), i -> CAST(id * i AS DOUBLE)) AS x")
    blocks = pack_blocks(df).persist()

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = [r["n"] for r in blocks.mapInArrow(sizes, "n LONG").collect()]
    blocks.unpersist()
    assert sum(found) > 2 * BATCH_BYTES and max(found) <= BATCH_BYTES + 2 * BLOCK_BYTES
