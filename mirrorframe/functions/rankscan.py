"""Exact ranks of many derived columns over packed blocks, by counting cells.

A scan counts equal cells of a range for each column and keeps the extremes of every
cell, so the cell that holds a rank is the next range exactly.  Two or three scans
find a rank among distinct doubles, whatever the first range was.  A task keeps
q x cells numbers, however many rows it reads.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.vectors import matrices

CELLS = 256
#: Numbers of derived columns that a task makes at a time; what is needed on the way takes some times as much.
AT_ONCE = 1 << 20
#: Rows of state that the driver reads of one aggregate, at most.
DRIVER_STATES = 64
Values = Callable[[np.ndarray], np.ndarray]


def to_merge_tasks(partials: DataFrame) -> DataFrame:
    """Deal the states of all tasks to as many tasks as ``spark.sql.shuffle.partitions`` names; adaptive execution joins small ones."""
    return partials.withColumn("part", F.spark_partition_id()).repartition("part").drop("part")


def merge_in_levels(partials: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Merge the states of all tasks in two levels: as widely as Spark shuffles, then to a few for the driver."""
    first = merge(to_merge_tasks(partials))
    return merge(first.withColumn("part", F.spark_partition_id() % DRIVER_STATES).repartition("part").drop("part"))


def _count_cells(v: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int):
    """Numbers, minima and maxima of the cells below, within and above [low, high] of each column, all columns at once."""
    q = len(low)
    step = np.where(high > low, (high - low) / cells, 1.0)
    n, a, b = np.zeros((q, cells + 2), np.int64), np.full((q, cells + 2), np.inf), np.full((q, cells + 2), -np.inf)
    s = np.ascontiguousarray(v.T)
    at = np.clip(np.floor((s - low[:, None]) / step[:, None]), -1, cells).astype(np.int64) + 1
    at = np.where((s >= low[:, None]) & (s <= high[:, None]), np.clip(at, 1, cells), at)
    key, flat = (at + np.arange(q)[:, None] * (cells + 2)).ravel(), s.ravel()
    n += np.bincount(key, minlength=n.size).reshape(n.shape)
    np.minimum.at(a.ravel(), key, flat)
    np.maximum.at(b.ravel(), key, flat)
    return n, a, b


def _parts(x: np.ndarray, q: int) -> list[np.ndarray]:
    """Runs of rows that make about ``AT_ONCE`` numbers of ``q`` derived columns."""
    step = max(1, AT_ONCE // max(q, 1))
    return [x[k : k + step] for k in range(0, len(x), step)]


def _cell_table(blocks: DataFrame, values: Values, low: np.ndarray, high: np.ndarray, cells: int):
    """The cells of all rows for each column of ``values(x)``."""
    q = len(low)

    def empty():
        return np.zeros((q, cells + 2), np.int64), np.full((q, cells + 2), np.inf), np.full((q, cells + 2), -np.inf)

    def add(x, y):
        return x[0] + y[0], np.minimum(x[1], y[1]), np.maximum(x[2], y[2])

    def packed(state):
        return pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in state], names=["n", "a", "b"])

    def fold(batches):
        state = empty()
        for batch in batches:
            for x in matrices(batch):
                state = add(state, _count_cells(values(x), low, high, cells))
        yield packed(state)

    def join(rows):
        state = empty()
        for row in rows:
            state = add(state, [np.frombuffer(row[c], t).reshape(q, cells + 2) for c, t in (("n", np.int64), ("a", float), ("b", float))])
        return state

    def merge(batches):
        state = None
        for batch in batches:
            state = join(batch.to_pylist()) if state is None else add(state, join(batch.to_pylist()))
        if state is not None:
            yield packed(state)

    ddl = "n BINARY, a BINARY, b BINARY"
    return join(merge_in_levels(blocks.mapInArrow(fold, ddl), lambda df: df.mapInArrow(merge, ddl)).collect())


def _rank_pairs(blocks: DataFrame, values: Values, first, last, low, high, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The values at two equal or neighbouring 0-based ranks of each column of ``values(x)``; ``low`` and ``high`` guess where they are.

    Both are in one cell, which is looked at again, or they are the last value of a cell
    and the first of the next one, which are known.
    """
    first, last, low, high = (np.asarray(v, t).copy() for v, t in ((first, np.int64), (last, np.int64), (low, float), (high, float)))
    left, right, todo = np.empty(len(first)), np.empty(len(first)), np.arange(len(first))
    while todo.size:
        at = todo
        n, a, b = _cell_table(blocks, lambda x: values(x)[:, at], low[at], high[at], cells)
        again = []
        for k, j in enumerate(at):
            passed = np.cumsum(n[k])
            c, d = (int(np.searchsorted(passed, r, side="right")) for r in (first[j], last[j]))
            if d > cells + 1:
                raise ValueError(f"rank {last[j]} of {int(passed[-1])} values")
            if c < d:
                left[j], right[j] = b[k, c], a[k, d]
                continue
            low[j], high[j] = a[k, c], b[k, c]
            left[j] = right[j] = low[j]
            if low[j] < high[j]:
                again.append(j)
        todo = np.array(again, np.int64)
    return left, right


def exact_ranks(blocks: DataFrame, values: Values, ranks, low, high, cells: int = CELLS) -> np.ndarray:
    """The value at a 0-based rank of each column of ``values(x)``; ``low`` and ``high`` guess where it is."""
    return _rank_pairs(blocks, values, ranks, ranks, low, high, cells)[0]


def medians(blocks: DataFrame, values: Values, n: int, low, high) -> np.ndarray:
    """The median of each column; the mean of the two middle values of an even number."""
    middle = np.full(len(low), n // 2)
    left, right = _rank_pairs(blocks, values, middle - (n % 2 == 0), middle, low, high)
    return 0.5 * (left + right) if n % 2 == 0 else left


def cell_counts(blocks: DataFrame, values: Values, q: int, low: float, high: float, cells: int) -> np.ndarray:
    """How many values of each column lie in each of the equal cells of a range; values beyond it count in the end cells."""

    def fold(batches):
        n = np.zeros((q, cells), np.int64)
        for batch in batches:
            for x in (part for whole in matrices(batch) for part in _parts(whole, q)):
                at = np.clip((values(x) - low) * (cells / (high - low)), 0, cells - 1).astype(np.int64)
                n += np.bincount((at + np.arange(q) * cells).ravel(), minlength=q * cells).reshape(q, cells)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["n"])

    def join(rows):
        return sum((np.frombuffer(r["n"], np.int64) for r in rows), np.zeros(q * cells, np.int64))

    def merge(batches):
        total = sum((join(batch.to_pylist()) for batch in batches), np.zeros(q * cells, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    return join(merge_in_levels(blocks.mapInArrow(fold, "n BINARY"), lambda df: df.mapInArrow(merge, "n BINARY")).collect()).reshape(q, cells)
