"""Feature columns and feature vectors.

A feature set is either a list of numeric column names or the name of one
``ARRAY`` column.  Both are turned into ``x ARRAY<DOUBLE>`` with a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Features = str | Sequence[str]
BLOCK_BYTES = 2**21
#: Bytes of an Arrow batch between Spark and a worker; without a bound it holds up to 10,000 blocks, a whole partition.
BATCH_BYTES = 8 << 20


def checked(c: Column) -> Column:
    """The value as DOUBLE; a null or NaN fails the job instead of biasing a result."""
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d)
    return F.when(bad, F.raise_error(F.lit("null or NaN feature value")).cast("double")).otherwise(d)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside nested lambdas.

    A column that is only named inside a lambda may be inlined by the optimizer
    and then be computed once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_incomplete(df: DataFrame, features: Features) -> DataFrame:
    """Keep only rows in which every feature is present and not NaN."""
    if isinstance(features, str):
        ok = F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
        return df.where(F.col(features).isNotNull() & ok)
    for name in features:
        df = df.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    return df


def vectorize(df: DataFrame, features: Features, keep: Sequence[str] = (), out: str = "x") -> DataFrame:
    """Project to ``keep`` columns plus the feature vector.

    An array column passes through as it is (a FLOAT array travels at half the
    size of a DOUBLE one); ``batch_matrix`` converts and checks it in the task.
    """
    x = F.col(features) if isinstance(features, str) else F.array(*[checked(F.col(f)) for f in features])
    return df.select(*keep, x.alias(out))


def width(df: DataFrame, features: Features) -> int:
    """Number of features; looks at one row for an array column."""
    if not isinstance(features, str):
        return len(features)
    row = df.select(F.size(features).alias("p")).head()
    if row is None:
        raise ValueError("empty feature table")
    return int(row["p"])


def batch_matrix(column: pa.Array, p: int | None = None) -> np.ndarray:
    """An Arrow list column as an n x p array; ragged rows, nulls and NaN are errors."""
    n = len(column)
    values = column.flatten()
    if column.null_count or values.null_count:
        raise ValueError("null or NaN feature value")
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return np.empty((0, p or 0))
    if p is None:
        p = flat.size // n
    if flat.size != n * p or (np.diff(column.offsets.to_numpy()) != p).any():
        raise ValueError("feature vectors differ in length")
    if np.isnan(flat).any():
        raise ValueError("null or NaN feature value")
    return flat.reshape(n, p)


def matrices(batch: pa.RecordBatch, column: str = "x"):
    """The n x p arrays of a batch: one for a list column, one per packed block."""
    values = batch.column(column)
    if pa.types.is_binary(values.type):
        for n, block in zip(batch.column("n").to_pylist(), values, strict=True):
            yield np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(n, -1)
    elif len(values):
        yield batch_matrix(values)


def pack_blocks(vectors: DataFrame, skip_zero_rows: bool = False) -> DataFrame:
    """``(n, x)`` with many feature vectors per row, as one block of bytes.

    Iterative estimators read the same rows again and again.  Packed once and
    persisted, a block passes between the JVM and Python as a plain copy instead
    of element by element.
    """

    def pack(batches):
        for batch in batches:
            for x in matrices(batch):
                if skip_zero_rows:
                    x = x[(x != 0.0).any(axis=1)]
                step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
                blocks = [x[a:a + step] for a in range(0, x.shape[0], step)]
                if blocks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.shape[0] for b in blocks], pa.int32()),
                         pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())],
                        names=["n", "x"],
                    )

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if vectors.sparkSession.conf.get(bound).rstrip("b") != str(BATCH_BYTES):
        vectors.sparkSession.conf.set(bound, BATCH_BYTES)
    return vectors.select("x").mapInArrow(pack, "n INT, x BINARY")


def list_column(matrix: np.ndarray) -> pa.Array:
    """An n x p array as an Arrow list column."""
    n, p = matrix.shape
    offsets = np.arange(0, n * p + 1, p, dtype=np.int32) if p else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))
