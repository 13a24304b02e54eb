"""Row-aligned Arrow maps, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task works on at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows of a table that may be broadcast; each broadcast row here is well under 200 bytes.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch between Spark and a worker; both sides hold a few of them for each task.
BATCH_BYTES = 8 << 20


def release_memory() -> None:
    """Give freed memory back to the system: a worker that waits between stages then holds no more than its modules."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES`` in this session, where a larger bound is set; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") != str(BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, which ``spark.checkpoint.dir`` names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size.row.check.min", 8).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of at most that many rows; else leave it to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def named(column: str) -> Column:
    """A column by its exact name, also one with dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def set_aside(df: DataFrame, text: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The table with all columns but the text under neutral names, and the function that gives the names back.

    Between the two an operator may add columns of any name.  ``restore`` takes
    replacements by column name, as functions of the neutral column.
    """
    plain = df.select(*[named(c) if c == text else named(c).alias(f"_{k}") for k, c in enumerate(df.columns)])

    def restore(found: DataFrame, **new: Callable[[Column], Column]) -> DataFrame:
        at = {c: named(c) if c == text else F.col(f"_{k}") for k, c in enumerate(df.columns)}
        return found.select(*[(new[c](v) if c in new else v).alias(c) for c, v in at.items()])

    return plain, restore


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (or ``limit / 4`` list items) each."""
    values = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(values).cast(pa.int64()), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(sizes.searchsorted(done + limit, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(sizes[end - 1])


def append_columns(df: DataFrame, fields: list[T.StructField], text: str, make: Callable[[], Callable], block: int = BLOCK_BYTES) -> DataFrame:
    """Add computed columns to every row, in place and without a shuffle.

    ``make()`` runs once in each task and returns a function from a block of rows
    to one Arrow array for each field.  A column that already has a field's name
    is replaced.  ``block`` bounds the bytes of text in a block.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    names = df.columns
    kept = [k for k, c in enumerate(names) if c.lower() not in new]
    # neutral names inside, as Spark's maps can't read columns with dots in their names
    types = [df.schema.fields[k].dataType for k in kept] + [f.dataType for f in fields]
    schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(types)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        work = make()
        out = to_arrow_schema(schema)
        for batch in batches:
            for rows in text_blocks(batch.rename_columns(names), text, block):
                arrays = [rows.column(k).cast(out.field(at).type) for at, k in enumerate(kept)]
                for at, a in enumerate(work(rows), len(kept)):
                    arrays.append(a.cast(out.field(at).type) if isinstance(a, pa.Array) else pa.array(a, type=out.field(at).type))
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
        del work
        release_memory()

    neutral = df.toDF(*[f"c{k}" for k in range(len(names))])
    return neutral.mapInArrow(run, schema).toDF(*[names[k] for k in kept], *[f.name for f in fields])
