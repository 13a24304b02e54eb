"""Feature tables, side lists and run records."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.operators.encode import Feature


def read_features(spark: SparkSession, path: str, schema: str | None = None, id_col: str | None = None,
                  columns: list[str] | None = None, fmt: str | None = None) -> DataFrame:
    """A wide feature table from CSV (with header) or Parquet, with a ``row_id``.

    ``id_col`` names an existing unique key.  Without one, the id of a Parquet row is
    a hash of its file's path and its position there, and that of a CSV row its number
    over all files (see ``number_rows``): the same whatever the split size.  Give ``schema``
    for large CSV files, since inferring it reads them once more.
    """
    if fmt is None:
        fmt = "csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    if fmt == "csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema else reader).load(path)
    features = [c for c in (columns or df.columns) if c != id_col]
    if id_col is None and fmt == "csv":
        return number_rows(df, features)
    if id_col is None and fmt != "parquet":
        raise ValueError("only rows of Parquet and CSV can be told apart by their place; name an id_col")
    row_id = F.xxhash64("_metadata.file_path", "_metadata.row_index") if id_col is None else F.col(id_col)
    return df.select(row_id.alias("row_id"), *features)


def number_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(row_id, *columns)`` of a table of text files: rows are numbered from 0 in each file's order, files by their path.

    A first pass counts the rows of every split; these counts, a number for each split
    that the driver plans anyway, say where the rows of a split begin.  In the second
    pass a task numbers the rows of its splits as they come.  A split is known by its
    file and its first byte, so the numbers hold for any split size and any grouping of
    splits into tasks, and a task that runs again gives the same ones.  Adding files
    whose path sorts last leaves the numbers of the others as they are.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    splits = sorted((r["_file"], r["_start"], r["count"]) for r in df.select(*place).groupBy("_file", "_start").count().collect())
    begins, at = {}, 0
    for file, start, n in splits:
        begins[file, start] = at
        at += n
    rows = df.select(*place, *[F.col(f"`{c}`") for c in columns]).toDF("_file", "_start", *[f"c{k}" for k in range(len(columns))])
    out = T.StructType([T.StructField("row_id", T.LongType()), *rows.schema.fields[2:]])

    def number(batches):
        split, used = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes = files.indices.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1, [len(codes)]])
            ids = np.empty(len(codes), np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here = files.dictionary[int(codes[a])].as_py(), int(starts[a])
                if here != split:
                    split, used = here, 0
                ids[a:b] = np.arange(begins[here] + used, begins[here] + used + b - a)
                used += b - a
            yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns[2:]], names=out.names)

    return rows.mapInArrow(number, out).toDF("row_id", *columns)


def _read_list(spark, path, schema):
    """A one-column CSV in file order; these lists have one row per feature."""
    df = spark.read.option("header", True).schema(schema).csv(path).coalesce(1)
    return [r[0] for r in df.collect()]


def read_feature_lists(spark: SparkSession, factors: str, chunks: str, cat_index: str, cont: str,
                       groups: str | None = None, columns: list[str] | None = None) -> list[Feature]:
    """The feature catalog from the four side lists; positions in the files start at 1.

    The lists must agree: chunk sizes add up to the number of categorical
    positions, and those follow the continuous features.  ``columns`` (the
    feature columns of the table) supplies the names of the indicator columns
    and must agree too; without it they are numbered within their factor.
    """
    factor_names = _read_list(spark, factors, "variable STRING")
    sizes = _read_list(spark, chunks, "X1 INT")
    positions = [p - 1 for p in _read_list(spark, cat_index, "X1 INT")]
    cont_names = _read_list(spark, cont, "variable STRING")
    group_of = {} if groups is None else {r["var_names"]: r["groups"] for r in read_feature_groups(spark, groups).collect()}
    if len(factor_names) != len(sizes):
        raise ValueError("one chunk size per factor is required")
    if sum(sizes) != len(positions):
        raise ValueError("chunk sizes do not add up to the categorical positions")
    if positions != list(range(len(cont_names), len(cont_names) + len(positions))):
        raise ValueError("categorical positions must follow the continuous features")
    if columns is not None and (len(columns) != len(cont_names) + len(positions) or columns[: len(cont_names)] != cont_names):
        raise ValueError("the feature lists do not describe the columns of this table")
    out = [Feature(i, c, "cont", group_id=group_of.get(c)) for i, c in enumerate(cont_names)]
    at = iter(positions)
    for k, (factor, size) in enumerate(zip(factor_names, sizes, strict=True)):
        for level in range(size):
            pos = next(at)
            name = columns[pos] if columns else f"{factor}_{level}"
            out.append(Feature(pos, name, "cat", k, str(level), group_of.get(factor)))
    return out


def read_feature_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(var_names, groups)``."""
    return spark.read.option("header", True).schema("var_names STRING, groups INT").csv(path)


def write_train_index(train: DataFrame, path: str, key: str = "row_id", fmt: str = "parquet") -> None:
    """Persist the ids of the training rows."""
    train.select(key).write.mode("overwrite").format(fmt).save(path)


def write_run_params(params: DataFrame, path: str, fmt: str = "json", replace: bool = False) -> None:
    """Add one parameter record for each run, in a folder of its own below ``path``; records of earlier calls stay.

    A run whose folder is there is complete, since a folder only takes its place
    when all its files are written: it is left as it is, so a repeated call changes
    nothing, or with ``replace`` written anew.  Other runs' folders are never touched.
    """
    spark = params.sparkSession
    if not replace:
        try:
            done = spark.read.format(fmt).schema(params.schema).load(path).select("run_label").distinct()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            params = params.join(F.broadcast(done), "run_label", "left_anti")  # one short row for each run
    params.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_label").format(fmt).save(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the directory that ``spark.checkpoint.dir`` names."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
