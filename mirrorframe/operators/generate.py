"""Knockoff copies of every row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import draws
from mirrorframe.functions.vectors import Features, batch_matrix, list_column, vectorize
from mirrorframe.operators.geometry import KnockoffPlan


def generate_knockoffs(df: DataFrame, features: Features, plan: KnockoffPlan, key: str, seed: int = 0) -> DataFrame:
    """``(key, x, xk)`` with ``xk = x - (x - mu) P + z L^T``.

    A pure map over Arrow batches: no shuffle, and the noise of a row depends
    only on (seed, key, feature), so a lost task is recomputed identically.
    """
    mu, projection, root = plan.mu, plan.projection, plan.root
    p = mu.size
    rows = vectorize(df, features, keep=[F.col(key), draws.hash_key(seed, draws.row_key(df, key)).alias("_h")])

    def copy(batches):
        for batch in batches:
            x = batch_matrix(batch.column("x"), p)
            if x.shape[0] and x.shape[1] != p:
                raise ValueError(f"expected {p} features, found {x.shape[1]}")
            noise = draws.normals_np(batch.column("_h").to_numpy(), p)
            xk = x - (x - mu) @ projection + noise @ root.T
            yield pa.RecordBatch.from_arrays([batch.column(key), list_column(x), list_column(xk)], names=[key, "x", "xk"])

    key_type = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(copy, f"`{key}` {key_type}, x ARRAY<DOUBLE>, xk ARRAY<DOUBLE>")
