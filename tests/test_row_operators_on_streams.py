"""Operators that look at one row at a time also run on a streaming table."""

import numpy as np
from pyspark.sql import functions as F

from mirrorframe.operators import generate, geometry, moments, project, sample


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_row_operators(spark, small):
    path = f"{small}/embeddings.parquet"
    batch = spark.read.parquet(path)
    cov = moments.matrix_table(spark, 0.02 * np.eye(64))
    plan = geometry.knockoff_plan(cov, geometry.s_equi(cov), np.zeros(64))

    def build(e):
        xk = generate.generate_knockoffs(e, "embedding", plan, "vec_id", 5)
        drawn = sample.gumbel_onehot(xk.withColumn("lg", F.slice("x", 1, 5)), "lg", "vec_id", 0.5, 5, [3, 2])
        flat = drawn.select("vec_id", "onehot", F.col("xk")[0].alias("a"), F.col("xk")[1].alias("b"))
        return project.logistic_label(project.standardize(flat, {"a": (0.0, 0.02)}), {"a": 1.0, "b": -1.0})

    stream = spark.readStream.schema(batch.schema).parquet(f"{small}/embeddings*.parquet")
    got = sorted(tuple(map(str, r)) for r in _run(spark, build(stream), "row_operators").collect())
    want = sorted(tuple(map(str, r)) for r in build(batch).collect())
    assert len(got) == batch.count()
    assert got == want
