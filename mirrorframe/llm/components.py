"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm.frames import written


def _fingerprint(edges: DataFrame):
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 20) - 1)))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), the component named by its smallest node.

    A large-star step links the larger neighbours of each node to the smallest of
    its neighbourhood, a small-star step the smaller ones and itself.  Neighbourhoods
    are never gathered: each step is a minimum by node, which combines before the
    shuffle, and a join with it, whose large keys Spark can split.  The edges are
    written after each pair of steps; it ends when they no longer change.  No edges
    give no rows; loops and repeated edges don't matter.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _fingerprint(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("_m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        linked = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u"), F.col("_m").alias("v"))))
        e = written(large.join(least, "u").select(linked.alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
