"""Ranges with fixed edges, and global positions without a global sort.

A window without partitions moves every row to one task.  Global order is
therefore taken in two steps: rows go to ranges of the key, and a small table of
per-range totals gives each range its offset.  The edges are literals, so a
recomputed task always sees the same ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorframe.functions import draws
from mirrorframe.functions.orderstats import SKETCH_SIZE, fractions, sketch

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 200_000
SKETCH_RANGES = 500  # finer ranges would be uneven, as the sketch is off by about 1/1000
SAMPLES_PER_RANGE = 64
INLINE_EDGES = 64
SAMPLE_SEED = 97


def range_edges(df: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE) -> list:
    """The upper edges of ranges of near equal size.

    One scan counts and sketches the key.  A table that needs more ranges than a
    sketch can separate takes a hash-chosen set of distinct keys instead, puts it
    in order the same way, and cuts at every ``SAMPLES_PER_RANGE``-th of them.
    """
    agg, read = sketch(df, key, F.col(key), SKETCH_SIZE)
    grid = fractions(i / SKETCH_RANGES for i in range(1, SKETCH_RANGES))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("k"), agg.alias("s")).select(
        "n", F.when(F.col("k") > 0, read("s", grid)).alias("q")
    ).head()
    wanted = min(MAX_RANGES, -(-row["n"] // rows_per_range))
    if wanted <= SKETCH_RANGES:
        return sorted({row["q"][i * SKETCH_RANGES // wanted - 1] for i in range(1, wanted)})
    rate = SAMPLES_PER_RANGE * wanted / row["n"]
    chosen = df.select(key).where(draws.uniform(SAMPLE_SEED, draws.row_key(df, key)) < rate).distinct()
    cuts = with_position(chosen, key).where(F.col("position") % SAMPLES_PER_RANGE == SAMPLES_PER_RANGE - 1)
    return sorted(r[key] for r in cuts.select(key).collect())


def range_of(key: str, edges: list) -> Column:
    """Number of edges below the key (range ``k`` holds edge[k-1] < key <= edge[k])."""
    if len(edges) <= INLINE_EDGES:
        bucket = F.lit(0)
        for e in edges:
            bucket = bucket + (F.col(key) > F.lit(e)).cast("int")
        return bucket
    fixed = np.array(edges)

    @F.pandas_udf("int")
    def search(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(fixed, v.to_numpy(), side="left"))

    return search(F.col(key))


def with_position(df: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE, out: str = "position") -> DataFrame:
    """0-based position of every row in the order of a unique numeric key."""
    placed = df.withColumn("_range", range_of(key, range_edges(df, key, rows_per_range)))
    totals = placed.groupBy("_range").count()
    # one row per range, at most MAX_RANGES of them in this unpartitioned window
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    # a left join keeps the optimizer from adding a null test that finds every range twice
    numbered = placed.withColumn("_rank", rank).join(F.broadcast(offsets), "_range", "left")
    return numbered.withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_range", "_rank", "_before")


def aligned_edges(keys: DataFrame, key: str, block: int, rows_per_range: int = ROWS_PER_RANGE) -> list:
    """Edges of ranges that begin at every position that is a multiple of ``block``, in the order of a unique numeric key.

    Borders from ``range_edges`` are moved up by less than a block; the keys they move
    to are found by rank within their range, one for each range.
    """
    edges = range_edges(keys, key, rows_per_range)
    if not edges:
        return edges
    placed = keys.select(F.col(key).alias("k"), range_of(key, edges).alias("r"))
    counts = dict(placed.groupBy("r").count().collect())
    moves, before = {}, 0
    for r in range(len(edges) + 1):
        moves[r] = -before % block
        before += counts.get(r, 0)
    wanted = [(r, m) for r, m in moves.items() if r and 0 < m <= counts.get(r, 0)]
    table = keys.sparkSession.createDataFrame(wanted, "r INT, at INT")  # one row for each range
    rank = F.row_number().over(Window.partitionBy("r").orderBy("k"))
    near = placed.withColumn("at", rank).filter(F.col("at") < block)
    last = {row["r"]: row["k"] for row in near.join(F.broadcast(table), ["r", "at"]).select("r", "k").collect()}
    # a range with fewer rows than its border would move by has none of its own
    return sorted({edges[r - 1] if moves[r] == 0 else last[r] for r in range(1, len(edges) + 1) if moves[r] == 0 or r in last})
