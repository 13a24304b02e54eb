"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key is hashed into one of some thousands of slots; a small table says
which shard owns a slot.  Rebalancing edits that table (a new version of it), so
only the records of the slots that moved change their shard.  The map has one row
for each slot, whatever the data, so it may be broadcast and collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
MAP_SCHEMA = "version INT, vslot INT, shard INT"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text, modulo the slots; a null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slot v belongs to shard v mod ``shards``."""
    if not 0 < shards <= slots:
        raise ValueError(f"{shards} shards need as many slots at least, not {slots}")
    v = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), v.alias("vslot"), F.pmod(v, F.lit(shards)).alias("shard"))


def grow(slot_map: DataFrame) -> DataFrame:
    """The next version with one more shard: each old shard gives up its last slots, beyond the new even share.

    Depends on the map alone, so key and shard count decide where a record goes.
    """
    by_shard = Window.partitionBy("shard")
    shards = F.max("shard").over(Window.partitionBy("version")) + 1
    slots = F.count("*").over(Window.partitionBy("version"))
    share = F.floor(slots / (shards + 1)) + (F.col("shard") < slots % (shards + 1)).cast("int")
    ranked = slot_map.select("*", F.row_number().over(by_shard.orderBy("vslot")).alias("_rank"), share.alias("_share"), shards.alias("_new"))
    shard = F.when(F.col("_rank") > F.col("_share"), F.col("_new")).otherwise(F.col("shard")).cast("int")
    return ranked.select((F.col("version") + 1).alias("version"), "vslot", shard.alias("shard"))


def rebalance(slot_map: DataFrame, loads: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The next version with slots moved until no shard is over its even share by more than ``tolerance``, or no move helps.

    ``loads`` has (vslot, n_bytes).  Slots without a load count as empty.  Each step
    moves the slot that evens the fullest and the emptiest shard best.
    """
    rows = slot_map.join(F.broadcast(loads.select("vslot", "n_bytes")), "vslot", "left").fillna(0, ["n_bytes"]).collect()
    spark = slot_map.sparkSession
    held: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["n_bytes"], r["vslot"])):
        held.setdefault(r["shard"], []).append((r["n_bytes"], r["vslot"]))
    total = {s: sum(b for b, _ in v) for s, v in held.items()}
    even = sum(total.values()) / max(1, len(total))
    while held:
        full, empty = max(total, key=lambda s: (total[s], -s)), min(total, key=lambda s: (total[s], s))
        gap = total[full] - total[empty]
        movable = [x for x in held[full] if 0 < x[0] < gap]
        if total[full] <= even * (1 + tolerance) or not movable:
            break
        moved = min(movable, key=lambda x: (abs(x[0] - gap / 2), x[1]))
        held[full].remove(moved)
        held[empty] = sorted([*held[empty], moved])
        total[full], total[empty] = total[full] - moved[0], total[empty] + moved[0]
    version = max((r["version"] for r in rows), default=0) + 1
    return spark.createDataFrame([(version, v, s) for s, x in held.items() for _, v in x], MAP_SCHEMA)


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Write each version in the table to a folder of its own; writing a version again replaces it."""
    for (version,) in slot_map.select("version").distinct().collect():
        slot_map.filter(F.col("version") == version).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    found = spark.read.schema("vslot INT, shard INT").parquet(f"{folder}/version={version}")
    return found.select(F.lit(version).alias("version"), "vslot", "shard")


def slot_loads(records: DataFrame, size: str = "size") -> DataFrame:
    """Rows and bytes of each slot that holds any; ``records`` has ``vslot`` and a size."""
    return records.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


def place(docs: DataFrame, slot_map: DataFrame, next_map: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Shard of every row now and under the next map, and its position within its shard, without gaps from 0.

    Returns key, size (UTF-8 bytes and 1; 1 for a null text), text_crc32 (0 for a
    null text), vslot, shard, slot (the position) and grown_shard.  Positions are
    counted in each virtual slot and shifted by the counts of the shard's earlier
    slots, so no task orders a whole shard.  Rows of equal key are ordered by
    checksum and size; rows equal in these are interchangeable.  Null keys share
    one slot; an empty table gives an empty one; other columns are not read.
    """
    records = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(F.col(key), slots).alias("vslot"),
    )
    owners = slot_map.select("vslot", "shard").join(F.broadcast(next_map.select("vslot", F.col("shard").alias("grown_shard"))), "vslot")
    counted = slot_loads(docs.select(slot_of(F.col(key), slots).alias("vslot"), F.lit(1).alias("size")))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = owners.join(F.broadcast(counted.select("vslot", "n_rows")), "vslot").select("*", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("vslot").orderBy(F.col(key), "text_crc32", "size")
    ranked = records.select("*", (F.row_number().over(within) - 1).alias("_rank"))
    placed = ranked.join(F.broadcast(starts.drop("n_rows")), "vslot")
    return placed.select(key, "size", "text_crc32", "vslot", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
