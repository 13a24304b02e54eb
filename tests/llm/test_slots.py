import zlib

import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import slots
from mirrorframe.llm.frames import shared_folder


def test_places(spark):
    texts = [None, "", "é", "x" * 100_000, "same", "same"]
    rows = [(i, texts[i % 6], 1, 2) for i in range(900)] + [(5, "again", 1, 2), (5, "again", 1, 2), (None, "n", 1, 2), (None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, shard INT, vslot INT").repartition(4)
    first = slots.initial_map(spark, 16, 512)
    got = slots.place(docs, first, slots.grow(first), slots=512).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)) == sorted((k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _, _ in rows)
    by_shard = {}
    for r in got:
        assert r["grown_shard"] in (r["shard"], 16) and r["shard"] == r["vslot"] % 16
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r["grown_shard"] for r in got} == set(range(17))
    moved = {r["vslot"] for r in got if r["grown_shard"] == 16}
    assert not moved & {r["vslot"] for r in got if r["grown_shard"] < 16}
    assert slots.place(docs.limit(0), first, slots.grow(first), slots=512).count() == 0


@pytest.mark.parametrize("shards,n", [(1, 1), (3, 64), (16, 4096), (64, 64)])
def test_growing_evens_slots_and_moves_none_between_old_shards(spark, shards, n):
    old = slots.initial_map(spark, shards, n)
    new = slots.grow(old)
    both = old.join(new.select("vslot", F.col("shard").alias("now")), "vslot").collect()
    assert len(both) == n and all(r["now"] in (r["shard"], shards) for r in both)
    counts = [sum(r["now"] == s for r in both) for s in range(shards + 1)]
    assert max(counts) - min(counts) <= 1
    assert [r["version"] for r in new.select("version").distinct().collect()] == [2]


def test_stored_versions(spark):
    folder = f"{shared_folder(spark)}/maps-test"
    first = slots.initial_map(spark, 4, 32)
    for _ in range(2):
        slots.store_map(first.unionByName(slots.grow(first)), folder)
    assert sorted(map(tuple, slots.load_map(spark, folder, 1).collect())) == sorted(map(tuple, first.collect()))
    assert slots.load_map(spark, folder, 2).count() == 32


def test_rebalance_by_bytes(spark):
    old = slots.initial_map(spark, 4, 64)
    loads = spark.createDataFrame([(v, 1000 if v % 4 == 0 else 10) for v in range(60)], "vslot INT, n_bytes LONG")
    new = slots.rebalance(old, loads)
    rows = new.join(loads, "vslot", "left").fillna(0).groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()
    even = sum(r["b"] for r in rows) / 4
    assert new.count() == 64 and max(r["b"] for r in rows) <= even + 500
    assert slots.rebalance(old, loads.limit(0)).select("vslot", "shard").exceptAll(old.select("vslot", "shard")).isEmpty()


def test_too_many_shards(spark):
    with pytest.raises(ValueError, match="slots"):
        slots.initial_map(spark, 5, 4)
