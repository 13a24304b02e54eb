import random

import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import suffixes
from tests.llm import brute

RNG = random.Random(2)
VOCABULARY = [f"w{i}" for i in range(12)]


def words(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


ITEMS = [(1, words(30)), (2, "w1, W2; w3"), (10, words(10)), (3, None), (4, "..."), (5, "solo"), (None, words(12)), (6, words(30)), (6, words(15))]
DOCS = [(0, None), (1, ""), (2, "..., !"), (3, words(400)), (4, f"{words(9)} {ITEMS[0][1].upper()} {words(20)}"), (4, "a SOLO b"), (5, f"{ITEMS[2][1]}"),
        (6, " ".join(ITEMS[0][1].split()[3:25])), (7, f"x {ITEMS[6][1]} y"), (8, words(5000)), (8, words(5000)), (None, "w1 w2 w3")]


@pytest.mark.parametrize("part_words", [1_000_000, 1])
def test_hits_equal_brute_force(spark, part_words):
    docs = spark.createDataFrame([(k, t, "own", 7) for k, t in DOCS], "doc_id LONG, text STRING, items STRING, n_words INT").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id LONG, text STRING")
    rows = suffixes.find_matches(docs, bench, part_words=part_words).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["n_words"], sum(b - a for a, b in r["hit_spans"]), r["items"]) for r in rows))
    want = sorted(((k is None, k or 0, t or "", *brute.contamination(t, ITEMS)) for k, t in DOCS))
    assert got == want


def test_matches_are_longest_and_verbatim(spark):
    docs = spark.createDataFrame([(1, " ".join(["q"] + ITEMS[0][1].split()[2:20] + ["q"]))], "doc_id LONG, text STRING")
    (row,) = suffixes.find_matches(docs, spark.createDataFrame(ITEMS[:1], "item_id LONG, text STRING")).collect()
    assert [(m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in row["matches"]] == [("1", 2, 1, 18)]


def test_decontaminate_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame([(1, "solo act", "m", 1), (2, "duet", "m", 2)], "doc_id LONG, text STRING, matches STRING, n_words INT")
    bench = spark.createDataFrame(ITEMS, "item_id LONG, text STRING")
    clean = suffixes.decontaminate(docs, bench)
    assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [(2, "duet", "m", 2)]
    assert suffixes.decontaminate(docs, bench.limit(0)).count() == 2
    assert suffixes.find_matches(docs.limit(0), bench).count() == 0
    assert suffixes.find_matches(docs, bench.limit(0)).select(F.sum("n_words")).first()[0] == 3
