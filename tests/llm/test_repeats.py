import random

import pytest

from mirrorframe.llm import repeats
from tests.llm import brute

RNG = random.Random(12)


def words(n, vocabulary=5000):
    return " ".join(f"x{RNG.randrange(vocabulary)}" for _ in range(n))


PASSAGES = [words(n) for n in (49, 50, 51, 70, 130)]
DOCS = [(None, f"{PASSAGES[4]} own"), (1, None), (2, ""), (3, " \n"), (4, words(49)), (5, words(3000))]
DOCS += [(10 + i, f"{words(RNG.randrange(30))} {RNG.choice(PASSAGES)} {words(RNG.randrange(40))}\n{RNG.choice(PASSAGES)}") for i in range(60)]
DOCS += [(200 + i, PASSAGES[4]) for i in range(40)] + [(300, f"{PASSAGES[3]} {PASSAGES[3]}"), (300, PASSAGES[2]), (300, PASSAGES[2]), (7, words(300, 2)), (8, words(300, 2))]


@pytest.mark.parametrize("bucket_keys,block_bytes,answer_bytes", [(1_000_000, 2 << 20, 32 << 20), (50, 3000, 0)])
def test_equals_brute_force(spark, monkeypatch, bucket_keys, block_bytes, answer_bytes):
    monkeypatch.setattr(repeats, "BUCKET_KEYS", bucket_keys)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(repeats, "ANSWER_BYTES", answer_bytes)
    docs = spark.createDataFrame([(*d, "c") for d in DOCS], "doc_id LONG, text STRING, removed STRING").repartition(3)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    got = [(r["doc_id"], r["n_words"], sum(b - a for a, b in r["removed"]), r["kept_text"]) for r in repeats.cut_repeats(docs).collect()]
    assert order(got) == order(brute.without_repeats(DOCS))


def test_spans_are_maximal(spark):
    docs = spark.createDataFrame([(1, PASSAGES[4]), (2, f"a {PASSAGES[4]} b")], "doc_id LONG, text STRING")
    rows = {r["doc_id"]: r for r in repeats.cut_repeats(docs).collect()}
    assert rows[1]["removed"] == [] and rows[2]["removed"] == [[1, 131]] and rows[2]["kept_text"] == "a b"


def test_empty_table(spark):
    assert repeats.cut_repeats(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0
