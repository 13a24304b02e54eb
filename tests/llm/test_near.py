import random

import pytest

from mirrorframe.llm import components, near
from tests.llm import brute

RNG = random.Random(11)
VOCABULARY = [f"v{i}" for i in range(3000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(base, edits):
    out = list(base)
    for _ in range(edits):
        kind, at = RNG.randrange(3), RNG.randrange(len(out))
        if kind == 0:
            out[at] = RNG.choice(VOCABULARY)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, RNG.choice(VOCABULARY))
    return " ".join(out)


def check(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(df, **options).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute.classes(docs).items()}


def test_groups_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near, "HUBS", 7)  # several rounds
    docs = []
    for _ in range(4):
        base = words(120)
        docs += [" ".join(base)] + [edited(base, RNG.randrange(0, 12)) for _ in range(60)]
        docs += [" ".join(base[: RNG.randrange(60, 120)]) for _ in range(30)]  # cut short: nested sets of many sizes
    docs += [" ".join(words(RNG.randrange(1, 80))) for _ in range(60)]
    RNG.shuffle(docs)
    check(spark, list(enumerate(docs)))


def test_odd_texts(spark):
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (11, "a b c d e"), (12, "a b c d e f"), (13, "a a a a a a a a a"), (14, "a a a a a"), (15, "é É"), (16, "É É")]
    docs += [(100 + i, "the same copy of one and the same text") for i in range(300)] + [(20, " ".join(words(30_000)))]
    check(spark, docs)


def test_repeated_keys_nulls_and_clashing_columns(spark):
    rows = [(2, "p q r s t u", "x", 1), (2, "p q r s t u", "x", 1), (2, "something else altogether for once", "x", 1), (1, "p q r s t u", "x", 1), (None, "P Q R S T U", "x", 1), (3, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, node STRING, kept INT")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect())
    assert got == [(-1, 1, False), (1, 1, True), (2, 1, False), (2, 1, False), (2, 2, True), (3, 3, True)]
    left = near.drop_near_duplicates(docs.filter("doc_id <> 2 or text like 'some%'"))
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.filter("doc_id is not null").collect()) == [1, 2, 3]
    assert near.near_duplicates(docs.limit(0)).count() == 0 == near.drop_near_duplicates(docs.limit(0)).count()


def test_of_repeated_rows_one_stays(spark):
    docs = spark.createDataFrame([(4, "q w e r t y u"), (4, "q w e r t y u"), (9, "q w e r t y u"), (5, "other words stand here now")], "doc_id LONG, text STRING")
    assert sorted(r["doc_id"] for r in near.drop_near_duplicates(docs).collect()) == [4, 5]


def test_rows_go_by_their_own_class(spark):
    rows = [
        (2, "p q r s t u"), (2, "p q r s t u"), (2, "something else altogether for once"), (1, "p q r s t u"), (None, "P Q R S T U"), (3, None),
        (None, "of no key and by itself"), (None, "Of no key and by itself"), (None, "of no key, and another"), (4, ""), (4, ""), (4, None), (4, "a text of key four"), (4, "A text of key four"),
    ]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    left = near.drop_near_duplicates(docs)
    want = [(-1, "of no key and by itself"), (-1, "of no key, and another"), (1, "p q r s t u"), (2, "something else altogether for once"), (3, ""), (4, ""), (4, ""), (4, "a text of key four")]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").lower()) for r in left.collect()) == want
    # a single null key among unique keys
    single = near.drop_near_duplicates(docs.filter("text in ('p q r s t u', 'P Q R S T U') and doc_id is distinct from 2"))
    assert [tuple(r) for r in single.collect()] == [(1, "p q r s t u")]


def test_one_row_of_a_class_under_one_key(spark):
    base = words(120)
    docs = spark.createDataFrame([(7, " ".join(base)), (7, " ".join([*base, "more"])), (7, " ".join(words(40))), (8, " ".join(base[1:]))], "doc_id LONG, text STRING")
    assert sorted(r["doc_id"] for r in near.drop_near_duplicates(docs).collect()) == [7, 7]


def test_near_copies_without_a_key(spark):
    base, other = words(120), words(90)
    rows = [(6, " ".join(base)), (None, " ".join([*base, "more"])), (None, " ".join(["more", *base])), (None, " ".join(other)), (None, " ".join(other[1:])), (9, " ".join(words(50)))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in near.near_duplicates(docs).collect())
    assert got == [(-1, 85, -1, True), (-1, 86, -1, True), (-1, 117, 6, False), (-1, 117, 6, False), (6, 116, 6, True), (9, 46, 9, True)]
    assert sorted(r["doc_id"] or -1 for r in near.drop_near_duplicates(docs).collect()) == [-1, 6, 9]


def test_fewer_minima(spark):
    assert [near.least_agreeing(n) for n in (128, 96, 64, 4)] == [68, 47, 28, 0]
    docs = []
    for _ in range(5):
        base = words(120)
        docs += [" ".join(base), edited(base, 1), edited(base, 1)]
    check(spark, list(enumerate(docs)), bands=16, rows=4)


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(k, 99) for k in range(50)],
    [(RNG.randrange(200), RNG.randrange(200)) for _ in range(150)],
])
def test_components(spark, edges):
    lead = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(lead)):
        for a, b in edges:
            if a != b:
                lead[a] = lead[b] = min(lead[a], lead[b])
    got = components.components(spark.createDataFrame(edges, "u LONG, v LONG")).collect()
    assert len(got) == len(lead) and {r["node"]: r["component"] for r in got} == lead
