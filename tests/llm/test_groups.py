"""Jaccard classes over token groups against all pairs."""

import numpy as np
import pytest

from mirrorframe.llm import groups
from tests.llm.brute import shingles


def plain(docs, size=3, percent=90):
    """[(key, set size, smallest key of the class)] of (key, text) rows, null keys last."""
    sets = [shingles(t, size) for _, t in docs]
    lead = list(range(len(docs)))

    def top(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lead[top(i)] = top(j)
    members = {}
    for i, (key, _) in enumerate(docs):
        members.setdefault(top(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(docs):
        keys = [k for k in members[top(i)] if k is not None]
        out.append((key, len(sets[i]), key if not sets[i] else min(keys, default=None)))
    return out


def edited(rng, words, n):
    """``words`` with ``n`` of them replaced."""
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"w{rng.integers(10**6)}"
    return " ".join(words)


def corpus(rng):
    base = [[f"v{x}" for x in rng.integers(0, 400, 120)] for _ in range(6)]
    docs = [edited(rng, b, int(rng.integers(0, 6))) for b in base for _ in range(25)]
    docs += [" ".join(b[: int(rng.integers(100, 121))]) for b in base for _ in range(5)]
    docs += [" ".join(f"u{x}" for x in rng.integers(0, 50, rng.integers(0, 40))) for _ in range(60)]
    docs += [" ".join(b + ["tail"] * int(rng.integers(0, 20))) for b in base]
    return [(i, t) for i, t in enumerate(docs)]


def found(df, **options):
    return sorted(map(tuple, groups.jaccard_classes(df, **options).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("members", [3, 64])
def test_against_all_pairs(spark, rng, monkeypatch, members):
    """Groups of three split every family over many groups; none of its links may be lost."""
    monkeypatch.setattr(groups, "MEMBERS", members)
    docs = corpus(rng)
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(6)
    assert found(df) == plain(docs)


def test_other_sizes_and_thresholds(spark, rng):
    docs = corpus(rng)[::2]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    for size, percent in ((1, 60), (2, 100)):
        assert found(df, size=size, percent=percent) == plain(docs, size, percent)


def test_queries_of_a_group_in_several_copies(spark, rng, monkeypatch):
    monkeypatch.setattr(groups, "QUERIES", 2)
    monkeypatch.setattr(groups, "MEMBERS", 4)
    docs = corpus(rng)[:100]
    assert found(spark.createDataFrame(docs, "doc_id LONG, text STRING")) == plain(docs)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    ten = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    docs = [(5, ten), (3, ten.upper()), (4, ten + " end"), (None, ten), (9, None), (8, ""), (7, " \t\n"), (6, "one two"), (2, "one  TWO"), (2, "other words"), (2, ten), (None, "alone here now"), (None, None)]
    rows = [(k, t, "n", 1, 0) for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, node STRING, g INT, `a.b` INT")
    want = sorted(plain(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert found(df) == want


def test_string_keys_and_empty_table(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", "x y")], "id STRING, body STRING")
    assert sorted(map(tuple, groups.jaccard_classes(df, "id", "body").collect())) == [("a", 1, "a"), ("b", 1, "a"), ("c", 1, "c")]
    assert groups.jaccard_classes(spark.createDataFrame([], "doc_id LONG, text STRING")).collect() == []


def test_very_long_text(spark, rng):
    words = [f"v{x}" for x in rng.integers(0, 5000, 40000)]
    docs = [(1, edited(rng, words, 500)), (2, " ".join(words)), (3, " ".join(words[:20000])), (4, "short one")]
    assert found(spark.createDataFrame(docs, "doc_id LONG, text STRING")) == plain(docs)


def test_linked_sets_share_enough_of_what_they_publish(rng):
    """The smallest overlaps that link, in any order of the tokens."""
    for _ in range(600):
        n = int(rng.integers(1, 150))
        m = int(rng.integers(groups.smallest_partner(n), n + 1))
        c = max(groups.needed(n, m), 1)
        if c > m:
            continue
        tokens = rng.permutation(n + m - c)
        a, b = set(tokens[:n].tolist()), set(tokens[n - c :].tolist())
        assert len(a & b) == c and 100 * c >= 90 * (n + m - c) > 100 * c - 190
        shared = set(sorted(a)[: groups.published(n)]) & set(sorted(b)[: groups.published(m)])
        assert len(shared) >= max(groups.least_shared(n), groups.least_shared(m))


def test_least_shared_as_a_column(spark):
    rows = spark.range(1, 700).selectExpr("id AS n").select("n", groups._least_shared(90).alias("s")).collect()
    assert all(r["s"] == groups.least_shared(r["n"]) for r in rows)


def test_bound_keeps_partners_and_closes_other_groups(rng):
    members = [np.unique(rng.integers(0, 1000, 100).astype(np.uint64)) for _ in range(5)]
    union = np.unique(np.concatenate(members))
    low = min(map(len, members))
    assert all(groups.qualifies(m, union, low) for m in members)
    assert not groups.qualifies(np.arange(2000, 2100, dtype=np.uint64), union, low)
    half = np.concatenate([members[0][:50], np.arange(2000, 2050, dtype=np.uint64)])
    assert not groups.qualifies(half, union, low)
