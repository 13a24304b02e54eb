"""Phrase mining against plain counting of all phrases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mirrorframe.llm import phrases
from tests.llm.brute import UPPER


def plain(docs, threshold, longest=5, reported=2000):
    counts = Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und", ()] += len(w)
            counts.update(((lang or "und"), tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {x: n for x, n in counts.items() if n >= threshold}
    inside = Counter()
    for (lang, w), n in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], n)
    out = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and inside[lang, w] < a:
            n = counts[lang, ()]
            cuts = [(1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], n))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, rows in out.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(rows)[:reported], 1)}


def corpus(rng, n=120):
    words = ["the", "The", "of", "naïve", "x", "new", "york", "San", "josé", "a-b", "日本"]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " "]
    docs = [("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.integers(0, 60))), rng.choice(["en", "de", "und"])) for _ in range(n)]
    return [(str(t), str(lang)) for t, lang in docs]


@pytest.mark.parametrize("sampled", [1, 4, 1000])
def test_against_plain_counts(spark, rng, sampled):
    docs = corpus(rng)
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(docs)], "doc_id LONG, text STRING, lang STRING").repartition(5)
    found = phrases.collocations(df, threshold=6, sampled=sampled)
    assert set(map(tuple, found.collect())) == plain(docs, 6)


def test_what_the_sample_misses_is_found_by_expansion(spark, rng):
    """An empty sample proposes nothing: one expansion pass finds all phrases of all lengths."""
    docs = [("one two three four five six " * 3, "en")] * 5
    df = spark.createDataFrame([(1, *d) for d in docs], "doc_id LONG, text STRING, lang STRING")
    whole, passes = phrases.frequent_phrases(df, threshold=5, sampled=1)
    missed, more = phrases.frequent_phrases(df, threshold=5, sampled=10**9)
    assert (passes, more) == (1, 2)
    assert set(map(tuple, whole.collect())) == set(map(tuple, missed.collect()))


@pytest.mark.parametrize("few", [0, phrases.FEW_PLACES])
def test_missed_phrases_are_expanded_and_named_whatever_their_number(spark, rng, few):
    """Of a sample of one document each hundred most is missed; both ways to go on give what plain counting gives."""
    docs = corpus(rng)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id LONG, text STRING, lang STRING").repartition(3)
    whole, _ = phrases.frequent_phrases(df, threshold=6, sampled=1)
    got, passes = phrases.frequent_phrases(df, threshold=6, sampled=100, few=few)
    assert passes == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_few_missed_phrases_take_one_scan(spark, rng, monkeypatch):
    """The whole corpus is read twice, for the cells and the counts, and once more for all that the sample missed."""
    docs = corpus(rng)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id LONG, text STRING, lang STRING")
    scans, wanted = [], {"count_phrases", "count_cells", "name_phrases", "expand_and_name"}
    for name in sorted(wanted & set(vars(phrases))):
        def counted(table, *args, _name=name, _real=getattr(phrases, name)):
            scans.append((_name, table.count() == len(docs)))
            return _real(table, *args)

        monkeypatch.setattr(phrases, name, counted)
    _, passes = phrases.frequent_phrases(df, threshold=6, sampled=100)
    assert passes == 2 and sum(whole for _, whole in scans) == 3, scans


def test_phrases_that_the_sample_does_not_name_take_no_scan_of_their_own(spark, rng, monkeypatch):
    """Of few bits some hold frequent phrases that the sample has not: they are named in the scan that expands."""
    docs = corpus(rng)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id LONG, text STRING, lang STRING")
    whole, _ = phrases.frequent_phrases(df, threshold=6, sampled=1)
    scans = []
    for name in ("count_phrases", "count_cells", "name_phrases", "expand_and_name"):
        def counted(table, *args, _name=name, _real=getattr(phrases, name)):
            scans.append((_name, table.count() == len(docs)))
            return _real(table, *args)

        monkeypatch.setattr(phrases, name, counted)
    got, passes = phrases.frequent_phrases(df, threshold=6, sampled=100, bits=512)
    assert passes == 2 and sum(whole for _, whole in scans) == 3, scans
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("few", [0, phrases.FEW_CELLS])
def test_cells_are_counted_exactly(spark, rng, monkeypatch, few):
    """Many small batches of cells, added up by the cells seen or over the whole bucket."""
    monkeypatch.setattr(phrases, "FEW_CELLS", few)
    monkeypatch.setattr(phrases, "HELD_CELLS", 40)
    docs = corpus(rng)
    df = spark.createDataFrame(docs, "text STRING, lang STRING").repartition(5)

    def wanted(words):
        return [(size, at, words.name(size, at)) for size in (1, 2) for at in [words.places(size)]]

    words = phrases.PieceWords(pa.array([t for t, _ in docs]), pa.array([x for _, x in docs]))
    cells, n = np.unique(np.concatenate([a.astype(np.uint32) for _, _, a in wanted(words)]), return_counts=True)
    for threshold in (1, 6, 6.5):
        found = phrases.count_cells(df, wanted, 200, threshold).collect()
        assert sorted(r["a"] for r in found) == cells[n >= threshold].tolist()


def test_names_tell_phrases_apart(rng):
    """Equal up to the case of A-Z, else different: also words of any length, with zero bytes, and in other languages."""
    words = ["a", "a\0", "\0a", "A", "b" * 8, "b" * 9, "b" * 16, "b" * 17, "b" * 7 + "c" + "b" * 7 + "d", "b" * 7 + "d" + "b" * 7 + "c", "é", "É"]
    words += ["".join(rng.choice(list("xyZ"), size=int(k))) for k in rng.integers(1, 40, 300)]
    texts = [" ".join(words), " ".join(words[::-1]), "", None, words[3]]
    langs = ["en", "de", "en", "en", None]
    block = phrases.PieceWords(pa.array(texts), pa.array(langs))
    for size in range(4):
        at = np.flatnonzero(block.left >= max(size, 1))
        found = list(zip(block.name(size, at).tolist(), block.other_half(size, at).tolist(), strict=True))
        want = [block.text(i, size) for i in at.tolist()]
        assert len(set(found)) == len(set(want)) == len(set(zip(found, want, strict=True)))
        assert len({a for a, _ in found}) == len({b for _, b in found}) == len(set(found))


def test_few_bits_only_count_more(spark, rng):
    docs = corpus(rng, 60)
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(docs)], "doc_id LONG, text STRING, lang STRING")
    assert set(map(tuple, phrases.collocations(df, threshold=4, sampled=2, bits=64).collect())) == plain(docs, 4)


def test_nulls_empties_repeats_ties_and_clashing_columns(spark):
    docs = [(None, "en"), ("", "en"), (" \t ", None), ("a b a b", None), ("a b a b", "und"), ("c d. c d", "und"), ("C D", "und"), ("c,d", "und"), ("ab", ""), ("e f e f", "")]
    rows = [(None if k % 3 else 7, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, phrase STRING, n INT, `a.b` INT")
    want = plain([(t, "\0" if lang == "" else lang) for t, lang in docs], 2)
    assert {(*r,) for r in map(tuple, phrases.collocations(df, threshold=2).collect())} == {("" if r[0] == "\0" else r[0], *r[1:]) for r in want}


def test_very_long_text_and_block_borders(spark, rng):
    words = np.array(["aa", "bb", "cc", "dd", "ee", "ff"])
    text = " ".join(words[rng.integers(0, 6, 30000)]) + ". " + "zz " * 500
    docs = [(text, "en"), ("zz zz", "en"), (text[:5000], "fr")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id LONG, text STRING, lang STRING")
    assert set(map(tuple, phrases.collocations(df, threshold=20, reported=40).collect())) == plain(docs, 20, reported=40)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING")
    assert phrases.collocations(df).collect() == []


def test_scores_pass_64_bits(spark):
    """1000 a n is beyond 64 bits for counts of 1e9 in 1e13 words; the division is exact."""
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 1000000007L a, 9999999999999L n, 1000000011L l, 1000000009L r")
    assert row.select(phrases.cut_score("a", "n", "l", "r").alias("s")).first()["s"] == 1000 * 1000000007 * 9999999999999 // (1000000011 * 1000000009)
    assert row.select(phrases.cut_score("a", "n", "l", "r").alias("s"), F.lit(1)).dtypes[0][1] == "bigint"
