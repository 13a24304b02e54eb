import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import rollups
from mirrorframe.llm.frames import shared_folder

ROWS = [(1, "a b  c", "s", "en"), (2, None, "s", "en"), (3, "", None, None), (4, "x-y é!", "t", "de"), (4, "x-y é!", "t", "de"), (5, "w " * 50_000, "t", None), (None, "one two", "s", "en")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id LONG, text STRING, source STRING, lang STRING, n_tokens INT")


def brute(rows, pattern):
    out = {}
    for _, t, s, lang in rows:
        n = out.setdefault((s, lang), Counter())
        n.update(d=1, t=len(re.findall(pattern, t or "")), b=len((t or "").encode()))
    return {k: (v["d"], v["t"], v["b"]) for k, v in out.items()}


def read(df):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_bytes"]) for r in df.collect()}


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"


@pytest.mark.parametrize("tokenizer,pattern", [("words-1", r"[^\x20\x09-\x0D]+"), ("words-2", "[0-9A-Za-z\x80-\U0010ffff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]")])
def test_commits_count_once(spark, folder, tokenizer, pattern):
    counted = rollups.counted(table(spark), tokenizer)
    for _ in range(3):
        rollups.commit(rollups.inserts(counted), folder, "day-1")
    assert read(rollups.read_totals(spark, folder)) == brute(ROWS, pattern)
    for _ in range(2):
        rollups.commit(rollups.deletes(counted.filter("key = 4")), folder, "day-2")
    assert read(rollups.read_totals(spark, folder)) == brute([r for r in ROWS if r[0] != 4], pattern)


def test_revisions_and_changes(spark, folder):
    old, new = table(spark, [ROWS[0], ROWS[3], ROWS[5]]), table(spark, [ROWS[0], (4, "now longer than before", "t", "fr"), (6, "new", "u", "en")])
    before, after = rollups.counted(old, "words-1"), rollups.counted(new, "words-1")
    rollups.commit(rollups.inserts(before), folder, "a")
    rollups.commit(rollups.changes(before, after), folder, "b")
    assert read(rollups.read_totals(spark, folder)) == brute([tuple(r)[:4] for r in new.collect()], r"[^\x20\x09-\x0D]+")
    rollups.commit(rollups.revisions(after, rollups.counted(new, "words-2")), folder, "c")
    assert {r["tokenizer"] for r in rollups.read_totals(spark, folder).collect()} == {"words-2"}
    assert rollups.changes(before, before).select(F.count("*")).first()[0] == 0


def test_empty_and_bad_batches(spark, folder):
    rollups.commit(rollups.inserts(rollups.counted(table(spark).limit(0), "words-1")), folder, "none")
    assert rollups.read_totals(spark, folder).count() == 0
    with pytest.raises(ValueError, match="batch id"):
        rollups.commit(rollups.inserts(rollups.counted(table(spark), "words-1")), folder, "a/b")


def test_only_complete_batches_count_and_they_stay(spark, folder):
    import os

    assert rollups.read_totals(spark, folder).collect() == []
    counted = rollups.counted(table(spark), "words-1")
    rollups.commit(rollups.inserts(counted), folder, "a")
    rollups.commit(rollups.inserts(counted), folder, "b")
    os.remove(f"{folder}/batch=b/_SUCCESS")  # as after a crash
    want = brute(ROWS, r"[^\x20\x09-\x0D]+")
    assert read(rollups.read_totals(spark, folder)) == want
    rollups.commit(rollups.deletes(counted), folder, "a")  # complete: not written again
    assert read(rollups.read_totals(spark, folder)) == want
    rollups.commit(rollups.deletes(counted), folder, "b")
    assert rollups.read_totals(spark, folder).collect() == []
