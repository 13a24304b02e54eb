import base64

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import languages


def test_held_out_accuracy_and_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = languages.learn(docs, ~languages.held_out())
    assert model[0] == ["de", "en", "es", "fr"]
    rows = languages.predict(docs.withColumns({"score": F.lit("x"), "held": languages.held_out()}), model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["held"]]) >= 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... $$"), (4, "漢字"), (4, "漢字"), (5, "the of and " * 50_000)], "doc_id LONG, text STRING")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in languages.predict(odd, model).collect())
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[3] == got[4] and got[3][1] in model[0] and got[5][1] == "en"
    assert languages.predict(odd.limit(0), model).count() == 0
    kept = languages.keep_explained(odd.withColumn("explained", F.lit(1)), *languages.count_cells(docs, ~languages.held_out()))
    assert kept.columns == ["doc_id", "text", "explained"] and [r["doc_id"] for r in kept.collect()] == [5]


def test_mixture_shares(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = languages.learn(docs, F.lit(True))
    one = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.max_by(F.substring("text", 1, 2000), F.length("text")).alias("t")).collect()}
    mixed = spark.createDataFrame([(1, one["en"][:1500] + " " + one["de"][:500])], "doc_id LONG, text STRING")
    (row,) = languages.predict(mixed, model).collect()
    assert row["lang_pred"] == "en" and set(row["lang_mix"]) == {"en", "de"} and abs(row["score"] - 0.75) < 0.06


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "123", "xx")], "doc_id LONG, text STRING, lang STRING")
    model = languages.learn(docs, F.lit(True))
    assert model[0] == [] and {r["lang_pred"] for r in languages.predict(docs, model).collect()} == {"und"}


def test_evenly_shared_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = languages.learn(docs, F.lit(True))
    one = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.max_by(F.substring("text", 1, 2000), F.length("text")).alias("t")).collect()}
    shared = spark.createDataFrame([(1, " ".join(one[k][:900] for k in ("de", "en", "es"))), (2, " ".join(one[k][:900] for k in ("de", "en", "es", "fr"))), (3, "4 5")], "doc_id LONG, text STRING")
    mixes = {r["doc_id"]: (len(r["lang_mix"]), r["score"]) for r in languages.predict(shared, model).collect()}
    assert mixes[1][0] == 3 and mixes[2][0] == 4 and mixes[1][1] < 0.4 and mixes[2][1] < 0.4
    assert sorted(r["doc_id"] for r in languages.keep_explained(shared, *languages.count_cells(docs, F.lit(True))).collect()) == [1, 2]


def test_nothing_learned_keeps_all_with_letters(spark):
    docs = spark.createDataFrame([(1, "words", 1), (2, "123", 2), (3, None, 3), (4, "é", 4), (5, "", 5)], "doc_id LONG, text STRING, lettered INT")
    kept = languages.keep_explained(docs, [], np.zeros((0, languages.CELLS)))
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["lettered"]) for r in kept.collect()) == [(1, 1), (4, 4)]


def test_em_finds_the_proportions():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(60, 0.2), 3)
    cells = np.concatenate([rng.choice(60, 700, p=p[0]), rng.choice(60, 300, p=p[2])])
    log_p = np.full((3, languages.CELLS), -30.0)
    log_p[:, :60] = np.log(np.maximum(p, 1e-9))
    share = languages.infer(cells, np.zeros(1000, np.int64), 2, log_p)
    assert np.abs(share[0] - [0.7, 0, 0.3]).max() < 0.05 and not share[1].any()


def test_trigrams_stay_within_rows():
    cell, row = languages.trigrams(pa.array(["ab", None, "", "AB", "--", "a-b"]))
    by_row = [sorted(cell[row == r].tolist()) for r in range(6)]
    assert by_row[0] == by_row[3] and len(by_row[0]) == 2 and by_row[1] == by_row[2] == by_row[4] == [] and len(by_row[5]) == 2


def test_noise_goes_and_prose_stays(spark, small):
    rng = np.random.default_rng(4)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counted = languages.count_cells(docs, ~languages.held_out())
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    keyboard = [" ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(60)) for _ in range(20)]
    encoded = [base64.b64encode(rng.bytes(300)).decode() for _ in range(20)]
    foreign = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 80)) for _ in range(10)] + ["".join(chr(c) for c in rng.integers(0x430, 0x44F, 80)) for _ in range(10)]
    noise = spark.createDataFrame([(i, t) for i, t in enumerate(keyboard + encoded + foreign)], "doc_id LONG, text STRING")
    assert languages.keep_explained(noise, *counted).count() <= 1
    prose = docs.filter(languages.held_out() & (F.length("text") > 200))
    assert languages.keep_explained(prose, *counted).count() >= 0.97 * prose.count()


def test_few_training_rows_turn_nothing_down(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "quite other words here", "en"), (3, "xqzvk wjfpq", None)], "doc_id LONG, text STRING, lang STRING")
    assert languages.keep_explained(docs, *languages.count_cells(docs, F.col("doc_id") == 1)).count() == 3


def test_more_labels_than_the_driver_may_hold(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LABELS", 2)
    docs = spark.createDataFrame([(k, "words", f"l{k}") for k in range(3)], "doc_id LONG, text STRING, lang STRING")
    with pytest.raises(ValueError, match="more than 2 labels"):
        languages.learn(docs, F.lit(True))
