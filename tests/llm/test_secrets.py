import base64
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import secrets
from tests.llm import brute

RNG = random.Random(8)
ALNUM = string.ascii_letters + string.digits
PIECES = ["password=", "Token : '", "SECRET:", "apikey=", "api_KEY = \"", "passwordpassword=x", "AKIA", "AKIAABCDEFGHIJKL", "deadbeef" * 4, "0123", "hunter2hunter2", " ", "'", "é漢", "ſecret=12345678", "=", "\n"]
RANDOM = [base64.b64encode(RNG.randbytes(33)).decode() for _ in range(40)] + ["".join(RNG.choice(ALNUM) for _ in range(44)) for _ in range(40)] + ["".join(RNG.choice("0123456789ABCDEF") for _ in range(48)) for _ in range(40)]
ORDINARY = ["the-quick-brown-fox-jumps-over-the-lazy-dog2", "/usr/local/lib/python3/dist-packages/numpy/Core", "this_is_a_very_long_identifier_name_V2", "A" * 40 + "1", "Abcdefghijklmnopqrstuvwxyz0123456789", "1234567890" * 3]


def test_base_spans_equal_the_plain_patterns():
    for _ in range(2000):
        text = "".join(RNG.choice(PIECES) for _ in range(RNG.randrange(12)))
        assert [(secrets.KINDS[k], a, b) for a, k, b in sorted(secrets.base_spans(text))] == brute.base_spans(text)


@pytest.fixture(scope="module")
def corpus(spark, small):
    prose = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    extra = [(10_000 + i, f"é {s} and more") for i, s in enumerate(RANDOM)] + [(20_000 + i, f"see {s} here") for i, s in enumerate(ORDINARY)]
    extra += [(30_000, None), (30_001, ""), (30_002, "key token = abcdefgh12345678 " * 3), (30_002, "key token = abcdefgh12345678 " * 3)]
    return prose.unionByName(spark.createDataFrame(extra, "doc_id LONG, text STRING")).withColumn("secrets", F.lit(1)).repartition(5)


def test_battery_adds_random_strings_only(corpus):
    found = {r["doc_id"]: r for r in secrets.find_secrets(corpus).collect()}
    added = [any(s["kind"] == "random" and found[10_000 + i]["text"][s["start"] : s["end"]] == t for s in found[10_000 + i]["secrets"]) for i, t in enumerate(RANDOM)]
    assert np.mean(added) >= 0.95
    assert [t for i, t in enumerate(ORDINARY) if found[20_000 + i]["secrets"]] == []
    assert found[30_000]["secrets"] == [] == found[30_001]["secrets"]
    for r in found.values():
        base = [(s["kind"], s["start"], s["end"]) for s in r["secrets"] if s["kind"] != "random"]
        assert base == brute.base_spans(r["text"] or "")
        if r["doc_id"] < 10_000:
            assert all(s["kind"] != "random" for s in r["secrets"])


def test_redaction_takes_effect(spark):
    rows = [(1, f"a token = abcdefgh12345678, {'0a' * 20} b", 99, "k"), (2, "clean", 5, "k"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_chars LONG, _spans STRING")
    got = secrets.redact(docs, length="n_chars")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "a [SECRET], [SECRET] b", 22, "k"), (2, "clean", 5, "k"), (3, None, None, None)]
    assert secrets.redact(docs.limit(0)).count() == 0


def test_mask_joins_overlaps():
    assert secrets.mask("0123456789", [(2, 5), (3, 4), (4, 7), (8, 9)], "*") == "01*7*9"
    assert secrets.mask("ab", [], "*") == "ab"


def test_encodings():
    assert secrets.encoding_of("deadbeef01") == "hex" and secrets.encoding_of("ABCDEF12==") == "HEX" and secrets.encoding_of("MZXW6YTB") == "base32"
    assert secrets.encoding_of("aB3/") == "base64" and secrets.encoding_of("aB3-") == "base64url" and secrets.encoding_of("aB3") == "base62"
    assert secrets.encoding_of("1234") is None and secrets.encoding_of("abc-def") is None and secrets.encoding_of("aB-/1") is None


def test_glued_keys_are_found(spark, corpus):
    """A key in a path or behind a name is found, by itself or with the run that one alphabet holds; prose around it is not."""
    keys = ["".join(RNG.choice(ALNUM) for _ in range(44)) for _ in range(30)]
    frames = ["https://hooks.example.com/services/T00-x/{}", "see my_app/{} now", "a-b+c/{}/x_y", "the_{}-end"]
    rows = [(40_000 + i, frames[i % 4].format(k)) for i, k in enumerate(keys)]
    both = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    found = {r["doc_id"]: r for r in secrets.find_secrets(both).filter("doc_id >= 40000").collect()}
    spans = [[found[40_000 + i]["text"][s["start"] : s["end"]] for s in found[40_000 + i]["secrets"]] for i in range(len(keys))]
    assert np.mean([any(k in s for s in own) for k, own in zip(keys, spans, strict=True)]) >= 0.95
    assert np.mean([k in own for i, (k, own) in enumerate(zip(keys, spans, strict=True)) if i % 4 != 3]) >= 0.95
    assert not any(" " in s or "example" in s for own in spans for s in own)


def plain_random_spans(texts):
    """The battery and the false-discovery step, one candidate after the other."""
    pairs = np.zeros((128, 128), np.int64)
    for t in texts:
        data = (t or "").encode()
        for a, b in zip(data, data[1:], strict=False):
            if a < 128 and b < 128:
                pairs[a, b] += 1
    battery = secrets.Battery(pairs)
    tested = []
    for k, t in enumerate(texts):
        for a, b, s, encoding, place in secrets.candidates(t or "", secrets.base_spans(t or "")):
            random, ordinary = battery.test(s, encoding)
            tested.append((k, place, a, b, random, 10.0 ** (-secrets.STEP * secrets._step_of(ordinary)), max(c for c, n in enumerate(secrets.LENGTHS) if len(s) >= n)))
    cut = {}
    for c in range(len(secrets.LENGTHS)):
        p = sorted(x[5] for x in tested if x[6] == c)
        good = [q for n, q in enumerate(p, 1) if q * len(p) <= secrets.FALSE_SHARE * n]
        cut[c] = max(good, default=-1.0)
    out, whole = [[] for _ in texts], set()
    for k, place, a, b, random, p, c in tested:
        if (k, place) not in whole and random >= secrets.PLAUSIBLE and p <= cut[c] * (1 + 1e-9):
            out[k].append((a, b))
            if secrets.SEPARATOR.search(texts[k][a:b]):
                whole.add((k, place))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_spans_equal_the_plain_battery_in_any_layout(spark, small, partitions):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    texts += [f"x {s} y" for s in RANDOM[:60]] + [f"see {s}" for s in ORDINARY] + [f"a/b-{s}" for s in RANDOM[40:50]] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(partitions)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "random"] for r in secrets.find_secrets(df).collect()}
    assert [found[k] for k in range(len(texts))] == [sorted(x) for x in plain_random_spans(texts)]
    assert sum(map(len, found.values())) > 50


def test_very_long_text(spark):
    key = "".join(RNG.choice(ALNUM) for _ in range(64))
    text = "plain words and more of them " * 60_000 + f"token={'ab12' * 5} {key} " + "the end " * 1000
    df = spark.createDataFrame([(1, text), (2, "words")], "doc_id LONG, text STRING")
    (found,) = [r["secrets"] for r in secrets.find_secrets(df).filter("doc_id = 1").collect()]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in found] == [("assign", f"token={'ab12' * 5}"), ("random", key)]
