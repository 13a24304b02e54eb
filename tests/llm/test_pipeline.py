import math

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from mirrorframe.llm import bpe, languages, secrets
from tests.llm import brute

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-copies", "benchmark", "secrets", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns[:5] == spark.read.parquet(f"{small}/documents.parquet").columns
    got = {r["doc_id"]: r for r in rows.collect()}

    table = spark.read.parquet(f"{small}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    names, counts = languages.count_cells(table, ~languages.held_out())
    log_p, least = languages.model_of(names, counts)[1], languages.least_likelihoods(counts)

    def explained(text):
        cells, rows = languages.trigrams(pa.array([text]))
        (share,) = languages.infer(cells, rows, 1, log_p)
        each = [math.log(sum(s * math.exp(p) for s, p in zip(share, log_p[:, c], strict=True))) for c in cells.tolist()]
        return any(c.isalpha() for c in text) and sum(each) / max(1, len(each)) >= share @ least

    before, docs = len(docs), [d for d in docs if explained(d[1])]
    assert 0.9 * before < len(docs)
    lead = brute.classes(docs)
    docs = [d for d in docs if lead[d[0]][1] == d[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [d for d in docs if not brute.contamination(d[1], items)[1]]
    assert set(got) == {k for k, _ in docs}
    for k, text in docs:
        text = secrets.mask(text, [(a, b) for _, a, b in brute.base_spans(text)], "[SECRET]")
        ids = ENCODING.encode_ordinary(text)
        assert got[k]["text"] == text and got[k]["n_chars"] == len(text)
        assert got[k]["token_ids"] == ids and got[k]["ids_sha256"] == brute.sha(" ".join(map(str, ids))) and got[k]["decoded_sha256"] == brute.sha(text)


def test_stages_on_odd_tables(spark, small):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables pass every stage."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    extra = {c: F.lit("x") for c in ("score", "node", "matches", "secrets", "_1", "n_words", "a.b", "key")}
    some = table.limit(30)
    nulls = table.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
    odd = some.unionByName(some).unionByName(nulls).unionByName(some.limit(2).withColumn("text", F.lit(""))).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, small)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        if name == "near-copies":
            assert out.filter("length(text) > 0").groupBy("doc_id").count().filter("count > 1").isEmpty()
        out.write.format("noop").mode("overwrite").save()
        assert stage(spark, odd.limit(0), small).count() == 0, name
