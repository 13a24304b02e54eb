"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm import bpe, centroids, groups, languages, near, neighbours, phrases, repeats, rollups, secrets, slots, suffixes, urls
from mirrorframe.llm.frames import named, shared_folder

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- op1 -------------------------------------------------------------------------------


@query
def op1_decontamination(spark, sf):
    found = suffixes.find_matches(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), longest.alias("longest_match"),
    )


# -- op2 -------------------------------------------------------------------------------


def vocabulary():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def token_digests(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Rows with the number and digest of the token ids of their text, and the digest of what these decode to.

    Columns of the new names (also ``token_ids`` and ``decoded``) are replaced.
    """
    ranks, pattern = vocabulary()
    new = [*["token_ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() not in {*new, "token_ids", "decoded"}])
    coded = bpe.round_trip(docs, ranks, pattern).withColumns({
        "n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256), "decoded_sha256": F.sha2("decoded", 256),
    })
    return coded.select(*[named(c) for c in docs.columns], *new)


@query
def op2_byte_bpe(spark, sf):
    return token_digests(read(spark, sf, "documents").select("doc_id", "text")).drop("text")


# -- op3 -------------------------------------------------------------------------------


@query
def op3_learned_partitions(spark, sf):
    return neighbours.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


# -- op4 -------------------------------------------------------------------------------


@query
def op4_secret_scan(spark, sf):
    found = secrets.find_secrets(read(spark, sf, "documents").select("doc_id", "text"))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    counts = [number(kind) for kind in secrets.KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"), counts[3])


# -- op5 -------------------------------------------------------------------------------


@query
def op5_minhash_dedup(spark, sf):
    return near.near_duplicates(read(spark, sf, "documents"))


# -- op6 -------------------------------------------------------------------------------


@query
def op6_anchored_repeats(spark, sf):
    cut = repeats.cut_repeats(read(spark, sf, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


# -- op7 -------------------------------------------------------------------------------


@query
def op7_language_mixture(spark, sf):
    docs = read(spark, sf, "documents")
    model = languages.learn(docs, ~languages.held_out())
    texts = docs.select("doc_id", "text", languages.held_out().alias("held_out"))
    return languages.predict(texts, model).select("doc_id", "held_out", "lang_pred", "score", F.size("lang_mix").alias("n_langs"))


# -- op8 -------------------------------------------------------------------------------

#: The given host and path rules, and patterns of pages without prose for the other URLs.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
PAGE_PATTERNS = [(r"/wp-login\.php$", ["wp", "login", "php"]), (r"/cart/checkout(/|$)", ["cart", "checkout"]), (r"^ads?\.[^/]*/click/", ["click"])]


@query
def op8_url_filters(spark, sf):
    rules = [urls.host_path_rule(r, v) for r, v in HOST_RULES] + [urls.pattern_rule(p, "block", t) for p, t in PAGE_PATTERNS]
    judged = urls.filter_urls(read(spark, sf, "pages").select("page_id", "url"), urls.rule_table(spark, rules))
    return judged.select("page_id", "host", "path", "rule", "verdict")


# -- op9 -------------------------------------------------------------------------------

SHARDS = 16


@query
def op9_virtual_slots(spark, sf):
    folder = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    first = slots.initial_map(spark, SHARDS)
    slots.store_map(first.unionByName(slots.grow(first)), folder)
    placed = slots.place(read(spark, sf, "documents"), slots.load_map(spark, folder, 1), slots.load_map(spark, folder, 2))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot")


# -- op10 ------------------------------------------------------------------------------

SHORT = 50


@query
def op10_token_rollups(spark, sf):
    """Three batches: all documents come; those under 50 words go; the rest of source src0 is recounted by the next tokenizer version.

    The first two are committed twice, as after a restart.
    """
    docs = read(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    folder = f"{shared_folder(spark)}/token-totals-{uuid.uuid4().hex}"
    words = rollups.counted(docs, "words-1")
    short = words.filter(F.col("n_tokens") < SHORT)
    hot = docs.filter(F.col("source") == "src0")
    old = rollups.counted(hot, "words-1").filter(F.col("n_tokens") >= SHORT)
    new = rollups.counted(hot.filter(rollups.count_tokens(F.col("text"), "words-1") >= SHORT), "words-2")
    for _ in range(2):
        rollups.commit(rollups.inserts(words), folder, "first")
        rollups.commit(rollups.deletes(short), folder, "short-ones-go")
    rollups.commit(rollups.revisions(old, new), folder, "recount-src0")
    return rollups.read_totals(spark, folder)


# -- op11 ------------------------------------------------------------------------------


@query
def op11_pivot_clusters(spark, sf):
    return centroids.summarize(*centroids.cluster_vectors(read(spark, sf, "embeddings")))


# -- op12 ------------------------------------------------------------------------------


@query
def op12_token_groups(spark, sf):
    return groups.jaccard_classes(read(spark, sf, "documents"))


# -- op13 ------------------------------------------------------------------------------


@query
def op13_phrase_mining(spark, sf):
    return phrases.collocations(read(spark, sf, "documents"))
