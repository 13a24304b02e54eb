"""From raw documents to tokens, in stages that are each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before
kept.  All but the last return the columns of ``documents``, and any others that
``docs`` has, as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mirrorframe.llm import languages, near, secrets, suffixes
from mirrorframe.llm.frames import shared_folder
from mirrorframe.llm.queries import token_digests


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no mixture of learned languages explains go; languages are learned from four fifths of the labelled rows."""
    return languages.keep_explained(docs, *languages.count_cells(docs, ~languages.held_out()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays."""
    return near.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any ``benchmark`` item go."""
    return suffixes.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts, and ``n_chars`` says the new length; no document goes."""
    return secrets.redact(docs, length="n_chars")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of every text, their number and digest, and the digest of the bytes they decode to."""
    return token_digests(docs, keep_ids=True)


STAGES = [
    ("language", identify_language),
    ("near-copies", drop_near_copies),
    ("benchmark", remove_benchmark),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]
#: Mixture inference and the randomness battery can't be written in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage's result is written to the shared folder and reread."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
