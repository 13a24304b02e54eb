"""Token counts kept up to date by signed deltas.

Totals by source, language and tokenizer version are additive, so a batch of
changes needs no recount: an insert adds its counts, a delete subtracts them, a
revision subtracts the old and adds the new.  A batch is committed as the small
table of its signed totals in a folder named by its id.  A folder counts once it has
the mark that Spark leaves when all files are written; a batch that has one is not
written again, so a repeated or restarted commit counts once, and no reader sees half of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer versions by name: what counts as one token.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"}
KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_bytes"]
COMMIT_SCHEMA = "source STRING, lang STRING, tokenizer STRING, n_docs LONG, n_tokens LONG, n_bytes LONG"


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def counted(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts for each document: (key, source, lang, tokenizer, n_tokens, n_bytes)."""
    return docs.select(
        F.col(key).alias("key"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), count_tokens(F.col(text), tokenizer).alias("n_tokens"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Counted rows as a change: +1 for what is added, -1 for what goes."""
    n = F.lit(sign).cast("long")
    return rows.select(*KEYS, n.alias("n_docs"), (n * F.col("n_tokens")).alias("n_tokens"), (n * F.col("n_bytes")).alias("n_bytes"))


def inserts(rows: DataFrame) -> DataFrame:
    return signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts go, new counts come; they may differ in any key, such as the tokenizer version."""
    return deletes(old).unionByName(inserts(new))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed difference of two counted tables, matched by key: rows that are equal in both cancel without being sent."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*KEYS, "n_tokens", "n_bytes")]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    both = old.alias("o").join(new.alias("n"), F.col("o.key").eqNullSafe(F.col("n.key")), "full_outer").filter(~equal)
    gone = both.filter(F.col("o.tokenizer").isNotNull()).select("o.*")
    come = both.filter(F.col("n.tokenizer").isNotNull()).select("n.*")
    return revisions(gone, come)


def totals(deltas: DataFrame) -> DataFrame:
    """Sum of signed rows by key; keys whose documents have all gone are left out.  A null source or language is a key of its own."""
    summed = deltas.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
    return summed.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0) | (F.col("n_bytes") != 0))


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the batches that are written to the end; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path) if f.isDirectory()]
    return [p.toString() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def commit(deltas: DataFrame, folder: str, batch: str) -> None:
    """Write a batch's signed totals to its own folder; a batch that is complete is left as it is, and its rows aren't read."""
    if not batch.replace("-", "").isalnum():
        raise ValueError(f"a batch id has letters, digits and '-': {batch!r}")
    if any(done.endswith(f"/batch={batch}") for done in _complete(deltas.sparkSession, folder)):
        return
    summed = deltas.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
    summed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over all complete batches; without any, no rows."""
    done = _complete(spark, folder)
    return totals(spark.read.schema(COMMIT_SCHEMA).parquet(*done) if done else spark.createDataFrame([], COMMIT_SCHEMA))
