"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over a URL's ``host + path``.  Its literal tokens
are strings that every URL it fits must hold as whole tokens.  Each rule is filed
under the one of them that the fewest URLs hold, so a URL fetches, by its own
tokens, the few rules that can fit, and only these run their expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.frames import named

#: The fewest characters that a rule list must have before it is no longer broadcast.
RULES_TO_BROADCAST = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule STRING, verdict STRING, pattern STRING, tokens ARRAY<STRING>, length INT, base BOOLEAN"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def literal_tokens(text: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9]+", text)


def host_path_rule(rule: str, verdict: str) -> tuple:
    """A rule for a host with all its subdomains and the paths that start with its path.

    The host's labels are whole tokens of any URL it fits; the path's last token may be cut, so it counts only before a closing '/'.
    """
    host, _, path = rule.partition("/")
    path = f"/{path}"
    closed = path[: path.rfind("/") + 1]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return rule, verdict, pattern, literal_tokens(host) + literal_tokens(closed), len(rule), True


def pattern_rule(pattern: str, verdict: str, tokens: list[str]) -> tuple:
    """A free regular expression with the literal tokens that it can't match without."""
    return pattern, verdict, pattern, tokens, len(pattern), False


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules given in code; a longer list is read from a table of this schema."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for each distinct URL: (url, host, path, rule, verdict).

    Among the base rules that fit, the longest wins (ties: the smaller text) and
    gives ``rule`` and ``verdict``.  Without one, ``rule`` is null and the longest
    pattern rule that fits gives the verdict, else ``default``.  A rule without any
    literal token is tried on every URL.  A null URL is one value; it has empty host
    and path and fits only rules that fit the empty string.
    """
    host, path = split_url(F.col("_url"))
    urls = pages.select(F.col(url).alias("_url")).distinct().select("_url", host.alias("_host"), path.alias("_path"))
    urls = urls.withColumn("_at", F.concat("_host", "_path"))
    tokens = F.array_distinct(F.array_append(F.regexp_extract_all("_at", F.lit("([A-Za-z0-9]+)"), 1), F.lit("")))
    held = urls.select("*", F.explode(tokens).alias("_token"))

    numbered = rules.select(F.xxhash64("rule", "pattern").alias("_id"), "*")
    wanted = numbered.select("_id", F.explode_outer(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("_token"))
    small = rules.limit(RULES_TO_BROADCAST + 1).count() <= RULES_TO_BROADCAST
    near = F.broadcast if small else (lambda df: df)
    counts = held.join(near(wanted.select("_token").distinct()), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = wanted.join(near(counts), "_token", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token"))).alias("_rarest"))
    index = numbered.join(near(rarest), "_id").select(F.col("_rarest.token").alias("_token"), "rule", "verdict", "pattern", "length", "base")

    fits = held.join(near(index), "_token").filter(F.expr("_at rlike pattern"))
    # the largest struct is the winner: base rules first, then the longest, then (by its inverted order) the smaller text
    best = fits.groupBy("_url").agg(F.min(F.struct((~F.col("base")).alias("other"), (-F.col("length")).alias("short"), F.col("rule"), F.col("verdict"))).alias("_best")).withColumnRenamed("_url", "_won")
    joined = urls.join(best, F.col("_url").eqNullSafe(F.col("_won")), "left").select(F.col("_url").alias("url"), F.col("_host").alias("host"), F.col("_path").alias("path"), "_best")
    rule = F.when(~F.col("_best.other"), F.col("_best.rule"))
    return joined.select("url", "host", "path", rule.alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with the host, path, rule and verdict of its URL; columns of these names are replaced."""
    new = ["host", "path", "rule", "verdict"]
    verdicts = judge(pages, rules, url, default).select(F.col("url").alias("_judged"), *[F.col(c).alias(f"_new_{c}") for c in new])
    kept = [c for c in pages.columns if c.lower() not in new]
    joined = pages.join(verdicts, F.col(url).eqNullSafe(F.col("_judged")), "left")
    return joined.select(*[named(c) for c in kept], *[F.col(f"_new_{c}").alias(c) for c in new])
