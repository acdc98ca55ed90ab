"""URL filters (operator 8): host-suffix / path-prefix expressions against a
rule list.

Each distinct (host, path) expands into expressions ``suffix + path prefix``:
every suffix of the host's labels, and every prefix of the path whose length
some rule path has.  Expressions meet the rules in an equi-join on the first
``PREFIX_HEX`` hex digits of their SHA-256; survivors are confirmed on the full
digest, and the longest rule wins (equally long: block before allow).

Hot hosts: URLs are reduced to distinct (host, path) pairs before expansion,
and the rule side, known by the number of rules, is small or joined by shuffle
as Spark sees fit; nothing is hinted.

Edge cases: a null URL or one without ``://`` has an empty host and path and
matches nothing; no rule gives ``allow`` with a null rule; an empty table or an
empty rule list work alike; repeated rows each get their answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import table

#: Hex digits of the short hash: 8 are 4 bytes.
PREFIX_HEX = 8
#: The rules of the contract (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), AZ, LOWER_AZ)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, verdict, path_chars, digest, short) of the rules; the host is
    compared in lower case and without an outer dot."""
    return (spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
            .withColumn("rule_host", F.translate("rule_host", AZ, LOWER_AZ))
            .select(F.concat("rule_host", "rule_path").alias("rule"), "verdict",
                    F.length("rule_path").alias("path_chars"), F.size(F.split("rule_host", r"\.")).alias("host_labels"),
                    F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"))
            .dropDuplicates(["rule_digest", "verdict"])
            .withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX)))


def expressions(urls: DataFrame, path_lengths: list[int], host_labels: list[int]) -> DataFrame:
    """(host, path, digest, short) for every expression of the distinct pairs that some rule could be:
    suffixes of as many labels, prefixes of as many characters, as a rule has."""
    labels = F.col("labels")
    suffixes = F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in host_labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in path_lengths])
    return (urls.select("host", "path").distinct()
            .withColumn("prefix", F.explode(F.array_compact(prefixes)))
            .withColumn("labels", F.split("host", r"\."))
            .withColumn("suffix", F.explode(F.array_compact(suffixes)))
            .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
            .select("host", "path", "digest", F.substring("digest", 1, PREFIX_HEX).alias("short")))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(host, path) pairs that a rule fits, with the winning rule and verdict."""
    # one row for each distinct length of a rule's path and number of its host's labels: at most as long as a URL
    sizes = rules.select("path_chars", "host_labels").distinct().collect()
    lengths, host_labels = (sorted({r[k] for r in sizes}) for k in (0, 1))
    if not lengths:
        return urls.select("host", "path").distinct().limit(0).withColumns(
            {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    hits = (expressions(urls, lengths, host_labels).join(rules, "short").filter(F.col("digest") == F.col("rule_digest")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict"))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    u = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return (u.join(judge(u, rules, default), ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark))


QUERIES = {"op8_url_filter": op8_url_filter}


def _fits(host: str, path: str) -> str:
    return f"(u.host = '{host}' OR u.host LIKE '%.{host}') AND starts_with(u.path, '{path}')"


_RULES_SQL = " UNION ALL ".join(
    f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS verdict FROM u WHERE {_fits(h, p)}" for v, h, p in RULES)
SQL = {"op8_url_filter": rf"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{AZ}', '{LOWER_AZ}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS ({_RULES_SQL}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
         FROM fit GROUP BY page_id)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (page_id)"""}
