"""The corpus pipeline: quality rules, language ID, exact dedup, SimHash
near-dedup and packing, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the rows of
``docs`` that stay, with the columns of ``docs``, or for packing one row for
each piece of a packed sequence.  A row is known by doc_id and a hash of its text, so rows
with repeated or null ids are judged one by one; each operator's module says what
it does with nulls, empty texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glenfare.llm import exact_dedup, language_id, packing, quality_rules, simhash
from glenfare.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the adaptive rules reject go."""
    return quality_rules.kept_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that are in none of the learned languages go."""
    return language_id.kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts one stays."""
    return exact_dedup.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of linked fingerprints one document stays."""
    return simhash.kept_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of the packed sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality_rules", quality), ("language_id", language), ("exact_dedup", dedup),
          ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: Language models, fingerprints and token ids have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out, f"pipeline-{name}") if k < len(STAGES) - 1 else out
    return docs
