"""Fixtures of the operator tests: small tables with every edge case."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

STOP = {"en": "the of and to in is that it for with this was", "fr": "le la de et les un une que pour est dans qui"}


def prose(rnd, lang="en", n=80):
    words = STOP[lang].split()
    syllables = {"en": "th er on an re he in ed nd ha", "fr": "eau é tion ment ou oi re elle ch è"}[lang].split()
    out = [rnd.choice(words) if rnd.random() < 0.4 else "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
           for _ in range(n)]
    return " ".join(out) + "."


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, repeated and null ids."""
    rnd = random.Random(5)
    a, b, c = prose(rnd), prose(rnd, "fr"), prose(rnd)
    long = " ".join(prose(rnd, n=200) for _ in range(150))
    rows = [(1, a, "en", "s1"), (2, a, "en", "s1"), (3, a.replace(" ", " \t\n", 3), "en", None), (4, b, "fr", "s2"),
            (4, b, "fr", "s2"), (5, None, None, None), (6, "", "en", "s1"), (7, " \n\t ", "en", "s1"),
            (None, c, "en", "s2"), (None, c, "en", "s2"), (8, c, None, "s2"), (9, long, "en", "s1"),
            (10, "x", "en", "s1"), (10, b, "fr", "s1"), (11, "123 !!! ²", "en", "s1"), (12, "日本語 テスト", None, "s3"),
            (None, None, None, None), (13, c[:-1] + " or.", "en", "s2")]
    return [(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in rows]


def clashing(df):
    """``df`` with further columns named like inner columns of the operators."""
    from pyspark.sql import functions as F
    names = ["digest", "norm", "keep_id", "n_rows", "kept", "fp", "label", "shard", "slot", "row", "blocks", "text_key",
             "n_words", "_n", "_w", "group", "task", "ids", "held_out", "accepted", "g_word_len", "first", "batch_id",
             "host", "path", "rule", "short", "component_id", "_own_id", "_key_id"]
    return df.select("*", *[F.lit(f"clash {n}").alias(n) for n in names])


def edge_docs(spark):
    return clashing(spark.createDataFrame(edge_rows(), DOCS)).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def as_rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)
