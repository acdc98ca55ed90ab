import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from glenfare.llm import exact_dedup as D
from helpers import SF, as_rows, documents, edge_docs, empty_docs

COLS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    out = []
    for r in rows:
        g = groups[norm(r["text"])]
        keep = min((x for x in g if x is not None), default=None)
        out.append((r["doc_id"], keep, len(g), r["doc_id"] == keep, hashlib.sha256(norm(r["text"]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_matches_brute_force(spark):
    got = as_rows(D.op2_exact_dedup(spark, SF), *COLS)
    assert got == brute(documents(spark).collect())


def test_edges_and_many_batches(spark):
    docs = edge_docs(spark)
    got = as_rows(D.exact_groups(docs, batch_bytes=1), *COLS)  # one file in each micro-batch
    assert got == brute(docs.select("doc_id", "text").collect())
    assert D.exact_groups(empty_docs(spark)).count() == 0


def test_collisions_are_settled_by_the_bytes(spark):
    docs = edge_docs(spark)
    weak = lambda norm: F.length(norm) % 2
    got = as_rows(D.exact_groups(docs, digest=weak, salt_rows=2), *COLS)
    assert got == brute(docs.select("doc_id", "text").collect())


def test_stage_keeps_one_row_of_each_text(spark):
    docs = edge_docs(spark)
    out = D.kept_documents(docs)
    assert out.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
    every = {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()}
    assert sorted(norm) == sorted(every)
