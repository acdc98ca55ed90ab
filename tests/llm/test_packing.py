import zlib
from array import array
from collections import defaultdict

import pytest

from glenfare.llm import packing as P
from helpers import SF, documents, edge_docs, empty_docs

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tok():
    return tokenizers.Tokenizer.from_file(P.default_tokenizer())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [2]


def check(pieces, docs, tok, window):
    """Every id of every document in one piece; sequences gapless, padding free. docs: [(doc_id, text)]"""
    want = defaultdict(int)  # pieces laid end to end give the documents
    for i, t in docs:
        want[i, tuple(ids_of(tok, t))] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for (i, ids), n in want.items():
        rows = by_doc[i, len(ids)]
        same = [k for k in want if k[0] == i and len(k[1]) == len(ids)]
        assert sum(r["length"] for r in rows) == len(ids) * sum(want[k] for k in same)
        for r in rows:
            cuts = {zlib.crc32(array("I", k[1][r["start"]:r["start"] + r["length"]]).tobytes()) for k in same}
            assert r["ids_crc32"] in cuts
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_query_packs_without_padding(spark, tok):
    check(P.op4_packing(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in documents(spark).collect()], tok, P.WINDOW)


@pytest.mark.parametrize("window,n_open,fan_in", [(64, 2, 2), (256, 8, 16)])
def test_edges_and_merging(spark, tok, window, n_open, fan_in):
    docs = edge_docs(spark).repartition(7, "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = P.pack(docs, P.default_tokenizer(), window, n_open, fan_in).collect()
    check(pieces, rows, tok, window)
    assert P.pack(empty_docs(spark), P.default_tokenizer()).count() == 0


def test_open_windows_are_bounded():
    p = P.Packer(0, 100, 5)
    for k in range(500):
        p.add(k, 0, 37 + k % 60, bytes(4 * (37 + k % 60)))
        assert len(p.open) <= 5
    emitted = defaultdict(int)
    for r in p.rows:
        emitted[r[5]] += r[2]
    assert set(emitted.values()) == {100}


TEXTS = ["", " ", "Hello, World!! it's 42 o'clock", "a<|endoftext|>b <|endoftext|>", "Éçeau aianre ß Ǆ ﬁ x² ½", "é äb",
         "ΑΣ ΣΑΣ.", "日本語 テスト。", "a\x1cb\x85c\xa0d e​f", "İstanbul I", "_a_b__ 1_000", "don't we'll 's", "A\x00B", "🙂🙂 ok"]


def test_chunks_give_the_same_ids(tok, spark):
    enc = P.ChunkEncoder(open(P.default_tokenizer(), "rb").read())
    texts = TEXTS + [r["text"] or "" for r in documents(spark).collect()]
    for t, got in zip(texts, enc.encode(texts)):
        assert got == array("I", tok.encode(t, add_special_tokens=False).ids).tobytes(), t[:80]
