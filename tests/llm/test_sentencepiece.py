import os
import struct
import uuid
import zlib
from array import array
from types import SimpleNamespace

import pyarrow as pa
import pytest

from glenfare.llm import sentencepiece_codec as C
from helpers import SF, as_rows, documents, edge_docs, empty_docs

sentencepiece = pytest.importorskip("sentencepiece")
DATA = open(C.default_model(), "rb").read()
TEXTS = ["", " ", "  two  spaces ", "a▁b", "日本語 テスト\n\nnew\tline", "é 🙂 <s> </s> <unk> <0x0A>", "x" * 3000, "trailing ", "A.B,c"]


def length(value):
    out = b""
    while value >= 0x80:
        out, value = out + bytes([value & 0x7F | 0x80]), value >> 7
    return out + bytes([value])


def field(number, value):
    if isinstance(value, int):
        return length(number << 3) + length(value)
    return length(number << 3 | 2) + length(len(value)) + value


def unigram_model(byte_fallback=True):
    """A hand-made unigram model: pieces and scores are given, nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    words = {"▁": -3.0, "▁the": -2.0, "▁th": -4.0, "e": -5.0, "t": -5.1, "h": -5.2, "▁a": -3.5, "n": -5.3, "an": -4.2, "▁an": -3.1,
             "o": -5.5, "on": -4.1, "s": -5.0, "a": -5.05, "the": -4.4, "é": -6.0, ".": -4.0}
    pieces += [(p, s, 1) for p, s in words.items()]
    data = b"".join(field(1, field(1, p.encode()) + length(2 << 3 | 5) + struct.pack("<f", s) + field(3, t)) for p, s, t in pieces)
    trainer = field(3, 1) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2)
    return data + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))


@pytest.mark.parametrize("data", [DATA, unigram_model()], ids=["bpe", "unigram"])
def test_parity_and_round_trip(data, spark):
    own, peer = C.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = TEXTS + [(r["text"] or "")[:3000] for r in documents(spark).limit(80).collect()] + ["the antone on a thé. zoo"]
    ids, parity, trip = own.encode(texts)
    exp = peer.encode(texts)
    assert [array("i", x).tobytes() for x in exp] == ids and all(parity) and all(trip)
    assert own.decode(exp) == peer.decode(exp)
    if own.model.model_type == C.BPE:
        assert [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)] == exp


def test_parsed_fields():
    m = C.Model.parse(unigram_model())
    assert (m.model_type, m.byte_fallback, m.dummy_prefix, m.remove_extra_spaces) == (C.UNIGRAM, True, True, True)
    assert m.unknown() == 0 and m.chunked() and m.pieces[3] == ("<0x00>", 0.0, C.BYTE)
    b = C.Model.parse(DATA)
    assert (b.model_type, len(b.pieces)) == (C.BPE, 32000)


def test_failed_checks_are_told(monkeypatch):
    own = C.Codec(DATA)
    monkeypatch.setattr(own, "peer_ids", lambda chunks: [[1] if "odd" in c else e.ids for c, e in zip(
        chunks, own.by_chunk.encode_batch(chunks, add_special_tokens=False))])
    _, parity, trip = own.encode(["fine text", "an odd one", "odd"])
    assert parity == [True, False, False] and trip == [True] * 3


def test_query_and_edges(spark):
    peer = sentencepiece.SentencePieceProcessor(model_proto=DATA)

    def brute(docs):
        return sorted([(r["doc_id"], n := len(i := peer.encode(r["text"] or "")), zlib.crc32(array("i", i).tobytes()), True, True, i)
                       for r in docs.collect()], key=repr)
    cols = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip", "ids"]
    assert as_rows(C.op1_sentencepiece(spark, SF), *cols) == brute(documents(spark))
    docs = edge_docs(spark)
    out = C.encode(docs, C.default_model())
    assert as_rows(out, *cols) == brute(docs)
    back = as_rows(C.decode(out, C.default_model()), "doc_id", "text")
    assert back == as_rows(docs.fillna({"text": ""}), "doc_id", "text")
    assert C.encode(empty_docs(spark), C.default_model()).count() == 0


def test_one_codec_a_worker(spark, tmp_path, monkeypatch):
    class Told(C.Codec):
        def __init__(self, data):
            super().__init__(data)
            (tmp_path / uuid.uuid4().hex).write_text(str(os.getpid()))

    monkeypatch.setattr(C, "Codec", Told)
    tasks = 2 * spark.sparkContext.defaultParallelism + 1
    docs = spark.range(0, 4 * tasks, numPartitions=tasks).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert all(r["ids"] for r in C.encode(docs, C.default_model()).collect())
    workers = [p.read_text() for p in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))


def test_work_at_once_is_bounded(monkeypatch):
    for name, value in (("SLICE", 3), ("SLICE_BYTES", 10), ("LEARN", 2)):
        monkeypatch.setattr(C, name, value)
    assert list(C.spans([])) == []
    assert list(C.spans([4, 4, 4, 0, 0, 0, 99, 1])) == [(0, 2), (2, 5), (5, 6), (6, 7), (7, 8)]
    own, texts, learnt = C.Codec(DATA), ["a b", None, "c d e f g h i j", "", "k", "é" * 6, "l", "m", None, "n"], []
    learn, encode, seen = own.learn, own.encode, []
    monkeypatch.setattr(own, "learn", lambda new: (learnt.append(len(new)), learn(new)))
    monkeypatch.setattr(own, "encode", lambda part: (seen.append(part), encode(part))[1])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    out = pa.Table.from_batches(C.encode_rows(iter([batch]), SimpleNamespace(value={"codec": own})))
    assert out.column("doc_id").to_pylist() == list(range(len(texts)))
    assert out.column("ids").to_pylist() == [own.peer.encode(t or "") for t in texts]
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t.encode()) for t in p) <= 10) for p in seen) and max(learnt) == 2
