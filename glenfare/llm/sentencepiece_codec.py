"""SentencePiece encoding and decoding (operator 1), by the tokenizers library.

A SentencePiece model file is parsed field by field, and its parts are rebuilt:
the normaliser (character map, white space, dummy prefix), the metaspace marker,
the pieces with their scores (a unigram model, or the merges that the scores of a
BPE model stand for) and byte fallback.

No piece runs over the start of a metaspace run (this is checked when the model is built),
so a text's ids are those of its chunks, each a run of markers and what follows.
Distinct chunks are encoded in batches, and each one is proven on the
spot: against the sentencepiece library (parity) and by decoding it (round trip).
A worker process keeps one codec for all tasks of a job, and takes on a bounded
number of texts, bytes and new chunks at once.

Edge cases: null and empty text have no ids and pass both checks; a text without
spaces is one chunk, however long; repeated rows each get their answer; a null doc_id
is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, small_batches, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Distinct chunks that a worker remembers; texts it encodes at once, their bytes (a longer text goes alone), and new chunks.
CACHE_CHUNKS, SLICE, SLICE_BYTES, LEARN = 300_000, 250, 1 << 20, 4096

#: Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


# ---- the model file ------------------------------------------------------------------------

def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind == 2:
                size, at = varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""
    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> "Model":
        m = cls([])
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0],
                                 piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                m.model_type, m.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
                if trainer.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                n = dict(fields(value))
                m.charsmap = n.get(2, b"")
                m.dummy_prefix, m.remove_extra_spaces, m.escape_spaces = (bool(n.get(k, 1)) for k in (3, 4, 5))
        return m

    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """The merges a BPE model's scores stand for: each way to make a piece of two, best scores first."""
        usable = {p for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED)}
        made = sorted(((s, i, p) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL and len(p) > 1),
                      key=lambda x: (-x[0], x[1]))
        return [(p[:k], p[k:]) for _, _, p in made for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]

    def chunked(self) -> bool:
        """No piece has a marker after another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED))


# ---- the rebuilt tokenizer -------------------------------------------------------------------

def normalizer(m: Model):
    from tokenizers import Regex, normalizers as N
    steps = [N.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_spaces:
        steps += [N.Replace(Regex("^ +| +$"), ""), N.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(N.Prepend(" "))
    if m.escape_spaces:
        steps.append(N.Replace(" ", MARK))
    return N.Sequence(steps)


def build(m: Model, text_only: bool = False):
    """A tokenizers.Tokenizer with the model's behaviour.  ``text_only``: pieces that
    never stand for text as written (control, byte and unused ones) get names that no
    normal form contains, which a unigram model would else find in a text."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders as D, models, pre_tokenizers
    unknown = m.unknown()
    if m.model_type == UNIGRAM:
        hidden = [text_only and t not in (NORMAL, USER_DEFINED) for _, _, t in m.pieces]
        model = models.Unigram([(f" {i}", 0.0) if h else (p, s) for i, ((p, s, _), h) in enumerate(zip(m.pieces, hidden))],
                               unk_id=unknown, byte_fallback=m.byte_fallback and not text_only)
    elif m.model_type == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, m.merges(),
                           unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} is not supported")
    t = Tokenizer(model)
    t.normalizer = normalizer(m)
    if m.chunked():
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    steps = [D.Replace(MARK, " "), D.ByteFallback(), D.Fuse()]
    t.decoder = D.Sequence(steps + ([D.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    own = [AddedToken(p, normalized=True, special=False) for p, _, k in m.pieces if k == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


class Codec:
    """Encodes and decodes texts; ``verify`` compares with the sentencepiece library."""

    def __init__(self, data: bytes, verify: bool = True):
        from tokenizers import normalizers as N, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only take more memory
        self.model = Model.parse(data)
        self.by_chunk = build(self.model, text_only=True)  # for single chunks of normal form
        self.by_chunk.normalizer = N.Sequence([])
        self.by_chunk.pre_tokenizer = pre_tokenizers.Sequence([])
        self.unknown = self.model.unknown()
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.model.pieces) if t == BYTE}
        self.whole = not self.model.chunked()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (UNKNOWN, CONTROL) else p.encode()
                         for p, _, t in self.model.pieces]
        self.peer = None
        if verify:
            import sentencepiece
            self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known: dict[str, bytes] = {}
        #: Known chunks that fail: not as the other library has it, or not restored by decoding.
        self.unlike: set[str] = set()
        self.unrestored: set[str] = set()

    @cached_property
    def tokenizer(self):
        """For whole texts: decoding and character maps need it."""
        return build(self.model)

    def normal(self, text: str) -> str:
        m = self.model
        if m.charsmap:
            return self.tokenizer.normalizer.normalize_str(text)
        if m.remove_extra_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if text and m.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape_spaces else text

    def chunks(self, text: str) -> list[str]:
        s = self.normal(text)
        return ([s] if s else []) if self.whole else CHUNK.findall(s)

    def peer_ids(self, chunks: list[str]) -> list[list[int]]:
        """What the sentencepiece library makes of chunks, given as the texts they come from.  A lone
        marker is its own piece: no text consists of the dummy prefix alone."""
        texts = [c[self.model.dummy_prefix:].replace(MARK, " ") for c in chunks]
        ids = self.peer.encode(texts, num_threads=1)
        return [i if t else [self.peer.piece_to_id(c)] for i, t, c in zip(ids, texts, chunks)]

    def with_bytes(self, chunk: str, encoding) -> list[int]:
        """The ids of an encoding, unknown characters as the ids of their bytes."""
        return [k for i, (lo, hi) in zip(encoding.ids, encoding.offsets) for k in (
            [self.byte_ids[b] for b in chunk[lo:hi].encode()] if i == self.unknown else [i])]

    def learn(self, new: list[str]) -> None:
        """Encode chunks, and prove each."""
        fallback = self.model.byte_fallback and self.model.model_type == UNIGRAM
        encode = self.by_chunk.encode_batch if fallback else self.by_chunk.encode_batch_fast
        ids = [self.with_bytes(c, e) if fallback and self.unknown in e.ids else e.ids
               for c, e in zip(new, encode(new, add_special_tokens=False))]
        for c, i, p in zip(new, ids, self.peer_ids(new) if self.peer else ids):
            self.known[c] = array("i", i).tobytes()
            if i != p:
                self.unlike.add(c)
            if b"".join([self.bytes_of[k] for k in i]) != c.encode():
                self.unrestored.add(c)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """For each text its ids (little-endian 32-bit), parity and round trip."""
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            for cache in (self.known, self.unlike, self.unrestored):
                cache.clear()
        new = list({c for chunks in cut for c in chunks}.difference(self.known))
        for lo in range(0, len(new), LEARN):
            self.learn(new[lo:lo + LEARN])
        get = self.known.__getitem__
        return ([b"".join(map(get, chunks)) for chunks in cut], [self.unlike.isdisjoint(chunks) for chunks in cut],
                [self.unrestored.isdisjoint(chunks) for chunks in cut])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def codec(held: dict) -> Codec:
    """The codec of a worker process, kept in its copy of the broadcast value, which outlives a
    task.  Globals of this module do not: it is shipped by value, so each task has its own."""
    if "codec" not in held:
        held["codec"] = Codec(held["file"])
    return held["codec"]


# ---- on tables -------------------------------------------------------------------------------

ENCODED = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean, ids array<int>"


def spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of at most SLICE texts and SLICE_BYTES bytes, or of one text."""
    lo = total = 0
    for k, size in enumerate(sizes):
        if k > lo and (k - lo == SLICE or total + size > SLICE_BYTES):
            yield lo, k
            lo, total = k, 0
        total += size
    if sizes:
        yield lo, len(sizes)


def encode_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = codec(model.value)
    for b in batches:
        for lo, hi in spans(pc.binary_length(b.column("text")).fill_null(0).to_pylist()):
            part = b.slice(lo, hi - lo)
            ids, parity, trip = own.encode([t or "" for t in part.column("text").to_pylist()])
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_tokens": pa.array(n),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "parity": pa.array(parity, pa.bool_()),
                "round_trip": pa.array(trip, pa.bool_()),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))})


def decode_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = codec(model.value)
    for b in batches:
        texts = own.decode([i or [] for i in b.column("ids").to_pylist()])
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})


def model_file(spark: SparkSession, path: str):
    """The model's bytes for the executors: one vocabulary, of a size its file bounds.  See ``codec``."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({"file": f.read()})


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip and ids of every row."""
    ship(__name__)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(encode_rows, model=model_file(docs.sparkSession, path)), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""
    ship(__name__)
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(decode_rows, model=model_file(encoded.sparkSession, path)), "doc_id bigint, text string")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
