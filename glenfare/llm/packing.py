"""Packing (operator 4): bounded-space online packing.

Each task tokenises its documents and packs them as they come.  It keeps
``OPEN_WINDOWS`` windows open.  A document gives off whole windows while it has
that many tokens; what is left goes best-fit: into the open window with the
least room that still holds it.  Where none holds it, the fullest window is
topped up from it and emitted, and the rest tries again.  At its end a task
writes its open windows, less than ``OPEN_WINDOWS`` windows of pieces, and these
leftovers are merged in the same way by groups of ``FAN_IN`` tasks, level by level,
until one group holds them; its last windows are cut into sequences whose
lengths are powers of two, which need no padding.

Pieces point into documents, so merging moves only (doc_id, start, length)
rows; a level has a FAN_IN-th of the rows of the one before.

Edge cases: null and empty texts are one end token; a text longer than a
window gives whole windows and a rest; repeated rows and repeated or null
doc_ids are packed row by row; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, small_batches, stored, table

WINDOW, OPEN_WINDOWS, END_ID = 4096, 64, 2
#: Tasks whose leftovers one task of the next level merges.
FAN_IN = 16
#: Distinct words and runs whose ids a worker remembers, before it starts anew.
CACHE_CHUNKS = 400_000

#: A piece of a sequence, and (with ids and its window) one of an open window.
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, task bigint, open_window int, ids binary")
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                   ("task", pa.int64()), ("open_window", pa.int32()), ("ids", pa.binary())])

#: In lower-case Latin text without apostrophes: runs of letters, of digits and of other characters.
RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
#: Runs of ASCII marks but the apostrophe; symbols that could stand beside them in a run.
MARKS, SYMBOLS = re.compile(r"[!-&(-/:-@\[-`{-~]+"), re.compile("[\xa1-\xbf\xd7\xf7]")
WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
LATIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\u024f]*\Z")

_encoders: dict[int, "ChunkEncoder"] = {}  # one for each worker process


class ChunkEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, put together from
    the ids of words or runs, which are remembered.

    The tokenizer joins nothing across white space.  In plain Latin text it also
    cuts between letters, digits and other characters, so such text is put together from
    the ids of its runs.  A run of letters has exactly one token with the word-end mark, its last, which
    tells the ids of many runs apart when they are encoded as one text."""

    JOINED = 256

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only wait for each other
        self.tokenizer = Tokenizer.from_str(data.decode())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}

    def learn_runs(self, runs: list[str]) -> None:
        single = [r for r in runs if not r.isalpha()]
        letters = [r for r in runs if r.isalpha()]
        groups = [letters[lo:lo + self.JOINED] for lo in range(0, len(letters), self.JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups],
                                                                     add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(group):  # some letter has a normal form with more than letters
                single += group
                continue
            data, at = ids.tobytes(), 0
            for r, end in zip(group, cuts.tolist()):
                self.ids[r], at = data[at:end], end
        for r, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False)):
            self.ids[r] = array("I", e.ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember new words, with the runs that make up the plain ones."""
        runs = {w: RUNS.findall(w) for w in words if not w.isalpha() and "'" not in w and "<|" not in w and w == w.lower() and LATIN.match(w)}
        new = {r for rs in runs.values() for r in rs}.union(words.difference(runs))
        self.learn_runs(list(new.difference(self.ids)))
        get = self.ids.__getitem__
        for w, rs in runs.items():
            self.ids[w] = b"".join(map(get, rs))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > CACHE_CHUNKS:
            self.ids.clear()
        cut, out, get = [], [], self.ids.__getitem__
        for t in texts:
            if not LATIN.match(t) or "<|" in t:
                cut.append(WORDS.findall(t))
            elif "'" in t or not t.isascii() and SYMBOLS.search(t):
                cut.append(t.lower().split())
            else:  # fewer different words without their punctuation
                cut.append(MARKS.sub(r" \g<0> ", t.lower()).split())
            try:
                out.append(b"".join(map(get, cut[-1])))
            except KeyError:  # something new
                out.append(None)
        new = set().union(*[c for c, ids in zip(cut, out) if ids is None]).difference(self.ids)
        if new:
            self.learn(new)
        return [b"".join(map(get, c)) if ids is None else ids for c, ids in zip(cut, out)]


def encoder(data: bytes) -> ChunkEncoder:
    key = zlib.crc32(data)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(data)
    return _encoders[key]


class Packer:
    """Best-fit packing of pieces (doc_id, start, doc_tokens, ids) into a fixed
    number of open windows; ``rows`` collects the pieces of emitted sequences."""

    def __init__(self, first_id: int, window: int, n_open: int):
        self.next_id, self.window, self.n_open = first_id, window, n_open
        self.open: list[list] = []  # [tokens, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next_id, offset, None, None, None))
            offset += n
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: bytes) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.window:
                self.emit([(doc_id, start, doc_tokens, ids[:4 * self.window])])
                used = self.window
            else:
                fitting = [w for w in self.open if w[0] + n <= self.window]
                if fitting or len(self.open) < self.n_open:
                    best = max(fitting, key=lambda w: w[0], default=None)
                    if best is None:
                        best = [0, []]
                        self.open.append(best)
                    best[0] += n
                    best[1].append((doc_id, start, doc_tokens, ids))
                    if best[0] == self.window:
                        self.open.remove(best)
                        self.emit(best[1])
                    return
                fullest = max(self.open, key=lambda w: w[0])
                used = self.window - fullest[0]
                self.open.remove(fullest)
                self.emit([*fullest[1], (doc_id, start, doc_tokens, ids[:4 * used])])
            start, ids = start + used, ids[4 * used:]

    def leave(self, task: int) -> None:
        """Rows of the open windows, for the next level."""
        for k, (_, pieces) in enumerate(self.open):
            for doc_id, start, doc_tokens, ids in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, None, None, task, k, ids))
        self.open = []

    def close(self) -> None:
        """Emit the open windows without padding: whole windows, then powers of two."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        total, self.open = sum(len(p[3]) // 4 for p in rest), []
        while total:
            size = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            total -= size
            pieces = []
            while size:
                doc_id, start, doc_tokens, ids = rest.pop(0)
                n = min(size, len(ids) // 4)
                pieces.append((doc_id, start, doc_tokens, ids[:4 * n]))
                if 4 * n < len(ids):
                    rest.insert(0, (doc_id, start + n, doc_tokens, ids[4 * n:]))
                size -= n
            self.emit(pieces)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [()] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def first_id(level: int, task: int) -> int:
    """Sequence ids of a level's task: 2^32 of them."""
    return level << 56 | task << 32


def pack_task(batches: Iterator[pa.RecordBatch], tokenizer, window: int, n_open: int) -> Iterator[pa.RecordBatch]:
    task, enc = TaskContext.get().partitionId(), encoder(tokenizer.value)
    packer, end = Packer(first_id(0, task), window, n_open), array("I", [END_ID]).tobytes()
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                ids += end
                packer.add(doc_id, 0, len(ids) // 4, ids)
            yield packer.take()
    packer.leave(task)
    yield packer.take()


def merger(level: int, last: bool, window: int, n_open: int):
    """The function that packs the leftovers of one group of tasks."""
    def merge(key: tuple[pa.Scalar, ...], left: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer(first_id(level, group), window, n_open)
        left = left.sort_by([("task", "ascending"), ("open_window", "ascending"), ("doc_id", "ascending"),
                             ("start", "ascending"), ("ids_crc32", "ascending")])
        for r in left.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
        if last:
            packer.close()
        else:
            packer.leave(group)
        return pa.Table.from_batches([packer.take()])
    return merge


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, n_open: int = OPEN_WINDOWS,
         fan_in: int = FAN_IN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(__name__)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with open(tokenizer_path, "rb") as f:  # one vocabulary, of a size its file bounds
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    done = stored(texts.mapInArrow(partial(pack_task, tokenizer=tokenizer, window=window, n_open=n_open), SCHEMA),
                  "packing")
    levels, out = [], done.filter("open_window IS NULL")
    left = done.filter("open_window IS NOT NULL")
    tasks = left.agg(F.max("task")).first()[0]
    while tasks is not None:
        last = tasks < fan_in
        merged = stored(left.withColumn("group", F.floor(F.col("task") / fan_in).cast("long")).groupBy("group")
                        .applyInArrow(merger(len(levels) + 1, last, window, n_open), SCHEMA),
                        f"packing-{len(levels) + 1}")
        levels.append(merged)
        out = out.unionByName(merged.filter("open_window IS NULL"))
        left = merged.filter("open_window IS NOT NULL")
        tasks = None if last else tasks // fan_in
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op4_packing": op4_packing}
