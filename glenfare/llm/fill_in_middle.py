"""Fill-in-middle transformation (operator 11): secondary-sort assembly.

1. A map cuts every text into prefix, middle and suffix and emits them as chunks
   of at most ``CHUNK`` code points, keyed by the document's row and the chunk's
   position in the output (which section is written when, then the chunk's number).
   A section's sentinel opens its first chunk.
2. The chunks are repartitioned by row and sorted within partitions (the
   DataFrame form of repartitionAndSortWithinPartitions: one shuffle, an external
   sort, no group in memory).  A pass over the sorted chunks feeds an incremental digest
   of each output and takes the output apart again by its sentinels, without
   any knowledge of the cuts, into chunks keyed by their place in the original.
3. These are sorted anew within the same partitions (no further shuffle) and
   streamed into the digest of the restored text.

No step holds more of a document than a chunk, once the map has read its row, and
a long document costs its partition time, not memory.

A row is known by its input partition and its number there, so repeated rows and
repeated or null doc_ids are transformed row by row.  Edge cases: a null text is
empty; empty texts and texts with a sentinel are plain; a null doc_id has no
digits after ``1:``; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, small_batches, table

#: Code points of a chunk.
CHUNK = 16_384
#: The sentinels, and what of 100 documents stays plain (from 90 on) or takes suffix first (below 20).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

#: Sections of the original text, in its order.
SECTION = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: The sentinels of a form in the order of its output.
ORDER = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

#: ``task`` and ``row`` name the document's row; ``head`` rows (place -1) hold its id, length and cuts.
KEYS = [("task", pa.int64()), ("row", pa.int64()), ("place", pa.int64())]
HEAD = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64())]
PIECES = pa.schema([*KEYS, *HEAD, ("chunk", pa.string())])
RESTORED = pa.schema([*KEYS, *HEAD, ("output_sha256", pa.string()), ("chunk", pa.string())])
OUT = pa.schema([*HEAD, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
DDL = {pa.int64(): "bigint", pa.string(): "string"}

#: Chunks of a section get places from its number times this.
SPACE = 1 << 40
#: Rows or code points after which a pass sends a batch on.
BATCH, BATCH_CHARS = 4096, 1 << 22


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``, whose last field is a chunk (or a digest) or null."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[-1] or "")
        if len(part) >= BATCH or size >= BATCH_CHARS:
            yield batch(part, schema)
            part, size = [], 0
    yield batch(part, schema)


def cuts(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """(form, code points of the prefix, of the middle)."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in SECTION) or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b - a


def chunks(text: str, lo: int, hi: int, mark: str, place: int, size: int) -> Iterator[tuple[int, str]]:
    """(place, chunk) of ``mark`` and text[lo:hi]; ``mark`` stands before the first."""
    for k, at in enumerate(range(lo, max(hi, lo + 1), size)):
        yield place * SPACE + k, (mark if not k else "") + text[at:min(at + size, hi)]


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        task, row = TaskContext.get().partitionId(), -1
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                row, doc_id, text = row + 1, doc_id.as_py(), text.as_py() or ""
                form, p, m = cuts(doc_id, text)
                plain = form == "plain"
                yield (task, row, -1, doc_id, len(text), form, None if plain else p, None if plain else m, None)
                bounds = {"": (0, len(text)), PREFIX: (0, p), MIDDLE: (p, p + m), SUFFIX: (p + m, len(text))}
                for k, mark in enumerate(ORDER[form] or ("",)):
                    for place, chunk in chunks(text, *bounds[mark], mark, k, size):
                        yield (task, row, place, None, None, None, None, None, chunk)
    return batched(rows(), PIECES)


class Taker:
    """Takes an output apart as it comes: ``feed`` gives (section, text) parts in
    output order.  A sentinel may fall between two chunks, so the last two characters
    wait for the next chunk."""

    def __init__(self, form: str):
        self.marks, self.section, self.rest = list(ORDER[form]), 0, ""

    def feed(self, chunk: str) -> Iterator[tuple[int, str]]:
        data = self.rest + chunk
        while self.marks and (at := data.find(self.marks[0])) >= 0:
            if at:
                yield self.section, data[:at]
            self.section, data = SECTION[self.marks[0]], data[at + len(self.marks.pop(0)):]
        keep = 2 if self.marks else 0
        self.rest = data[max(len(data) - keep, 0):] if keep else ""
        if ready := data[:len(data) - len(self.rest)]:
            yield self.section, ready

    def end(self) -> Iterator[tuple[int, str]]:
        if self.rest:
            yield self.section, self.rest


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):  # few chunks at once are Python strings
            yield from b.slice(lo, 64).to_pylist()


def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted output chunks in; digest of each output, and the chunks of its restored text, out."""
    def rows() -> Iterator[tuple]:
        head, digest, taker, count = None, None, None, 0

        def part(section: int, text: str) -> tuple:
            nonlocal count
            count += 1
            return (head["task"], head["row"], section * SPACE + count, None, None, None, None, None, None, text)

        def end() -> Iterator[tuple]:
            if head is not None:
                yield from (part(*x) for x in taker.end())
                yield (head["task"], head["row"], -1, head["doc_id"], head["n"], head["form"], head["prefix_chars"],
                       head["middle_chars"], digest.hexdigest(), None)

        for r in read(batches):
            if r["place"] == -1:
                yield from end()
                head, digest, taker, count = r, hashlib.sha256(), Taker(r["form"]), 0
            else:
                digest.update(r["chunk"].encode())
                yield from (part(*x) for x in taker.feed(r["chunk"]))
        yield from end()
    return batched(rows(), RESTORED)


def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of the original in; one row for each document out."""
    def rows() -> Iterator[tuple]:
        head, digest = None, None

        def end() -> Iterator[tuple]:
            if head is not None:
                yield (head["doc_id"], head["n"], head["form"], head["prefix_chars"], head["middle_chars"],
                       head["output_sha256"], digest.hexdigest())

        for r in read(batches):
            if r["place"] == -1:
                yield from end()
                head, digest = r, hashlib.sha256()
            else:
                digest.update(r["chunk"].encode())
        yield from end()
    return batched(rows(), OUT)


def emit_pieces(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks of all outputs, unsorted: a document's output is the concatenation of its chunks by place."""
    ship(__name__)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial(pieces, size=size), ddl(PIECES))


def transform(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, n, form, prefix_chars, middle_chars and the
    digests of its output and of the text restored from that output."""
    order: list[Column] = [F.col("task"), F.col("row"), F.col("place")]
    sorted_out = emit_pieces(docs, size).repartition("task", "row").sortWithinPartitions(*order)
    taken = sorted_out.mapInArrow(outputs, ddl(RESTORED))
    return taken.sortWithinPartitions(*order).mapInArrow(restored, ddl(OUT))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(table(spark, sf_dir, "documents"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

#: The whole operator in SQL: the cuts, the output, and the text rebuilt from the output and its sentinels.
SQL = {"op11_fill_in_middle": """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
i AS (
  SELECT *, CAST('0x' || substring(hex, 1, 8) AS BIGINT) % (n + 1) AS c1,
         CAST('0x' || substring(hex, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substring(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substring(hex, 25, 8) AS BIGINT) AS h4 FROM h),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM i),
o AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
         CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
         CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
              ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a)
         END AS output FROM f),
s AS (
  SELECT *, strpos(output, '<P>') AS p, strpos(output, '<S>') AS s, strpos(output, '<M>') AS m FROM o)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substring(output, p + 3, s - p - 3) || substring(output, m + 3) || substring(output, s + 3, m - s - 3)
              ELSE substring(output, p + 3, m - p - 3) || substring(output, m + 3) || substring(output, s + 3, p - s - 3) END)
         AS restored_sha256
FROM s"""}
