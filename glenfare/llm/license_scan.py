"""License scans (operator 9): an exact set-similarity join of text blocks with
license templates.

A block is a line, or, of a line of over ``BLOCK_WORDS`` words, each window of
that many words, starting every half window.  With a template of over half as many
words, windows have twice its words, so that a run of its length is always whole in one.  ``wrapped`` (as the query has it)
cuts each paragraph, lines up to one without words, in the same way beside its
lines, as notices are wrapped.  A block meets a template when it
contains at least ``CONTAINMENT`` of the template's distinct words.  Words are
ordered by how many blocks of the whole table hold them, rarest first.  A
template that needs r of its s words must then share one of its first s - r + 1
words with a block (prefix filter), at places that leave both sides enough
words (positional filter), and the block must hold r template words (length
filter).  The surviving pairs are checked in full, so the join is exact.

The base scan finds given phrases word by word.  Blocks that pass no template's
prefix never leave their task; the template side has a few rows for each of a
parameter's templates and is broadcast.

Edge cases: null and empty texts have no words and no labels (empty strings,
null places, score 0); repeated rows each get their answer; a null doc_id is
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, small_batches, stored, table

CONTAINMENT = 0.9
BLOCK_WORDS = 64

#: The base phrases of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening words of well-known license notices (label, text).
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("cc-by-nc", "licensed under CC BY-NC"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial International License"),
    ("cc-by-sa", "licensed under CC BY-SA"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Everything that is no word character, as bytes of UTF-8, becomes a space; A-Z are lower-cased.
TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A
                 else 10 if c == 10 else 32 for c in range(256))


def word_lines(text: str | None) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split(b"\n")]


def words(text: str) -> list[bytes]:
    return [w for line in word_lines(text) for w in line]


def blocks(line: list[bytes], size: int = BLOCK_WORDS) -> Iterator[list[bytes]]:
    if len(line) <= size:
        yield line
        return
    for lo in range(0, len(line) - size // 2, size // 2):
        yield line[lo:lo + size]


def window_words(templates: list[tuple[str, str]]) -> int:
    """Words of a window: twice those of the longest template, BLOCK_WORDS at least."""
    return max(BLOCK_WORDS, 2 * max((len(words(t)) for _, t in templates), default=0))


def text_blocks(lines: list[list[bytes]], wrapped: bool, size: int = BLOCK_WORDS) -> Iterator[list[bytes]]:
    """The blocks of a text, given as the words of its lines."""
    for worded, group in groupby(lines, bool):
        paragraph = list(group)
        if wrapped and worded and len(paragraph) > 1:
            whole = [w for line in paragraph for w in line]
            yield from blocks(whole, size)
            if len(whole) <= size:  # holds the lines
                continue
        for line in paragraph:
            yield from blocks(line, size)


def base_places(flat: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Starts of every phrase, by label."""
    out: dict[str, list[int]] = {}
    joined = b" " + b" ".join(flat) + b" "
    for phrase, label in phrases.items():
        p = b" " + phrase.encode() + b" "
        at, counted, place = joined.find(p), 0, 0
        while at >= 0:
            place, counted = place + joined.count(b" ", counted, at), at  # on from the last one
            out.setdefault(label, []).append(place)
            at = joined.find(p, at + 1)
    return out


class Templates:
    """The templates in a global word order: distinct words, rarest first, with
    how many a block needs and the prefix that must be met."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], containment: float):
        self.order = {w: k for k, w in enumerate(sorted(
            {w for _, t in templates for w in words(t)}, key=lambda w: (frequency.get(w.decode(), 0), w)))}
        self.rows, self.least_needed = [], {}
        for k, (label, text) in enumerate(templates):
            own = sorted(set(words(text)), key=self.order.__getitem__)
            need = math.ceil(containment * len(own) - 1e-9)
            for i, w in enumerate(own[:len(own) - need + 1]):
                self.rows.append((w.decode(), k, label, i, len(own), need, [x.decode() for x in own]))
                self.least_needed[w] = min(need, self.least_needed.get(w, need))

    def candidate(self, block: list[bytes]) -> list[str] | None:
        """The block's template words, rarest first, if some prefix word is there with enough others."""
        held = self.order.keys() & block
        if any(self.least_needed.get(w, math.inf) <= len(held) for w in held):
            return [w.decode() for w in sorted(held, key=self.order.__getitem__)]
        return None


def count_words(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes], wrapped: bool,
                size: int = BLOCK_WORDS) -> Iterator[pa.RecordBatch]:
    """(word, n): blocks of this task that hold each template word."""
    n: Counter = Counter()
    for b in batches:
        for t in b.column("text"):
            for block in text_blocks(word_lines(t.as_py()), wrapped, size):
                n.update(vocabulary.intersection(block))
    yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in n], pa.string()),
                                      "n": pa.array(n.values(), pa.int64())})


SCANNED = ("row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
           "base_labels array<string>, blocks array<array<string>>")
ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                   ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                   ("blocks", pa.list_(pa.list_(pa.string())))])


def scan(batches: Iterator[pa.RecordBatch], templates: Templates, phrases: dict[str, str],
         wrapped: bool, size: int = BLOCK_WORDS) -> Iterator[pa.RecordBatch]:
    """The base scan of every row, and its candidate blocks."""
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        out = []
        for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            lines = word_lines(t.as_py())
            flat = [w for line in lines for w in line]
            places = base_places(flat, phrases)
            starts = [x for xs in places.values() for x in xs]
            found = {tuple(c) for block in text_blocks(lines, wrapped, size) if (c := templates.candidate(block))}
            out.append((row, doc_id, len(flat), len(starts), min(starts, default=None), max(starts, default=None),
                        sorted(places), sorted(found)))
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW) \
            if out else pa.RecordBatch.from_pylist([], schema=ARROW)


def template_links(scanned: DataFrame, templates: Templates) -> DataFrame:
    """(row, template, label, containment): every block-template pair that meets the threshold, by row."""
    spark = scanned.sparkSession
    side = spark.createDataFrame(templates.rows, "word string, template int, label string, place int, size int, "
                                                 "need int, template_words array<string>")
    words_of = (scanned.filter(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "held"))
                .select("row", "block", "held", F.posexplode("held").alias("at", "word")))
    pairs = (words_of.join(F.broadcast(side), "word")
             .filter((F.size("held") >= F.col("need"))
                     & (F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at")) >= F.col("need"))))
    shared = F.size(F.array_intersect("held", "template_words"))
    return (pairs.filter(shared >= F.col("need"))
            .select("row", "template", "label", (shared / F.col("size")).alias("containment")).distinct())


def license_rows(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT,
                 wrapped: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels and score (the best containment; 1 with a base phrase)."""
    ship(__name__)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary, size = frozenset(w for _, t in templates for w in words(t)), window_words(templates)
    # one row for each word of the templates
    frequency = {r["word"]: r["n"] for r in rows.select("text").mapInArrow(
        partial(count_words, vocabulary=vocabulary, wrapped=wrapped, size=size), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).collect()}
    ordered = Templates(templates, frequency, containment)
    scanned = stored(rows.mapInArrow(partial(scan, templates=ordered, phrases=phrases, wrapped=wrapped, size=size), SCANNED),
                     "license-scan")
    found = template_links(scanned, ordered).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels")]
    base_score = F.when(F.size("base_labels") > 0, 1.0).otherwise(0.0)
    plain = scanned.filter(F.size("blocks") == 0).select(
        *cols, F.array_join("base_labels", ",").alias("labels"), base_score.alias("score"))
    labelled = scanned.filter(F.size("blocks") > 0).join(found, "row", "left").select(
        *cols, F.array_join(F.sort_array(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))),
                            ",").alias("labels"),
        F.greatest(base_score, F.coalesce("best", F.lit(0.0))).alias("score"))
    return plain.unionByName(labelled)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rows(table(spark, sf_dir, "documents"), wrapped=True)


QUERIES = {"op9_license_scan": op9_license_scan}
