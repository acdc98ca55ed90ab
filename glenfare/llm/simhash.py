"""SimHash near-dedup (operator 10): binary trie self-join.

Each text gets a 64-bit fingerprint over hashed word shingles.  Distinct
fingerprints form a binary trie; the self-join walks pairs of trie nodes down
together, adds up the bits in which they differ and drops a pair once it has
more than ``max_bits``.

On the cluster the trie's upper levels deal out the work: pairs of nodes within
the error budget are the cells, and each cell walks its two subtrees in one task.
The first ``depth`` levels grow with the logarithm of the number of
fingerprints, so that a node holds about ``NODE_FINGERPRINTS``.  Nodes are counted first: a pair is
a cell only if both of its nodes hold something, and a pair that holds more than
``CELL_FINGERPRINTS`` goes ``SPLIT_BITS`` levels further down, with what is left of its
budget, again and again (crowded subtrees come from many texts that
share most of their words).  A cell returns a spanning
forest of its links and not the pairs, so a family of n near copies costs n
rows.  Components then come from repeated minimum-label joins over the forest
edges, with their tables in the shared folder.

Edge cases: null and empty text have fingerprint zero, which links like any
other; a text with fewer words than a shingle is one shingle; equal
fingerprints are one node, however many rows; a null doc_id never is a
component id unless all of the component's are null; repeated rows each get
their answer; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import rows_in, ship, small_batches, stored, table, text_key

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
NODE_FINGERPRINTS = 1 << 16
#: A pair of nodes with more fingerprints is split, by so many levels at a time, down to the last level of a signed path.
CELL_FINGERPRINTS, SPLIT_BITS, LAST_LEVEL = 4 * NODE_FINGERPRINTS, 4, 62
#: Stands for the id of a fingerprint whose rows all have a null doc_id: it sorts last.
NO_ID = (1 << 63) - 1
#: Least depth, so that even a small table is dealt over many tasks.
MIN_DEPTH = 5
#: Node pairs walked at once, and the pair products that end the walk.
FRONTIER, LEAF_PAIRS = 1 << 18, 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash: bit i is set where over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(shingle_words)])))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):  # a very long text takes bounded memory
        part = h[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp): fp holds the unsigned fingerprint's bits in a long."""
    ship(__name__)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle_words, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"),
                       F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_at(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where, in each node [lo, hi) at ``level``, the children with bit 1 begin."""
    bit = np.uint64(1) << np.uint64(63 - level)
    below = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
    first = (values[lo] & below) | bit
    return np.clip(np.searchsorted(values, first), lo, hi)


def trie_join(a: np.ndarray, b: np.ndarray, level: int, spent: int, max_bits: int,
              same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) within the budget.  ``a`` and ``b`` are
    sorted subtrees below ``level``, ``spent`` the bits in which their paths
    differ; ``same``: they are one subtree, and each unordered pair comes once.

    The frontier of node pairs is walked level by level in slices of bounded size."""
    one = np.int64
    todo = [(level, np.zeros(1, one), np.full(1, len(a), one), np.zeros(1, one), np.full(1, len(b), one),
             np.full(1, spent, one))]
    while todo:
        lev, alo, ahi, blo, bhi, diff = todo.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            todo += [(lev, *(x[:half] for x in (alo, ahi, blo, bhi, diff))),
                     (lev, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (lev >= 64)
        if small.any():
            yield from leaf_pairs(a, b, alo[small], ahi[small], blo[small], bhi[small], max_bits, same)
            keep = ~small
            alo, ahi, blo, bhi, diff = (x[keep] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        amid, bmid = split_at(a, alo, ahi, lev), split_at(b, blo, bhi, lev)
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff),
                 (alo, amid, bmid, bhi, diff + 1), (amid, ahi, blo, bmid, diff + 1)]
        if same:  # of a node with itself, the crossed children come once
            crossed = tuple(x[(alo != blo)] for x in parts[3])
            parts[3] = crossed
        joined = [np.concatenate(x) for x in zip(*parts)]
        ok = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= max_bits)
        todo.append((lev + 1, *(x[ok] for x in joined)))


def leaf_pairs(a, b, alo, ahi, blo, bhi, max_bits, same):
    """All pairs of small (or fully walked) node pairs, by popcount, in slices."""
    na, nb = ahi - alo, bhi - blo
    n = na * nb
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")))
        own = np.repeat(np.arange(start, stop), n[start:stop])
        k = np.arange(len(own)) - np.repeat(ends[start:stop] - n[start:stop] - (ends[start - 1] if start else 0),
                                            n[start:stop])
        i, j = alo[own] + k // nb[own], blo[own] + k % nb[own]
        ok = differing(a[i], b[j]) <= max_bits
        if same:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]
        start = stop


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n vertices and their links, each vertex's root: the least index of its component."""
    root = np.arange(n)
    for i, j in links:
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while True:  # every vertex points to its root
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def near_masks(depth: int, max_bits: int) -> list[int]:
    """Differences of two ``depth``-bit paths within the budget."""
    return [m for m in range(1 << depth) if m.bit_count() <= max_bits] if depth <= 12 else \
        sorted(_masks(depth, max_bits))


def _masks(depth: int, max_bits: int) -> set[int]:
    out, last = {0}, {0}
    for _ in range(max_bits):
        last = {m | 1 << i for m in last for i in range(depth)}
        out |= last
    return out


def cell_links(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Forest edges (id, fp, root_id, root_fp) of one cell: a node with itself or two nodes, paths of ``depth`` bits."""
    depth = int(pdf["depth"].iloc[0])
    value = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    value, ids = value[order], pdf["id"].to_numpy(np.int64)[order]
    path = value >> np.uint64(64 - depth)
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    low, high = np.flatnonzero(path == lo), np.flatnonzero(path == hi)
    pairs = trie_join(value[low], value[high], depth, (lo ^ hi).bit_count(), max_bits, lo == hi) \
        if len(low) and len(high) else iter(())
    root = forest(len(value), ((low[i], high[j]) for i, j in pairs))
    moved = np.flatnonzero(root != np.arange(len(value)))
    to = root[moved]
    fp = value.view(np.int64)
    return pd.DataFrame({"id": ids[moved], "fp": fp[moved], "root_id": ids[to], "root_fp": fp[to]})


def path_at(depth: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - depth)


def node_pairs(distinct: DataFrame, depth: int, max_bits: int = MAX_BITS,
               limit: int = CELL_FINGERPRINTS) -> list[tuple[int, DataFrame]]:
    """(depth, pairs (lo, hi)): the pairs of nodes that hold fingerprints and may hold links, each pair at
    the first level where it holds at most ``limit`` of them.  Counts are added up in each task; the tables
    here have a row a node or pair, not a fingerprint."""

    def counted(rows: DataFrame, level: int) -> DataFrame:
        return stored(rows.groupBy(path_at(level).alias("lo")).agg(F.count(F.lit(1)).alias("n")), "simhash-nodes")

    def both(half: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs whose other node holds something, with the fingerprints of the two."""
        other = nodes.select(F.col("lo").alias("hi"), F.col("n").alias("m"))
        size = F.col("n") + F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.col("m"))
        return stored(half.filter(F.col("lo") <= F.col("hi")).join(other, "hi").select("lo", "hi", size.alias("size")),
                      "simhash-pairs")

    def masks(bits: int) -> Column:
        return F.array(*[F.lit(m).cast("long") for m in near_masks(bits, max_bits)])

    nodes = counted(distinct, depth)
    pairs = both(nodes.withColumn("mask", F.explode(masks(depth)))
                 .select("lo", F.col("lo").bitwiseXOR(F.col("mask")).alias("hi"), "n"), nodes)
    out = []
    while True:
        crowded = pairs.filter(F.col("size") > limit)
        if depth + SPLIT_BITS > LAST_LEVEL or crowded.isEmpty():
            return [*out, (depth, pairs.select("lo", "hi"))]
        out.append((depth, pairs.filter(F.col("size") <= limit).select("lo", "hi")))
        inside = crowded.select(F.explode(F.array("lo", "hi")).alias("path")).distinct()
        nodes = counted(distinct.join(inside, path_at(depth) == F.col("path"), "left_semi"), depth + SPLIT_BITS)
        spent = F.col("up_lo").bitwiseXOR(F.col("up_hi"))
        near = F.filter(masks(SPLIT_BITS), lambda m: F.bit_count(m) <= max_bits - F.bit_count(spent))
        half = (nodes.withColumn("up_lo", F.shiftright("lo", SPLIT_BITS))
                .join(crowded.select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi")), "up_lo")
                .withColumn("mask", F.explode(near))
                .select("lo", F.col("lo").bitwiseXOR(F.shiftleft(spent, SPLIT_BITS)).bitwiseXOR(F.col("mask")).alias("hi"),
                        "n"))
        depth += SPLIT_BITS
        pairs = both(half, nodes)


def trie_links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS, depth: int | None = None,
               limit: int = CELL_FINGERPRINTS) -> DataFrame:
    """(v, u): forest edges that connect all fingerprints within ``max_bits``.  A
    vertex is (id, fp): the least doc_id of the fingerprint goes along, so that
    the least vertex of a component names it."""
    ship(__name__)
    depth = depth or max(MIN_DEPTH, math.ceil(math.log2(max(1, n / NODE_FINGERPRINTS))))
    dealt = []
    for level, pairs in node_pairs(distinct, depth, max_bits, limit):
        pair = F.struct("lo", "hi")
        sides = (pairs.select(F.col("lo").alias("path"), pair.alias("pair"))
                 .union(pairs.filter(F.col("lo") < F.col("hi")).select(F.col("hi").alias("path"), pair.alias("pair"))))
        dealt.append(distinct.select("id", "fp", path_at(level).alias("path")).join(sides, "path")
                     .select("id", "fp", F.lit(level).alias("depth"), "pair.lo", "pair.hi"))
    cells = reduce(DataFrame.union, dealt)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        return cell_links(pdf, max_bits)

    return (cells.groupBy("depth", "lo", "hi").applyInPandas(walk, "id bigint, fp bigint, root_id bigint, root_fp bigint")
            .select(F.struct("id", "fp").alias("v"), F.struct(F.col("root_id").alias("id"), F.col("root_fp").alias("fp")).alias("u")))


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (v, u): the least vertex of its
    component.  Each round every vertex takes the least label around it,
    and then its label's label; rounds grow with the logarithm of a chain."""
    both = stored(edges.select("v", "u").union(edges.select("u", "v")).distinct(), "simhash-edges")
    label = stored(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label")), "simhash-labels")
    while True:
        around = (both.join(label.select(F.col("v").alias("u"), F.col("label").alias("l")), "u")
                  .groupBy("v").agg(F.min("l").alias("l")))
        # hook: the vertex that is my label learns of the least label near me
        hook = (label.join(around, "v").filter(F.col("l") < F.col("label"))
                .groupBy(F.col("label").alias("v")).agg(F.min("l").alias("h")))
        least = (label.join(around, "v").join(hook, "v", "left")
                 .select("v", F.col("label").alias("old"), F.least("label", "l", "h").alias("label")))
        least = stored(least, "simhash-least")
        up = least.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = stored(least.join(up, "label", "left")
                     .select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "simhash-labels")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("v", "label")
        label = new.drop("old")


def near_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    seed: int = SEED, depth: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, fp, component_id."""
    prints = stored(fingerprints(docs, shingle_words, seed), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id")), "simhash-distinct")
    label = components(stored(trie_links(distinct, distinct.count(), max_bits, depth), "simhash-forest"))
    named = (distinct.join(label.select(F.col("v.fp").alias("fp"), F.col("label.id").alias("label_id")), "fp", "left")
             .select("fp", F.nullif(F.coalesce("label_id", "id"), F.lit(NO_ID)).alias("component_id")))
    # from a stored table both sides are plain shuffles, of which Spark can split a hot fingerprint
    return prints.join(stored(named, "simhash-named"), "fp").select("doc_id", "text_key", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one of each
    (rows with a null doc_id stay where the whole component has none)."""
    keep = stored(near_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
                  .select("doc_id", "text_key"), "simhash-kept")
    return rows_in(docs, keep, once=True)


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
