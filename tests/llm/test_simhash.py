import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from glenfare.llm import simhash as S
from helpers import SF, as_rows, documents, edge_docs, empty_docs, prose

COLS = ["doc_id", "fingerprint", "component_id"]


def print_of(text, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=3):
    """rows: (doc_id, text) -> (doc_id, fingerprint, component_id)."""
    fps = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        out.append((i, f"{fps[k]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def result(df):
    return as_rows(df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), *COLS)


def near_copies(n=60):
    """Chains of texts that differ in a word or two."""
    rnd = random.Random(3)
    rows = []
    for c in range(6):
        words = prose(rnd, n=300).split()
        for k in range(n // 6):
            words[rnd.randrange(len(words))] = "changed"
            rows.append((c * 100 + k, " ".join(words)))
    rnd.shuffle(rows)
    return rows


def test_query_matches_brute_force(spark):
    got = as_rows(S.op10_simhash_near_dedup(spark, SF), *COLS)
    assert got == brute([(r["doc_id"], r["text"]) for r in documents(spark).collect()])


def test_chains_and_edges(spark):
    rows = near_copies() + [(r["doc_id"], r["text"]) for r in edge_docs(spark).collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    exp = brute(rows)
    assert len({r[2] for r in exp}) < len({r[0] for r in exp})
    assert result(S.near_components(df)) == exp
    assert S.near_components(empty_docs(spark)).count() == 0


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(1)
    for n, noise in ((300, 3), (2000, 6), (5, 64)):
        centres = rng.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2)
        flips = np.zeros(n, np.uint64)
        for _ in range(noise):
            flips ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        v = np.unique(centres[rng.integers(0, 20, n)] ^ flips)
        exp = {(i, j) for i in range(len(v)) for j in (np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= 3) + i + 1)}
        got = [(int(a), int(b)) for i, j in S.trie_join(v, v, 0, 0, 3, True) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == exp
        a, b = v[::2], v[1::2]
        exp = {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= 3)}
        got = [(int(x), int(y)) for i, j in S.trie_join(a, b, 0, 0, 3, False) for x, y in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == exp


def test_dense_family_and_depths(spark):
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    flips = np.zeros(3000, np.uint64)
    for _ in range(3):  # all within the budget of the base
        flips ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    v = np.unique(np.concatenate([base ^ flips, [base]])).view(np.int64)
    df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(v)], "id bigint, fp bigint")
    for depth in (1, 6):
        edges = S.trie_links(df, len(v), depth=depth).distinct()
        assert edges.count() <= len(v) * 2**depth
        labels = S.components(edges)
        assert labels.select("label").distinct().count() == 1 and labels.count() == len(v)


def test_crowded_subtrees_are_split(spark):
    """Most fingerprints share their first bits: their cells go down until they are small, and no link is lost."""
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 40, 1500, dtype=np.uint64)  # crowded: 24 equal leading bits, spread below
    low[::3] = low[0] ^ (np.uint64(1) << rng.integers(0, 40, 500).astype(np.uint64))
    family = np.uint64(0xABCDEF) << np.uint64(40) | low
    far = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    top = family[:200] ^ (np.uint64(1) << np.uint64(63))  # a link that crosses the very first bit
    v = np.unique(np.concatenate([family, far, top]))
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    exp = {k: find(k) for k in range(len(v)) if any(find(j) == find(k) for j in range(len(v)) if j != k)}
    df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(v.view(np.int64))], "id bigint, fp bigint")
    levels = S.node_pairs(df, 2, limit=100)
    assert len(levels) > 6  # past the 24 equal bits
    sizes = {x: c for d, p in levels for x, c in [(d, p.count())]}
    assert all(c for d, c in sizes.items() if d > 26)
    got = S.components(S.trie_links(df, len(v), depth=2, limit=100))
    assert {r["v"]["id"]: r["label"]["id"] for r in got.collect()} == exp
    whole = S.components(S.trie_links(df, len(v), depth=2))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))


def test_long_chain_components(spark):
    rnd = random.Random(4)
    ids = list(range(200))
    rnd.shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001)], "v bigint, u bigint")
    got = dict(tuple(r) for r in S.components(edges).collect())
    assert got == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}


def test_stage_keeps_one_of_each_group(spark):
    docs = edge_docs(spark)
    out = S.kept_documents(docs)
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    exp = {(i, print_of(t)) for (i, t) in rows for (j, _, c) in brute(rows) if i == j and i == c}
    got = [(r["doc_id"], print_of(r["text"])) for r in out.collect()]
    assert len(got) == len({(r["doc_id"], r["text"]) for r in out.collect()}) and set(got) <= exp
    assert {g[0] for g in got} == {e[0] for e in exp}
