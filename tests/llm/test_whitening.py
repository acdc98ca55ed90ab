"""Operator 12 against whole-table numpy, exact integers and problems of known solution."""

import math
from fractions import Fraction

import numpy as np
import pytest

from glenfare.llm import whitening as M

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """From the statement: Python integers and fractions, numpy's own eigen solver in double."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in kept]
    fit = [list(t) for t in {tuple(x) for x in xs}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    dev = [sum((n * x[k] - s[k]) ** 2 for k in range(d)) for x in xs]
    dev = [v if v < 2 ** 63 else None for v in dev]
    centred = np.array([[float(Fraction(n * x[k] - s[k], n)) for k in range(d)] for x in fit])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    every = np.array([[float(Fraction(n * x[k] - s[k], n)) for k in range(d)] for x in xs])
    return [i for i, _ in kept], n, dev, every @ vector[:, :4] / np.sqrt(value[:4]), value / value.sum()


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(parts)
    ids, n, dev, white, explained = brute(rows)
    got = sorted(M.whiten(df).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"], r["whitened"]))
    assert len(got) == len(ids) * white.shape[1]
    assert {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1
    assert sorted(map(repr, zip(ids, dev))) == sorted(repr((r["vec_id"], r["deviation"])) for r in got if r["component"] == 1)
    for k in range(white.shape[1]):
        mine = np.array([r["whitened"] for r in got if r["component"] == k + 1])
        want = np.array([w for _, w in sorted(zip([(i is None, i) for i in ids], white[:, k]))])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(got[k]["explained"] / explained[k] - 1) < 1e-10


def test_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(300, 12)) @ rnd.normal(size=(12, 12))
    rows = [(int(k), v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # a third are copies
    rows += [(5, [1.0] * 11 + [None]), (6, None), (7, [float("nan")] * 12), (8, [float("inf")] + [0.0] * 11), (None, base[1].tolist())]
    check(spark, rows)


def test_large_and_shifted_values_stay_exact(spark):
    """Far from zero, and too large for one float64 product: limbs."""
    rnd = np.random.default_rng(4)
    check(spark, [(k, (1000 + rnd.normal(size=6)).tolist()) for k in range(200)])
    check(spark, [(k, (rnd.normal(size=5) * 3e5).tolist()) for k in range(200)])


def test_limbs_and_product_sums():
    import pyarrow as pa
    rnd = np.random.default_rng(5)
    for bits in (3, 20, 33, 61):
        y = rnd.integers(-(1 << bits), 1 << bits, (50, 3))
        parts = M.limbs(y)
        assert (sum(p.astype(object) << (M.LIMB * k) for k, p in enumerate(parts)) == y.astype(object)).all()
        assert all(int(np.abs(p).max()) < 1 << 26 for p in parts)
        b = pa.RecordBatch.from_arrays([pa.array(y.tolist())], ["x"])
        got = np.zeros((3, 3), object)
        for out in M.product_sums(iter([b]), [0, 1, -1]):
            for i, j, shift, v in zip(*(c.to_pylist() for c in out.columns)):
                got[i, j] += v << shift
        z = y.astype(object) - np.array([0, 1, -1], object)
        assert (got == np.triu(z.T @ z)).all()


def known(values, seed=0):
    """A symmetric matrix in extended precision with the given eigenvalues, and its eigenvectors."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q @ (3 * np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [
    [8, 4, 2, 1, 0.5, 0.25], [5, 5 - 1e-9, 5 - 2e-9, 1, 1 - 1e-11, 0.1], [3, 3 - 1e-13, 2, 1, 1e-3, 1e-8],
    [1e6, 1, 1 - 1e-10, 1e-6, 1e-7, 0.0], [2, 2, 2, 1, 1, 0], [7] * 6, [0] * 6, [1e-30, 1e-31, 1e-32, 0, 0, 0], [9, 9, 9, 9, 9, 1]])
def test_eigenvectors_to_double_precision(values):
    a, q = known(values)
    got, x = M.eigen((a + a.T) / 2)
    top = max(max(values), 1e-300)
    assert float(np.abs(x.T @ x - np.eye(6)).max()) < 1e-16 * 8
    assert float(np.abs(np.array(got, float) - sorted(values, reverse=True)).max()) <= 1e-15 * top
    assert float(np.abs(a @ x - x * got).max()) <= 1e-15 * top
    for k in range(6):  # to double precision, wherever extended precision can tell the vector from the others
        gap = min(abs(values[k] - v) for j, v in enumerate(values) if j != k)
        if gap > 1e-14 * top and np.finfo(np.longdouble).eps < 1e-18:
            assert min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max()) < max(1e-15, 2e-18 * top / gap)


def test_float32_alone_is_not_enough():
    a, q = known([5, 5 - 1e-9, 3, 2, 1, 0.1])
    x = np.linalg.eigh(a.astype(np.float32))[1][:, -1]
    assert min(np.abs(x - q[:, 0]).max(), np.abs(x + q[:, 0]).max()) > 1e-4


def test_edge_cases(spark):
    empty = M.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == [f.name for f in M.OUT]
    none = M.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA))
    assert none.count() == 0
    one = M.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    ragged = M.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, [2.0, -1.0], 0)], SCHEMA)).collect()
    assert len(ragged) == 6 and all(r["n"] == 3 and r["whitened"] is not None for r in ragged)
    huge = M.whiten(spark.createDataFrame([(1, [1e30, 2.0], 0), (2, [-1e30, 1.0], 0), (3, [0.0, 0.0], 0)], SCHEMA)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None or r["vec_id"] == 3 for r in huge)
    line = M.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.5], 0) for k in range(9)], SCHEMA)).collect()
    assert len(line) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in line)


def test_clashing_columns_and_query(spark):
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    clash = df.select("*", *[F.lit("c").alias(c) for c in ("x", "v", "n", "i", "component", "whitened")])
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    a = sorted(map(tuple, M.op12_whitening(spark, sf).collect()))
    b = sorted(map(tuple, M.whiten(clash).collect()))
    assert [r[:4] for r in a] == [r[:4] for r in b] and np.allclose([r[4] for r in a], [r[4] for r in b], atol=1e-12)
    check(spark, rows)
