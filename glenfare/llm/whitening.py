"""Embedding whitening (operator 12): mixed-precision eigenvector refinement.

Entries become integers x = floor(256 c).  The fit list is each distinct x vector
once.  Over it, Spark sums the entries (exactly), then the products of entries
centred by the nearest integer to their mean: integers again, summed exactly; what
the mean differs from that integer (at most a half) is taken off as an exact
fraction.  So the covariance reaches the driver, one number for each pair of
dimensions, without any rounding.

There the eigenvectors are found in float32 and corrected by Ogita-Aishima
iterations: matrix multiplications in extended precision alone, converging
quadratically.  Eigenvalues nearer than the iteration can tell apart form a
cluster; within a cluster the vectors are turned by the solution of its own small
problem, the covariance projected on them and shifted by their mean eigenvalue,
which resolves gaps far below the size of the whole; then the iteration goes on.

The whitening itself is a map over all rows, and its identity error is measured by
another pass over the fit list.

Edge cases: rows whose vector is null or holds null, NaN or infinite entries go;
of vectors of unequal lengths the shorter are filled up with zeros; repeated rows
and repeated or null vec_ids give rows of their own; integers are held within
2^62; a deviation beyond the range of a long is null; a component whose eigenvalue
is zero (below 2^-44 of the largest) has null ``whitened``; where all are, identity_error
is null, and where the trace is zero ``explained`` is null; no valid row or no
dimension gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, stored, table

SCALE, COMPONENTS = 256, 4
LIMIT = (1 << 62) - 1
#: Rows of a product; limbs of this many bits keep its sums below 2^53, where float64 is exact.
ROWS, LIMB = 2048, 20
#: Eigenvalues below this share of the largest count as zero.
ZERO = 2.0 ** -44

SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("shift", pa.int32()), ("v", pa.int64())])
SUMS_DDL = "i int, j int, shift int, v bigint"
MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])
OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                 ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
OUT_DDL = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double")


# --- integer vectors and their exact sums -------------------------------------------------------

def finite(v: Column) -> Column:
    """Vectors without null, NaN and infinite entries."""
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integers(v: Column, scale: int) -> Column:
    limit = F.lit(LIMIT)
    return F.transform(v, lambda c: F.greatest(F.least(F.floor(F.lit(float(scale)) * c).cast("long"), limit), -limit))


def filled(df: DataFrame, shortest: int, d: int) -> DataFrame:
    if shortest == d:
        return df
    return df.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb k times 2^(LIMB k); one limb where the products' sums are exact as they are."""
    if not y.size or int(np.abs(y).max()) ** 2 * len(y) < 1 << 53:
        return [y]
    out = []
    while int(np.abs(y).max()) >= 1 << LIMB:  # what is above the last limb keeps the sign
        out.append(y & (1 << LIMB) - 1)
        y = y >> LIMB
    return [*out, y]


def entry_sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Sums by dimension, of the low 31 bits and of what is above; with i = -1, the rows."""
    total, rows = np.zeros((2, d), np.int64), 0
    for b in batches:
        x = matrix(b.column("x"), d)
        total += [(x & (1 << 31) - 1).sum(0), (x >> 31).sum(0)]
        rows += len(x)
    i = [-1, *range(d), *range(d)]
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(i, pa.int32()),
                                      pa.array([0] * (d + 1) + [31] * d, pa.int32()),
                                      pa.array([rows, *total.ravel().tolist()], pa.int64())], schema=SUMS)


def product_sums(batches: Iterator[pa.RecordBatch], centre: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred entries, by pair of dimensions and power of two."""
    d, total, added = len(centre), {}, 0
    middle, (i, j) = np.array(centre, np.int64), np.triu_indices(len(centre))

    def flush() -> Iterator[pa.RecordBatch]:
        for shift, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(np.full(len(i), shift), pa.int32()), pa.array(t[i, j])], schema=SUMS)
        total.clear()

    for b in batches:
        x = matrix(b.column("x"), d)
        for lo in range(0, len(x), ROWS):
            parts = [p.astype(np.float64) for p in limbs(x[lo:lo + ROWS] - middle)]
            for p, a in enumerate(parts):
                for q, c in enumerate(parts):
                    t = total.setdefault((p + q) * LIMB, np.zeros((d, d), np.int64))
                    t += (a.T @ c).astype(np.int64)
            added += 1
            if added % 100 == 0:  # a total has at most 100 x 5 sums below 2^53
                yield from flush()
    yield from flush()


def exact_sums(rows: DataFrame) -> dict[tuple[int, int], int]:
    """(i, j) -> sum of v 2^shift, as Python integers: one entry for each pair of dimensions."""
    out: dict[tuple[int, int], int] = {}
    for r in rows.groupBy("i", "j", "shift").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["v"]) << r["shift"])
    return out


def extended(f: Fraction) -> np.longdouble:
    """``f`` in extended precision: its nearest double and the nearest double to the rest."""
    high = float(f)
    return np.longdouble(high) + np.longdouble(float(f - Fraction(high)))


def covariance(n: int, products: dict[tuple[int, int], int], rest: list[int]) -> tuple[np.ndarray, Fraction]:
    """The covariance in extended precision, and its exact trace.  ``rest``: sums of the centred entries."""
    d = len(rest)
    v, trace = np.zeros((d, d), np.longdouble), Fraction(0)
    for i in range(d):
        for j in range(i, d):
            f = Fraction(n * products.get((i, j), 0) - rest[i] * rest[j], n * n)
            v[i, j] = v[j, i] = extended(f)
            trace += f if i == j else 0
    return v, trace


# --- eigenvectors -------------------------------------------------------------------------------

def clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Index groups of two or more whose eigenvalues follow each other within ``delta``."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [g for g in np.split(order, breaks) if len(g) > 1]


def symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def orthogonal(x: np.ndarray) -> np.ndarray:
    """``x`` with its columns made orthonormal: the iteration's rule for equal eigenvalues, for all of them."""
    for _ in range(2):
        x = x + x @ symmetric(np.eye(len(x), dtype=x.dtype) - x.T @ x) / 2
    return x


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: better vectors, their values, the distance below which
    values count as a cluster, and the largest correction of vectors that are apart.

    The distance is 16 times the one the method needs at least, so that corrections are
    small and their squares do not matter."""
    r = symmetric(np.eye(len(a), dtype=a.dtype) - x.T @ x)
    s = symmetric(x.T @ (a @ x))
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    delta = 32 * float(np.sqrt((off ** 2).sum()) + np.sqrt((a ** 2).sum()) * np.sqrt((r ** 2).sum()))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > delta
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    return x + x @ e, values, delta, float(np.abs(np.where(far, e, 0)).max())


def split(a: np.ndarray, x: np.ndarray, group: np.ndarray, value: np.longdouble) -> None:
    """Turn the vectors of a cluster by the eigenvectors of its own problem."""
    sub = x[:, group]
    t = sub.T @ (a @ sub - value * sub)
    size = np.abs(t).max()
    if size > 0:
        t = ((t + t.T) / (2 * size)).astype(np.float64)
        x[:, group] = sub @ np.linalg.eigh(t)[1].astype(x.dtype)


def eigen(v: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric ``v``, falling, and unit eigenvectors (columns), each
    with its largest entry positive."""
    eps, size = np.finfo(v.dtype).eps, np.abs(v).max()
    if not size > 0:
        return np.zeros(len(v), v.dtype), np.eye(len(v), dtype=v.dtype)
    a = v / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(v.dtype)
    before, still = np.inf, 0
    for _ in range(steps):
        x, values, delta, change = refine(a, x)
        x = orthogonal(x)
        near = clusters(values, delta)
        # at the end the corrections are as small as the rounding of the products lets them be
        still = still + 1 if change <= 64 * len(a) * float(eps) or before / 2 < change < 1e-6 else 0
        before = change
        if still > (2 if near else 0):
            break
        for g in near:
            split(a, x, g, values[g].mean())
    x = orthogonal(x)
    x = x / np.sqrt((x ** 2).sum(0))
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * size, x[:, order]
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(len(a))])
    return values, x * sign


# --- whitening ----------------------------------------------------------------------------------

def project(x: np.ndarray, model: dict) -> np.ndarray:
    """(x - S / n) on the components over the roots of their eigenvalues; NaN where an eigenvalue is zero."""
    y = (x - model["centre"]).astype(np.float64) - model["shift"]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model["root"] > 0, (y @ model["vectors"]) / model["root"], np.nan)


def moments(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened values; with i = -1, their sums."""
    k, d = model["vectors"].shape[1], len(model["centre"])
    total = np.zeros((k + 1, k))
    for b in batches:
        w = np.nan_to_num(project(matrix(b.column("x"), d), model))
        total += np.vstack([w.sum(0), w.T @ w])
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel() - 1, pa.int32()), pa.array(j.ravel(), pa.int32()),
                                      pa.array(total.ravel())], schema=MOMENTS)


def identity_error(fit: DataFrame, n: int, model: dict) -> float | None:
    live = model["root"] > 0
    if not live.any():
        return None
    sums = fit.mapInArrow(partial(moments, model=model), "i int, j int, v double")
    total = {(r["i"], r["j"]): r["v"] / n for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    k = len(live)
    mean = np.array([total[-1, j] for j in range(k)])
    cov = np.array([[total[i, j] for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max())


def deviations(x: np.ndarray, n: int, model: dict) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; null beyond the range of a long."""
    if not x.size:
        return []
    y, rest = x - model["centre"], model["rest"]
    largest = n * int(np.abs(y).max()) + max(map(abs, rest))
    if largest ** 2 * x.shape[1] < 1 << 63:
        z = n * y - np.array(rest, np.int64)
        return (z * z).sum(1).tolist()
    z = n * y.astype(object) - np.array(rest, object)
    return [v if v < 1 << 63 else None for v in (z * z).sum(1)]


def whitened_rows(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    k, n = model["vectors"].shape[1], model["n"]
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            x = matrix(part.column("x"), len(model["centre"]))
            w = project(x, model).ravel()
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows), n), pa.int64()), pa.array(deviations(x, n, model), pa.int64()).take(pa.array(rows)),
                pa.array(w, mask=np.isnan(w)), pa.array(model["explained"] * len(x), pa.float64()),
                pa.array([model["identity_error"]] * len(rows), pa.float64())], schema=OUT)


def fit_model(fit: DataFrame, d: int, components: int) -> dict:
    """What whitening needs, from the distinct integer vectors ``fit`` (column x, length d)."""
    sums = exact_sums(fit.mapInArrow(partial(entry_sums, d=d), SUMS_DDL))
    n, s = sums[-1, -1], [sums[i, i] for i in range(d)]
    centre = [round(Fraction(t, n)) for t in s]
    rest = [t - n * c for t, c in zip(s, centre)]
    products = exact_sums(fit.mapInArrow(partial(product_sums, centre=centre), SUMS_DDL))
    v, trace = covariance(n, products, rest)
    values, vectors = eigen(v)
    k = min(components, d)
    values = np.where(values > ZERO * values[0], values, 0)[:k].astype(np.float64)
    model = {"n": n, "sums": s, "centre": np.array(centre, np.int64), "rest": rest,
             "shift": np.array([float(Fraction(r, n)) for r in rest]), "values": values, "root": np.sqrt(values),
             "vectors": vectors[:, :k].astype(np.float64),
             "explained": [float(e) / float(trace) if trace else None for e in values]}
    return model | {"identity_error": identity_error(fit, n, model)}


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """A row for each valid row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    ship(__name__)
    spark = df.sparkSession
    named = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = stored(named.filter(finite(F.col("v"))).select("vec_id", integers(F.col("v"), scale).alias("x")), "whitening")
    lengths = rows.agg(F.min(F.size("x")).alias("shortest"), F.max(F.size("x")).alias("d")).first()
    if not lengths["d"]:
        return spark.createDataFrame([], OUT_DDL)
    rows = filled(rows, lengths["shortest"], lengths["d"])
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    model = fit_model(fit, lengths["d"], components)
    return rows.mapInArrow(partial(whitened_rows, model=model), OUT_DDL)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
