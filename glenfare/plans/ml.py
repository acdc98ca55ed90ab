"""Shared Spark ML plumbing: scaling, K-Means with restarts, relabelling.

* ``scale``: (x - mean) / population std from one broadcast row of moments
  (a zero-variance column scales to 0), assembled into one vector column.
* ``best_kmeans``: ``pyspark.ml.clustering.KMeans`` fitted with ``n_init``
  seeds on at most about ``POINTS`` points.  Fits are Spark jobs; they are submitted
  from a small driver thread pool so the scheduler can overlap their stages.
  Up to ``POINTS`` rows are the points themselves.  More rows are summed up in
  cells (every row in one; a point is a cell's mean, weighted with its rows),
  as wide as it takes to have few of them.
* ``refine``: Lloyd's iteration over all rows, from the centres of every seed at once,
  until no centre moves further than the tolerance.  Starting beside a fixed point
  it needs few passes, where a fit on the rows needs up to 300 for each seed.  The cost
  of a fit is that over all rows, and the lowest wins.
* ``kept_kmeans``: the same, fitted once for given rows and parameters (``plans/models.py``).
* ``label``: K-Means cluster ids are arbitrary; clusters are renumbered
  0..k-1 by ascending centre (first feature, then the next), so results are
  reproducible and comparable across runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.plans.joins import attach_scalars
from glenfare.plans.models import fit_once, key_of, versioned

#: Rows up to which the seeds run on the rows themselves, and the aim for the number of cells.
POINTS = 100_000
#: Widths of a cell, in standard deviations.
WIDTHS = [2.0 ** e for e in range(-5, 4)]


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` cached while several passes read it."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def scale(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Append ``z_<col>`` standardised columns and the assembled vector ``out``."""
    m = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))])
    j = attach_scalars(df, m)
    z = {f"z_{c}": F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}"))
                    .otherwise(F.lit(0.0)) for c in cols}
    s = j.withColumns(z).drop(*[f"_{p}_{c}" for c in cols for p in ("mu", "sd")])
    return VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol=out).transform(s)


class Centres:
    """The k centres of a fit, in the scaled space, numbered by ascending centre: saved as k rows."""

    def __init__(self, centres, spark: SparkSession):
        self.centres = sorted(tuple(float(v) for v in c) for c in centres)
        self.spark = spark

    def write(self) -> Centres:
        return self

    def save(self, path: str) -> None:
        rows = [(i, list(c)) for i, c in enumerate(self.centres)]
        self.spark.createDataFrame(rows, "cluster int, centre array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, path: str) -> Centres:
        spark = SparkSession.getActiveSession()
        return cls([r["centre"] for r in spark.read.parquet(path).collect()], spark)


class Scaled:
    """Rows without nulls in ``cols``, with what one scan tells about them: version, number, means and deviations."""

    def __init__(self, data: DataFrame, cols: list[str]):
        moments = [f(F.col(c).cast("double")) for f in (F.avg, F.stddev_pop) for c in cols]
        self.data, self.cols = data, cols
        self.seen, row = versioned(data, cols, *moments)
        self.n, d = row[0], len(cols)
        self.mean, self.std = ([float(v or 0.0) for v in row[i:i + d]] for i in (4, 4 + d))

    def z(self) -> list[Column]:
        return [(F.col(c) - F.lit(m)) / F.lit(s) if s > 0 else F.lit(0.0) for c, m, s in zip(self.cols, self.mean, self.std)]


def _kmeans(k: int, seed: int, max_iter: int = 300, tol: float = 1e-2) -> KMeans:
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol / k ** 0.5, featuresCol="features",
                  predictionCol="cluster_raw")


def best_kmeans(points: DataFrame, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300,
                tol: float = 1e-2, threads: int = 8) -> list[tuple[float, np.ndarray]]:
    """(cost, centres) of the fits with ``n_init`` seeds, lowest cost first (caller persists ``points``).

    ``tol`` bounds the root of the total squared shift of all centres between
    iterations, in standard deviations (features are standardised): 1e-2 is the
    usual total of 1e-4 of the mean variance.  Spark tests each centre, so it gets
    ``tol / sqrt(k)``, which implies the bound on the total."""

    def fit(s: int) -> tuple[float, np.ndarray]:
        e = _kmeans(k, s, max_iter, tol)
        m = (e.setWeightCol("weight") if "weight" in points.columns else e).fit(points)
        return float(m.summary.trainingCost), np.array(m.clusterCenters())

    with ThreadPoolExecutor(max_workers=max(1, min(threads, n_init))) as pool:
        return sorted(pool.map(fit, [seed + i for i in range(n_init)]), key=lambda f: f[0])


def cells(rows: Scaled) -> DataFrame:
    """(features, weight): every row of ``rows`` counted in its cell, a box of the scaled space; a point is its cell's mean.
    The narrowest width with at most ``POINTS`` cells (estimated by sketches, in one scan), else the widest."""

    def box(width: float) -> list[Column]:
        return [F.floor(z / F.lit(width)) for z in rows.z()]

    counts = rows.data.agg(*[F.approx_count_distinct(F.xxhash64(*box(w))) for w in WIDTHS]).first()
    width = next((w for w, n in zip(WIDTHS, counts) if n <= POINTS), WIDTHS[-1])
    zs, keys = [f"z_{i}" for i in range(len(rows.cols))], [f"_b{i}" for i in range(len(rows.cols))]
    boxed = rows.data.select(*[z.alias(n) for z, n in zip(rows.z(), zs)]).select(
        *zs, *[F.floor(F.col(n) / F.lit(width)).alias(b) for n, b in zip(zs, keys)])
    means = boxed.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in zs], F.count(F.lit(1)).cast("double").alias("weight"))
    # a few megabytes, read by hundreds of small jobs
    return VectorAssembler(inputCols=zs, outputCol="features").transform(means).select("features", "weight").coalesce(2)


def lloyd_step(rows: Scaled, starts: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """For each start: the cost of its centres over all rows, and the means of the rows nearest to each of them (a centre
    without rows stays).  One pass; a task returns the sums of its rows, one for each start and centre."""
    mean, std = np.array(rows.mean), np.array(rows.std)
    centres, d, names = [np.array(c) for c in starts], len(rows.cols), list(rows.cols)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total = [np.zeros((len(c), d + 2)) for c in centres]
        scale = np.where(std > 0, std, 1.0)
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            z = np.where(std > 0, (x - mean) / scale, 0.0)
            own = np.column_stack([z, np.ones(len(z)), (z * z).sum(1)])
            for c, t in zip(centres, total):
                part = (c * c).sum(1) - 2.0 * (z @ c.T)  # the squared distance less that of the row from the origin
                near = part.argmin(1)
                own_part = own.copy() if len(total) > 1 else own
                own_part[:, d + 1] += part[np.arange(len(z)), near]
                t += (near == np.arange(len(c))[:, None]).astype(float) @ own_part
        flat = [(i, j, *r) for i, t in enumerate(total) for j, r in enumerate(t.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*flat)], names=["start", "cluster", *[f"s{i}" for i in range(d)], "n", "cost"])

    fields = [*[f"s{i}" for i in range(d)], "n", "cost"]
    parts = rows.data.select(*names).mapInArrow(sums, f"start long, cluster long, {', '.join(f'{f} double' for f in fields)}")
    found = parts.groupBy("start", "cluster").agg(*[F.sum(f).alias(f) for f in fields]).collect()
    means, costs = [c.copy() for c in centres], [0.0] * len(centres)
    for r in found:
        costs[r["start"]] += max(r["cost"], 0.0)
        if r["n"] > 0:
            means[r["start"]][r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(d)]
    return list(zip(costs, means))


def refine(rows: Scaled, fits: list[tuple[float, np.ndarray]], max_iter: int = 300, tol: float = 1e-2) -> tuple[np.ndarray, float]:
    """The centres of lowest cost that Lloyd's iteration over all rows reaches from ``fits``, and that cost.  Fits whose centres lie
    within the tolerance of another's are one start."""
    limit, left, ended = tol / len(fits[0][1]) ** 0.5, [], []
    for _, c in fits:
        c = np.array(sorted(c.tolist()))
        if not any(np.sqrt(((c - o) ** 2).sum(1)).max() <= limit for o in left):
            left.append(c)
    for turn in range(max_iter):
        again = []
        for c, (cost, means) in zip(left, lloyd_step(rows, left)):
            if turn + 1 == max_iter or np.sqrt(((means - c) ** 2).sum(1)).max() <= limit:
                ended.append((cost, c))
            else:
                again.append(means)
        left = again
        if not left:
            break
    cost, c = min(ended, key=lambda e: e[0])
    return c, float(cost)


def kept_kmeans(rows: Scaled, points: DataFrame | None, k: int, n_init: int = 10, seed: int = 42) -> tuple[Centres, float]:
    """The best of ``n_init`` fits and its cost over all rows, fitted once for the version of ``rows``.  ``points``: those that
    the seeds run on, where the caller holds them already."""
    spark = rows.data.sparkSession

    def fit():
        if points is None:
            with held(points_of(rows)) as some:
                fits = best_kmeans(some, k, n_init, seed)
        else:
            fits = best_kmeans(points, k, n_init, seed)
        if rows.n <= POINTS:  # the points were the rows
            return Centres(fits[0][1], spark), fits[0][0]
        c, cost = refine(rows, fits)
        return Centres(c, spark), cost

    return fit_once(spark, key_of(_kmeans(k, seed), n_init, rows.seen), fit, Centres)


def points_of(rows: Scaled) -> DataFrame:
    """The rows, scaled, or their cells where there are more than ``POINTS``."""
    return scale(rows.data, rows.cols) if rows.n <= POINTS else cells(rows)


def kmeans_elbow(data: DataFrame, cols: list[str], ks, n_init: int = 10, seed: int = 42) -> list[tuple[int, float]]:
    """(k, inertia) for each k.  k = 1 is closed-form: the total squared
    deviation from the mean, i.e. the sum of squared standardised values."""
    out = []
    with held(data):
        rows = Scaled(data, cols)
        with held(points_of(rows)) as points:
            for k in ks:
                if k == 1:
                    tot = data.agg(F.sum(sum((z * z for z in rows.z()), F.lit(0.0)))).first()[0]
                    out.append((1, float(tot or 0.0)))
                else:
                    out.append((k, kept_kmeans(rows, points, k, n_init, seed)[1]))
    return out


def cluster(df: DataFrame, cols: list[str], k: int, n_init: int = 10, seed: int = 42, cached: bool = False) -> DataFrame:
    """Scale ``cols``, fit K-Means (k capped at the row count) and return the
    rows with a deterministic ``cluster`` id; rows with a null feature are
    dropped first, as the reference does.  ``cached``: the caller holds the rows already."""
    data = df.dropna(subset=cols)
    narrow = data.select(*cols)
    if not cached:
        narrow.persist(StorageLevel.MEMORY_AND_DISK)  # for the passes of the fit; the result is a lazy plan on ``df``
    try:
        rows = Scaled(narrow, cols)
        k = min(k, rows.n)
        if k < 1:
            return data.withColumn("cluster", F.lit(None).cast("int"))
        if k == 1:
            return data.withColumn("cluster", F.lit(0))
        model, _ = kept_kmeans(rows, None, k, n_init, seed)
    finally:
        if not cached:
            narrow.unpersist()
    return label(data, rows, model)


def label(data: DataFrame, rows: Scaled, model: Centres) -> DataFrame:
    """``data`` plus ``cluster``, the number of the nearest centre (of equally near ones, the first)."""
    zs = [f"_z_{c}" for c in rows.cols]

    def distance(centre) -> Column:
        return sum(((F.col(z) - F.lit(v)) * (F.col(z) - F.lit(v)) for z, v in zip(zs, centre)), F.lit(0.0))
    near = data.withColumns(dict(zip(zs, rows.z()))).withColumn("_far", F.array(*[distance(c) for c in model.centres]))
    return near.withColumn("cluster", (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop(*zs, "_far")
