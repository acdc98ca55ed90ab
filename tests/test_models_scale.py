"""Fits on more rows than the restarts run on, and what a fit's stages read."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from conftest import trips_frame
from glenfare.operators import forecast, segment
from glenfare.operators.features import with_features
from glenfare.plans import ml

T0 = dt.datetime(2024, 3, 4)


def _trips(spark, n, seed=3):
    rnd = random.Random(seed)
    rows = [(T0 + dt.timedelta(hours=i % 300), f"G{1 + i % 4}1AA", "G25QS", d, 2 * d + rnd.uniform(0, 9), 3 + d + rnd.uniform(0, 5),
             f"{i % 9}%", 1.0 + i % 3, 5 + 2 * d, "Card", 1 + i % 3) for i in range(n) for d in [rnd.uniform(1, 30)]]
    return with_features(trips_frame(spark, rows))


@pytest.fixture
def small_points(monkeypatch):
    """The seeds run on some 60 cells; the sizes of what they were fitted on."""
    seen, own = [], KMeans._fit
    monkeypatch.setattr(ml, "POINTS", 60)
    monkeypatch.setattr(KMeans, "_fit", lambda self, df: (seen.append(df.count()), own(self, df))[1])
    return seen


def _brute(rows, cols, centres):
    x = np.array([[float(r[c]) for c in cols] for r in rows])
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    far = ((z[:, None, :] - np.array(centres)[None]) ** 2).sum(2)
    return z, far.argmin(1), far.min(1).sum()


def test_restarts_read_cells_and_centres_fit_all_rows(spark, small_points):
    cols = segment.REPORT_FEATURES
    data = _trips(spark, 900).select(*cols)
    rows = ml.Scaled(data, cols)
    model, cost = ml.kept_kmeans(rows, None, 3, n_init=3)
    assert len(small_points) == 3 and max(small_points) < 200  # 900 rows
    z, near, brute = _brute(data.collect(), cols, model.centres)
    assert cost == pytest.approx(brute, rel=1e-9)
    means = np.array([z[near == i].mean(0) for i in range(3)])
    assert np.sqrt(((means - np.array(model.centres)) ** 2).sum(1)).max() <= 1e-2 / 3 ** 0.5
    got = ml.cluster(data, cols, 3, n_init=3).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == dict(enumerate(np.bincount(near)))


def test_cells_hold_every_row(spark, small_points):
    cols = segment.REPORT_FEATURES
    rows = ml.Scaled(_trips(spark, 700).select(*cols), cols)
    got = ml.cells(rows).agg(F.sum("weight"), F.count(F.lit(1))).first()
    assert got[0] == 700 and got[1] < 200


def test_one_step_of_several_starts_and_an_empty_centre(spark):
    data = spark.createDataFrame([(float(v), 7) for v in (0, 1, 10, 11)], "a double, b int")
    rows = ml.Scaled(data, ["a", "b"])  # b does not vary: it is 0
    sd = np.std([0, 1, 10, 11])
    at = [(v - 5.5) / sd for v in (0, 1, 10, 11)]
    (c1, m1), (c2, m2) = ml.lloyd_step(rows, [np.array([[at[0], 0], [at[2], 0]]), np.array([[0.0, 0], [99.0, 0]])])
    assert c1 == pytest.approx(2 / sd ** 2) and m1[:, 0] == pytest.approx([(at[0] + at[1]) / 2, (at[2] + at[3]) / 2])
    assert c2 == pytest.approx(4.0) and m2[1].tolist() == [99.0, 0.0]


@pytest.mark.parametrize("fn", [segment.price_clusters, segment.time_clusters, segment.comprehensive_clusters,
                                segment.trip_patterns, segment.fleet_temporal_clusters])
def test_clusterings_over_cells_keep_every_row(spark, small_points, fn):
    f, kept = _trips(spark, 400), spark.sparkContext._jsc.getPersistentRDDs
    n, before = f.count(), set(kept())
    if fn not in (segment.trip_patterns, segment.fleet_temporal_clusters):
        n = segment._clustering_data(f).count()
    assert fn(f, n_init=2).agg(F.sum("size")).first()[0] == n and set(kept()) <= before


def test_zone_clusters_read_stored_areas(spark):
    from contextlib import redirect_stdout
    from io import StringIO
    out = StringIO()
    with redirect_stdout(out):
        segment.zone_clusters(_trips(spark, 200), n_init=2).explain()
    assert "zones-" in out.getvalue() and "ExistingRDD" not in out.getvalue()


def test_train_rows_are_dealt_evenly(spark, monkeypatch):
    few = spark.range(0, 1000, 1, 3).selectExpr("cast(id as double) a")
    assert forecast._dealt(few, 1000).rdd.getNumPartitions() == 3
    monkeypatch.setattr(forecast, "FEW_ROWS", 100)
    monkeypatch.setattr(forecast, "MOST_ROWS", 200)
    cores = spark.sparkContext.defaultParallelism
    for rows in (1000, 5000):
        got = forecast._dealt(spark.range(0, rows, 1, 1).selectExpr("cast(id as double) a"), rows).rdd.glom().map(len).collect()
        assert len(got) % cores == 0 and sum(got) == rows and max(got) <= max(200, 1.1 * rows / len(got))


def test_forecast_matrix_is_stored(spark):
    from io import StringIO
    from contextlib import redirect_stdout
    out = StringIO()
    with redirect_stdout(out):
        forecast._forecast_inputs(spark, "/root/testdata/sf0.001").explain()
    assert "forecast-matrix-" in out.getvalue() and "lineitem" not in out.getvalue()
