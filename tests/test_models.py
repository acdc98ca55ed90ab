"""Fitted models: planted structure is found, and what SQL can state holds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import trips_frame
from glenfare.operators import forecast, segment, series
from glenfare.operators.features import with_features

T0 = dt.datetime(2024, 3, 4)


def _trip(ts, dist, dur, fare, pax=1, tip=1.0):
    return (ts, "G11AA", "G25QS", dist, dur, fare, "10%", tip, fare + tip, "Card", pax)


@pytest.fixture(scope="module")
def blobs(spark):
    """Four groups of trips, far apart in every measure."""
    rnd = random.Random(1)
    centres = [(2, 5, 6), (8, 15, 15), (20, 30, 40), (50, 70, 90)]
    rows = [_trip(T0 + dt.timedelta(minutes=i), *(c + rnd.uniform(-0.3, 0.3) for c in centres[i % 4])) for i in range(200)]
    return with_features(trips_frame(spark, rows)).cache()


def test_clusters_find_planted_groups(blobs):
    got = segment.customer_clusters(blobs, n_init=4).orderBy("cluster").collect()
    assert [r["size"] for r in got] == [50] * 4 and all(r["pct"] == 25.0 for r in got)
    assert [round(r["distance_km_mean"]) for r in got] == [2, 8, 20, 50]
    prof = segment.cluster_profiles(blobs, n_init=4).collect()
    assert [r["fare_rank"] for r in prof] == [1, 2, 3, 4]
    assert [r["category"] for r in prof] == ["Short Local Trips", "Medium Distance Trips", "Long Distance Trips",
                                             "Long Distance Trips"]
    high = segment.cluster_highlights(blobs, n_init=4).first()
    assert (high["most_valuable_cluster"], high["highest_revenue_cluster"], high["largest_size"]) == (3, 3, 50)


@pytest.mark.parametrize("fn", [segment.kmeans_elbow, segment.trip_pattern_elbow, segment.fleet_temporal_elbow])
def test_inertia_falls_with_k(blobs, fn):
    rows = fn(blobs, ks=range(2, 5), n_init=2).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4]
    assert all(a["inertia"] >= b["inertia"] - 1e-9 for a, b in zip(rows, rows[1:]))


def test_other_clusterings_keep_every_row(blobs):
    n = blobs.count()
    for fn in (segment.trip_patterns, segment.fleet_temporal_clusters):
        assert fn(blobs, n_init=2).agg(F.sum("size")).first()[0] == n


@pytest.fixture(scope="module")
def linear(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        d, m, p, h = rnd.uniform(1, 30), rnd.uniform(2, 60), rnd.randint(1, 4), rnd.randrange(24)
        rows.append(_trip(T0 + dt.timedelta(days=i % 9, hours=h), d, m, 3 + 1.5 * d + 0.2 * m + 0.5 * p - 0.1 * h, p))
    return with_features(trips_frame(spark, rows)).cache()


def test_linear_fare_is_recovered(linear):
    got = {r.term: r.value for r in forecast.fare_linear_regression(linear).collect()}
    assert got == pytest.approx({"intercept": 3, "distance_km": 1.5, "duration_min": 0.2, "passenger_count": 0.5, "hour": -0.1},
                                abs=1e-3)


def test_fare_models_and_importance(linear, monkeypatch):
    monkeypatch.setattr(forecast, "_forest", lambda label, trees=10, seed=42, max_depth=8, real=forecast._forest:
                        real(label, 10, seed, 8))
    m = {r.model: r for r in forecast.fare_model_metrics(linear).collect()}
    assert m["Linear Regression"].r2 == pytest.approx(1, abs=1e-6) and m["Random Forest"].r2 > 0.8
    assert forecast.fare_model_assessment(linear).first().best_model == "Linear Regression"
    imp = forecast.fare_feature_importance(linear).orderBy("rank").collect()
    assert imp[0].feature == "distance_km" and sum(r.importance for r in imp) == pytest.approx(1, abs=1e-3)
    pred = forecast.fare_random_forest(linear)
    assert 40 < pred.count() < 130


def test_boosting_beats_the_mean_on_a_periodic_series(spark):
    rows = [_trip(T0 + dt.timedelta(hours=h), 5.0, 10.0, 10.0) for h in range(24 * 14) for _ in range(1 + (h % 24 >= 12) * 6)]
    split = series.forecast_split(series.forecast_features(with_features(trips_frame(spark, rows)))).cache()
    gbt = forecast.regression_metrics(forecast._tree_forecast(split, forecast._gbt().setMaxIter(10))[0], "actual").first()
    mean = forecast.regression_metrics(series.forecast_mean_baseline(split), "actual").first()
    naive = forecast.regression_metrics(series.forecast_seasonal_naive(split), "actual").first()
    assert gbt.n == mean.n == naive.n == 24
    assert gbt.mae < mean.mae / 3 and naive.mae == 0
