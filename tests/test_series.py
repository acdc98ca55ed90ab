"""Window buckets with copied rows, and the seasonal autoregression."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glenfare.operators import series

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts_hour timestamp_ntz, trip_count bigint, split string"


def planted(spark, n, seed, key, hold_out=24):
    rnd = random.Random(seed)
    y = [rnd.randint(80, 120) for _ in range(25)]
    while len(y) < n:
        y.append(max(0, round(30 + 0.6 * y[-1] + 0.5 * y[-24] - 0.3 * y[-25] + rnd.gauss(0, 4) - 0.1 * y[-2])))
    return [(key, T0 + dt.timedelta(hours=i), v, "test" if i >= n - hold_out else "train") for i, v in enumerate(y)]


@pytest.mark.parametrize("bucket", [1, 24, 25, 97, 4096])
def test_buckets_change_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(series, "BUCKET_HOURS", bucket)
    rows = planted(spark, 130, 1, "a") + planted(spark, 61, 2, "b")
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.ts_hour): r for r in series.add_past(df, ["k"]).collect()}
    assert len(got) == len(rows)
    for key in "ab":
        y = [r for r in rows if r[0] == key]
        v = [r[2] for r in y]
        for i, (_, ts, _, _) in enumerate(y):
            r = got[key, ts]
            assert [r[f"lag_{k}"] for k in series.LAGS] == [v[i - k] if i >= k else None for k in series.LAGS]
            assert r.rolling_mean_3 == (pytest.approx(np.mean(v[i - 3:i])) if i >= 3 else None)
            assert r.rolling_std_24 == (pytest.approx(np.std(v[i - 24:i], ddof=1)) if i >= 24 else None)


def test_every_window_has_partitions(spark):
    df = spark.createDataFrame(planted(spark, 60, 3, "a"), SCHEMA).drop("k")
    plan = series.add_past(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_bucket" in plan


def test_seasonal_ar_beats_the_naive_forecast_and_matches_least_squares(spark):
    rows = planted(spark, 24 * 60, 5, "a") + planted(spark, 24 * 40, 6, "b")
    df = spark.createDataFrame(rows, SCHEMA).cache()
    coef = {r.k: r for r in series.ar_coefficients(series.ar_moments(df, ["k"])).collect()}
    for key in "ab":
        v = np.array([r[2] for r in rows if r[0] == key and r[3] == "train"], float)
        x = np.column_stack([np.ones(len(v) - 25), v[24:-1], v[1:-24], v[:-25]])
        want = np.linalg.lstsq(x, v[25:], rcond=None)[0]
        assert [coef[key][c] for c in ("b0", "b1", "b24", "b25")] == pytest.approx(list(want), rel=1e-6, abs=1e-8)
        path = list(v)
        for _ in range(24):
            path.append(want @ [1, path[-1], path[-24], path[-25]])
        got = [r.prediction for r in series.forecast_seasonal_ar(df, ["k"]).filter(F.col("k") == key).orderBy("ts_hour").collect()]
        assert got == pytest.approx(path[-24:], abs=1e-3)

    def error(forecast):
        return forecast.agg(F.avg(F.pow(F.col("actual") - F.col("prediction"), 2))).first()[0]
    assert error(series.forecast_seasonal_ar(df, ["k"])) < error(series.forecast_seasonal_naive(df, ["k"]))


def test_seasonal_ar_edges(spark):
    """A constant series, one of a few hours, gaps, one without hold-out or training rows, and no row at all."""
    hour = lambda i: T0 + dt.timedelta(hours=i)
    rows = [("constant", hour(i), 7, "test" if i >= 60 else "train") for i in range(66)]
    rows += [("short", hour(i), i + 1, "test" if i >= 3 else "train") for i in range(5)]
    rows += [r for i, r in enumerate(planted(spark, 200, 7, "gaps")) if i not in (50, 51, 172, 190)]
    rows += [("no hold-out", hour(i), 3, "train") for i in range(40)] + [("no training", hour(1), 3, "test")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in series.forecast_seasonal_ar(df, ["k"]).collect():
        got.setdefault(r.k, []).append(r.prediction)
    assert got["constant"] == [7.0] * 6 and got["short"] == [2.0] * 2 and got["no training"] == [None]
    assert len(got["gaps"]) == 23 and None not in got["gaps"] and "no hold-out" not in got
    assert series.forecast_seasonal_ar(df.limit(0), ["k"]).count() == 0
    assert series.forecast_seasonal_ar(df.limit(0).drop("k")).count() == 0
