import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import trips_frame
from glenfare.operators import demand, quality, series, stats
from glenfare.operators.features import with_features


def _trip(ts, pu="G11AA", do="G25QS", dist=5.0, dur=10.0, fare=10.0, tip="10%", tipa=1.0, tot=11.0,
          pay="Card", pax=1):
    return (ts, pu, do, dist, dur, fare, tip, tipa, tot, pay, pax)


T0 = dt.datetime(2024, 3, 4, 8, 0)  # a Monday


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [_trip(T0 + dt.timedelta(hours=i), pu=pu, fare=f, tot=f + 1, dist=d)
            for i, (pu, f, d) in enumerate([("G11AA", 10.0, 5.0), ("G11AA", 12.0, 6.0), ("G22AA", 8.0, 4.0),
                                            ("G22AA", 20.0, 10.0), ("G33AA", 30.0, 0.0), ("G12 8QQ", 9.0, 3.0)])]
    rows.append(rows[0])                      # one duplicate row
    rows.append((None,) * 11)                 # an all-null row
    return trips_frame(spark, rows)


def test_features_schema_and_values(tiny):
    f = with_features(tiny)
    r = f.filter(F.col("ts") == T0).first()
    assert (r.hour, r.day_of_week, r.day_name, r.is_weekend, r.time_of_day) == (8, 0, "Monday", 0, "Morning")
    assert (r.pickup_area, r.pickup_area_type, r.country) == ("G1", "Commercial", "United Kingdom")
    z = f.filter(F.col("distance_km") == 0.0).first()
    assert z.revenue_per_km is None


def test_ties_key_ascending(tiny):
    top = demand.top_pickup_areas(with_features(tiny)).collect()
    # G1 has 3 trips (incl. the duplicate); G2 and G3 tie at... G2 2, G3 1
    assert [(r.area, r.trip_count) for r in top] == [("G1", 3), ("G2", 2), ("G3", 1)]


def test_duplicates_and_missing(tiny):
    d = quality.duplicate_rows(tiny).first()
    assert d.duplicate_rows == 1
    p = quality.missing_patterns(tiny).first()
    assert (p.all_null_rows, p.partial_null_rows) == (1, 0)
    mc = {r.column_name: r.missing_count for r in quality.missing_by_column(tiny).collect()}
    assert mc["ts"] == 1 and mc["payment_type"] == 1


def test_moments_bias_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10, 20]], "x double")
    st = quality.numeric_stats(df, ["x"]).first()
    s = pd.Series([1, 2, 3, 10, 20], dtype=float)
    assert st.q1 == 2.0 and st.median == 3.0 and st.q3 == 10.0
    assert math.isclose(st.skewness, round(s.skew(), 4), abs_tol=1e-4)
    assert math.isclose(st.kurtosis, round(s.kurt(), 4), abs_tol=1e-4)
    assert math.isclose(st.std, round(s.std(), 4), abs_tol=1e-4)


def test_iqr_bounds_contain_quartiles(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(rnd.gauss(0, 1),) for _ in range(500)], "x double")
    o = stats.outliers_iqr(df, ["x"]).first()
    assert o.lower_bound <= o.q1 <= o.q3 <= o.upper_bound


def test_constant_column_does_not_fail(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, x double")
    z = {r.column_name: r.outlier_count for r in stats.outliers_zscore(df, ["c", "x"]).collect()}
    assert z["c"] == 0
    corr = {(r.var1, r.var2): r.r for r in stats.correlation_pearson(df, ["c", "x"]).collect()}
    assert corr[("c", "x")] is None and corr[("x", "x")] == 1.0
    sp = {(r.var1, r.var2): r.r for r in stats.correlation_spearman(df, ["c", "x"]).collect()}
    assert sp[("c", "x")] is None and sp[("x", "x")] == 1.0


def test_correlations_match_pandas_pairwise(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(300):
        a = rnd.randint(0, 20)
        b = a * 2 + rnd.randint(-5, 5)
        c = None if rnd.random() < 0.2 else float(rnd.randint(0, 3))
        rows.append((float(a), float(b), c))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    for method, fn in [("pearson", stats.correlation_pearson), ("spearman", stats.correlation_spearman)]:
        got = {(r.var1, r.var2): r.r for r in fn(df, ["a", "b", "c"]).collect()}
        exp = pdf.corr(method=method)
        for (v1, v2), r in got.items():
            assert math.isclose(r, exp.loc[v1, v2], abs_tol=1e-6), (method, v1, v2, r, exp.loc[v1, v2])


def test_correlation_matrix_symmetric_unit_diagonal(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.random(), rnd.random()) for _ in range(50)], "x double, y double")
    m = {(r.var1, r.var2): r.r for r in stats.correlation_pearson(df, ["x", "y"]).collect()}
    assert m[("x", "y")] == m[("y", "x")] and m[("x", "x")] == 1.0


def test_series_zero_fill_and_full_window(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [_trip(base + dt.timedelta(hours=h)) for h in [0, 1, 4, 30, 31]]
    f = with_features(trips_frame(spark, rows))
    s = series.hourly_series(f).orderBy("ts_hour").collect()
    assert len(s) == 32 and sum(r.trip_count for r in s) == 5 and s[2].trip_count == 0
    r = series.add_rolling(series.hourly_series(f)).orderBy("ts_hour").collect()
    assert r[2].rolling_mean_3 is None and r[3].rolling_mean_3 == pytest.approx(2 / 3)
    assert r[23].rolling_mean_24 is None and r[24].rolling_mean_24 is not None


def test_rolling_never_reads_current_hour(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [_trip(base + dt.timedelta(hours=h)) for h in range(40) for _ in range(h % 5 + 1)]
    f = with_features(trips_frame(spark, rows))
    a = series.add_rolling(series.add_lags(series.hourly_series(f))).orderBy("ts_hour").collect()
    extra = rows + [_trip(base + dt.timedelta(hours=39))] * 7      # perturb the last hour only
    b = series.add_rolling(series.add_lags(series.hourly_series(with_features(trips_frame(spark, extra))))) \
        .orderBy("ts_hour").collect()
    last = len(a) - 1
    for c in ["lag_1", "lag_24", "rolling_mean_3", "rolling_mean_24", "rolling_std_24"]:
        assert a[last][c] == b[last][c]


def test_pareto_monotone_and_hourly_sum(spark):
    from glenfare.plans.registry import features
    f = features(spark, "/root/testdata/sf0.001")
    p = demand.pareto_pickup(f).orderBy("cum_share").collect()
    assert all(x.cum_share <= y.cum_share for x, y in zip(p, p[1:])) and all(x.cum_share <= 0.8 for x in p)
    assert demand.hourly_demand(f).agg(F.sum("trip_count")).first()[0] == f.filter("ts IS NOT NULL").count()


def test_repartition_invariance(spark):
    from glenfare.plans.registry import features
    f = features(spark, "/root/testdata/sf0.001")
    ref = sorted(demand.hourly_demand(f).collect())
    for n in (1, 7):
        assert sorted(demand.hourly_demand(f.repartition(n)).collect()) == ref


def test_empty_input(spark):
    empty = trips_frame(spark, [])
    f = with_features(empty)
    assert demand.hourly_demand(f).count() == 0
    assert quality.completeness_score(empty).first().total_rows == 0
    assert series.hourly_series(f).count() == 0
    assert stats.histogram(f, "total_amount").count() == 0


def test_anova_p_value_helper():
    # Reference values of the F(3, 20) and F(5, 10) upper tails.
    assert stats.f_sf(2.5, 3, 20) == pytest.approx(0.08884, abs=1e-4)
    assert stats.f_sf(3.0, 5, 10) == pytest.approx(0.06556, abs=1e-4)
    # F(2, d): the tail is (1 + 2 f / d) ** (-d / 2), at any size
    for d in (3, 50, 1e4, 6e4, 1e8, 1e13):
        for f in (0.01, 0.5, 1.0, 3.0, 9.0):
            assert stats.f_sf(f, 2, d) == pytest.approx(math.exp(-d / 2 * math.log1p(2 * f / d)), rel=1e-6)
    # chi-square limit: F(2k, inf) at f is the Poisson tail of k f
    assert stats.f_sf(1.0, 23, 1e13) == pytest.approx(stats.f_sf(1.0, 23, 1e11), rel=1e-6)
    assert math.isnan(stats.f_sf(None, 2, 3)) and stats.f_sf(0.0, 2, 3) == 1.0


def test_pearson_far_from_zero(spark):
    rows = [(1e8 + a, 1e8 + b) for a, b in [(0, 0), (1, 1), (2, 3), (3, 3), (4, 5)]]
    got = {(r.var1, r.var2): r.r for r in stats.correlation_pearson(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()}
    exp = pd.DataFrame(rows).corr().iloc[0, 1]
    assert got[("x", "y")] == pytest.approx(exp, abs=1e-6) and got[("x", "x")] == 1.0


def test_pareto_cuts_on_the_exact_share(spark):
    # 8,000,002 of 10,000,000 trips: a share of 0.8000002 is over 0.8
    f = spark.range(10_000_000).select(F.when(F.col("id") < 8_000_002, "A").otherwise("B").alias("pickup_area"))
    assert demand.pareto_pickup(f).count() == 0


def test_duplicate_rows_with_nulls(spark):
    rows = [(1, None), (None, 1), (1, None), (None, None), (None, None), (0, None)]
    assert quality.duplicate_rows(spark.createDataFrame(rows, "a int, b int")).first().duplicate_rows == 2


def test_load(spark):
    from glenfare.sources.schema import load
    with pytest.raises(ValueError):
        load(spark)
    rows = [_trip(T0), _trip(T0, tot=float("nan"))]
    frame = load(spark, trips_frame(spark, rows))
    from glenfare.operators import revenue
    r = revenue.revenue_metrics(with_features(frame)).first()
    assert r.total_revenue == 11.0
    assert quality.dataset_overview(frame).count() == 1
    assert all(x.outlier_pct is not None for x in stats.outliers_iqr(with_features(frame)).collect())


def test_rejected_cells_of_a_file(spark, tmp_path):
    from glenfare.sources import schema
    header = ",".join(schema.REFERENCE_HEADERS[c] for c in schema.TRIP_COLUMNS)
    lines = ["2024-01-01 10:00:00,G1 1AA,G2 2BB,3.5,10,8,10%,0.8,8.8,Card,1",
             "not a time,G1 1AA,,far,10,NaN,10%,,8.8,Card,two", ",,,,,,,,,,", "2024-01-01 11:00:00,G1 1AA,G2 2BB,1"]
    (tmp_path / "t.csv").write_text("\n".join([header, *lines]), encoding="utf-8")
    raw = schema.scan_trips_csv(spark, str(tmp_path / "t.csv"))
    got = {r.column_name: (r.cells, r.missing, r.rejected) for r in schema.rejected_cells(raw).collect()}
    assert got == {"ts": (4, 1, 1), "distance_km": (4, 1, 1), "duration_min": (4, 2, 0), "fare_amount": (4, 3, 0),
                   "tip_amount": (4, 3, 0), "total_amount": (4, 2, 0), "passenger_count": (4, 2, 1)}
    none = schema.rejected_cells(raw.limit(0)).collect()
    assert len(none) == 7 and all((r.cells, r.missing, r.rejected) == (0, 0, 0) for r in none)


@pytest.mark.parametrize("zone", ["UTC", "Europe/London"])
def test_series_does_not_read_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = [dt.datetime(2024, 3, 31, 0, 10), dt.datetime(2024, 3, 31, 1, 10, 5), dt.datetime(2024, 3, 31, 3, 59),
              dt.datetime(2024, 10, 27, 0, 30), dt.datetime(2024, 10, 27, 1, 0)]
        f = with_features(trips_frame(spark, [_trip(t) for t in ts]))
        s = series.hourly_series(f)
        assert s.dtypes[0] == ("ts_hour", "timestamp_ntz")
        hours = [r.ts_hour for r in s.orderBy("ts_hour").collect()]
        assert hours[0] == dt.datetime(2024, 3, 31) and len(hours) == len(set(hours)) == 210 * 24 + 2
        assert {r.ts_hour for r in s.filter("trip_count > 0").collect()} == {t.replace(minute=0, second=0) for t in ts}
        assert series.add_lags(s).filter("lag_24 = 1").count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_forecast_matrix_keeps_every_hour(spark):
    from glenfare.operators.series import weather_fixture
    from glenfare.plans.registry import features
    sf = "/root/testdata/sf0.001"
    f = features(spark, sf)
    n = series.hourly_series(f).count()
    m = series.forecast_split(series.forecast_features(f, weather=weather_fixture(spark, sf))).cache()
    assert m.count() == n - 24
    test = [r.ts_hour for r in m.filter("split = 'test'").orderBy("ts_hour").collect()]
    assert len(test) == 24 and test[-1] - test[0] == dt.timedelta(hours=23)
    naive = series.forecast_seasonal_naive(m).collect()
    lag = {r.ts_hour: r.lag_24 for r in m.collect()}
    drift = {round(r.prediction - lag[r.ts_hour], 3) for r in naive}
    assert max(drift) - min(drift) <= 0.0011


def test_keyed_series(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [_trip(base + dt.timedelta(hours=h), pay=p) for p, n in (("Card", 60), ("Cash", 80)) for h in range(n) for _ in range(h % 3 + 1)]
    f = with_features(trips_frame(spark, rows))
    events = spark.createDataFrame([(dt.date(2024, 1, 2), "fair")], "date date, name string")
    m = series.forecast_features(f, events=events, keys=["payment_type"])
    split = series.forecast_split(m, 12, ["payment_type"])
    got = {(r.payment_type, r.split): r["count"] for r in split.groupBy("payment_type", "split").count().collect()}
    assert got == {("Card", "test"): 12, ("Card", "train"): 24, ("Cash", "test"): 12, ("Cash", "train"): 44}
    assert m.filter("is_major_event = 1").select(F.to_date("ts_hour")).distinct().count() == 1
    assert series.forecast_mean_baseline(split, ["payment_type"]).count() == 24
    assert series.forecast_seasonal_naive(split, ["payment_type"]).filter("prediction IS NULL").count() == 0


def test_report_summary_without_known_areas(spark):
    from glenfare.plans.report import report_summary
    r = report_summary(trips_frame(spark, [_trip(T0, pu=None), _trip(T0, pu=None)])).collect()
    assert len(r) == 1 and r[0].total_trips == 2 and r[0].top_pickup_area is None


def test_geo_revenue_joins_areas(spark):
    from glenfare.operators import revenue
    areas = spark.createDataFrame([("G1", "Centre", 55.8, -4.2)], "area string, name string, lat double, lon double")
    f = with_features(trips_frame(spark, [_trip(T0), _trip(T0, pu="G22AA")]))
    got = {r.pickup_area: r["name"] for r in revenue.geo_revenue(f, areas).collect()}
    assert got["G1"] == "Centre" and got.get("G2") is None


def test_report_has_every_section(spark, tiny):
    from glenfare.plans.report import report
    parts = report(tiny, persist=False)
    assert len(parts) == 18 and all(p for p in parts.values())
    for section, name in [("data_overview", "dataset_overview"), ("pricing_analysis", "price_by_distance_bin"),
                          ("fleet_optimization", "fleet_summary"), ("geospatial_map", "geo_revenue"), ("business", "summary"),
                          ("postcode_demand", "pareto_pickup"), ("demand_forecast", "hourly_forecasts")]:
        assert parts[section][name]().count() >= 0, (section, name)


def test_numeric_stats_runs_as_generated_code(spark):
    """Spark leaves generated code for an aggregate of more fields than its limit: all moments of seven columns were 127."""
    def widest(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return widest(plan.inputPlan())
        own = plan.output().size() if "Aggregate" in plan.nodeName() else 0
        return max([own, *[widest(plan.children().apply(k)) for k in range(plan.children().size())]])
    df = spark.createDataFrame([tuple(float(k * j) for j in range(7)) for k in range(9)], [f"c{j}" for j in range(7)])
    plan = quality.numeric_stats(df, df.columns)._jdf.queryExecution().executedPlan()
    assert 0 < widest(plan) <= int(spark.conf.get("spark.sql.codegen.maxFields"))


def test_numeric_stats_of_columns_with_nulls_and_without_rows(spark):
    rnd = random.Random(8)
    rows = [(None if k % 5 == 0 else rnd.gauss(3, 2), k % 4, None, 1e6 if k == 7 else float(k), 0.1) for k in range(60)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(4)
    got = quality.numeric_stats(df, list("abcde")).collect()
    assert [r.column_name for r in got] == list("abcde")
    for r, c in zip(got, zip(*rows)):
        s = pd.Series([math.nan if v is None else float(v) for v in c])
        if s.count() == 0:
            assert r.mean is r.std is r["min"] is r.skewness is r.lower_bound is None and (r.outlier_count, r.outlier_pct) == (0.0, 0.0)
            continue
        lo, hi = (s.quantile(p) + k * (s.quantile(0.75) - s.quantile(0.25)) for p, k in ((0.25, -1.5), (0.75, 1.5)))
        out = int(((s < lo) | (s > hi)).sum())
        assert [r.mean, r.std, r["min"], r["max"]] == pytest.approx([s.mean(), s.std(), s.min(), s.max()], abs=6e-5)
        assert (r.outlier_count, r.outlier_pct) == (out, round(out / 60 * 100, 4))
        if s.nunique() == 1:
            assert r.skewness is r.kurtosis is None
        else:
            assert (r.skewness, r.kurtosis) == pytest.approx((s.skew(), s.kurt()), abs=6e-5)
    none = quality.numeric_stats(df.filter("b > 9"), list("abc")).collect()
    assert [(r.column_name, r.outlier_count, r.outlier_pct, r.mean) for r in none] == [(c, 0.0, None, None) for c in "abc"]
