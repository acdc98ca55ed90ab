"""Hourly demand series, lags, rolling windows and forecast features
(WIN1-WIN5, EXP17, EXP18, FOR3, FOR4).

Scale notes.  The series has one row per hour of the covered time span (per
key when ``keys`` are given), not per trip: the trips are reduced by one
grouped aggregate first.  Ordered windows (lags, rolling frames) run in buckets of
BUCKET_HOURS hours; the rows that a bucket's first hours look back on are copied
into it, so that each bucket of each key is a window partition of its own, however
long the span.  The dense hour grid comes from ``sequence`` + ``explode`` of the
span per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.oracle import holiday_case, with_ctes
from glenfare.plans.joins import attach_scalars

LAGS = (1, 2, 3, 24)
ROLLING = ((3, "mean"), (24, "mean"), (24, "std"))
#: Hours in a window partition.
BUCKET_HOURS = 4096

# Weather thresholds (mm, degrees C) and calendar month sets.
RAIN_MM, COLD_C, HOT_C = 5.0, 5.0, 20.0
WINTER, SUMMER, FESTIVAL = (12, 1, 2), (6, 7, 8), (8, 12)

FORECAST_FEATURES = [
    "hour", "day_of_week", "is_weekend", "lag_1", "lag_2", "lag_3", "lag_24",
    "rolling_mean_3", "rolling_mean_24", "rolling_std_24",
    "temperature", "precipitation", "is_rainy", "is_cold", "is_hot",
    "is_holiday", "is_bank_holiday", "is_major_event",
    "is_rush_hour", "is_late_night", "is_lunch_time",
    "is_winter", "is_summer", "is_festival_season",
    "rainy_rush_hour", "cold_weekend", "event_weekend",
]
WEATHER_FEATURES = {"temperature", "precipitation", "is_rainy", "is_cold", "is_hot", "rainy_rush_hour", "cold_weekend"}


def hour_number(ts) -> Column:
    """Hours since 1970 of a zone-less timestamp."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)


def with_history(series: DataFrame, keys: list[str], halo: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``series`` plus window columns that look back at most ``halo`` hours.

    ``columns`` gets the window of a bucket of hours, ordered by hour number.  A row goes to its own bucket and to those
    that begin within ``halo`` hours after it; there it is only looked back on, and leaves again."""
    h = F.col("_hour_number")
    own = F.floor(h / BUCKET_HOURS)
    rows = series.withColumn("_hour_number", hour_number("ts_hour")).withColumn("_own_bucket", own)
    rows = rows.withColumn("_bucket", F.explode(F.sequence("_own_bucket", F.floor((h + halo) / BUCKET_HOURS))))
    out = rows.withColumns(columns(Window.partitionBy(*keys, "_bucket").orderBy("_hour_number")))
    return out.filter(F.col("_bucket") == F.col("_own_bucket")).drop("_hour_number", "_own_bucket", "_bucket")


def clock_hour(ts: str):
    """The hour of a zone-less timestamp, by subtraction: ``date_trunc`` would go
    through the session's time zone and shift or repeat hours at clock changes."""
    return F.expr(f"{ts} - make_dt_interval(0, 0, minute({ts}), extract(SECOND FROM {ts}))")


def hourly_series(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trips per clock hour with zero-filled gaps (WIN1).

    Grid per key: ``explode(sequence(first hour, last hour, 1 hour))``; the
    counts are left-joined on (keys, hour), so an empty hour gets 0.
    """
    keys = list(keys or [])
    base = features.filter(F.col("ts").isNotNull())
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    counts = (base.groupBy(*keys, clock_hour("ts").alias("ts_hour"))
              .agg(F.count(F.lit(1)).alias("trip_count")))
    span = counts.groupBy(*keys).agg(F.min("ts_hour").alias("_lo"), F.max("ts_hour").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 HOUR"))).alias("ts_hour"))
    return (grid.join(counts, [*keys, "ts_hour"], "left")
            .select(*keys, "ts_hour",
                    F.coalesce("trip_count", F.lit(0)).cast("bigint").alias("trip_count")))


def _lag_columns(lags) -> Callable[[WindowSpec], dict[str, Column]]:
    return lambda w: {f"lag_{k}": F.lag("trip_count", k).over(w) for k in lags}


def _rolling_columns(windows) -> Callable[[WindowSpec], dict[str, Column]]:
    def columns(w0):
        out = {}
        for n, fn in windows:
            w = w0.rowsBetween(-n, -1)
            full = F.count("trip_count").over(w) == n
            v = F.avg("trip_count").over(w) if fn == "mean" else F.stddev_samp("trip_count").over(w)
            out[f"rolling_{fn}_{n}"] = F.when(full, v)
        return out
    return columns


def add_lags(series: DataFrame, keys: list[str] | None = None, lags=LAGS) -> DataFrame:
    """lag_k = trip_count k hours earlier (WIN2); the series has every hour of its span."""
    return with_history(series, keys or [], max(lags), _lag_columns(lags))


def add_rolling(series: DataFrame, keys: list[str] | None = None, windows=ROLLING) -> DataFrame:
    """Rolling mean / sample std of the *previous* w hours, null until w
    hours exist (WIN3, D15): the frame ends one row before the current hour,
    so a feature never reads the hour it predicts."""
    return with_history(series, keys or [], max(n for n, _ in windows), _rolling_columns(windows))


def add_past(series: DataFrame, keys: list[str] | None = None, lags=LAGS, windows=ROLLING) -> DataFrame:
    """Lags and rolling columns in one shuffle."""
    return with_history(series, keys or [], max(*lags, *[n for n, _ in windows]),
                        lambda w: _lag_columns(lags)(w) | _rolling_columns(windows)(w))


def demand_lags(features: DataFrame) -> DataFrame:
    return add_lags(hourly_series(features))


def demand_rolling(features: DataFrame) -> DataFrame:
    r = add_rolling(hourly_series(features))
    return r.select("ts_hour", "trip_count", *[F.round(f"rolling_{fn}_{n}", 6).alias(f"rolling_{fn}_{n}")
                                               for n, fn in ROLLING])


def add_calendar(series: DataFrame, holidays: DataFrame | None = None, events: DataFrame | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Hour-of-day, weekday, month flags, holiday and event flags (EXP17).

    ``holidays`` / ``events`` are optional ``(date, name)`` dimensions joined
    by date.  Without ``holidays`` the
    rule-based Scottish calendar is used; without ``events`` an event day is
    every 7th day from the first hour of the series, within its span.
    """
    keys = keys or []
    ts, h = F.col("ts_hour"), F.hour("ts_hour")
    d = F.to_date(ts)
    s = series.withColumns({
        "hour": h, "day_of_week": F.weekday(ts), "is_weekend": X.is_weekend(ts), "month": F.month(ts),
        "is_rush_hour": X.is_peak(h).cast("int"),
        "is_late_night": ((h >= 22) | (h <= 4)).cast("int"),
        "is_lunch_time": h.between(11, 14).cast("int"),
        "is_winter": F.month(ts).isin(*WINTER).cast("int"),
        "is_summer": F.month(ts).isin(*SUMMER).cast("int"),
        "is_festival_season": F.month(ts).isin(*FESTIVAL).cast("int"),
    })
    if holidays is None:
        s = s.withColumn("is_holiday", X.is_holiday(ts))
    else:
        hd = holidays.select(F.col("date").cast("date").alias("_hd")).distinct()
        s = (s.join(hd, d == F.col("_hd"), "left").withColumn("is_holiday", F.col("_hd").isNotNull().cast("int"))
             .drop("_hd"))
    s = s.withColumn("is_bank_holiday", F.col("is_holiday"))
    if events is None and not keys:
        # The series span is one row: scalar subqueries, no unpartitioned window.
        b = series.agg(F.min("ts_hour").alias("_lo"), F.max("ts_hour").alias("_hi"))
        s = attach_scalars(s, b)
        days = F.datediff(d, F.to_date("_lo"))
        event = (days % 7 == 0) & ((F.col("_lo") + F.make_dt_interval(days=days)) <= F.col("_hi"))
        s = s.withColumn("is_major_event", event.cast("int")).drop("_lo", "_hi")
    elif events is None:
        span = Window.partitionBy(*keys)
        lo, hi = F.min("ts_hour").over(span), F.max("ts_hour").over(span)
        days = F.datediff(d, F.to_date(lo))
        s = s.withColumn("is_major_event", ((days % 7 == 0) & ((lo + F.make_dt_interval(days=days)) <= hi)).cast("int"))
    else:
        ed = events.select(F.col("date").cast("date").alias("_ed")).distinct()
        s = s.join(ed, d == F.col("_ed"), "left").withColumn("is_major_event", F.col("_ed").isNotNull().cast("int")).drop("_ed")
    return s


def add_weather(series: DataFrame, weather: DataFrame) -> DataFrame:
    """Join an hourly weather table ``(ts_hour, temperature, precipitation)``
    and derive the threshold flags and interactions (EXP18).

    Needs ``is_rush_hour``, ``is_weekend`` and ``is_major_event`` (from
    ``add_calendar``).  The weather table has one row per hour, the same
    grain as the series, so this is an equi-join on the hour that AQE plans
    as broadcast or shuffle by its runtime size.  An hour that the table lacks gets the
    mean of its month and hour of day (or of all hours) in hundredths, and
    ``weather_missing`` = 1: no hour of the series is lost."""
    w = weather.select(F.col("ts_hour").cast("timestamp_ntz").alias("ts_hour"),
                       F.col("temperature").cast("double"), F.col("precipitation").cast("double"))

    def mean(c):  # whole hundredths, so that the order of the sum cannot matter
        cents = F.round(F.col(c) * 100).cast("long")
        return F.floor(F.try_divide(F.sum(cents), F.count(cents))).cast("double") / 100

    climate = w.groupBy(F.month("ts_hour").alias("_month"), F.hour("ts_hour").alias("_hour")).agg(
        mean("temperature").alias("_t"), mean("precipitation").alias("_p"))
    overall = w.agg(mean("temperature").alias("_t0"), mean("precipitation").alias("_p0"))
    s = series.join(w, "ts_hour", "left")
    s = s.join(climate, (F.month("ts_hour") == F.col("_month")) & (F.hour("ts_hour") == F.col("_hour")), "left")
    s = attach_scalars(s, overall).withColumns({
        "weather_missing": (F.col("temperature").isNull() | F.col("precipitation").isNull()).cast("int"),
        "temperature": F.coalesce("temperature", "_t", "_t0"),
        "precipitation": F.coalesce("precipitation", "_p", "_p0")}).drop("_month", "_hour", "_t", "_p", "_t0", "_p0")
    return s.withColumns({
        "is_rainy": (F.col("precipitation") > RAIN_MM).cast("int"),
        "is_cold": (F.col("temperature") < COLD_C).cast("int"),
        "is_hot": (F.col("temperature") > HOT_C).cast("int"),
    }).withColumns({
        "rainy_rush_hour": F.col("is_rainy") * F.col("is_rush_hour"),
        "cold_weekend": F.col("is_cold") * F.col("is_weekend"),
        "event_weekend": F.col("is_major_event") * F.col("is_weekend"),
    })


def weather_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather derived from the driver's ``lineitem`` (test fixture):
    temperature = 400 * mean tax - 4 (about -4 to 28 C), precipitation =
    100 * mean discount (0 to 10 mm), per trip hour."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.expr("l_shipdate + make_dt_interval(0, CAST(l_partkey % 5 + l_suppkey % 20 AS INT), "
                "CAST(l_orderkey % 60 AS INT), 0)")
    return (li.select(ts.alias("ts"), "l_tax", "l_discount").withColumn("ts_hour", clock_hour("ts"))
            .groupBy("ts_hour").agg(F.round(F.avg("l_tax") * 400 - 4, 2).alias("temperature"),
                                    F.round(F.avg("l_discount") * 100, 2).alias("precipitation")))


def forecast_features(features: DataFrame, weather: DataFrame | None = None, holidays: DataFrame | None = None,
                      events: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The hour-ahead model matrix, rows with any null feature dropped (WIN4).

    Without a weather table the weather columns and their interactions are
    left out (the reference simulated them with random draws)."""
    keys = keys or []
    s = add_past(hourly_series(features, keys), keys)
    s = add_calendar(s, holidays, events, keys)
    feats = list(FORECAST_FEATURES)
    if weather is not None:
        s = add_weather(s, weather)
    else:
        s = s.withColumn("event_weekend", F.col("is_major_event") * F.col("is_weekend"))
        feats = [f for f in feats if f not in WEATHER_FEATURES]
    return s.select(*keys, "ts_hour", "trip_count", *feats).dropna()


def forecast_split(matrix: DataFrame, test_hours: int = 24, keys: list[str] | None = None) -> DataFrame:
    """Chronological hold-out: the last ``test_hours`` clock hours (of each key) are 'test' (WIN5)."""
    keys = keys or []
    last = matrix.groupBy(*keys).agg(F.max("ts_hour").alias("_last"))
    m = matrix.join(last, keys) if keys else attach_scalars(matrix, last)
    test = F.col("ts_hour") > F.col("_last") - F.expr(f"INTERVAL {int(test_hours)} HOURS")
    return m.withColumn("split", F.when(test, "test").otherwise("train")).drop("_last")


def forecast_mean_baseline(split: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Constant forecast = mean of the training target (FOR3)."""
    keys = keys or []
    m = split.filter(F.col("split") == "train").groupBy(*keys).agg(F.avg("trip_count").alias("prediction"))
    test = split.filter(F.col("split") == "test").select(*keys, "ts_hour", F.col("trip_count").alias("actual"))
    j = test.join(m, keys, "left") if keys else attach_scalars(test, m)
    return j.select(*keys, "ts_hour", "actual", F.round("prediction", 4).alias("prediction"))


def forecast_seasonal_naive(split: DataFrame, keys: list[str] | None = None, period: int = 24) -> DataFrame:
    """Seasonal naive with drift (FOR4, re-aimed from SARIMA): the value ``period``
    clock hours earlier (found by that hour, so gaps in the matrix do not shift
    it) plus the mean seasonal difference of the training rows."""
    keys = keys or []
    earlier = split.select(*keys, (F.col("ts_hour") + F.expr(f"INTERVAL {int(period)} HOURS")).alias("ts_hour"),
                           F.col("trip_count").alias("_prev"))
    s = split.join(earlier, [*keys, "ts_hour"], "left")
    drift = (s.filter((F.col("split") == "train") & F.col("_prev").isNotNull()).groupBy(*keys)
             .agg(F.avg(F.col("trip_count") - F.col("_prev")).alias("_drift")))
    test = s.filter(F.col("split") == "test")
    j = test.join(drift, keys, "left") if keys else attach_scalars(test, drift)
    return j.select(*keys, "ts_hour", F.col("trip_count").alias("actual"),
                    F.round(F.col("_prev") + F.coalesce("_drift", F.lit(0.0)), 4).alias("prediction"))


def _products(lags: list[int]) -> list[tuple[int, int]]:
    return [(i, j) for i in lags for j in lags if i <= j]


def ar_moments(split: DataFrame, keys: list[str] | None = None, period: int = 24) -> DataFrame:
    """One row (for each key) for ``forecast_seasonal_ar``, from one aggregate.

    ``n`` training rows whose hours 1, ``period`` and ``period`` + 1 before are known, the sums ``s{k}`` of the trips k
    hours before and ``p{j}_{k}`` of products, exact; ``last`` training hour, ``ahead`` hours to the last test hour
    and ``mean`` of all training rows."""
    keys = keys or []
    lags = [0, 1, period, period + 1]
    s = with_history(split, keys, period + 1, lambda w: {
        f"_y{k}": F.max("trip_count").over(w.rangeBetween(-k, -k)).cast("decimal(18,0)") for k in lags})
    train = F.col("split") == "train"
    known = train
    for k in lags:
        known = known & F.col(f"_y{k}").isNotNull()
    zero = F.lit(0).cast("decimal(38,0)")

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(known, c)).cast("decimal(38,0)"), zero).alias(name)
    last = F.max(F.when(train, F.col("ts_hour")))
    return s.groupBy(*keys).agg(
        F.count_if(known).alias("n"), *[total(F.col(f"_y{k}"), f"s{k}") for k in lags],
        *[total(F.col(f"_y{i}") * F.col(f"_y{j}"), f"p{i}_{j}") for i, j in _products(lags)], last.alias("last"),
        (hour_number(F.max("ts_hour")) - hour_number(last)).alias("ahead"),
        F.avg(F.when(train, F.col("trip_count"))).alias("mean"))


def ar_coefficients(moments: DataFrame, period: int = 24) -> DataFrame:
    """``moments`` plus ``b{k}`` for lags 1, ``period`` and ``period`` + 1 and the intercept ``b0``: the normal equations, solved
    by elimination.  A lag that the others explain wholly (in a constant series, all) gets 0; without a usable row
    the intercept is the mean."""
    lags = [1, period, period + 1]

    def exact(i: int, j: int) -> Column:  # n^2 times the covariance, subtracted before it becomes a double
        return (F.col("n").cast("decimal(18,0)") * F.col(f"p{min(i, j)}_{max(i, j)}") - F.col(f"s{i}") * F.col(f"s{j}")).cast("double")
    a = {(i, j): f"_a{i}_{j}" for i in lags for j in [*lags, 0] if j == 0 or i <= j}
    m = moments.withColumns({name: exact(i, j) for (i, j), name in a.items()})
    m = m.withColumns({f"_d{k}": F.col(a[k, k]) for k in lags})
    for at, k in enumerate(lags):
        usable = F.col(a[k, k]) > 1e-9 * F.col(f"_d{k}")
        m = m.withColumn(f"_ok{k}", usable)
        later = lags[at + 1:]
        m = m.withColumns({a[i, j]: F.when(F.col(f"_ok{k}"), F.col(a[i, j]) - F.col(a[k, i]) * F.col(a[k, j]) / F.col(a[k, k]))
                           .otherwise(F.col(a[i, j])) for i in later for j in [*later, 0] if (i, j) in a})
    for at, k in reversed([*enumerate(lags)]):
        rest = F.col(a[k, 0])
        for j in lags[at + 1:]:
            rest = rest - F.col(a[k, j]) * F.col(f"b{j}")
        m = m.withColumn(f"b{k}", F.when(F.col(f"_ok{k}"), rest / F.col(a[k, k])).otherwise(F.lit(0.0)))
    level = F.col("s0").cast("double")
    for k in lags:
        level = level - F.col(f"b{k}") * F.col(f"s{k}").cast("double")
    m = m.withColumn("b0", F.when(F.col("n") > 0, level / F.nullif("n", F.lit(0))).otherwise(F.col("mean")))
    return m.select(*moments.columns, "b0", *[f"b{k}" for k in lags])


def forecast_seasonal_ar(split: DataFrame, keys: list[str] | None = None, period: int = 24) -> DataFrame:
    """Seasonal autoregression (FOR4): trips from those 1, ``period`` and ``period`` + 1 hours before.

    Fitted on the training rows, then carried on hour by hour through the hold-out from its own forecasts: no actual
    hour of the hold-out is read.  Hours missing before the hold-out count as the mean of the training rows."""
    keys = keys or []
    fitted = ar_coefficients(ar_moments(split, keys, period), period).filter("last IS NOT NULL AND ahead > 0")
    names = ["b0", "b1", f"b{period}", f"b{period + 1}"]
    fitted = fitted.select(*keys, "last", "ahead", "mean", *names)
    train = split.filter(F.col("split") == "train").select(*keys, "ts_hour", F.col("trip_count").cast("double").alias("_y"))
    recent = train.join(fitted.select(*keys, "last"), keys) if keys else attach_scalars(train, fitted.select("last"))
    back = hour_number("last") - hour_number("ts_hour")
    recent = recent.filter(back <= period).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(back.alias("back"), F.col("_y")))).alias("_recent"))
    both = fitted.join(recent, keys) if keys else attach_scalars(fitted, recent)
    start = F.transform(F.sequence(F.lit(period).cast("long"), F.lit(0).cast("long")),
                        lambda k: F.coalesce(F.element_at("_recent", k), F.col("mean")))

    def step(path: Column, _: Column) -> Column:
        ahead = F.col("b0")
        for k in (1, period, period + 1):
            ahead = ahead + F.col(f"b{k}") * F.element_at(path, F.lit(-k))
        return F.concat(path, F.array(ahead))
    path = both.withColumn("_start", start).select(*keys, "last", F.posexplode(F.slice(F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("ahead")), F.col("_start"), step), period + 2, F.col("ahead").cast("int")))
        .alias("_pos", "_p"))
    path = path.select(*keys, (F.col("last") + F.make_dt_interval(hours=F.col("_pos") + 1)).alias("ts_hour"), "_p")
    test = split.filter(F.col("split") == "test").select(*keys, "ts_hour", F.col("trip_count").alias("actual"))
    return test.join(path, [*keys, "ts_hour"], "left").select(*keys, "ts_hour", "actual", F.round("_p", 4).alias("prediction"))


def hourly_forecasts(features: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """The forecasts without Spark ML of the last 24 hours beside the actual trips."""
    split = forecast_split(forecast_features(features, weather))
    mean = forecast_mean_baseline(split).withColumnRenamed("prediction", "mean_baseline")
    naive = forecast_seasonal_naive(split).select("ts_hour", F.col("prediction").alias("seasonal_naive"))
    auto = forecast_seasonal_ar(split).select("ts_hour", F.col("prediction").alias("seasonal_ar"))
    return mean.join(naive, "ts_hour").join(auto, "ts_hour")


# --- registered queries ------------------------------------------------------------------------

def _matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glenfare.plans.registry import features
    return forecast_features(features(spark, sf_dir), weather=weather_fixture(spark, sf_dir))


def calendar_flags(features: DataFrame) -> DataFrame:
    s = add_calendar(hourly_series(features))
    return s.select("ts_hour", "trip_count", "hour", "day_of_week", "is_weekend", "month", "is_rush_hour",
                    "is_late_night", "is_lunch_time", "is_winter", "is_summer", "is_festival_season",
                    "is_holiday", "is_bank_holiday", "is_major_event")


def _weather_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glenfare.plans.registry import features
    s = add_weather(add_calendar(hourly_series(features(spark, sf_dir))), weather_fixture(spark, sf_dir))
    return s.select("ts_hour", "temperature", "precipitation", "is_rainy", "is_cold", "is_hot",
                    "rainy_rush_hour", "cold_weekend", "event_weekend", "weather_missing")


def _split_q(spark, sf_dir):
    return forecast_split(_matrix_q(spark, sf_dir)).select("ts_hour", "trip_count", "split")


def _mean_q(spark, sf_dir):
    return forecast_mean_baseline(forecast_split(_matrix_q(spark, sf_dir)))


def _snaive_q(spark, sf_dir):
    return forecast_seasonal_naive(forecast_split(_matrix_q(spark, sf_dir)))


def _sar_q(spark, sf_dir):
    return forecast_seasonal_ar(forecast_split(_matrix_q(spark, sf_dir)))


def _moments_q(spark, sf_dir):
    m = ar_moments(forecast_split(_matrix_q(spark, sf_dir)))
    return m.select("n", *[F.col(c).cast("long").alias(c) for c in m.columns if c[0] in "sp"], "last", "ahead")


def _rounded_matrix(spark, sf_dir):
    m = _matrix_q(spark, sf_dir)
    return m.select(*[F.round(c, 6).alias(c) if c.startswith("rolling") else F.col(c) for c in m.columns])


# --- DuckDB oracle -----------------------------------------------------------------------------

_SERIES = """s AS (SELECT g.ts_hour, CAST(coalesce(c.n, 0) AS BIGINT) AS trip_count FROM
  (SELECT CAST(unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS TIMESTAMP) AS ts_hour
   FROM (SELECT date_trunc('hour', ts) AS h FROM f WHERE ts IS NOT NULL)) g
  LEFT JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM f WHERE ts IS NOT NULL GROUP BY 1) c
  ON g.ts_hour = c.h)"""
_LAGS = ", ".join(f"lag(trip_count, {k}) OVER (ORDER BY ts_hour) AS lag_{k}" for k in LAGS)
_ROLL = ", ".join(
    f"CASE WHEN count(trip_count) OVER (ORDER BY ts_hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN "
    f"{'avg' if fn == 'mean' else 'stddev_samp'}(trip_count) OVER (ORDER BY ts_hour ROWS BETWEEN {n} PRECEDING "
    f"AND 1 PRECEDING) END AS rolling_{fn}_{n}" for n, fn in ROLLING)
_CAL = f"""cal AS (SELECT s.*, CAST(hour(ts_hour) AS INTEGER) AS hour, CAST(isodow(ts_hour) - 1 AS INTEGER) AS day_of_week,
  CASE WHEN isodow(ts_hour) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(month(ts_hour) AS INTEGER) AS month,
  CASE WHEN hour(ts_hour) BETWEEN 7 AND 9 OR hour(ts_hour) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_rush_hour,
  CASE WHEN hour(ts_hour) >= 22 OR hour(ts_hour) <= 4 THEN 1 ELSE 0 END AS is_late_night,
  CASE WHEN hour(ts_hour) BETWEEN 11 AND 14 THEN 1 ELSE 0 END AS is_lunch_time,
  CASE WHEN month(ts_hour) IN (12, 1, 2) THEN 1 ELSE 0 END AS is_winter,
  CASE WHEN month(ts_hour) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer,
  CASE WHEN month(ts_hour) IN (8, 12) THEN 1 ELSE 0 END AS is_festival_season,
  CASE WHEN ({holiday_case('CAST(ts_hour AS DATE)')}) IS NULL THEN 0 ELSE 1 END AS is_holiday,
  CASE WHEN ({holiday_case('CAST(ts_hour AS DATE)')}) IS NULL THEN 0 ELSE 1 END AS is_bank_holiday,
  CASE WHEN date_diff('day', CAST(b.lo AS DATE), CAST(ts_hour AS DATE)) % 7 = 0
        AND b.lo + to_days(CAST(date_diff('day', CAST(b.lo AS DATE), CAST(ts_hour AS DATE)) AS INTEGER)) <= b.hi
       THEN 1 ELSE 0 END AS is_major_event
  FROM sl s, (SELECT min(ts_hour) AS lo, max(ts_hour) AS hi FROM s) b)"""
_SL = f"sl AS (SELECT *, {_LAGS}, {_ROLL} FROM s)"
_WEATHER = """wx AS (SELECT date_trunc('hour', l_shipdate + to_hours(CAST(l_partkey % 5 + l_suppkey % 20 AS INT))
    + to_minutes(CAST(l_orderkey % 60 AS INT))) AS ts_hour, round(avg(l_tax) * 400 - 4, 2) AS temperature,
    round(avg(l_discount) * 100, 2) AS precipitation FROM lineitem GROUP BY 1)"""
_WEATHER += """, filled AS (SELECT s.ts_hour, CAST(wx.ts_hour IS NULL AS INTEGER) AS weather_missing,
    coalesce(wx.temperature, c.t, o.t) AS temperature, coalesce(wx.precipitation, c.p, o.p) AS precipitation
    FROM s LEFT JOIN wx ON s.ts_hour = wx.ts_hour
    LEFT JOIN (SELECT month(ts_hour) AS m, hour(ts_hour) AS h,
        floor(sum(CAST(round(temperature * 100) AS BIGINT)) / count(*)) / 100 AS t,
        floor(sum(CAST(round(precipitation * 100) AS BIGINT)) / count(*)) / 100 AS p FROM wx GROUP BY 1, 2) c
      ON month(s.ts_hour) = c.m AND hour(s.ts_hour) = c.h,
    (SELECT floor(sum(CAST(round(temperature * 100) AS BIGINT)) / count(*)) / 100 AS t,
        floor(sum(CAST(round(precipitation * 100) AS BIGINT)) / count(*)) / 100 AS p FROM wx) o)"""
_WCOLS = """cw AS (SELECT *, is_rainy * is_rush_hour AS rainy_rush_hour, is_cold * is_weekend AS cold_weekend,
    is_major_event * is_weekend AS event_weekend FROM (SELECT cal.*, w.temperature, w.precipitation, w.weather_missing,
    CAST(w.precipitation > 5 AS INTEGER) AS is_rainy, CAST(w.temperature < 5 AS INTEGER) AS is_cold,
    CAST(w.temperature > 20 AS INTEGER) AS is_hot FROM cal JOIN filled w ON cal.ts_hour = w.ts_hour))"""
_NN = " AND ".join(f"{c} IS NOT NULL" for c in FORECAST_FEATURES)
_MATRIX = f"m AS (SELECT ts_hour, trip_count, {', '.join(FORECAST_FEATURES)} FROM cw WHERE {_NN})"
_SPLIT = ("sp AS (SELECT m.*, CASE WHEN date_diff('hour', m.ts_hour, e.last) < 24 THEN 'test' ELSE 'train' END "
          "AS split FROM m, (SELECT max(ts_hour) AS last FROM m) e)")


_AR = [0, 1, 24, 25]
_AR_ROWS = ("ar AS (SELECT y0.trip_count AS y0, " + ", ".join(f"y{k}.trip_count AS y{k}" for k in _AR[1:]) + " FROM sp y0 " + " ".join(
    f"JOIN sp y{k} ON y{k}.ts_hour = y0.ts_hour - INTERVAL {k} HOUR" for k in _AR[1:]) + " WHERE y0.split = 'train')")
_AR_ENDS = ("ends AS (SELECT max(ts_hour) FILTER (split = 'train') AS last, "
            "date_diff('hour', max(ts_hour) FILTER (split = 'train'), max(ts_hour)) AS ahead FROM sp)")
_AR_SUMS = ("ms AS (SELECT count(*) AS n, " + ", ".join(f"CAST(sum(y{k}) AS BIGINT) AS s{k}" for k in _AR) + ", " + ", ".join(
    f"CAST(sum(y{i} * y{j}) AS BIGINT) AS p{i}_{j}" for i, j in _products(_AR)) + " FROM ar)")


def _ar_solution() -> list[str]:
    """Cramer's rule on the covariances (the Spark side eliminates)."""
    def c(i, j):
        i, j = min(i, j), max(i, j)
        return f"(CAST(n AS HUGEINT) * p{i}_{j} - CAST(s{i} AS HUGEINT) * s{j})::DOUBLE"
    covs = "cv AS (SELECT *, " + ", ".join(f"{c(i, j)} AS c{i}_{j}" for i, j in _products(_AR)) + " FROM ms)"

    def e(i, j):
        return f"c{min(i, j)}_{max(i, j)}"

    def det(cols):
        (a, b, d) = [[f(r) for r in _AR[1:]] for f in cols]
        return (f"({a[0]} * ({b[1]} * {d[2]} - {d[1]} * {b[2]}) - {b[0]} * ({a[1]} * {d[2]} - {d[1]} * {a[2]}) "
                f"+ {d[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))")
    base = [lambda r, k=k: e(r, k) for k in _AR[1:]]
    answer = lambda r: e(r, 0)
    bs = ", ".join(f"{det([answer if i == at else f for i, f in enumerate(base)])} / {det(base)} AS b{k}" for at, k in enumerate(_AR[1:]))
    return [covs, f"bs AS (SELECT n, s0, s1, s24, s25, {bs} FROM cv)",
            "co AS (SELECT *, (s0 - b1 * s1 - b24 * s24 - b25 * s25) / n AS b0 FROM bs)"]


_AR_PATH = """pa AS (WITH RECURSIVE r AS (
    SELECT 0 AS i, (SELECT list(CAST(trip_count AS DOUBLE) ORDER BY ts_hour) FROM sp, ends
                    WHERE split = 'train' AND ts_hour > last - INTERVAL 25 HOUR) AS acc
    UNION ALL SELECT i + 1, list_append(acc, b0 + b1 * acc[-1] + b24 * acc[-24] + b25 * acc[-25]) FROM r, co, ends WHERE i < ahead)
  SELECT last + to_hours(CAST(i AS INTEGER)) AS ts_hour, acc[-1] AS p FROM r, ends WHERE i > 0)"""


def _m(body, *extra):
    return with_ctes(body, _SERIES, _SL, _CAL, _WEATHER, _WCOLS, _MATRIX, _SPLIT, *extra)


SQL = {
    "hourly_series": with_ctes("SELECT ts_hour, trip_count FROM s", _SERIES),
    "demand_lags": with_ctes(f"SELECT ts_hour, trip_count, {_LAGS} FROM s", _SERIES),
    "demand_rolling": with_ctes("SELECT ts_hour, trip_count, " + ", ".join(
        f"round(rolling_{fn}_{n}, 6) AS rolling_{fn}_{n}" for n, fn in ROLLING) + " FROM sl", _SERIES, _SL),
    "calendar_flags": with_ctes("""SELECT ts_hour, trip_count, hour, day_of_week, is_weekend, month, is_rush_hour,
      is_late_night, is_lunch_time, is_winter, is_summer, is_festival_season, is_holiday, is_bank_holiday,
      is_major_event FROM cal""", _SERIES, _SL, _CAL),
    "weather_features": with_ctes("""SELECT ts_hour, temperature, precipitation, is_rainy, is_cold, is_hot,
      rainy_rush_hour, cold_weekend, event_weekend, weather_missing FROM cw""", _SERIES, _SL, _CAL, _WEATHER, _WCOLS),
    "forecast_features": _m("SELECT ts_hour, trip_count, " + ", ".join(
        f"round({c}, 6) AS {c}" if c.startswith("rolling") else c for c in FORECAST_FEATURES) + " FROM m"),
    "forecast_split": _m("SELECT ts_hour, trip_count, split FROM sp"),
    "forecast_mean_baseline": _m("""SELECT ts_hour, trip_count AS actual,
      round((SELECT avg(trip_count) FROM sp WHERE split = 'train'), 4) AS prediction FROM sp WHERE split = 'test'"""),
    "forecast_seasonal_naive": _m("""SELECT ts_hour, trip_count AS actual,
      round(prev + coalesce((SELECT avg(trip_count - prev) FROM p WHERE split = 'train' AND prev IS NOT NULL), 0), 4)
        AS prediction FROM p WHERE split = 'test'""",
                                  "p AS (SELECT a.*, b.trip_count AS prev FROM sp a LEFT JOIN sp b "
                                  "ON b.ts_hour = a.ts_hour - INTERVAL 24 HOUR)"),
    "forecast_ar_moments": _m("SELECT n, " + ", ".join([*[f"s{k}" for k in _AR], *[f"p{i}_{j}" for i, j in _products(_AR)]])
                              + ", last, ahead FROM ms, ends", _AR_ROWS, _AR_ENDS, _AR_SUMS),
    "forecast_seasonal_ar": _m("""SELECT sp.ts_hour, trip_count AS actual, round(p, 4) AS prediction FROM sp LEFT JOIN pa
      ON sp.ts_hour = pa.ts_hour WHERE split = 'test'""", _AR_ROWS, _AR_ENDS, _AR_SUMS, *_ar_solution(), _AR_PATH),
}

QUERIES = {
    "hourly_series": ("features", hourly_series),
    "demand_lags": ("features", demand_lags),
    "demand_rolling": ("features", demand_rolling),
    "calendar_flags": ("features", calendar_flags),
    "weather_features": ("raw", _weather_q),
    "forecast_features": ("raw", _rounded_matrix),
    "forecast_split": ("raw", _split_q),
    "forecast_mean_baseline": ("raw", _mean_q),
    "forecast_seasonal_naive": ("raw", _snaive_q),
    "forecast_ar_moments": ("raw", _moments_q),
    "forecast_seasonal_ar": ("raw", _sar_q),
}
