"""Pricing analysis (PRI1-PRI6) and the percentile trim (FIL3).

All pricing operators read the priced table: features plus ``price_per_km``
and ``tip_rate``, rows with any null dropped (D11), then trimmed to the
1st-99th percentile of ``price_per_km`` and, for the section tables, of
``tip_rate`` on the survivors.  Each trim selects its two bounds by rank when
the frame is built, and filters by them as constants: no join, no shuffle of trips.
The reference samples 3,000 rows first; the engine uses every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.oracle import with_ctes
from glenfare.plans.quantiles import quantiles
from glenfare.operators.features import ENGINEERED_COLUMNS, price_metrics
from glenfare.sources.schema import TRIP_COLUMNS

PRICED_COLUMNS = TRIP_COLUMNS + ENGINEERED_COLUMNS + ["price_per_km", "tip_rate"]


def _r(c, n=3):
    return F.round(c, n)


def priced(features: DataFrame) -> DataFrame:
    """features + price_per_km + tip_rate, rows with any null removed (EXP12, FIL2, D11).

    Same rows as ``dropna()`` over every column, by checks of what the columns
    come from: an engineered column is null only where a trip column is, the
    tip string is no number, a postcode has no area, or a divisor is zero.
    The filter therefore repeats no engineered expression."""
    pm = price_metrics(features)
    ok = F.col("tip_pct").isNotNull() & (F.col("distance_km") != 0) & (F.col("total_amount") != 0)
    for c in TRIP_COLUMNS:
        ok = F.col(c).isNotNull() & ok
    for c in ("pickup_postcode", "dropoff_postcode"):
        ok = ok & X.has_postcode_area(c)
    return pm.filter(ok)


def trim(df: DataFrame, c: str, lo: float = 0.01, hi: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """Keep rows with ``c`` inside its [lo, hi] quantiles (inclusive); without
    a value of ``c`` there are no bounds and no rows."""
    low, high = quantiles(df, [c], [lo, hi], accuracy)[c]
    return df.filter((F.col(c) >= F.lit(low).cast("double")) & (F.col(c) <= F.lit(high).cast("double")))


def price_trimmed(features: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Priced trips trimmed on price_per_km only (the price-per-km section)."""
    return trim(priced(features), "price_per_km", accuracy=accuracy)


def trimmed_trips(features: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Priced trips trimmed on price_per_km, then on tip_rate of the survivors (FIL3)."""
    return trim(price_trimmed(features, accuracy), "tip_rate", accuracy=accuracy)


def price_per_km_stats(features: DataFrame) -> DataFrame:
    """Mean, median, sample std of price_per_km after the price trim (PRI1)."""
    t = price_trimmed(features)
    median, = quantiles(t, ["price_per_km"], [0.5])["price_per_km"]
    return t.agg(F.count(F.lit(1)).alias("n_trips"), F.round(F.avg("price_per_km"), 4).alias("avg_price_per_km"),
                 F.round(F.lit(median).cast("double"), 4).alias("median_price_per_km"),
                 F.round(F.stddev_samp("price_per_km"), 4).alias("std_price_per_km"))


def _price_stats(df: DataFrame, key) -> DataFrame:
    return df.groupBy(key).agg(_r(F.avg("price_per_km")).alias("mean"), _r(F.stddev_samp("price_per_km")).alias("std"),
                               F.count("price_per_km").alias("count"))


def price_by_hour(features: DataFrame) -> DataFrame:
    """price_per_km mean / std / count per hour (PRI2)."""
    return _price_stats(trimmed_trips(features), "hour")


def price_hour_extremes(features: DataFrame) -> DataFrame:
    """Hours with the highest and lowest (rounded) mean price and their gap % (PRI2)."""
    h = price_by_hour(features)
    a = h.agg(F.min_by("hour", F.struct(-F.col("mean"), F.col("hour"))).alias("peak_hour"),
              F.max("mean").alias("peak_price"),
              F.min_by("hour", F.struct(F.col("mean"), F.col("hour"))).alias("off_peak_hour"),
              F.min("mean").alias("off_peak_price"))
    return a.withColumn("variation_pct", F.round(F.try_divide(F.col("peak_price") - F.col("off_peak_price"),
                                                              F.col("off_peak_price")) * 100, 4))


def price_by_day_type(features: DataFrame) -> DataFrame:
    """price_per_km by weekday / weekend (PRI3)."""
    t = trimmed_trips(features)
    return _price_stats(t, F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday").alias("day_type"))


def price_by_peak(features: DataFrame) -> DataFrame:
    """price_per_km in and out of the peak hours (PRI3)."""
    t = trimmed_trips(features)
    return _price_stats(t, F.when(X.is_peak("hour"), "Peak").otherwise("Off-Peak").alias("period"))


def price_by_distance_bin(features: DataFrame) -> DataFrame:
    """Price and total fare by right-closed distance bin; all five bins emitted (PRI4, D12)."""
    t = trimmed_trips(features)
    agg = (t.withColumn("distance_bin", X.distance_bin("distance_km")).filter(F.col("distance_bin").isNotNull())
           .groupBy("distance_bin").agg(
               _r(F.avg("price_per_km")).alias("avg_price_per_km"), _r(F.stddev_samp("price_per_km")).alias("std_price_per_km"),
               _r(F.avg("total_amount")).alias("avg_total_fare"), _r(F.stddev_samp("total_amount")).alias("std_total_fare"),
               F.count("distance_km").alias("trip_count")))
    spark = features.sparkSession
    rows = ", ".join(f"({i}, '{label}')" for i, (_, _, label) in enumerate(X.DISTANCE_BINS))
    bins = spark.sql(f"SELECT * FROM VALUES {rows} AS t(bin_order, distance_bin)")
    return (F.broadcast(bins).join(agg, "distance_bin", "left")
            .withColumn("trip_count", F.coalesce("trip_count", F.lit(0)).cast("bigint")))


def tip_rate_stats(features: DataFrame) -> DataFrame:
    """describe() of tip_rate plus zero-tip count and share (PRI5)."""
    t = trimmed_trips(features)
    x = F.col("tip_rate")
    q25, median, q75 = (F.round(F.lit(v).cast("double"), 6) for v in quantiles(t, ["tip_rate"], [0.25, 0.5, 0.75])["tip_rate"])
    return t.agg(F.count(x).alias("count"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"),
                 F.round(F.min(x), 6).alias("min"), q25.alias("q25"),
                 median.alias("median"), q75.alias("q75"),
                 F.round(F.max(x), 6).alias("max"), F.count_if(x == 0).alias("zero_tip_count"),
                 F.round(F.try_divide(F.count_if(x == 0), F.count(F.lit(1))) * 100, 4).alias("zero_tip_pct"))


def pricing_opportunities(features: DataFrame) -> DataFrame:
    """Overall, peak, off-peak, weekend, weekday price and % vs overall (PRI6); one pass."""
    t = trimmed_trips(features)
    p, peak, wk = F.col("price_per_km"), X.is_peak("hour"), F.col("is_weekend") == 1
    a = t.agg(F.avg(p).alias("avg"), F.avg(F.when(peak, p)).alias("peak"), F.avg(F.when(~peak, p)).alias("off_peak"),
              F.avg(F.when(wk, p)).alias("weekend"), F.avg(F.when(~wk, p)).alias("weekday"))
    out = [F.round("avg", 4).alias("avg_price_per_km")]
    for k in ["peak", "off_peak", "weekend", "weekday"]:
        out += [F.round(k, 4).alias(f"{k}_price_per_km"),
                F.round((F.try_divide(F.col(k), F.col("avg")) - 1) * 100, 4).alias(f"{k}_vs_avg_pct")]
    return a.select(*out)


# --- DuckDB oracle -----------------------------------------------------------------------------

_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in PRICED_COLUMNS)
_P = (f"p AS MATERIALIZED (SELECT * FROM (SELECT *, total_amount / nullif(distance_km, 0) AS price_per_km, "
      f"tip_amount / nullif(total_amount, 0) AS tip_rate, "
      f"CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 AS INTEGER) AS is_peak FROM f) WHERE {_NOT_NULL})")
_T1 = ("t1 AS MATERIALIZED (SELECT * FROM p WHERE price_per_km >= (SELECT quantile_cont(price_per_km, 0.01) FROM p) "
       "AND price_per_km <= (SELECT quantile_cont(price_per_km, 0.99) FROM p))")
_T2 = ("t AS MATERIALIZED (SELECT * FROM t1 WHERE tip_rate >= (SELECT quantile_cont(tip_rate, 0.01) FROM t1) "
       "AND tip_rate <= (SELECT quantile_cont(tip_rate, 0.99) FROM t1))")
_PEAK = "(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19)"
_BIN = ("CASE WHEN distance_km > 0 AND distance_km <= 5 THEN '0-5km' WHEN distance_km > 5 AND distance_km <= 10 "
        "THEN '5-10km' WHEN distance_km > 10 AND distance_km <= 20 THEN '10-20km' WHEN distance_km > 20 AND "
        "distance_km <= 50 THEN '20-50km' WHEN distance_km > 50 AND distance_km <= 100 THEN '50+km' END")
_STATS = "round(avg(price_per_km), 3) AS mean, round(stddev_samp(price_per_km), 3) AS std, count(price_per_km) AS count"
_BYHOUR = f"SELECT hour, {_STATS} FROM t GROUP BY hour"


def _t(body, *extra):
    return with_ctes(body, _P, _T1, _T2, *extra)


SQL = {
    "trimmed_trips": _t("SELECT * FROM t"),
    "price_per_km_stats": _t("""SELECT count(*) AS n_trips, round(avg(price_per_km), 4) AS avg_price_per_km,
      round(quantile_cont(price_per_km, 0.5), 4) AS median_price_per_km,
      round(stddev_samp(price_per_km), 4) AS std_price_per_km FROM t1"""),
    "price_by_hour": _t(_BYHOUR),
    "price_hour_extremes": _t("""SELECT arg_min(hour, (-mean, hour)) AS peak_hour, max(mean) AS peak_price,
      arg_min(hour, (mean, hour)) AS off_peak_hour, min(mean) AS off_peak_price,
      round((max(mean) - min(mean)) / nullif(min(mean), 0) * 100, 4) AS variation_pct FROM h""",
                              f"h AS ({_BYHOUR})"),
    "price_by_day_type": _t(f"""SELECT CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type, {_STATS}
      FROM t GROUP BY 1"""),
    "price_by_peak": _t(f"SELECT CASE WHEN {_PEAK} THEN 'Peak' ELSE 'Off-Peak' END AS period, {_STATS} FROM t GROUP BY 1"),
    "price_by_distance_bin": _t("""SELECT b.distance_bin, b.bin_order, a.avg_price_per_km, a.std_price_per_km,
      a.avg_total_fare, a.std_total_fare, CAST(coalesce(a.trip_count, 0) AS BIGINT) AS trip_count
      FROM (VALUES (0, '0-5km'), (1, '5-10km'), (2, '10-20km'), (3, '20-50km'), (4, '50+km')) b(bin_order, distance_bin)
      LEFT JOIN (SELECT distance_bin, round(avg(price_per_km), 3) AS avg_price_per_km,
        round(stddev_samp(price_per_km), 3) AS std_price_per_km, round(avg(total_amount), 3) AS avg_total_fare,
        round(stddev_samp(total_amount), 3) AS std_total_fare, count(distance_km) AS trip_count
        FROM (SELECT *, """ + _BIN + """ AS distance_bin FROM t) WHERE distance_bin IS NOT NULL GROUP BY 1) a
      ON a.distance_bin = b.distance_bin"""),
    "tip_rate_stats": _t("""SELECT count(tip_rate) AS count, round(avg(tip_rate), 6) AS mean,
      round(stddev_samp(tip_rate), 6) AS std, round(min(tip_rate), 6) AS min,
      round(quantile_cont(tip_rate, 0.25), 6) AS q25, round(quantile_cont(tip_rate, 0.5), 6) AS median,
      round(quantile_cont(tip_rate, 0.75), 6) AS q75, round(max(tip_rate), 6) AS max,
      count(*) FILTER (WHERE tip_rate = 0) AS zero_tip_count,
      round(count(*) FILTER (WHERE tip_rate = 0) / nullif(count(*), 0) * 100, 4) AS zero_tip_pct FROM t"""),
    "pricing_opportunities": _t(f"""SELECT round(avg, 4) AS avg_price_per_km,
      round(peak, 4) AS peak_price_per_km, round((peak / nullif(avg, 0) - 1) * 100, 4) AS peak_vs_avg_pct,
      round(off_peak, 4) AS off_peak_price_per_km, round((off_peak / nullif(avg, 0) - 1) * 100, 4) AS off_peak_vs_avg_pct,
      round(weekend, 4) AS weekend_price_per_km, round((weekend / nullif(avg, 0) - 1) * 100, 4) AS weekend_vs_avg_pct,
      round(weekday, 4) AS weekday_price_per_km, round((weekday / nullif(avg, 0) - 1) * 100, 4) AS weekday_vs_avg_pct
      FROM (SELECT avg(price_per_km) AS avg, avg(CASE WHEN {_PEAK} THEN price_per_km END) AS peak,
        avg(CASE WHEN NOT {_PEAK} THEN price_per_km END) AS off_peak,
        avg(CASE WHEN is_weekend = 1 THEN price_per_km END) AS weekend,
        avg(CASE WHEN is_weekend <> 1 THEN price_per_km END) AS weekday FROM t)"""),
}

QUERIES = {name: ("features", globals()[name]) for name in SQL}
