"""Feature engineering (EXP3-EXP16) and the cleaning filter (FIL1).

``with_features`` is one projection over the trips table; Catalyst fuses it
into every consumer and prunes the columns a consumer does not read, so the
engineered table costs nothing until used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.plans.quantiles import quantiles
from glenfare.sources.dims import holiday_dim
from glenfare.sources.schema import TRIP_COLUMNS, read_trips_csv, rejected_cells, write_trips_csv

COUNTRY = "United Kingdom"

ENGINEERED_COLUMNS = ["tip_pct", "hour", "day_of_week", "day_name", "week_of_year", "is_weekend",
                      "month", "time_of_day", "is_holiday", "pickup_area", "dropoff_area",
                      "pickup_area_type", "dropoff_area_type", "revenue_per_km", "country"]


def with_features(trips: DataFrame, commercial=X.COMMERCIAL_AREAS,
                  strip_inner: bool = False) -> DataFrame:
    """The full engineered table (EXP16): trip columns + engineered columns.

    Steps are guarded by column presence, as in the original feature step.
    """
    cols = set(trips.columns)
    out = [F.col(c) for c in trips.columns]
    if "tip_pct_raw" in cols:
        out.append(X.parse_pct("tip_pct_raw").alias("tip_pct"))
    if "ts" in cols:
        ts = F.col("ts")
        hour = F.hour(ts)
        out += [hour.alias("hour"),
                F.weekday(ts).alias("day_of_week"),
                F.date_format(ts, "EEEE").alias("day_name"),
                F.weekofyear(ts).alias("week_of_year"),
                X.is_weekend(ts).alias("is_weekend"),
                F.month(ts).alias("month"),
                X.time_of_day(hour).alias("time_of_day"),
                X.is_holiday(ts).alias("is_holiday")]
    if "pickup_postcode" in cols:
        pa = X.postcode_area("pickup_postcode", strip_inner)
        out += [pa.alias("pickup_area")]
    if "dropoff_postcode" in cols:
        da = X.postcode_area("dropoff_postcode", strip_inner)
        out += [da.alias("dropoff_area")]
    if "pickup_postcode" in cols:
        out.append(X.area_type(X.postcode_area("pickup_postcode", strip_inner), commercial)
                   .alias("pickup_area_type"))
    if "dropoff_postcode" in cols:
        out.append(X.area_type(X.postcode_area("dropoff_postcode", strip_inner), commercial)
                   .alias("dropoff_area_type"))
    if {"total_amount", "distance_km"} <= cols:
        out.append(X.safe_ratio("total_amount", "distance_km").alias("revenue_per_km"))
    out.append(F.lit(COUNTRY).alias("country"))
    return trips.select(*out)


def short_trips(trips: DataFrame, min_minutes: float = 1.0) -> DataFrame:
    """Trips shorter than ``min_minutes`` (reported before removal, FIL1)."""
    return trips.filter(F.col("duration_min") < min_minutes)


def clean(trips: DataFrame, min_minutes: float = 1.0) -> DataFrame:
    """Drop trips shorter than ``min_minutes``; a null duration fails both
    predicates, so it is neither kept nor reported (FIL1)."""
    return trips.filter(F.col("duration_min") >= min_minutes)


def processed(trips: DataFrame) -> DataFrame:
    """Processed dataset: features over the cleaned trips (SRC5)."""
    return with_features(clean(trips))


def processed_shape(trips: DataFrame) -> DataFrame:
    """Rows, columns and added-column count of the processed dataset."""
    p = processed(trips)
    added = len(p.columns) - len([c for c in trips.columns if c in TRIP_COLUMNS])
    return p.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(p.columns)).alias("n_columns"), F.lit(added).alias("n_added_columns"))


def temporal_features(trips: DataFrame) -> DataFrame:
    """Calendar parts of each trip (EXP4/EXP5)."""
    ts = F.col("ts")
    return trips.select(
        ts, F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"),
        F.date_format(ts, "EEEE").alias("day_name"), F.weekofyear(ts).alias("week_of_year"),
        F.month(ts).alias("month"), F.dayofmonth(ts).alias("day_of_month"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"), X.is_weekend(ts).alias("is_weekend"))


def price_metrics(features: DataFrame) -> DataFrame:
    """price_per_km = total / distance, tip_rate = tip / total (EXP12)."""
    return features.withColumns({
        "price_per_km": X.safe_ratio("total_amount", "distance_km"),
        "tip_rate": X.safe_ratio("tip_amount", "total_amount"),
        "is_peak": X.is_peak("hour").cast("int"),
    })


def trip_flags(features: DataFrame, short_km: float = 5.0, long_km: float = 20.0,
               high_value_pct: float = 0.8) -> DataFrame:
    """Short / long / high-value flags (EXP14).

    The 80th percentile of ``total_amount`` is selected by rank when the frame
    is built, and read as a constant.
    """
    bound, = quantiles(features, ["total_amount"], [high_value_pct])["total_amount"]
    return (features
            .withColumns({
                "is_short": (F.col("distance_km") <= short_km).cast("int"),
                "is_long": (F.col("distance_km") >= long_km).cast("int"),
                "is_high_value": (F.col("total_amount") >= F.lit(bound).cast("double")).cast("int"),
            }))


# --- registered expression queries (EXP1-EXP16, FIL1, SRC1/4/5, FIL6) ----------------------------

def _r(c, n=4):
    return F.round(c, n)


def parse_tip_pct(trips: DataFrame) -> DataFrame:
    """Every distinct raw tip string, its parsed value and its trip count (EXP1)."""
    return (trips.groupBy("tip_pct_raw").agg(F.count(F.lit(1)).alias("trip_count"))
            .select("tip_pct_raw", X.parse_pct("tip_pct_raw").alias("tip_pct"), "trip_count"))


def time_of_day_counts(features: DataFrame) -> DataFrame:
    """Trips per time-of-day band (EXP6)."""
    return (features.filter(F.col("time_of_day").isNotNull())
            .groupBy("time_of_day").agg(F.count(F.lit(1)).alias("trip_count")))


def holiday_calendar(trips: DataFrame) -> DataFrame:
    """The holiday dimension ``(date, name)``: the rule-built calendar of the
    years that the trips cover; a user-supplied table of the same shape can be
    passed to ``flag_holidays``."""
    return holiday_dim(trips.select(F.year("ts").alias("year")))


def flag_holidays(features: DataFrame, holidays: DataFrame) -> DataFrame:
    """Left join trips to a holiday dimension; ``is_holiday`` = 1 on a match (EXP7/JOI1).

    The dimension has tens of rows per year; Spark picks the join by its size.
    """
    h = holidays.select(F.col("date").alias("_hdate"), F.col("name").alias("holiday_name")).dropDuplicates(["_hdate"])
    j = features.join(h, F.to_date("ts") == F.col("_hdate"), "left")
    return j.withColumn("is_holiday", F.col("_hdate").isNotNull().cast("int")).drop("_hdate")


def holiday_flag(features: DataFrame) -> DataFrame:
    """Trips per holiday date via the holiday-dimension join (EXP7)."""
    flagged = flag_holidays(features.drop("is_holiday"), holiday_calendar(features))
    return (flagged.filter(F.col("is_holiday") == 1)
            .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), "holiday_name")
            .agg(F.count(F.lit(1)).alias("trip_count")))


def postcode_area_counts(features: DataFrame) -> DataFrame:
    """Each pickup postcode, its extracted area and trip count (EXP8)."""
    return (features.filter(F.col("pickup_postcode").isNotNull())
            .groupBy("pickup_postcode", "pickup_area").agg(F.count(F.lit(1)).alias("trip_count")))


def area_type_counts(features: DataFrame) -> DataFrame:
    """Trips per area type, pickup and dropoff side, in one pass (EXP9)."""
    long = features.selectExpr("stack(2, 'pickup', pickup_area_type, 'dropoff', dropoff_area_type) AS (side, area_type)")
    return long.groupBy("side", "area_type").agg(F.count(F.lit(1)).alias("trip_count"))


def revenue_per_km_stats(features: DataFrame) -> DataFrame:
    """revenue_per_km: defined / undefined (zero distance) counts and moments (EXP10)."""
    v = F.col("revenue_per_km")
    return features.agg(F.count(v).alias("n_defined"), F.count_if(v.isNull()).alias("n_undefined"),
                        _r(F.avg(v)).alias("avg_revenue_per_km"), _r(F.min(v)).alias("min_revenue_per_km"),
                        _r(F.max(v)).alias("max_revenue_per_km"))


def price_metric_stats(features: DataFrame) -> DataFrame:
    """price_per_km and tip_rate counts and means (EXP12)."""
    pm = price_metrics(features)
    return pm.agg(F.count("price_per_km").alias("n_price_per_km"), _r(F.avg("price_per_km")).alias("avg_price_per_km"),
                  F.count("tip_rate").alias("n_tip_rate"), _r(F.avg("tip_rate"), 6).alias("avg_tip_rate"))


def peak_flag_counts(features: DataFrame) -> DataFrame:
    """Trips in and out of the 7-9 / 17-19 peak hours (EXP13)."""
    return (features.filter(F.col("hour").isNotNull())
            .groupBy(X.is_peak("hour").cast("int").alias("is_peak")).agg(F.count(F.lit(1)).alias("trip_count")))


def trip_flag_counts(features: DataFrame) -> DataFrame:
    """Counts of short, long and high-value trips and the high-value bound (EXP14)."""
    t = trip_flags(features)
    return t.agg(F.sum("is_short").alias("short_trips"), F.sum("is_long").alias("long_trips"),
                 F.sum("is_high_value").alias("high_value_trips"))


def sample_rows(trips: DataFrame, n: int = 10) -> DataFrame:
    """First n rows in a total order over every column (SRC4)."""
    return trips.orderBy(*trips.columns).limit(n)


def processed_dataset(trips: DataFrame) -> DataFrame:
    return processed(trips)


def csv_roundtrip(trips: DataFrame, path: str | None = None) -> DataFrame:
    """Write the trips as CSV in the export layout and scan them back (SRC1).

    The folder defaults to a fresh subfolder of the session's shared
    checkpoint folder; the returned frame reads it, so its owner removes it.
    """
    import uuid
    from glenfare.session import checkpoint_dir
    spark = trips.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/csv_roundtrip-{uuid.uuid4().hex}"
    write_trips_csv(trips, path)
    return read_trips_csv(spark, path)


def rejected_trip_cells(trips: DataFrame) -> DataFrame:
    """Missing and rejected cells by column (SRC1) of the trips as text, in which a fare of three passengers has a
    currency sign, two passengers are a word, and a trip without passengers has no time."""
    n = F.col("passenger_count")
    text = trips.withColumns({c: F.col(c).cast("string") for c in TRIP_COLUMNS})
    text = text.select(*[c for c in trips.columns if c not in ("fare_amount", "passenger_count", "ts")], *[
        F.when(n == 3, F.concat(F.lit("£"), "fare_amount")).otherwise(F.col("fare_amount")).alias("fare_amount"),
        F.when(n == 2, "two").otherwise(n).alias("passenger_count"),
        F.when(n.isNull(), F.lit("")).otherwise(F.col("ts")).alias("ts")])
    return rejected_cells(text)


def sample_trips(trips: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """Deterministic bounded sample (FIL6): the n rows with the smallest
    seeded hash of all columns.  Opt-in only: operators run on all rows.
    ``orderBy(...).limit(n)`` plans a per-task top-n, so at most n rows per
    task reach the final merge."""
    return (trips.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in trips.columns]))
            .orderBy("_h", *trips.columns).limit(n).drop("_h"))


# --- DuckDB oracle -----------------------------------------------------------------------------

def _sql():
    from glenfare.oracle import with_ctes
    tc = ", ".join(TRIP_COLUMNS)
    return {
        "parse_tip_pct": with_ctes("""SELECT tip_pct_raw,
          CASE WHEN isnan(try_cast(nullif(replace(tip_pct_raw, '%', ''), '') AS DOUBLE)) THEN NULL
               ELSE try_cast(nullif(replace(tip_pct_raw, '%', ''), '') AS DOUBLE) END AS tip_pct,
          count(*) AS trip_count FROM trips GROUP BY tip_pct_raw"""),
        "temporal_features": with_ctes("""SELECT ts, CAST(hour(ts) AS INTEGER) AS hour,
          CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, dayname(ts) AS day_name,
          CAST(weekofyear(ts) AS INTEGER) AS week_of_year, CAST(month(ts) AS INTEGER) AS month,
          CAST(day(ts) AS INTEGER) AS day_of_month, strftime(ts, '%Y-%m-%d') AS date,
          CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM trips"""),
        "time_of_day_counts": with_ctes("SELECT time_of_day, count(*) AS trip_count FROM f GROUP BY time_of_day"),
        "holiday_flag": with_ctes("""SELECT strftime(ts, '%Y-%m-%d') AS date, h.name AS holiday_name,
          count(*) AS trip_count FROM f JOIN h ON CAST(f.ts AS DATE) = h.d GROUP BY 1, 2""",
          "h AS (SELECT * FROM (SELECT d, " + _holiday("d") + " AS name FROM (SELECT DISTINCT CAST(ts AS DATE) AS d "
          "FROM trips WHERE ts IS NOT NULL)) WHERE name IS NOT NULL)"),
        "postcode_area": with_ctes("""SELECT pickup_postcode, pickup_area, count(*) AS trip_count FROM f
          WHERE pickup_postcode IS NOT NULL GROUP BY 1, 2"""),
        "area_type_counts": with_ctes("""SELECT side, area_type, count(*) AS trip_count FROM (
          SELECT 'pickup' AS side, pickup_area_type AS area_type FROM f
          UNION ALL SELECT 'dropoff', dropoff_area_type FROM f) GROUP BY 1, 2"""),
        "revenue_per_km": with_ctes("""SELECT count(revenue_per_km) AS n_defined,
          count(*) FILTER (WHERE revenue_per_km IS NULL) AS n_undefined,
          round(avg(revenue_per_km), 4) AS avg_revenue_per_km, round(min(revenue_per_km), 4) AS min_revenue_per_km,
          round(max(revenue_per_km), 4) AS max_revenue_per_km FROM f"""),
        "price_metrics": with_ctes("""SELECT count(total_amount / nullif(distance_km, 0)) AS n_price_per_km,
          round(avg(total_amount / nullif(distance_km, 0)), 4) AS avg_price_per_km,
          count(tip_amount / nullif(total_amount, 0)) AS n_tip_rate,
          round(avg(tip_amount / nullif(total_amount, 0)), 6) AS avg_tip_rate FROM f"""),
        "peak_flag_counts": with_ctes("""SELECT CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END
          AS is_peak, count(*) AS trip_count FROM f WHERE hour IS NOT NULL GROUP BY 1"""),
        "trip_flags": with_ctes("""SELECT sum(CASE WHEN distance_km <= 5 THEN 1 ELSE 0 END) AS short_trips,
          sum(CASE WHEN distance_km >= 20 THEN 1 ELSE 0 END) AS long_trips,
          sum(CASE WHEN total_amount >= (SELECT quantile_cont(total_amount, 0.8) FROM f) THEN 1 ELSE 0 END)
            AS high_value_trips FROM f"""),
        "engineered_features": with_ctes("SELECT * FROM f"),
        "clean_short_trips": with_ctes("SELECT * FROM trips WHERE duration_min >= 1"),
        "short_trips": with_ctes("SELECT * FROM trips WHERE duration_min < 1"),
        "processed_dataset": with_ctes("SELECT * FROM f WHERE duration_min >= 1"),
        "processed_shape": with_ctes("""SELECT count(*) AS n_rows, 26 AS n_columns, 15 AS n_added_columns
          FROM trips WHERE duration_min >= 1"""),
        "sample_rows": with_ctes(f"SELECT * FROM trips ORDER BY {', '.join(c + ' NULLS FIRST' for c in TRIP_COLUMNS)} LIMIT 10"),
        "csv_roundtrip": with_ctes(f"SELECT {tc} FROM trips"),
        "rejected_cells": with_ctes(" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS cells, count(*) FILTER ({missing}) AS missing, "
            f"count(*) FILTER ({rejected}) AS rejected FROM trips" for c, missing, rejected in [
                ("ts", "ts IS NULL OR passenger_count IS NULL", "false"),
                *[(c, f"{c} IS NULL OR isnan({c})", "false") for c in ("distance_km", "duration_min", "tip_amount", "total_amount")],
                ("fare_amount", "fare_amount IS NULL", "passenger_count = 3 AND fare_amount IS NOT NULL"),
                ("passenger_count", "passenger_count IS NULL", "passenger_count = 2")])),
    }


def _holiday(d):
    from glenfare.oracle import holiday_case
    return holiday_case(d)


SQL = _sql()

QUERIES = {
    "parse_tip_pct": ("trips", parse_tip_pct),
    "temporal_features": ("trips", temporal_features),
    "time_of_day_counts": ("features", time_of_day_counts),
    "holiday_flag": ("features", holiday_flag),
    "postcode_area": ("features", postcode_area_counts),
    "area_type_counts": ("features", area_type_counts),
    "revenue_per_km": ("features", revenue_per_km_stats),
    "price_metrics": ("features", price_metric_stats),
    "peak_flag_counts": ("features", peak_flag_counts),
    "trip_flags": ("features", trip_flag_counts),
    "engineered_features": ("features", lambda f: f),
    "clean_short_trips": ("trips", clean),
    "short_trips": ("trips", short_trips),
    "processed_dataset": ("trips", processed_dataset),
    "processed_shape": ("trips", processed_shape),
    "sample_rows": ("trips", sample_rows),
    "csv_roundtrip": ("trips", csv_roundtrip),
    "rejected_cells": ("trips", rejected_trip_cells),
    "sample_trips": ("trips", sample_trips),
}
