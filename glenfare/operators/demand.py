"""Demand aggregations by time and area (DEM1-DEM15, TEM1-TEM3).

Every operator is a grouped aggregate over the engineered table: Spark plans
a partial (map-side) aggregate, a shuffle of at most one row per group per
task, and a final aggregate.  Group counts are small (24 hours, 7 days, 53
weeks, postcode districts), so a hot key costs one partial row per task
rather than a skewed shuffle partition.  Windows and top-k run only over the
aggregated rows, never over raw trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.oracle import with_ctes
from glenfare.plans.rollup import at, cells, levels, total

# Weekday names Monday-first and short month names.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _count_by(features: DataFrame, key: str, name: str = "trip_count") -> DataFrame:
    return (features.filter(F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias(name)))


def hourly_demand(features: DataFrame) -> DataFrame:
    """Trips per hour of day (DEM1); absent hours are absent."""
    return _count_by(features, "hour")


def daily_demand(features: DataFrame) -> DataFrame:
    """Trips per weekday, Monday first, absent days as 0 (DEM2).

    One pass of conditional counts (no join to a calendar table), then the
    one-row result is unpivoted to seven rows.
    """
    wd = F.col("day_of_week")
    wide = features.agg(*[F.count_if(wd == i).alias(f"d{i}") for i in range(7)])
    stack = ", ".join(f"{i}, '{n}', d{i}" for i, n in enumerate(WEEKDAYS))
    return wide.selectExpr(f"stack(7, {stack}) AS (day_of_week, day_name, trip_count)")


def weekly_demand(features: DataFrame) -> DataFrame:
    """Trips per ISO week number, years merged (DEM3, D16)."""
    return _count_by(features, "week_of_year")


def monthly_demand(features: DataFrame) -> DataFrame:
    """Trips per month with its short name (DEM4)."""
    return (_count_by(features, "month")
            .withColumn("month_name", F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM"))
            .select("month", "month_name", "trip_count"))


def daily_trip_counts(features: DataFrame) -> DataFrame:
    """Trips per calendar date with its weekday name (DEM5)."""
    return (features.filter(F.col("ts").isNotNull())
            .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("day_name"))
            .agg(F.count(F.lit(1)).alias("trip_count")))


def daily_annotations(features: DataFrame) -> DataFrame:
    """Peak date (earliest on ties), first Monday, last date and their counts."""
    d = daily_trip_counts(features)
    return d.agg(
        F.min_by("date", F.struct(-F.col("trip_count"), F.col("date"))).alias("peak_date"),
        F.max("trip_count").alias("peak_count"),
        F.min(F.when(F.col("day_name") == "Monday", F.col("date"))).alias("first_monday"),
        F.min_by("trip_count", F.when(F.col("day_name") == "Monday", F.col("date"))).alias("first_monday_count"),
        F.max("date").alias("last_date"),
        F.max_by("trip_count", "date").alias("last_date_count"),
    )


def date_hour_demand(features: DataFrame) -> DataFrame:
    """Trips per (date, hour) (DEM6)."""
    return (features.filter(F.col("ts").isNotNull())
            .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("hour"))
            .agg(F.count(F.lit(1)).alias("trip_count")))


def hourly_demand_box(features: DataFrame) -> DataFrame:
    """Box statistics per hour of the per-day trip counts (DEM6 + OUT5)."""
    from glenfare.operators.stats import box_stats
    return box_stats(date_hour_demand(features), "hour", ["trip_count"]).drop("metric")


def _top_areas(features: DataFrame, area: str, n: int = 10) -> DataFrame:
    return (_count_by(features, area).withColumnRenamed(area, "area")
            .orderBy(F.desc("trip_count"), F.asc("area")).limit(n))


def top_pickup_areas(features: DataFrame, n: int = 10) -> DataFrame:
    """Top-n pickup areas by trips, ties by area (DEM7)."""
    return _top_areas(features, "pickup_area", n)


def top_dropoff_areas(features: DataFrame, n: int = 10) -> DataFrame:
    return _top_areas(features, "dropoff_area", n)


def _pareto(features: DataFrame, area: str, share: float = 0.8) -> DataFrame:
    counts = _count_by(features, area).withColumnRenamed(area, "area")
    # The window runs over the aggregated areas (one row per district).
    w = Window.orderBy(F.desc("trip_count"), F.asc("area")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return (counts.withColumn("cum_share", F.sum("trip_count").over(w) / F.sum("trip_count").over(total))
            .filter(F.col("cum_share") <= share).withColumn("cum_share", F.round("cum_share", 6)))


def pareto_pickup(features: DataFrame, share: float = 0.8) -> DataFrame:
    """Areas whose cumulative share of trips stays within ``share`` (DEM8)."""
    return _pareto(features, "pickup_area", share)


def pareto_dropoff(features: DataFrame, share: float = 0.8) -> DataFrame:
    return _pareto(features, "dropoff_area", share)


def _routes(features: DataFrame) -> DataFrame:
    return (features.filter(F.col("pickup_area").isNotNull() & F.col("dropoff_area").isNotNull())
            .groupBy("pickup_area", "dropoff_area").agg(F.count("ts").alias("trip_count")))


def route_matrix(features: DataFrame) -> DataFrame:
    """Origin-destination counts in sparse long form (DEM9).

    Only observed (pickup, dropoff) cells are emitted; absent cells are the
    zeros of the dense matrix.  A dense area x area product grows with the
    square of the number of districts and is left to the consumer
    (``groupBy('pickup_area').pivot('dropoff_area')``) when it is small.
    """
    return _routes(features)


def route_summary(features: DataFrame) -> DataFrame:
    """Distinct pickup areas, dropoff areas and matrix cells (DEM10)."""
    both = features.filter(F.col("pickup_area").isNotNull() & F.col("dropoff_area").isNotNull())
    return (both.agg(F.count_distinct("pickup_area").alias("n_pickup_areas"),
                     F.count_distinct("dropoff_area").alias("n_dropoff_areas"))
            .withColumn("n_cells", F.col("n_pickup_areas") * F.col("n_dropoff_areas")))


def top_routes(features: DataFrame, n: int = 10) -> DataFrame:
    """Top-n routes by trips, ties by pickup then dropoff (DEM11)."""
    return _routes(features).orderBy(F.desc("trip_count"), "pickup_area", "dropoff_area").limit(n)


def rush_matrix(features: DataFrame) -> DataFrame:
    """Pickup area x hour counts, 24 hour columns h0..h23 filled with 0 (DEM12).

    The pivot has an explicit value list, so no extra distinct job runs.
    """
    p = (features.filter(F.col("pickup_area").isNotNull() & F.col("hour").isNotNull())
         .groupBy("pickup_area").pivot("hour", list(range(24))).agg(F.count("ts")))
    return p.select("pickup_area", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h}") for h in range(24)])


def rush_peak(features: DataFrame) -> DataFrame:
    """Hour with the most trips among trips with a known pickup area."""
    hourly = (features.filter(F.col("pickup_area").isNotNull() & F.col("hour").isNotNull())
              .groupBy("hour").agg(F.count("ts").alias("trip_count")))
    return hourly.agg(
        F.min_by("hour", F.struct(-F.col("trip_count"), F.col("hour"))).alias("peak_hour"),
        F.max("trip_count").alias("trip_count"))


def peak_hours(features: DataFrame) -> DataFrame:
    """Peak and off-peak hour, counts, ratio and peak type (DEM13)."""
    h = hourly_demand(features)
    row = h.agg(
        F.min_by("hour", F.struct(-F.col("trip_count"), F.col("hour"))).alias("peak_hour"),
        F.max("trip_count").alias("peak_count"),
        F.min_by("hour", F.struct(F.col("trip_count"), F.col("hour"))).alias("off_peak_hour"),
        F.min("trip_count").alias("off_peak_count"))
    return row.withColumns({
        "peak_ratio": F.round(F.try_divide(F.col("peak_count"), F.col("off_peak_count")), 6),
        "peak_type": X.peak_type("peak_hour"),
    })


def weekday_pattern(features: DataFrame) -> DataFrame:
    """Busiest / quietest weekday and weekend vs weekday means (DEM14).

    Days without trips are left out of the means, as a reindexed series with
    missing days would be.
    """
    d = (features.filter(F.col("day_of_week").isNotNull())
         .groupBy("day_of_week", "day_name").agg(F.count(F.lit(1)).alias("trip_count")))
    wk = F.col("day_of_week") >= 5
    # The two pattern labels.
    return d.agg(
        F.min_by("day_name", F.struct(-F.col("trip_count"), F.col("day_of_week"))).alias("busiest_day"),
        F.min_by("day_name", F.struct(F.col("trip_count"), F.col("day_of_week"))).alias("quietest_day"),
        F.round(F.avg(F.when(wk, F.col("trip_count"))), 4).alias("weekend_avg"),
        F.round(F.avg(F.when(~wk, F.col("trip_count"))), 4).alias("weekday_avg"),
    ).withColumn("pattern", F.when(F.col("weekend_avg") > F.col("weekday_avg"), "Weekend Business")
                 .otherwise("Weekday Business"))


def fleet_summary(features: DataFrame, top_n: int = 5) -> DataFrame:
    """Peak share, weekend share, mean trips per (hour, weekday) cell, and
    the revenue share of the top areas among trips with a known area (DEM15)."""
    dims = ["hour", "day_of_week", "pickup_area"]
    lev = levels(cells(features, dims, ("total_amount",),
                       peak=F.count_if(F.col("hour").isin(7, 8, 9, 17, 18, 19)),
                       weekend=F.count_if(F.col("is_weekend") == 1)), dims)
    rev = F.when(at("pickup_area"), F.col("total_amount_sum"))
    w = Window.partitionBy(at("pickup_area")).orderBy(F.desc("total_amount_sum"), F.asc("pickup_area"))
    row = lev.withColumn("_rn", F.row_number().over(w)).agg(
        F.coalesce(total("trips", "hour"), F.lit(0)).alias("total_trips"),
        F.count_if(at("hour")).alias("_nh"), F.count_if(at("day_of_week")).alias("_nd"),
        F.coalesce(total("peak", "hour"), F.lit(0)).alias("_peak"),
        F.coalesce(total("weekend", "hour"), F.lit(0)).alias("_wkend"),
        F.sum(F.when(F.col("_rn") <= top_n, rev)).alias("_top"), F.sum(rev).alias("_all"))
    return row.select(
        "total_trips",
        F.round(F.try_divide(F.col("total_trips"), F.col("_nh") * F.col("_nd")), 4).alias("avg_trips_per_cell"),
        F.round(F.try_divide(F.col("_peak"), F.col("total_trips")), 6).alias("peak_demand_ratio"),
        F.round(F.try_divide(F.col("_wkend"), F.col("total_trips")), 6).alias("weekend_demand_ratio"),
        F.round(F.try_divide(F.col("_top"), F.col("_all")), 6).alias("top_areas_revenue_ratio"))


def hourly_averages(features: DataFrame) -> DataFrame:
    """Mean fare and mean duration by hour (TEM1)."""
    return (features.filter(F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.round(F.avg("fare_amount"), 4).alias("avg_fare"),
                 F.round(F.avg("duration_min"), 4).alias("avg_duration")))


def fare_variation(features: DataFrame) -> DataFrame:
    """Highest / lowest mean-fare hour and variation % (TEM2)."""
    h = (features.filter(F.col("hour").isNotNull()).groupBy("hour")
         .agg(F.avg("fare_amount").alias("avg_fare")))
    r = h.agg(
        F.min_by("hour", F.struct(-F.col("avg_fare"), F.col("hour"))).alias("highest_fare_hour"),
        F.max("avg_fare").alias("_hi"),
        F.min_by("hour", F.struct(F.col("avg_fare"), F.col("hour"))).alias("lowest_fare_hour"),
        F.min("avg_fare").alias("_lo"),
        F.avg("avg_fare").alias("_mean"))
    var = F.try_divide(F.col("_hi") - F.col("_lo"), F.col("_mean")) * 100
    # The pricing labels and their cut.
    return r.select(
        "highest_fare_hour", F.round("_hi", 4).alias("highest_avg_fare"),
        "lowest_fare_hour", F.round("_lo", 4).alias("lowest_avg_fare"),
        F.round(var, 4).alias("fare_variation_pct"),
        F.when(var > 20, "Dynamic Pricing").otherwise("Stable Pricing").alias("pricing_label"))


def _weekly(features: DataFrame) -> DataFrame:
    return (features.filter(F.col("week_of_year").isNotNull()).groupBy("week_of_year")
            .agg(F.round(F.sum("total_amount"), 2).alias("total_revenue"),
                 F.round(F.avg("total_amount"), 2).alias("avg_revenue_per_trip"),
                 F.count("total_amount").alias("trip_count")))


def weekly_stats(features: DataFrame, n: int = 10) -> DataFrame:
    """Top-n weeks by trips with revenue sum and mean (TEM3)."""
    return _weekly(features).orderBy(F.desc("trip_count"), "week_of_year").limit(n)


def weekly_best(features: DataFrame) -> DataFrame:
    """Mean weekly revenue and the best week (TEM3)."""
    return _weekly(features).agg(
        F.round(F.avg("total_revenue"), 4).alias("avg_weekly_revenue"),
        F.min_by("week_of_year", F.struct(-F.col("total_revenue"), F.col("week_of_year"))).alias("best_week"),
        F.max("total_revenue").alias("best_week_revenue"))


# --- DuckDB oracle -----------------------------------------------------------------------------

_AREA_COUNTS = """SELECT {a} AS area, count(*) AS trip_count FROM f WHERE {a} IS NOT NULL GROUP BY {a}"""
_PARETO = """SELECT area, trip_count, cum_share FROM (
  SELECT a.area, a.trip_count, round(sum(b.trip_count) / any_value(t.n), 6) AS cum_share,
    10 * sum(b.trip_count) <= 8 * any_value(t.n) AS within
  FROM ({inner}) a JOIN ({inner}) b
    ON b.trip_count > a.trip_count OR (b.trip_count = a.trip_count AND b.area <= a.area),
    (SELECT sum(trip_count) AS n FROM ({inner})) t
  GROUP BY a.area, a.trip_count) WHERE within"""
_WEEKLY = """SELECT week_of_year, round(sum(total_amount), 2) AS total_revenue,
  round(avg(total_amount), 2) AS avg_revenue_per_trip, count(total_amount) AS trip_count
  FROM f WHERE week_of_year IS NOT NULL GROUP BY week_of_year"""

SQL = {
    "hourly_demand": with_ctes("SELECT hour, count(*) AS trip_count FROM f WHERE hour IS NOT NULL GROUP BY hour"),
    "daily_demand": with_ctes(
        "SELECT d.day_of_week, d.day_name, count(f.ts) AS trip_count FROM (VALUES "
        + ", ".join(f"({i}, '{n}')" for i, n in enumerate(WEEKDAYS))
        + ") d(day_of_week, day_name) LEFT JOIN f ON f.day_of_week = d.day_of_week "
          "GROUP BY d.day_of_week, d.day_name"),
    "weekly_demand": with_ctes(
        "SELECT week_of_year, count(*) AS trip_count FROM f WHERE week_of_year IS NOT NULL GROUP BY week_of_year"),
    "monthly_demand": with_ctes(
        "SELECT month, strftime(make_date(2000, month, 1), '%b') AS month_name, count(*) AS trip_count "
        "FROM f WHERE month IS NOT NULL GROUP BY month"),
    "daily_trip_counts": with_ctes(
        "SELECT strftime(ts, '%Y-%m-%d') AS date, day_name, count(*) AS trip_count FROM f "
        "WHERE ts IS NOT NULL GROUP BY 1, 2"),
    "daily_annotations": with_ctes(
        """SELECT
          (SELECT date FROM d ORDER BY trip_count DESC, date LIMIT 1) AS peak_date,
          (SELECT max(trip_count) FROM d) AS peak_count,
          (SELECT min(date) FROM d WHERE day_name = 'Monday') AS first_monday,
          (SELECT trip_count FROM d WHERE day_name = 'Monday' ORDER BY date LIMIT 1) AS first_monday_count,
          (SELECT max(date) FROM d) AS last_date,
          (SELECT trip_count FROM d ORDER BY date DESC LIMIT 1) AS last_date_count""",
        "d AS (SELECT strftime(ts, '%Y-%m-%d') AS date, day_name, count(*) AS trip_count FROM f "
        "WHERE ts IS NOT NULL GROUP BY 1, 2)"),
    "date_hour_demand": with_ctes(
        "SELECT strftime(ts, '%Y-%m-%d') AS date, hour, count(*) AS trip_count FROM f "
        "WHERE ts IS NOT NULL GROUP BY 1, 2"),
    "top_pickup_areas": with_ctes(_AREA_COUNTS.format(a="pickup_area") + " ORDER BY trip_count DESC, area LIMIT 10"),
    "top_dropoff_areas": with_ctes(_AREA_COUNTS.format(a="dropoff_area") + " ORDER BY trip_count DESC, area LIMIT 10"),
    "pareto_pickup": with_ctes(_PARETO.format(inner=_AREA_COUNTS.format(a="pickup_area"))),
    "pareto_dropoff": with_ctes(_PARETO.format(inner=_AREA_COUNTS.format(a="dropoff_area"))),
    "route_matrix": with_ctes(
        "SELECT pickup_area, dropoff_area, count(ts) AS trip_count FROM f "
        "WHERE pickup_area IS NOT NULL AND dropoff_area IS NOT NULL GROUP BY 1, 2"),
    "route_summary": with_ctes(
        "SELECT count(DISTINCT pickup_area) AS n_pickup_areas, count(DISTINCT dropoff_area) AS n_dropoff_areas, "
        "count(DISTINCT pickup_area) * count(DISTINCT dropoff_area) AS n_cells FROM f "
        "WHERE pickup_area IS NOT NULL AND dropoff_area IS NOT NULL"),
    "top_routes": with_ctes(
        "SELECT pickup_area, dropoff_area, count(ts) AS trip_count FROM f "
        "WHERE pickup_area IS NOT NULL AND dropoff_area IS NOT NULL GROUP BY 1, 2 "
        "ORDER BY trip_count DESC, pickup_area, dropoff_area LIMIT 10"),
    "rush_matrix": with_ctes(
        "SELECT pickup_area, " + ", ".join(f"count(CASE WHEN hour = {h} THEN ts END) AS h{h}" for h in range(24))
        + " FROM f WHERE pickup_area IS NOT NULL AND hour IS NOT NULL GROUP BY pickup_area"),
    "rush_peak": with_ctes(
        "SELECT hour AS peak_hour, trip_count FROM (SELECT hour, count(ts) AS trip_count FROM f "
        "WHERE pickup_area IS NOT NULL AND hour IS NOT NULL GROUP BY hour) ORDER BY trip_count DESC, hour LIMIT 1"),
    "peak_hours": with_ctes(
        """SELECT p.hour AS peak_hour, p.trip_count AS peak_count, o.hour AS off_peak_hour,
          o.trip_count AS off_peak_count, round(p.trip_count / nullif(o.trip_count, 0), 6) AS peak_ratio,
          CASE WHEN p.hour IN (7, 8, 9) THEN 'Morning Commute' WHEN p.hour IN (17, 18, 19) THEN 'Evening Commute'
               WHEN p.hour IN (21, 22, 23) THEN 'Night Life' ELSE 'Other Peak' END AS peak_type
        FROM (SELECT * FROM h ORDER BY trip_count DESC, hour LIMIT 1) p,
             (SELECT * FROM h ORDER BY trip_count, hour LIMIT 1) o""",
        "h AS (SELECT hour, count(*) AS trip_count FROM f WHERE hour IS NOT NULL GROUP BY hour)"),
    "weekday_pattern": with_ctes(
        """SELECT (SELECT day_name FROM d ORDER BY trip_count DESC, day_of_week LIMIT 1) AS busiest_day,
          (SELECT day_name FROM d ORDER BY trip_count, day_of_week LIMIT 1) AS quietest_day,
          round((SELECT avg(trip_count) FROM d WHERE day_of_week >= 5), 4) AS weekend_avg,
          round((SELECT avg(trip_count) FROM d WHERE day_of_week < 5), 4) AS weekday_avg,
          CASE WHEN round((SELECT avg(trip_count) FROM d WHERE day_of_week >= 5), 4)
                  > round((SELECT avg(trip_count) FROM d WHERE day_of_week < 5), 4)
               THEN 'Weekend Business' ELSE 'Weekday Business' END AS pattern""",
        "d AS (SELECT day_of_week, day_name, count(*) AS trip_count FROM f WHERE day_of_week IS NOT NULL "
        "GROUP BY 1, 2)"),
    "fleet_summary": with_ctes(
        """SELECT g.total_trips, round(g.total_trips / nullif(g.nh * g.nd, 0), 4) AS avg_trips_per_cell,
          round(g.peak / nullif(g.total_trips, 0), 6) AS peak_demand_ratio,
          round(g.wkend / nullif(g.total_trips, 0), 6) AS weekend_demand_ratio,
          round((SELECT sum(rev) FROM (SELECT rev FROM a ORDER BY rev DESC, pickup_area LIMIT 5))
                / (SELECT sum(rev) FROM a), 6) AS top_areas_revenue_ratio
        FROM (SELECT count(*) AS total_trips, count(DISTINCT hour) AS nh, count(DISTINCT day_of_week) AS nd,
                     count(*) FILTER (WHERE hour IN (7, 8, 9, 17, 18, 19)) AS peak,
                     count(*) FILTER (WHERE is_weekend = 1) AS wkend FROM f) g""",
        "a AS (SELECT pickup_area, sum(total_amount) AS rev FROM f WHERE pickup_area IS NOT NULL "
        "GROUP BY pickup_area)"),
    "hourly_averages": with_ctes(
        "SELECT hour, round(avg(fare_amount), 4) AS avg_fare, round(avg(duration_min), 4) AS avg_duration "
        "FROM f WHERE hour IS NOT NULL GROUP BY hour"),
    "fare_variation": with_ctes(
        """SELECT (SELECT hour FROM h ORDER BY avg_fare DESC, hour LIMIT 1) AS highest_fare_hour,
          round((SELECT max(avg_fare) FROM h), 4) AS highest_avg_fare,
          (SELECT hour FROM h ORDER BY avg_fare, hour LIMIT 1) AS lowest_fare_hour,
          round((SELECT min(avg_fare) FROM h), 4) AS lowest_avg_fare,
          round(((SELECT max(avg_fare) FROM h) - (SELECT min(avg_fare) FROM h)) / (SELECT avg(avg_fare) FROM h) * 100, 4)
            AS fare_variation_pct,
          CASE WHEN ((SELECT max(avg_fare) FROM h) - (SELECT min(avg_fare) FROM h)) / (SELECT avg(avg_fare) FROM h)
                    * 100 > 20 THEN 'Dynamic Pricing' ELSE 'Stable Pricing' END AS pricing_label""",
        "h AS (SELECT hour, avg(fare_amount) AS avg_fare FROM f WHERE hour IS NOT NULL GROUP BY hour)"),
    "weekly_stats": with_ctes(_WEEKLY + " ORDER BY trip_count DESC, week_of_year LIMIT 10"),
    "weekly_best": with_ctes(
        """SELECT round(avg(total_revenue), 4) AS avg_weekly_revenue,
          (SELECT week_of_year FROM w ORDER BY total_revenue DESC, week_of_year LIMIT 1) AS best_week,
          max(total_revenue) AS best_week_revenue FROM w""",
        f"w AS ({_WEEKLY})"),
}
