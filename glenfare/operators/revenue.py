"""Revenue and executive KPIs (REV1-REV9, EXE1-EXE9).

KPI rows are single global aggregates (partial aggregation per task, one
final row), or rollups of one grouped scan (``plans/rollup.py``); area tables are grouped aggregates over a bounded number of
districts.  Ratios use ``try_divide`` so empty or zero denominators give null
instead of failing under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.oracle import with_ctes
from glenfare.plans.quantiles import quantiles
from glenfare.plans.rollup import at, cells, first_by, levels, total


def _r(c, n=4):
    return F.round(c, n)


def revenue_metrics(features: DataFrame) -> DataFrame:
    """Total, per-trip and per-km revenue with efficiency and variability labels (REV1)."""
    a = features.agg(F.sum("total_amount").alias("_tot"), F.avg("total_amount").alias("_avg"),
                     F.sum("distance_km").alias("_dist"), F.stddev_samp("total_amount").alias("_std"))
    per_km = F.try_divide(F.col("_tot"), F.col("_dist"))
    cv = F.try_divide(F.col("_std"), F.col("_avg")) * 100
    # Bands of revenue per km and of its variability.
    return a.select(
        _r(F.col("_tot"), 2).alias("total_revenue"), _r(F.col("_avg")).alias("avg_revenue_per_trip"),
        _r(per_km).alias("revenue_per_km"),
        F.when(per_km > 3, "High").when(per_km > 2, "Moderate").otherwise("Low").alias("efficiency_label"),
        _r(F.col("_std")).alias("revenue_std"), _r(cv).alias("revenue_cv_pct"),
        F.when(cv < 30, "Stable").when(cv < 50, "Moderate").otherwise("High").alias("variability_label"))


def _revenue_by(features: DataFrame, key: str) -> DataFrame:
    # One scan: the trips without a key are a group as well until the total is taken.
    g = features.groupBy(key).agg(F.sum("total_amount").alias("_sum"), F.avg("total_amount").alias("_mean"),
                                  F.count("total_amount").alias("trip_count"))
    w = Window.orderBy(F.desc("_sum"), F.asc(key))
    return (g.withColumn("_all", F.sum("_sum").over(Window.partitionBy())).filter(F.col(key).isNotNull())
            .withColumn("_rn", F.row_number().over(w))
            .select(key, _r(F.col("_sum"), 2).alias("revenue_sum"), _r(F.col("_mean")).alias("revenue_mean"),
                    "trip_count", _r(F.try_divide(F.col("_sum"), F.col("_all")) * 100).alias("revenue_share_pct"),
                    (F.col("_rn") == 1).cast("int").alias("is_dominant")))


def revenue_by_payment(features: DataFrame) -> DataFrame:
    """Revenue sum/mean/count and share by payment type; dominant type flagged (REV2)."""
    return _revenue_by(features, "payment_type")


def revenue_by_passengers(features: DataFrame) -> DataFrame:
    """Revenue sum/mean/count and share by passenger count (REV3)."""
    return _revenue_by(features, "passenger_count")


def revenue_by_area(features: DataFrame, n: int = 10) -> DataFrame:
    """Top-n pickup areas by revenue with mean revenue (REV4)."""
    return (features.filter(F.col("pickup_area").isNotNull()).groupBy("pickup_area")
            .agg(_r(F.sum("total_amount"), 2).alias("revenue_sum"),
                 _r(F.avg("total_amount"), 2).alias("revenue_mean"))
            .orderBy(F.desc("revenue_sum"), "pickup_area").limit(n))


def revenue_by_hour(features: DataFrame) -> DataFrame:
    """Mean revenue per trip by hour with best / worst hour flags (REV5)."""
    h = (features.filter(F.col("hour").isNotNull()).groupBy("hour")
         .agg(F.avg("total_amount").alias("_avg")))
    best = Window.orderBy(F.desc("_avg"), "hour")
    worst = Window.orderBy(F.asc("_avg"), "hour")
    return h.select("hour", _r(F.col("_avg")).alias("avg_revenue"),
                    (F.row_number().over(best) == 1).cast("int").alias("is_best"),
                    (F.row_number().over(worst) == 1).cast("int").alias("is_worst"))


def _distribution(features: DataFrame, key: str) -> DataFrame:
    g = features.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("trip_count"))
    w = Window.partitionBy()
    top = Window.orderBy(F.desc("trip_count"), key)
    return g.select(key, "trip_count",
                    _r(F.col("trip_count") / F.sum("trip_count").over(w) * 100).alias("share_pct"),
                    (F.row_number().over(top) == 1).cast("int").alias("is_mode"))


def payment_distribution(features: DataFrame) -> DataFrame:
    """Share of trips by payment type; modal type flagged (REV6)."""
    return _distribution(features, "payment_type")


def passenger_distribution(features: DataFrame) -> DataFrame:
    """Share of trips by passenger count; modal count flagged (REV6)."""
    return _distribution(features, "passenger_count")


def business_insights(features: DataFrame) -> DataFrame:
    """One KPI row composed of the demand, revenue and share aggregates (REV7)."""
    dims = ["hour", "payment_type", "passenger_count"]
    n, mean = F.col("trips"), F.try_divide(F.col("total_amount_sum"), F.col("total_amount_n"))
    row = levels(cells(features, dims, ("total_amount", "fare_amount")), dims).agg(
        F.coalesce(total("trips", "hour"), F.lit(0)).alias("total_trips"),
        _r(total("total_amount_sum", "hour"), 2).alias("total_revenue"),
        _r(F.try_divide(total("fare_amount_sum", "hour"), total("fare_amount_n", "hour"))).alias("avg_fare"),
        F.try_divide(total("total_amount_sum", "hour"), total("total_amount_n", "hour")).alias("_rpt"),
        first_by("hour", -n).alias("peak_hour"), first_by("hour", n).alias("off_peak_hour"),
        first_by("hour", -mean).alias("best_revenue_hour"), first_by("hour", mean).alias("worst_revenue_hour"),
        first_by("payment_type", -n).alias("dominant_payment"),
        first_by("passenger_count", -n).alias("most_common_passengers"))
    rpt = F.col("_rpt")
    # Performance bands of revenue per trip.
    return row.select(
        "total_trips", "total_revenue", "avg_fare", _r(rpt).alias("avg_revenue_per_trip"),
        "peak_hour", "off_peak_hour", "best_revenue_hour", "worst_revenue_hour",
        X.peak_type("peak_hour").alias("peak_type"), "dominant_payment", "most_common_passengers",
        F.when(rpt > 20, "EXCELLENT").when(rpt > 15, "GOOD").when(rpt > 10, "MODERATE")
         .otherwise("NEEDS IMPROVEMENT").alias("performance_label"))


def geo_revenue(features: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Revenue by pickup area for the map (REV8), optionally matched to an
    ``areas(area, name, lat, lon)`` dimension by a size-checked join (JOI4)."""
    rev = (features.filter(F.col("pickup_area").isNotNull()).groupBy("pickup_area")
           .agg(_r(F.sum("total_amount"), 2).alias("revenue"), F.count(F.lit(1)).alias("trip_count")))
    if areas is None:
        return rev
    dim = areas.select(F.col("area").alias("pickup_area"), "name", "lat", "lon")
    return rev.join(dim, "pickup_area", "left")


def areas_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ``areas`` dimension derived from the driver's ``nation`` (test fixture): one named area for each of its rows."""
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.concat(F.lit("G"), (k + 1).cast("string")).alias("area"), F.col("n_name").alias("name"),
        (F.lit(55.0) + k.cast("double") / 100).alias("lat"), (F.lit(-4.0) - k.cast("double") / 100).alias("lon"))


def _geo_areas_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glenfare.plans.registry import features
    return geo_revenue(features(spark, sf_dir), areas_fixture(spark, sf_dir))


def distance_revenue_bins(features: DataFrame, distance_width: float = 5.0,
                          revenue_width: float = 10.0) -> DataFrame:
    """2-D binned counts of (distance, total) pairs: the scatter at scale (REV9)."""
    d = F.floor(F.col("distance_km") / distance_width).cast("int")
    r = F.floor(F.col("total_amount") / revenue_width).cast("int")
    return (features.filter(F.col("distance_km").isNotNull() & F.col("total_amount").isNotNull())
            .groupBy(d.alias("distance_bin"), r.alias("revenue_bin"))
            .agg(F.count(F.lit(1)).alias("trip_count"))
            .withColumns({"distance_from": F.col("distance_bin") * F.lit(distance_width),
                          "revenue_from": F.col("revenue_bin") * F.lit(revenue_width)}))


# --- executive dashboard ---------------------------------------------------------------------

def exec_kpis(features: DataFrame) -> DataFrame:
    """Revenue, trips, trips per area (null area counts as one), mean/median
    total, distance sum and mean (EXE1)."""
    median, = quantiles(features, ["total_amount"], [0.5])["total_amount"]
    a = features.agg(
        F.sum("total_amount").alias("_rev"), F.count(F.lit(1)).alias("total_trips"),
        (F.count_distinct("pickup_area") + F.max(F.col("pickup_area").isNull().cast("int"))).alias("_areas"),
        F.avg("total_amount").alias("_avg"), F.max(F.lit(median).cast("double")).alias("_med"),
        F.sum("distance_km").alias("_dist"), F.avg("distance_km").alias("_avgd"))
    return a.select(
        _r(F.col("_rev"), 2).alias("total_revenue"),
        _r(F.try_divide(F.col("_rev"), F.col("total_trips"))).alias("revenue_per_trip"),
        "total_trips", _r(F.try_divide(F.col("total_trips"), F.col("_areas"))).alias("trips_per_area"),
        _r(F.col("_avg")).alias("avg_total"), _r(F.col("_med")).alias("median_total"),
        _r(F.col("_dist"), 2).alias("total_distance"), _r(F.col("_avgd")).alias("avg_distance"))


def _area_rev(features: DataFrame) -> DataFrame:
    return (features.filter(F.col("pickup_area").isNotNull()).groupBy("pickup_area")
            .agg(F.sum("total_amount").alias("_rev")))


def exec_area_revenue(features: DataFrame, n: int = 10) -> DataFrame:
    """Top-n areas by revenue (EXE2; the flagship query)."""
    return (_area_rev(features).orderBy(F.desc("_rev"), "pickup_area").limit(n)
            .select("pickup_area", _r(F.col("_rev"), 2).alias("revenue")))


def exec_concentration(features: DataFrame, big: float = 10000.0) -> DataFrame:
    """Top area, its share of all revenue (null-area trips included in the
    denominator, D20) and the number of areas above ``big`` (EXE2)."""
    # One scan: the trips without an area are a group as well, and only the total reads it.
    area, rev = F.col("pickup_area"), F.col("_rev")
    known = area.isNotNull()
    return features.groupBy("pickup_area").agg(F.sum("total_amount").alias("_rev")).agg(
        F.min_by("pickup_area", F.when(known, F.struct(-rev, area))).alias("top_area"),
        F.max(F.when(known, rev)).alias("_top"), F.count_if(known & (rev > big)).alias("areas_over_threshold"),
        F.sum("_rev").alias("_all")) \
        .select("top_area", _r(F.col("_top"), 2).alias("top_revenue"),
                _r(F.try_divide(F.col("_top"), F.col("_all")) * 100).alias("concentration_pct"),
                "areas_over_threshold")


def exec_peak_hours(features: DataFrame, n: int = 3) -> DataFrame:
    """The n busiest and n quietest hours (EXE3)."""
    h = features.filter(F.col("hour").isNotNull()).groupBy("hour").agg(F.count(F.lit(1)).alias("trip_count"))
    busy = Window.orderBy(F.desc("trip_count"), "hour")
    quiet = Window.orderBy(F.asc("trip_count"), "hour")
    ranked = h.select("hour", "trip_count", F.row_number().over(busy).alias("_b"),
                      F.row_number().over(quiet).alias("_q"))
    return (ranked.filter(F.col("_b") <= n).select(F.lit("busiest").alias("kind"), F.col("_b").alias("rank"),
                                                   "hour", "trip_count")
            .unionByName(ranked.filter(F.col("_q") <= n)
                         .select(F.lit("quietest").alias("kind"), F.col("_q").alias("rank"), "hour", "trip_count")))


def exec_top_trips(features: DataFrame, n: int = 8) -> DataFrame:
    """Top-n pickup areas by trips (EXE4)."""
    return (features.filter(F.col("pickup_area").isNotNull()).groupBy("pickup_area")
            .agg(F.count(F.lit(1)).alias("trip_count")).orderBy(F.desc("trip_count"), "pickup_area").limit(n))


def exec_top_fare(features: DataFrame, n: int = 8) -> DataFrame:
    """Top-n pickup areas by mean total (EXE4)."""
    return (features.filter(F.col("pickup_area").isNotNull()).groupBy("pickup_area")
            .agg(F.avg("total_amount").alias("_m")).orderBy(F.desc("_m"), "pickup_area").limit(n)
            .select("pickup_area", _r(F.col("_m")).alias("avg_total")))


def _weekend_parts() -> dict[str, Column]:
    wk, wd = F.col("is_weekend") == 1, F.col("is_weekend") == 0
    return {"_wr": F.sum(F.when(wk, F.col("total_amount"))), "_wn": F.count_if(wk),
            "_dr": F.sum(F.when(wd, F.col("total_amount"))), "_dn": F.count_if(wd)}


def _premium():
    return (F.try_divide(F.try_divide(F.col("_wr"), F.col("_wn")), F.try_divide(F.col("_dr"), F.col("_dn"))) - 1) * 100


def weekend_premium(features: DataFrame) -> DataFrame:
    """Weekend and weekday revenue and the per-trip weekend premium % (EXE5)."""
    return features.agg(*[e.alias(name) for name, e in _weekend_parts().items()]).select(
        _r(F.col("_wr"), 2).alias("weekend_revenue"), _r(F.col("_dr"), 2).alias("weekday_revenue"),
        _r(_premium()).alias("weekend_premium_pct"))


def distance_band_revenue(features: DataFrame, short_km: float = 5.0, long_km: float = 10.0) -> DataFrame:
    """Revenue of short (<= 5 km) and long (> 10 km) trips, mean distance (EXE6)."""
    d = F.col("distance_km")
    return features.agg(
        _r(F.sum(F.when(d <= short_km, F.col("total_amount"))), 2).alias("short_trip_revenue"),
        _r(F.sum(F.when(d > long_km, F.col("total_amount"))), 2).alias("long_trip_revenue"),
        _r(F.avg(d)).alias("avg_distance"))


def time_efficiency(features: DataFrame) -> DataFrame:
    """Mean duration, revenue and trips per driving hour (EXE7)."""
    a = features.agg(F.avg("duration_min").alias("_avg"), F.sum("duration_min").alias("_mins"),
                     F.sum("total_amount").alias("_rev"), F.count(F.lit(1)).alias("_n"))
    hours = F.col("_mins") / 60
    return a.select(_r(F.col("_avg")).alias("avg_duration"),
                    _r(F.try_divide(F.col("_rev"), hours)).alias("revenue_per_hour"),
                    _r(F.try_divide(F.col("_n"), hours)).alias("trips_per_hour"))


def risk_flags(features: DataFrame, share_cut: float = 20.0, peak_factor: float = 2.0) -> DataFrame:
    """Revenue-concentration and peak-capacity risks (EXE8)."""
    dims = ["pickup_area", "hour"]
    rev, n = F.col("total_amount_sum"), F.col("trips")
    row = levels(cells(features, dims, ("total_amount",)), dims).agg(
        first_by("pickup_area", -rev).alias("top_area"), F.max(F.when(at("pickup_area"), rev)).alias("_top"),
        total("total_amount_sum", "pickup_area").alias("_all"),
        F.max(F.when(at("hour"), n)).alias("peak_hour_trips"), F.avg(F.when(at("hour"), n)).alias("_mean"))
    row = row.withColumn("concentration_pct", _r(F.try_divide(F.col("_top"), F.col("_all")) * 100))
    return row.select(
        "top_area", "concentration_pct", (F.col("concentration_pct") > share_cut).alias("concentration_risk"),
        "peak_hour_trips", _r(F.try_divide(F.col("peak_hour_trips"), F.col("_mean"))).alias("peak_to_mean"),
        (F.col("peak_hour_trips") > F.col("_mean") * peak_factor).alias("peak_capacity_risk"))


def exec_metrics(features: DataFrame) -> DataFrame:
    """The six-metric performance table in long form (EXE9)."""
    parts = _weekend_parts()
    hourly = cells(features, ["hour"], ("total_amount",), **parts)
    row = hourly.agg(
        F.sum("total_amount_sum").alias("_rev"), F.coalesce(F.sum("trips"), F.lit(0)).alias("_n"),
        F.try_divide(F.sum("total_amount_sum"), F.sum("total_amount_n")).alias("_avg"),
        F.max(F.when(F.col("hour").isNotNull(), F.col("trips"))).alias("_peak"),
        *[F.sum(name).alias(name) for name in parts])
    row = row.select(
        _r(F.col("_rev"), 2).alias("m1"), F.col("_n").cast("double").alias("m2"), _r(F.col("_avg")).alias("m3"),
        _r(F.try_divide(F.col("_rev"), F.col("_n"))).alias("m4"), F.col("_peak").cast("double").alias("m5"),
        _r(_premium()).alias("m6"))
    # Metric names and status marks of the performance table.
    return row.selectExpr(
        "stack(6, 'Total Revenue', m1, 'ok', 'Total Trips', m2, 'ok', 'Average Fare', m3, 'ok', "
        "'Revenue per Trip', m4, 'ok', 'Peak Hour Demand', m5, 'watch', 'Weekend Premium', m6, 'ok') "
        "AS (metric, value, status)")


# --- DuckDB oracle -----------------------------------------------------------------------------

def _rev_by_sql(key: str) -> str:
    return with_ctes(f"""SELECT {key}, round(s, 2) AS revenue_sum, round(m, 4) AS revenue_mean, trip_count,
      round(s / (SELECT sum(total_amount) FROM f) * 100, 4) AS revenue_share_pct,
      CASE WHEN row_number() OVER (ORDER BY s DESC, {key}) = 1 THEN 1 ELSE 0 END AS is_dominant
      FROM (SELECT {key}, sum(total_amount) AS s, avg(total_amount) AS m, count(total_amount) AS trip_count
            FROM f WHERE {key} IS NOT NULL GROUP BY {key})""")


def _dist_sql(key: str) -> str:
    return with_ctes(f"""SELECT {key}, trip_count, round(trip_count / sum(trip_count) OVER () * 100, 4) AS share_pct,
      CASE WHEN row_number() OVER (ORDER BY trip_count DESC, {key}) = 1 THEN 1 ELSE 0 END AS is_mode
      FROM (SELECT {key}, count(*) AS trip_count FROM f WHERE {key} IS NOT NULL GROUP BY {key})""")


_WK = """(SELECT sum(CASE WHEN is_weekend = 1 THEN total_amount END) AS wr,
  count(*) FILTER (WHERE is_weekend = 1) AS wn, sum(CASE WHEN is_weekend = 0 THEN total_amount END) AS dr,
  count(*) FILTER (WHERE is_weekend = 0) AS dn FROM f)"""
_PREM = "((wr / nullif(wn, 0)) / nullif(dr / nullif(dn, 0), 0) - 1) * 100"
_AREA_REV = "ar AS (SELECT pickup_area, sum(total_amount) AS rev FROM f WHERE pickup_area IS NOT NULL GROUP BY 1)"
_CONC = """SELECT (SELECT pickup_area FROM ar ORDER BY rev DESC, pickup_area LIMIT 1) AS top_area,
  round((SELECT max(rev) FROM ar), 2) AS top_revenue,
  round((SELECT max(rev) FROM ar) / (SELECT sum(total_amount) FROM f) * 100, 4) AS concentration_pct,
  (SELECT count(*) FROM ar WHERE rev > 10000) AS areas_over_threshold"""
_HOURS = "h AS (SELECT hour, count(*) AS n, avg(total_amount) AS rev FROM f WHERE hour IS NOT NULL GROUP BY hour)"

SQL = {
    "revenue_metrics": with_ctes("""SELECT round(tot, 2) AS total_revenue, round(av, 4) AS avg_revenue_per_trip,
      round(tot / nullif(dist, 0), 4) AS revenue_per_km,
      CASE WHEN tot / nullif(dist, 0) > 3 THEN 'High' WHEN tot / nullif(dist, 0) > 2 THEN 'Moderate' ELSE 'Low' END
        AS efficiency_label,
      round(sd, 4) AS revenue_std, round(sd / nullif(av, 0) * 100, 4) AS revenue_cv_pct,
      CASE WHEN sd / nullif(av, 0) * 100 < 30 THEN 'Stable' WHEN sd / nullif(av, 0) * 100 < 50 THEN 'Moderate'
           ELSE 'High' END AS variability_label
      FROM (SELECT sum(total_amount) AS tot, avg(total_amount) AS av, sum(distance_km) AS dist,
                   stddev_samp(total_amount) AS sd FROM f)"""),
    "revenue_by_payment": _rev_by_sql("payment_type"),
    "revenue_by_passengers": _rev_by_sql("passenger_count"),
    "revenue_by_area": with_ctes("""SELECT pickup_area, round(sum(total_amount), 2) AS revenue_sum,
      round(avg(total_amount), 2) AS revenue_mean FROM f WHERE pickup_area IS NOT NULL GROUP BY 1
      ORDER BY revenue_sum DESC, pickup_area LIMIT 10"""),
    "revenue_by_hour": with_ctes("""SELECT hour, round(a, 4) AS avg_revenue,
      CASE WHEN row_number() OVER (ORDER BY a DESC, hour) = 1 THEN 1 ELSE 0 END AS is_best,
      CASE WHEN row_number() OVER (ORDER BY a ASC, hour) = 1 THEN 1 ELSE 0 END AS is_worst
      FROM (SELECT hour, avg(total_amount) AS a FROM f WHERE hour IS NOT NULL GROUP BY hour)"""),
    "payment_distribution": _dist_sql("payment_type"),
    "passenger_distribution": _dist_sql("passenger_count"),
    "business_insights": with_ctes("""SELECT g.total_trips, g.total_revenue, g.avg_fare,
      round(g.rpt, 4) AS avg_revenue_per_trip,
      (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour,
      (SELECT hour FROM h ORDER BY n, hour LIMIT 1) AS off_peak_hour,
      (SELECT hour FROM h ORDER BY rev DESC, hour LIMIT 1) AS best_revenue_hour,
      (SELECT hour FROM h ORDER BY rev, hour LIMIT 1) AS worst_revenue_hour,
      CASE WHEN (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) IN (7, 8, 9) THEN 'Morning Commute'
           WHEN (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) IN (17, 18, 19) THEN 'Evening Commute'
           WHEN (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) IN (21, 22, 23) THEN 'Night Life'
           ELSE 'Other Peak' END AS peak_type,
      (SELECT payment_type FROM f WHERE payment_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        AS dominant_payment,
      (SELECT passenger_count FROM f WHERE passenger_count IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        AS most_common_passengers,
      CASE WHEN g.rpt > 20 THEN 'EXCELLENT' WHEN g.rpt > 15 THEN 'GOOD' WHEN g.rpt > 10 THEN 'MODERATE'
           ELSE 'NEEDS IMPROVEMENT' END AS performance_label
      FROM (SELECT count(*) AS total_trips, round(sum(total_amount), 2) AS total_revenue,
                   round(avg(fare_amount), 4) AS avg_fare, avg(total_amount) AS rpt FROM f) g""", _HOURS),
    "geo_revenue": with_ctes("""SELECT pickup_area, round(sum(total_amount), 2) AS revenue, count(*) AS trip_count
      FROM f WHERE pickup_area IS NOT NULL GROUP BY 1"""),
    "distance_revenue_bins": with_ctes("""SELECT distance_bin, revenue_bin, count(*) AS trip_count,
      distance_bin * CAST(5.0 AS DOUBLE) AS distance_from, revenue_bin * CAST(10.0 AS DOUBLE) AS revenue_from
      FROM (SELECT CAST(floor(distance_km / 5.0) AS INTEGER) AS distance_bin,
                   CAST(floor(total_amount / 10.0) AS INTEGER) AS revenue_bin FROM f
            WHERE distance_km IS NOT NULL AND total_amount IS NOT NULL) GROUP BY 1, 2"""),
    "exec_kpis": with_ctes("""SELECT round(sum(total_amount), 2) AS total_revenue,
      round(sum(total_amount) / nullif(count(*), 0), 4) AS revenue_per_trip, count(*) AS total_trips,
      round(count(*) / nullif(count(DISTINCT pickup_area) + max(CASE WHEN pickup_area IS NULL THEN 1 ELSE 0 END), 0), 4)
        AS trips_per_area,
      round(avg(total_amount), 4) AS avg_total, round(quantile_cont(total_amount, 0.5), 4) AS median_total,
      round(sum(distance_km), 2) AS total_distance, round(avg(distance_km), 4) AS avg_distance FROM f"""),
    "exec_area_revenue": with_ctes("SELECT pickup_area, round(rev, 2) AS revenue FROM ar "
                                   "ORDER BY rev DESC, pickup_area LIMIT 10", _AREA_REV),
    "exec_concentration": with_ctes(_CONC, _AREA_REV),
    "exec_peak_hours": with_ctes("""SELECT * FROM (
        SELECT 'busiest' AS kind, row_number() OVER (ORDER BY n DESC, hour) AS rank, hour, n AS trip_count FROM h)
        WHERE rank <= 3
      UNION ALL SELECT * FROM (
        SELECT 'quietest' AS kind, row_number() OVER (ORDER BY n ASC, hour) AS rank, hour, n AS trip_count FROM h)
        WHERE rank <= 3""", _HOURS),
    "exec_top_trips": with_ctes("""SELECT pickup_area, count(*) AS trip_count FROM f WHERE pickup_area IS NOT NULL
      GROUP BY 1 ORDER BY trip_count DESC, pickup_area LIMIT 8"""),
    "exec_top_fare": with_ctes("""SELECT pickup_area, round(m, 4) AS avg_total FROM (
      SELECT pickup_area, avg(total_amount) AS m FROM f WHERE pickup_area IS NOT NULL GROUP BY 1)
      ORDER BY m DESC, pickup_area LIMIT 8"""),
    "weekend_premium": with_ctes(f"""SELECT round(wr, 2) AS weekend_revenue, round(dr, 2) AS weekday_revenue,
      round({_PREM}, 4) AS weekend_premium_pct FROM {_WK}"""),
    "distance_band_revenue": with_ctes("""SELECT
      round(sum(CASE WHEN distance_km <= 5 THEN total_amount END), 2) AS short_trip_revenue,
      round(sum(CASE WHEN distance_km > 10 THEN total_amount END), 2) AS long_trip_revenue,
      round(avg(distance_km), 4) AS avg_distance FROM f"""),
    "time_efficiency": with_ctes("""SELECT round(avg(duration_min), 4) AS avg_duration,
      round(sum(total_amount) / nullif(sum(duration_min) / 60, 0), 4) AS revenue_per_hour,
      round(count(*) / nullif(sum(duration_min) / 60, 0), 4) AS trips_per_hour FROM f"""),
    "risk_flags": with_ctes(f"""SELECT c.top_area, c.concentration_pct, c.concentration_pct > 20 AS concentration_risk,
      p.peak_hour_trips, round(p.peak_hour_trips / nullif(p.mean_n, 0), 4) AS peak_to_mean,
      p.peak_hour_trips > p.mean_n * 2 AS peak_capacity_risk
      FROM ({_CONC}) c, (SELECT max(n) AS peak_hour_trips, avg(n) AS mean_n FROM h) p""", _AREA_REV, _HOURS),
    "exec_metrics": with_ctes(f"""SELECT metric, value, status FROM (
      SELECT 1 AS k, 'Total Revenue' AS metric, round(sum(total_amount), 2) AS value, 'ok' AS status FROM f
      UNION ALL SELECT 2, 'Total Trips', CAST(count(*) AS DOUBLE), 'ok' FROM f
      UNION ALL SELECT 3, 'Average Fare', round(avg(total_amount), 4), 'ok' FROM f
      UNION ALL SELECT 4, 'Revenue per Trip', round(sum(total_amount) / nullif(count(*), 0), 4), 'ok' FROM f
      UNION ALL SELECT 5, 'Peak Hour Demand', CAST(max(n) AS DOUBLE), 'watch' FROM h
      UNION ALL SELECT 6, 'Weekend Premium', round({_PREM}, 4), 'ok' FROM {_WK})""", _HOURS),
}

QUERIES = {name: ("features", globals()[name]) for name in SQL}

SQL["geo_revenue_areas"] = with_ctes("""SELECT r.*, n_name AS name, 55.0::DOUBLE + n_nationkey::DOUBLE / 100 AS lat,
  -4.0::DOUBLE - n_nationkey::DOUBLE / 100 AS lon
  FROM (SELECT pickup_area, round(sum(total_amount), 2) AS revenue, count(*) AS trip_count FROM f
        WHERE pickup_area IS NOT NULL GROUP BY 1) r LEFT JOIN nation ON pickup_area = 'G' || (n_nationkey + 1)""")
QUERIES["geo_revenue_areas"] = ("raw", _geo_areas_q)
