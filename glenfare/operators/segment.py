"""K-Means segmentation (CLU1-CLU10).

All fits use every row (the reference samples 2,000-3,000 rows first), with
population-sigma scaling and the best of ``n_init`` seeds (``plans/ml.py``); a fit is kept in
the shared folder, so clusters, profiles, highlights and the elbow read one.  Rows that
several passes read are cached while the frame is built.  Summaries are
grouped aggregates over the clustered rows (k groups, so partial
aggregation leaves one row per cluster and task), and the labels are
``F.when`` chains over those summaries.  Only ``zone_features`` (an area
aggregate) and ``standardized_features`` are SQL-comparable; cluster ids and
labels depend on the fitted model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.oracle import with_ctes
from glenfare.plans import ml
from glenfare.plans.joins import attach_scalars
from glenfare.plans.quantiles import quantiles
from glenfare.plans.stages import stored

REPORT_FEATURES = ["distance_km", "duration_min", "fare_amount", "total_amount"]
PATTERN_FEATURES = ["duration_min", "fare_amount", "distance_km"]
PRICE_FEATURES = ["total_amount", "price_per_km", "tip_rate", "distance_km"]
TIME_FEATURES = ["hour", "is_weekend", "is_peak_hour", "total_amount", "distance_km"]
COMPREHENSIVE_FEATURES = ["distance_km", "duration_min", "total_amount", "price_per_km", "tip_rate", "hour",
                          "is_weekend", "is_peak_hour"]
TEMPORAL_FEATURES = ["day_of_week", "hour", "is_weekend", "is_peak_hour"]
ZONE_FEATURES = ["avg_fare", "total_revenue", "trip_count", "avg_distance"]

# Weekday names, Monday first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _r(c, n=2):
    return F.round(c, n)


def _summary(clustered: DataFrame, cols: list[str], stats=("mean", "std")) -> DataFrame:
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    g = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                         *[_r(fn[s](c)).alias(f"{c}_{s}") for c in cols for s in stats],
                                         *[F.avg(c).alias(f"_m_{c}") for c in cols])
    # one row for each cluster: the total is a window over them
    return g.withColumn("pct", _r(F.col("size") / F.sum("size").over(Window.partitionBy()) * 100))


def _overall(c: str):
    """The mean of ``c`` over all rows, from the sizes and means of the clusters (k rows, no null in ``c``)."""
    w = Window.partitionBy()
    return F.sum(F.col(f"_m_{c}") * F.col("size")).over(w) / F.sum("size").over(w)


def _with_peak(df: DataFrame) -> DataFrame:
    return df.withColumn("is_peak_hour", X.is_peak("hour").cast("int"))


def standardized_features(features: DataFrame) -> DataFrame:
    """Population-sigma z-scores of the report clustering features (CLU1)."""
    d = features.dropna(subset=REPORT_FEATURES)
    s = ml.scale(d.select(*REPORT_FEATURES), REPORT_FEATURES).drop("features")
    return s.select(*REPORT_FEATURES, *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in REPORT_FEATURES])


def elbow(df: DataFrame, cols: list[str], ks, n_init: int = 10) -> DataFrame:
    """Inertia of K-Means on the scaled ``cols`` for each k (CLU2)."""
    rows = ml.kmeans_elbow(df.dropna(subset=cols).select(*cols), cols, ks, n_init)
    # The k values and their inertias are k numbers (bounded by the k range).
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def kmeans_elbow(features: DataFrame, ks=range(1, 8), n_init: int = 10) -> DataFrame:
    """Elbow of the report features, k = 1..7 (CLU2)."""
    return elbow(features, REPORT_FEATURES, ks, n_init)


def trip_pattern_elbow(features: DataFrame, ks=range(2, 8), n_init: int = 10) -> DataFrame:
    """Elbow of the trip patterns, k = 2..7 (CLU2)."""
    return elbow(features, PATTERN_FEATURES, ks, n_init)


def fleet_temporal_elbow(features: DataFrame, ks=range(2, 7), n_init: int = 10) -> DataFrame:
    """Elbow of the fleet's time patterns, k = 2..6 (CLU2)."""
    return elbow(_with_peak(features), TEMPORAL_FEATURES, ks, n_init)


def _customer(features: DataFrame, n_init: int) -> DataFrame:
    return ml.cluster(features.select(*REPORT_FEATURES), REPORT_FEATURES, 4, n_init)


def customer_clusters(features: DataFrame, n_init: int = 10) -> DataFrame:
    """k = 4 on distance, duration, fare, total: size and mean / std (CLU3)."""
    return _summary(_customer(features, n_init), REPORT_FEATURES).drop(*[f"_m_{c}" for c in REPORT_FEATURES])


def cluster_profiles(features: DataFrame, n_init: int = 10) -> DataFrame:
    """Cluster size, %, means, segment category and rank by mean fare, lowest first (CLU4, SRT3)."""
    s = _summary(_customer(features, n_init), REPORT_FEATURES, stats=())
    d, f = F.col("_m_distance_km"), F.col("_m_fare_amount")
    # Segment categories by mean distance and fare.
    cat = (F.when((d < 5) & (f < 12), "Short Local Trips").when((d < 10) & (f < 20), "Medium Distance Trips")
           .when((d >= 10) & (f >= 20), "Long Distance Trips").otherwise("Mixed Profile"))
    return s.select("cluster", "size", "pct", *[_r(F.col(f"_m_{c}")).alias(f"avg_{c}") for c in REPORT_FEATURES],
                    cat.alias("category"),
                    F.row_number().over(Window.orderBy(f, "cluster")).alias("fare_rank")).orderBy("fare_rank")


def cluster_highlights(features: DataFrame, n_init: int = 10) -> DataFrame:
    """Most valuable (mean total), largest and highest-revenue cluster (CLU4)."""
    s = _summary(_customer(features, n_init), REPORT_FEATURES, stats=())
    rev = F.col("_m_total_amount") * F.col("size")
    return s.agg(F.min_by("cluster", F.struct(-F.col("_m_total_amount"), F.col("cluster"))).alias("most_valuable_cluster"),
                 _r(F.max("_m_total_amount")).alias("most_valuable_avg_total"),
                 F.min_by("cluster", F.struct(-F.col("size"), F.col("cluster"))).alias("largest_cluster"),
                 F.max("size").alias("largest_size"),
                 F.min_by("cluster", F.struct(-rev, F.col("cluster"))).alias("highest_revenue_cluster"),
                 _r(F.max(rev)).alias("highest_revenue"))


def trip_patterns(features: DataFrame, n_init: int = 10) -> DataFrame:
    """k = 5 on duration, fare, distance with trip-type labels against the
    overall means and the best cluster per minute and per km (CLU5)."""
    c = ml.cluster(features.select(*PATTERN_FEATURES), PATTERN_FEATURES, 5, n_init)
    # one scan of the trips; all that follows reads the five rows
    s = stored(_summary(c, PATTERN_FEATURES, stats=("mean", "std", "min", "max")), "trip-patterns")
    s = s.withColumns({f"_o_{x}": _overall(x) for x in PATTERN_FEATURES})
    du, fa, di = (F.col(f"_m_{x}") for x in PATTERN_FEATURES)
    odu, ofa, odi = (F.col(f"_o_{x}") for x in PATTERN_FEATURES)
    # Trip-type factors against the overall means.
    label = (F.when((du < odu * 0.7) & (di < odi * 0.7), "Short-Duration, Short-Distance Trips")
             .when((du > odu * 1.3) & (di > odi * 1.3), "Long-Duration, Long-Distance Trips")
             .when(fa > ofa * 1.3, "High-Revenue Trips")
             .when((du < odu * 0.8) & (fa < ofa * 0.8), "Quick Budget Trips")
             .otherwise("Standard Trips"))
    per_min, per_km = F.try_divide(fa, du), F.try_divide(fa, di)
    s = s.withColumns({"trip_type": label, "_pm": per_min, "_pk": per_km})
    best = s.agg(F.max_by("cluster", "_pm").alias("_best_pm"), F.max_by("cluster", "_pk").alias("_best_pk"))
    s = attach_scalars(s, best)
    return s.select("cluster", "size", "pct", *[f"{x}_{st}" for x in PATTERN_FEATURES for st in ("mean", "std", "min", "max")],
                    "trip_type", _r(F.col("_pm"), 4).alias("fare_per_minute"), _r(F.col("_pk"), 4).alias("fare_per_km"),
                    (F.col("cluster") == F.col("_best_pm")).cast("int").alias("most_profitable"),
                    (F.col("cluster") == F.col("_best_pk")).cast("int").alias("most_efficient"))


def _clustering_data(features: DataFrame) -> DataFrame:
    from glenfare.operators.pricing import price_trimmed
    return _with_peak(price_trimmed(features))


def _price_fit(features: DataFrame, cols: list[str], k: int, n_init: int, probs: list[float]) -> tuple[DataFrame, list[float | None]]:
    """The clustered rows (a lazy plan) and the quantiles of the trimmed price per km.  The trim's passes, the fit's and the
    quantiles' read the same priced rows: their few columns are cached until the plan is made."""
    from glenfare.operators.pricing import priced, trim
    with ml.held(_with_peak(priced(features)).select(*{*cols, "price_per_km"})) as rows:
        d = trim(rows, "price_per_km")
        q = quantiles(d, ["price_per_km"], probs)["price_per_km"] if probs else []
        return ml.cluster(d.select(*cols), cols, k, n_init, cached=True), q


def zone_features(features: DataFrame) -> DataFrame:
    """Per pickup area: mean and sum of total, trips, mean / std distance (CLU6)."""
    z = _clustering_data(features).dropna(subset=["pickup_area", "dropoff_area", "total_amount", "distance_km"])
    return z.groupBy("pickup_area").agg(
        _r(F.avg("total_amount")).alias("avg_fare"), _r(F.sum("total_amount")).alias("total_revenue"),
        F.count(F.lit(1)).alias("trip_count"), _r(F.avg("distance_km")).alias("avg_distance"),
        _r(F.stddev_samp("distance_km")).alias("distance_std"))


def zone_clusters(features: DataFrame, n_init: int = 10) -> DataFrame:
    """K-Means (k = min(5, areas)) over the area aggregates; summary and
    value label per zone cluster (CLU6).  The input is one row per area."""
    zf = stored(zone_features(features), "zones")  # one row for each area, read by every pass of the fit
    c = ml.cluster(zf, ZONE_FEATURES, 5, n_init)
    overall = zf.agg(F.avg("avg_fare").alias("_o"))
    g = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("zone_count"), _r(F.avg("avg_fare")).alias("avg_fare"),
                                 _r(F.sum("total_revenue")).alias("total_revenue"), F.sum("trip_count").alias("total_trips"),
                                 _r(F.avg("avg_distance")).alias("avg_distance"), F.avg("avg_fare").alias("_m"))
    g = attach_scalars(g, overall)
    return g.withColumn("fare_status", F.when(F.col("_m") > F.col("_o"), "High-value zones")
                        .otherwise("Standard zones")).drop("_m", "_o")


def price_clusters(features: DataFrame, n_init: int = 10) -> DataFrame:
    """k = 4 on total, price/km, tip rate, distance; pricing label (CLU7)."""
    c, (q25,) = _price_fit(features, PRICE_FEATURES, 4, n_init, [0.25])
    s = _summary(c, PRICE_FEATURES).withColumns({"_avg": _overall("price_per_km"), "_q25": F.lit(q25).cast("double")})
    p = F.col("_m_price_per_km")
    # Price labels.
    lab = F.when(p > F.col("_avg"), "Premium pricing").when(p < F.col("_q25"), "Budget pricing").otherwise("Standard pricing")
    return s.withColumn("price_category", lab).drop("_avg", "_q25", *[f"_m_{x}" for x in PRICE_FEATURES])


def time_clusters(features: DataFrame, n_init: int = 10) -> DataFrame:
    """k = 4 on hour, weekend, peak, total, distance; demand label (CLU8)."""
    c, _ = _price_fit(features, TIME_FEATURES, 4, n_init, [])
    s = _summary(c, TIME_FEATURES)
    h, wk, pk = F.col("_m_hour"), F.col("_m_is_weekend"), F.col("_m_is_peak_hour")
    # Time labels and their cuts.
    lab = (F.when(pk > 0.5, "Peak hour demand").when(wk > 0.5, "Weekend leisure demand")
           .when((h >= 22) | (h <= 4), "Late night demand").otherwise("Off-peak demand"))
    return s.withColumn("time_category", lab).drop(*[f"_m_{x}" for x in TIME_FEATURES])


def comprehensive_clusters(features: DataFrame, n_init: int = 10) -> DataFrame:
    """k = 5 on eight features; distance and pricing labels (CLU9)."""
    c, q = _price_fit(features, COMPREHENSIVE_FEATURES, 5, n_init, [0.25, 0.75])
    s = _summary(c, COMPREHENSIVE_FEATURES)
    q1, q3 = (F.lit(v).cast("double") for v in q)
    dist, p = F.col("_m_distance_km"), F.col("_m_price_per_km")
    return s.withColumns({
        # Trip types by km, pricing types by quartile.
        "trip_type": F.when(dist > 15, "Long-distance trips").when(dist < 5, "Short-distance trips")
                      .otherwise("Medium-distance trips"),
        "pricing_type": F.when(p > q3, "Premium pricing").when(p < q1, "Budget pricing")
                         .otherwise("Standard pricing"),
    }).drop(*[f"_m_{x}" for x in COMPREHENSIVE_FEATURES])


def fleet_temporal_clusters(features: DataFrame, n_init: int = 10) -> DataFrame:
    """k = 4 on weekday, hour, weekend, peak flags; pattern label (CLU10)."""
    d = _with_peak(features).select(*TEMPORAL_FEATURES)
    c = ml.cluster(d, TEMPORAL_FEATURES, 4, n_init)
    s = _summary(c, TEMPORAL_FEATURES)
    day, h, wk, pk = (F.col(f"_m_{x}") for x in TEMPORAL_FEATURES)
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    # Demand patterns and their cuts.
    lab = (F.when(pk > 0.6, "Peak Hour Demand").when(wk > 0.7, "Weekend Leisure Demand")
           .when((h >= 22) | (h <= 4), "Late Night Demand").when((wk < 0.3) & (pk < 0.3), "Off-Peak Weekday Demand")
           .otherwise("Mixed Demand Pattern"))
    return s.withColumns({"avg_day_name": F.element_at(names, F.round(day).cast("int") + 1), "pattern_type": lab}) \
        .drop(*[f"_m_{x}" for x in TEMPORAL_FEATURES])


# --- DuckDB oracle -----------------------------------------------------------------------------

def _sql():
    from glenfare.operators.pricing import _P, _T1
    nn = " AND ".join(f"{c} IS NOT NULL" for c in REPORT_FEATURES)
    z = ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
                  f"ELSE 0 END, 6) AS z_{c}" for c in REPORT_FEATURES)
    return {
        "standardized_features": with_ctes(f"SELECT {', '.join(REPORT_FEATURES)}, {z} FROM f WHERE {nn}"),
        "zone_features": with_ctes("""SELECT pickup_area, round(avg(total_amount), 2) AS avg_fare,
          round(sum(total_amount), 2) AS total_revenue, count(*) AS trip_count, round(avg(distance_km), 2) AS avg_distance,
          round(stddev_samp(distance_km), 2) AS distance_std FROM t1
          WHERE pickup_area IS NOT NULL AND dropoff_area IS NOT NULL AND total_amount IS NOT NULL
            AND distance_km IS NOT NULL GROUP BY pickup_area""", _P, _T1),
    }


SQL = _sql()

QUERIES = {name: ("features", globals()[name]) for name in [
    "standardized_features", "zone_features", "kmeans_elbow", "trip_pattern_elbow", "fleet_temporal_elbow", "customer_clusters", "cluster_profiles",
    "cluster_highlights", "trip_patterns", "zone_clusters", "price_clusters", "time_clusters",
    "comprehensive_clusters", "fleet_temporal_clusters"]}
