"""The KPI cuboid: one scan of trips from which figures by any dimension are added up.

``kpi_cuboid`` holds a row for each observed combination of area, hour, weekday, payment,
passengers and distance band: at most some 300,000 for 15 areas, however many trips there are,
and one partial row each a task.  Beside counts and sums it holds centred sums of squares, which
merge without loss far from zero.  ``kpi_board`` stores the cuboid once and reads the
board of all dimensions from it; ``cuboid=`` takes one that is stored already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glenfare.oracle import with_ctes
from glenfare.plans.stages import stored

DIMS = ["pickup_area", "hour", "day_of_week", "payment_type", "passenger_count", "distance_band"]
MEASURES = ["total_amount", "fare_amount", "distance_km", "duration_min"]


def distance_band(short_km: float = 5.0, long_km: float = 10.0) -> Column:
    """short (<= ``short_km``), long (> ``long_km``) or medium; null without a distance."""
    d = F.col("distance_km")
    return F.when(d <= short_km, "short").when(d > long_km, "long").when(d.isNotNull(), "medium")


def kpi_cuboid(features: DataFrame) -> DataFrame:
    """Trips, and count, sum and centred sum of squares of each measure, by ``DIMS`` (null is a value of each)."""
    return features.withColumn("distance_band", distance_band()).groupBy(*DIMS).agg(
        F.count(F.lit(1)).alias("trips"),
        *[e for c in MEASURES for e in (F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_sum"),
                                        (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"))])


def _kpi_cuboid_q(features: DataFrame) -> DataFrame:
    # shown with count times squares: of amounts in cents it has four decimals, so that rounding meets no ties
    return kpi_cuboid(features).select(*DIMS, "trips", *[e for m in MEASURES for e in (
        f"{m}_n", F.round(f"{m}_sum", 4).alias(f"{m}_sum"),
        F.round(F.col(f"{m}_m2") * F.col(f"{m}_n"), 4).alias(f"{m}_n_m2"))])


def kpi_board(features: DataFrame | None = None, cuboid: DataFrame | None = None) -> DataFrame:
    """For every value of every dimension: trips and their share, revenue and its share, mean and standard deviation of the
    total, mean fare, distance and duration.  ``level`` is the dimension, ``key`` the value (null where unknown)."""
    c = stored(kpi_cuboid(features), "kpi-cuboid") if cuboid is None else cuboid
    # six rows a cell, of a cuboid whose size does not follow the trips
    long = c.select(F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.col(d).cast("string").alias("key"))
                                        for d in DIMS])).alias("at"), *[x for x in c.columns if x not in DIMS])
    sums = long.groupBy("at").agg(F.sum("trips").alias("trips"), *[
        F.sum(f"{m}_{p}").alias(f"{m}_{p}") for m in MEASURES for p in ("n", "sum")])
    n, s = F.col("total_amount_n"), F.col("total_amount_sum")
    mean = sums.select(F.col("at").alias("_at"), F.try_divide(s, n).alias("_mean"))
    # parallel variance: a cell's own squares, and those of its mean around the group's
    apart = F.try_divide(s, n) - F.col("_mean")
    m2 = (long.join(mean, F.col("at").eqNullSafe(F.col("_at")))
          .groupBy("_at").agg(F.sum(F.col("total_amount_m2") + n * apart * apart).alias("_m2")))
    j = sums.join(m2, F.col("at").eqNullSafe(F.col("_at")))
    all_trips = F.lit(c.agg(F.sum("trips")).first()[0]).cast("bigint")
    all_revenue = F.lit(c.agg(F.sum("total_amount_sum")).first()[0]).cast("double")

    def avg(m: str) -> Column:
        return F.round(F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_n")), 4)

    return j.select(
        "at.level", "at.key", "trips", F.round(F.try_divide(F.col("trips"), all_trips) * 100, 4).alias("trips_pct"),
        F.round(s, 2).alias("revenue"), F.round(F.try_divide(s, all_revenue) * 100, 4).alias("revenue_pct"),
        avg("total_amount").alias("avg_total"),
        F.round(F.sqrt(F.try_divide(F.col("_m2"), F.nullif(n - 1, F.lit(0)))), 4).alias("std_total"),
        avg("fare_amount").alias("avg_fare"), avg("distance_km").alias("avg_distance"),
        avg("duration_min").alias("avg_duration"))


# --- DuckDB oracle -----------------------------------------------------------------------------

_BAND = ("CASE WHEN distance_km <= 5 THEN 'short' WHEN distance_km > 10 THEN 'long' "
         "WHEN distance_km IS NOT NULL THEN 'medium' END")


def _sql():
    g = f"(SELECT *, {_BAND} AS distance_band FROM f)"
    measures = ", ".join(f"count({m}) AS {m}_n, round(sum({m}), 4) AS {m}_sum, "
                         f"round(var_pop({m}) * count({m}) * count({m}), 4) AS {m}_n_m2"
                         for m in MEASURES)
    figures = """count(*) AS trips, round(count(*) / (SELECT count(*) FROM f) * 100, 4) AS trips_pct,
      round(sum(total_amount), 2) AS revenue,
      round(sum(total_amount) / (SELECT sum(total_amount) FROM f) * 100, 4) AS revenue_pct,
      round(avg(total_amount), 4) AS avg_total, round(stddev_samp(total_amount), 4) AS std_total,
      round(avg(fare_amount), 4) AS avg_fare, round(avg(distance_km), 4) AS avg_distance,
      round(avg(duration_min), 4) AS avg_duration"""
    board = " UNION ALL ".join(f"SELECT '{d}' AS level, CAST({d} AS VARCHAR) AS key, {figures} FROM {g} GROUP BY {d}"
                               for d in DIMS)
    return {"kpi_cuboid": with_ctes(f"SELECT {', '.join(DIMS)}, count(*) AS trips, {measures} FROM {g} GROUP BY ALL"),
            "kpi_board": with_ctes(board)}


SQL = _sql()

QUERIES = {"kpi_cuboid": ("features", _kpi_cuboid_q), "kpi_board": ("features", kpi_board)}
