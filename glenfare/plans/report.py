"""Run-all report (REP1): the eighteen sections, and a summary row.

``report(trips)`` maps every section to its parts, each a function without
arguments that builds the part's DataFrame: nothing runs, and no model is
fitted, before a part is called and its frame is asked for.  Outliers and the data
sections read the raw trips, the others the median-imputed ones, in the order
of the original report; ``persist`` keeps the engineered table for a caller
who runs many parts (and then unpersists it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glenfare.operators import demand, features as feat, forecast, pricing, quality, revenue, segment, series, stats
from glenfare.operators.features import with_features
from glenfare.oracle import with_ctes
from glenfare.plans.joins import attach_scalars
from glenfare.plans.rollup import cells, first_by, levels, total

#: Section -> parts that read the raw trips, the raw features, or the imputed features.
SECTIONS: dict[str, tuple[list[Callable], list[Callable], list[Callable]]] = {
    "data_overview": ([quality.dataset_overview, quality.column_info, quality.dtype_summary], [], []),
    "descriptive_stats": ([], [quality.describe_numeric, quality.numeric_stats, quality.distribution_labels], []),
    "data_quality": ([quality.missing_by_column, quality.missing_patterns, quality.completeness_score,
                      quality.duplicate_rows], [], []),
    "data_cleaning": ([feat.short_trips, quality.impute_median], [], []),
    "feature_engineering": ([with_features], [], [feat.price_metric_stats, feat.trip_flag_counts]),
    "processed_cleansed": ([feat.processed, feat.processed_shape], [], []),
    "postcode_demand": ([], [], [demand.top_pickup_areas, demand.top_dropoff_areas, demand.pareto_pickup,
                                 demand.pareto_dropoff, demand.route_matrix, demand.top_routes]),
    "demand_analysis": ([], [], [demand.hourly_demand, demand.daily_demand, demand.weekly_demand, demand.monthly_demand,
                                 demand.daily_trip_counts, demand.rush_matrix]),
    "correlation": ([], [], [stats.correlation_pearson, stats.correlation_spearman, stats.strong_correlations]),
    "temporal": ([], [], [demand.hourly_averages, demand.fare_variation, demand.weekly_stats, stats.anova_fare_hour]),
    "hourly_variations": ([], [stats.outliers_iqr, stats.outliers_zscore, stats.outlier_quality,
                               stats.hourly_box_stats], []),
    "revenue": ([], [], [revenue.revenue_metrics, revenue.revenue_by_payment, revenue.revenue_by_passengers,
                         revenue.revenue_by_area, revenue.revenue_by_hour]),
    "clustering": ([], [], [segment.kmeans_elbow, segment.cluster_profiles, segment.trip_pattern_elbow,
                            segment.trip_patterns]),
    "pricing_analysis": ([], [], [pricing.price_per_km_stats, pricing.price_by_hour, pricing.price_by_day_type,
                                  pricing.price_by_distance_bin, pricing.tip_rate_stats, pricing.pricing_opportunities]),
    "fleet_optimization": ([], [], [segment.fleet_temporal_elbow, segment.fleet_temporal_clusters, demand.fleet_summary]),
    "demand_forecast": ([], [], [series.hourly_forecasts, forecast.fare_model_metrics]),
    "business": ([], [], [revenue.business_insights, revenue.exec_kpis]),
    "geospatial_map": ([], [], [revenue.geo_revenue]),
}


def report(trips: DataFrame, persist: bool = True) -> dict[str, dict[str, Callable[[], DataFrame]]]:
    """Section -> part -> function that builds the part."""
    raw = with_features(trips)
    imputed = with_features(quality.impute_median(trips))
    if persist:
        imputed = imputed.persist(StorageLevel.MEMORY_AND_DISK)

    def part(fn, df):
        return lambda: fn(df)

    out = {name: {fn.__name__: part(fn, df) for fns, df in zip(groups, (trips, raw, imputed)) for fn in fns}
           for name, groups in SECTIONS.items()}
    out["business"]["summary"] = lambda: report_summary(trips)
    return out


def report_summary(trips: DataFrame) -> DataFrame:
    """One row of headline findings: trips, revenue, peak hour, busiest
    weekday, top pickup area, completeness and outlier-quality labels."""
    f = with_features(trips)
    dims = ["hour", "day_of_week", "pickup_area"]
    lev = levels(cells(f, dims, ("total_amount",)), dims)
    n = F.col("trips")
    names = F.array(*[F.lit(d) for d in demand.WEEKDAYS])
    out = lev.agg(
        F.coalesce(total("trips", "hour"), F.lit(0)).alias("total_trips"),
        F.round(total("total_amount_sum", "hour"), 2).alias("total_revenue"), first_by("hour", -n).alias("peak_hour"),
        F.get(names, first_by("day_of_week", -n)).alias("busiest_day"),
        first_by("pickup_area", -n).alias("top_pickup_area"))
    comp = quality.completeness_score(trips).select("completeness_pct", "completeness_band")
    outq = stats.outlier_quality(f).select(F.col("quality").alias("outlier_quality"))
    for part in (comp, outq):
        out = attach_scalars(out, part)
    return out


def summary_sql() -> str:
    from glenfare.operators.demand import SQL as DS
    from glenfare.operators.quality import SQL as QS
    from glenfare.operators.stats import SQL as SS

    return with_ctes(f"""SELECT b.total_trips, b.total_revenue, p.peak_hour, w.busiest_day,
      t.top_pickup_area, c.completeness_pct, c.completeness_band, o.outlier_quality
      FROM (SELECT count(*) AS total_trips, round(sum(total_amount), 2) AS total_revenue FROM f) b,
           (SELECT peak_hour FROM ({DS['peak_hours']})) p,
           (SELECT busiest_day FROM ({DS['weekday_pattern']})) w,
           (SELECT area AS top_pickup_area FROM ({DS['top_pickup_areas']}) ORDER BY trip_count DESC, area LIMIT 1) t,
           (SELECT completeness_pct, completeness_band FROM ({QS['completeness_score']})) c,
           (SELECT quality AS outlier_quality FROM ({SS['outlier_quality']})) o""")

