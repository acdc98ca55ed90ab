"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's parquet tables (``lineitem`` projected onto the
trip schema, ``events`` for streaming), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glenfare.operators import demand, features as feat
from glenfare.sources.schema import load_trips

Query = Callable[[SparkSession, str], DataFrame]


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_trips(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.with_features(load_trips(spark, sf_dir))


def _on_features(fn) -> Query:
    return lambda spark, sf_dir: fn(features(spark, sf_dir))


def _on_trips(fn) -> Query:
    return lambda spark, sf_dir: fn(trips(spark, sf_dir))


def build() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for name in ["hourly_demand", "daily_demand", "weekly_demand", "monthly_demand",
                 "daily_trip_counts", "daily_annotations", "date_hour_demand", "hourly_demand_box",
                 "top_pickup_areas", "top_dropoff_areas", "pareto_pickup", "pareto_dropoff",
                 "route_matrix", "route_summary", "top_routes", "rush_matrix", "rush_peak",
                 "peak_hours", "weekday_pattern", "fleet_summary", "hourly_averages",
                 "fare_variation", "weekly_stats", "weekly_best"]:
        q[name] = _on_features(getattr(demand, name))
    _extend(q)
    from glenfare.plans.report import report_summary
    q["report_summary"] = _on_trips(report_summary)
    return q


def _extend(q: dict[str, Query]) -> None:
    """The other operator families."""
    import importlib
    for modname in ["features", "quality", "revenue", "pricing", "stats", "series",
                    "segment", "forecast", "cuboid"]:
        mod = importlib.import_module(f"glenfare.operators.{modname}")
        for name, spec in getattr(mod, "QUERIES", {}).items():
            kind, fn = spec
            q[name] = {"features": _on_features, "trips": _on_trips}[kind](fn) if kind != "raw" else fn
