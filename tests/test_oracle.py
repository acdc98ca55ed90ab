"""Spark query vs its DuckDB SQL twin on the driver's sf0.001 tables.

A cross-family subset runs by default; GLENFARE_FULL_ORACLE=1 runs every
query that has an oracle."""

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("oracle_check", ROOT / "tools" / "oracle_check.py")
oc = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(oc)

SUBSET = ["hourly_demand", "daily_demand", "top_routes", "pareto_pickup", "weekly_best", "peak_hours",
          "revenue_metrics", "business_insights", "exec_concentration", "weekend_premium", "exec_metrics",
          "dataset_overview", "numeric_stats", "categorical_top5", "duplicate_rows", "unique_values",
          "engineered_features", "holiday_flag", "sample_rows", "csv_roundtrip", "trimmed_trips",
          "price_by_distance_bin", "outliers_iqr", "hourly_box_stats", "tip_histogram", "correlation_spearman",
          "strong_correlations", "anova_fare_hour", "hourly_series", "demand_rolling", "forecast_features",
          "forecast_seasonal_naive", "standardized_features", "zone_features", "kpi_board", "risk_flags", "fleet_summary"]
SQL = E.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("GLENFARE_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in oc.TABLES:
        p = Path(SF) / f"{t}.parquet"
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(SQL[name]).df()
    c1, r1 = oc.rows_of(sp)
    c2, r2 = oc.rows_of(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
