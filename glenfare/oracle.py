"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each operator module keeps its SQL next to its Spark code in a ``SQL`` dict;
the bodies may read the ``trips`` and ``f`` (engineered features) common
table expressions defined here, which mirror
``glenfare.sources.schema.trips_from_lineitem`` and
``glenfare.operators.features.with_features`` expression by expression.
"""

from __future__ import annotations

TRIPS_SQL = """
SELECT
  l_shipdate + to_hours(CAST(l_partkey % 5 + l_suppkey % 20 AS INT))
             + to_minutes(CAST(l_orderkey % 60 AS INT)) AS ts,
  CASE WHEN l_suppkey % 25 = 0 THEN NULL
       WHEN l_suppkey % 25 = 1 THEN 'G12 8QQ'
       ELSE concat('G', CAST(l_suppkey % 14 + 1 AS VARCHAR), CAST(l_partkey % 9 + 1 AS VARCHAR), 'AA')
  END AS pickup_postcode,
  concat('G', CAST(l_partkey % 20 + 1 AS VARCHAR), '5', 'QS') AS dropoff_postcode,
  (l_quantity - 1) * CAST(1.25 AS DOUBLE) AS distance_km,
  l_quantity * CAST(1.5 AS DOUBLE) + l_linenumber - 2 AS duration_min,
  CAST(floor(l_extendedprice / 10) AS DOUBLE) / CAST(100 AS DOUBLE) AS fare_amount,
  concat(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), '%') AS tip_pct_raw,
  CAST(floor(l_extendedprice * l_discount / 10) AS DOUBLE) / CAST(100 AS DOUBLE) AS tip_amount,
  CAST(floor(l_extendedprice / 10) AS DOUBLE) / CAST(100 AS DOUBLE)
    + CAST(floor(l_extendedprice * l_discount / 10) AS DOUBLE) / CAST(100 AS DOUBLE) AS total_amount,
  CASE l_returnflag WHEN 'A' THEN 'Card' WHEN 'N' THEN 'Cash' ELSE 'App' END AS payment_type,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_linenumber END AS passenger_count
FROM lineitem
"""


def _area(p: str) -> str:
    s = f"upper(trim({p}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    return (f"CASE WHEN length({s}) = 6 THEN substr({s}, 1, 3) "
            f"WHEN length({s}) = 5 THEN substr({s}, 1, 2) END")


def _area_type(a: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN 'Unknown' WHEN {a} IN ('G1', 'G2', 'G3', 'G4') "
            f"THEN 'Commercial' ELSE 'Residential' END")


def _easter(y: str) -> str:
    a, b, c = f"({y} % 19)", f"({y} // 100)", f"({y} % 100)"
    d, e = f"({b} // 4)", f"({b} % 4)"
    f_ = f"(({b} + 8) // 25)"
    g = f"(({b} - {f_} + 1) // 3)"
    h = f"((19 * {a} + {b} - {d} - {g} + 15) % 30)"
    i, k = f"({c} // 4)", f"({c} % 4)"
    l_ = f"((32 + 2 * {e} + 2 * {i} - {h} - {k}) % 7)"
    m = f"(({a} + 11 * {h} + 22 * {l_}) // 451)"
    month = f"(({h} + {l_} - 7 * {m} + 114) // 31)"
    day = f"((({h} + {l_} - 7 * {m} + 114) % 31) + 1)"
    return f"make_date(CAST({y} AS INT), CAST({month} AS INT), CAST({day} AS INT))"


def holiday_case(d: str) -> str:
    """SQL twin of ``glenfare.functions.expr.scottish_holiday_name``."""
    mo, dom, wd = f"month({d})", f"day({d})", f"(isodow({d}) - 1)"
    gf = f"(CAST({_easter(f'CAST(year({d}) AS BIGINT)')} AS DATE) - INTERVAL 2 DAY)"
    return (f"CASE WHEN {mo} = 1 AND {dom} = 1 THEN 'New Year''s Day' "
            f"WHEN {mo} = 1 AND {dom} = 2 THEN 'New Year Holiday' "
            f"WHEN CAST({d} AS DATE) = CAST({gf} AS DATE) THEN 'Good Friday' "
            f"WHEN {mo} = 5 AND {wd} = 0 AND {dom} <= 7 THEN 'May Day' "
            f"WHEN {mo} = 5 AND {wd} = 0 AND {dom} >= 25 THEN 'Spring Bank Holiday' "
            f"WHEN {mo} = 8 AND {wd} = 0 AND {dom} <= 7 THEN 'Summer Bank Holiday' "
            f"WHEN {mo} = 11 AND {dom} = 30 THEN 'Saint Andrew''s Day' "
            f"WHEN {mo} = 12 AND {dom} = 25 THEN 'Christmas Day' "
            f"WHEN {mo} = 12 AND {dom} = 26 THEN 'Boxing Day' "
            f"WHEN {mo} = 1 AND {dom} = 3 AND {wd} <= 1 THEN 'New Year''s Day (substitute day)' "
            f"WHEN {mo} = 1 AND {dom} = 4 AND {wd} <= 1 THEN 'New Year Holiday (substitute day)' "
            f"WHEN {mo} = 12 AND {dom} <= 2 AND {wd} = 0 THEN 'Saint Andrew''s Day (substitute day)' "
            f"WHEN {mo} = 12 AND {dom} = 27 AND {wd} <= 1 THEN 'Christmas Day (substitute day)' "
            f"WHEN {mo} = 12 AND {dom} = 28 AND {wd} <= 1 THEN 'Boxing Day (substitute day)' END")


FEATURES_SQL = f"""
SELECT trips.*,
  CASE WHEN isnan(try_cast(nullif(replace(tip_pct_raw, '%', ''), '') AS DOUBLE)) THEN NULL
       ELSE try_cast(nullif(replace(tip_pct_raw, '%', ''), '') AS DOUBLE) END AS tip_pct,
  CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  dayname(ts) AS day_name,
  CAST(weekofyear(ts) AS INTEGER) AS week_of_year,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CAST(month(ts) AS INTEGER) AS month,
  CASE WHEN hour(ts) >= 6 AND hour(ts) < 12 THEN 'Morning'
       WHEN hour(ts) >= 12 AND hour(ts) < 17 THEN 'Afternoon'
       WHEN hour(ts) >= 17 AND hour(ts) < 22 THEN 'Evening'
       ELSE 'Night' END AS time_of_day,
  CASE WHEN ({holiday_case('CAST(ts AS DATE)')}) IS NULL THEN 0 ELSE 1 END AS is_holiday,
  {_area('pickup_postcode')} AS pickup_area,
  {_area('dropoff_postcode')} AS dropoff_area,
  {_area_type(_area('pickup_postcode'))} AS pickup_area_type,
  {_area_type(_area('dropoff_postcode'))} AS dropoff_area_type,
  total_amount / nullif(distance_km, 0) AS revenue_per_km,
  'United Kingdom' AS country
FROM trips
"""


def with_ctes(body: str, *extra: str) -> str:
    """``WITH trips AS (...), f AS (...) [, extra...] <body>``."""
    ctes = [f"trips AS ({TRIPS_SQL})", f"f AS ({FEATURES_SQL})", *extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def all_sql() -> dict[str, str]:
    import importlib
    out: dict[str, str] = {}
    for modname in ["features", "quality", "demand", "revenue", "pricing", "stats", "series",
                    "segment", "forecast", "cuboid"]:
        mod = importlib.import_module(f"glenfare.operators.{modname}")
        out.update(getattr(mod, "SQL", {}))
    from glenfare.plans.report import summary_sql
    out["report_summary"] = summary_sql()
    return out
