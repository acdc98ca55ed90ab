"""Profiling, data quality and imputation (PRO1-PRO17, FIL4).

Multi-column statistics follow one pattern: a single wide global aggregate
(one pass, partial aggregation per task, one row out) and then ``stack`` of
that one-row result into one row per column.  Unpivoting the raw rows first
would multiply the shuffled data by the number of columns; stacking the
result costs nothing.  Only the moments of ``numeric_stats``, too many for one
row of generated code, are taken from unpivoted values; each task combines them
to one row a column before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glenfare.oracle import with_ctes
from glenfare.plans.heavy import heavy_hitters
from glenfare.plans.quantiles import quantiles
from glenfare.sources.schema import NUMERIC_MEASURES, TRIP_COLUMNS

STRING_COLUMNS = ["pickup_postcode", "dropoff_postcode", "payment_type"]


def _r(c, n=4):
    return F.round(c, n)


def _dtype(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _stack(row: DataFrame, cols: list[str], fields: list[str], key: str = "column_name") -> DataFrame:
    """Unpivot a one-row frame with ``{col}__{field}`` columns to one row per col."""
    parts = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{f}`" for f in fields) for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {parts}) AS ({key}, {', '.join(fields)})")


# --- overview ----------------------------------------------------------------------------------

def dataset_overview(trips: DataFrame) -> DataFrame:
    """Rows, columns, date range, whole elapsed days, revenue, mean fare (PRO1/PRO2)."""
    a = trips.agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
                  F.sum("total_amount").alias("_rev"), F.avg("fare_amount").alias("_fare"))
    return a.select(
        "n_rows", F.lit(len(trips.columns)).alias("n_columns"),
        F.date_format("min_ts", "yyyy-MM-dd").alias("min_date"), F.date_format("max_ts", "yyyy-MM-dd").alias("max_date"),
        F.expr("timestampdiff(DAY, min_ts, max_ts)").cast("bigint").alias("span_days"),
        _r(F.col("_rev"), 2).alias("total_revenue"), _r(F.col("_fare")).alias("avg_fare"))


def column_info(trips: DataFrame) -> DataFrame:
    """Ordinal, dtype, non-null and null count of every column (PRO3)."""
    cols = trips.columns
    row = trips.agg(*[F.count(F.col(c)).alias(f"{c}__non_null") for c in cols], F.count(F.lit(1)).alias("_n"))
    row = row.select(*[F.col(f"{c}__non_null") for c in cols],
                     *[(F.col("_n") - F.col(f"{c}__non_null")).alias(f"{c}__null_count") for c in cols])
    out = _stack(row, cols, ["non_null", "null_count"])
    meta = ", ".join(f"('{c}', {i}, '{_dtype(trips, c)}')" for i, c in enumerate(cols, 1))
    spark = trips.sparkSession
    dims = spark.sql(f"SELECT * FROM VALUES {meta} AS t(column_name, ordinal, dtype)")
    return out.join(F.broadcast(dims), "column_name").select("ordinal", "column_name", "dtype", "non_null", "null_count")


def dtype_summary(trips: DataFrame) -> DataFrame:
    """Number of columns per data type (PRO4)."""
    return column_info(trips).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def quick_stats(trips: DataFrame) -> DataFrame:
    """Distinct postcodes, trips, mean distance / duration, tip rate (PRO5)."""
    return trips.agg(
        F.count_distinct("pickup_postcode").alias("unique_pickup_postcodes"),
        F.count_distinct("dropoff_postcode").alias("unique_dropoff_postcodes"),
        F.count(F.lit(1)).alias("total_trips"),
        _r(F.avg("distance_km")).alias("avg_distance"), _r(F.avg("duration_min")).alias("avg_duration"),
        _r(F.try_divide(F.sum("tip_amount"), F.sum("fare_amount")) * 100).alias("tip_rate_pct"))


# --- numeric statistics ------------------------------------------------------------------------

def _moments(cols: list[str]) -> list[Column]:
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.skewness(x).alias(f"{c}__g1"), F.kurtosis(x).alias(f"{c}__g2")]
    return aggs


def _outside_and_moments(df: DataFrame, cols: list[str], fences: dict[str, tuple]) -> DataFrame:
    """One row: ``{col}__rows`` (nulls too), ``{col}__outliers`` (outside the fences) and the moments of each column.

    All moments of seven columns side by side are over 100 buffer fields, which Spark does not run as generated code.
    Here a value is a row keyed by its column's number, combined in each task: a task sends one row a column."""
    cells = [e for i, c in enumerate(cols) for e in (
        F.lit(i), F.col(c).cast("double"), (F.col(c) < _number(fences[c][0])) | (F.col(c) > _number(fences[c][1])))]
    facts = df.select(F.stack(F.lit(len(cols)), *cells).alias("_c", "_x", "_out")).groupBy("_c").agg(
        F.count(F.lit(1)).alias("_x__rows"), F.count_if("_out").alias("_x__outliers"), *_moments(["_x"]))
    names = [n.removeprefix("_x__") for n in facts.columns if n != "_c"]
    row = facts.agg(*[F.max(F.when(F.col("_c") == i, F.col(f"_x__{n}"))).alias(f"{c}__{n}") for i, c in enumerate(cols) for n in names])
    counts = [f"{c}__{n}" for c in cols for n in ("rows", "outliers", "count")]
    return row.fillna(0, counts)  # without rows there is no group


def _number(v: float | None) -> Column:
    return F.lit(v).cast("double")


def _bias_corrected(c: str):
    """Sample skewness G1 and excess kurtosis G2 from Spark's population g1, g2 (D6)."""
    n, g1, g2 = F.col(f"{c}__count"), F.col(f"{c}__g1"), F.col(f"{c}__g2")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def describe_numeric(features: DataFrame, cols: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column (PRO6)."""
    cols = cols or NUMERIC_MEASURES
    q = quantiles(features, cols, [0.25, 0.5, 0.75], accuracy)
    row = features.agg(*_moments(cols)).select(*[e for c in cols for e in (
        F.col(f"{c}__count"), _r(F.col(f"{c}__mean")).alias(f"{c}__mean"), _r(F.col(f"{c}__std")).alias(f"{c}__std"),
        F.col(f"{c}__min"), *[_r(_number(v)).alias(f"{c}__{k}") for k, v in zip(("q25", "q50", "q75"), q[c])], F.col(f"{c}__max"))])
    return _stack(row, cols, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def numeric_stats(features: DataFrame, cols: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Extended statistics per numeric column (PRO7): mean, median, std, min,
    max, quartiles, IQR, bias-corrected skewness and excess kurtosis, CV %,
    Tukey fences and the count / % of rows outside them (% of all rows)."""
    cols = cols or NUMERIC_MEASURES
    # the quartiles come first, as numbers; one scan then takes the moments and counts what is outside the fences
    quartiles = quantiles(features, cols, [0.25, 0.5, 0.75], accuracy)
    fences = {c: (q[0] - (q[2] - q[0]) * 1.5, q[2] + (q[2] - q[0]) * 1.5) if q[0] is not None else (None, None) for c, q in quartiles.items()}
    row = _outside_and_moments(features, cols, fences)
    fields = ["mean", "median", "std", "min", "max", "q1", "q3", "iqr", "skewness", "kurtosis", "cv_pct",
              "lower_bound", "upper_bound", "outlier_count", "outlier_pct"]
    sel = []
    for c in cols:
        q1, q2, q3 = map(_number, quartiles[c])
        lo, hi = map(_number, fences[c])
        skew, kurt = _bias_corrected(c)
        sel += [_r(F.col(f"{c}__mean")).alias(f"{c}__mean"), _r(q2).alias(f"{c}__median"),
                _r(F.col(f"{c}__std")).alias(f"{c}__std"), F.col(f"{c}__min"), F.col(f"{c}__max"),
                _r(q1).alias(f"{c}__q1"), _r(q3).alias(f"{c}__q3"), _r(q3 - q1).alias(f"{c}__iqr"),
                _r(skew).alias(f"{c}__skewness"), _r(kurt).alias(f"{c}__kurtosis"),
                _r(F.try_divide(F.col(f"{c}__std"), F.col(f"{c}__mean")) * 100).alias(f"{c}__cv_pct"),
                _r(lo, 6).alias(f"{c}__lower_bound"), _r(hi, 6).alias(f"{c}__upper_bound"),
                F.col(f"{c}__outliers").cast("double").alias(f"{c}__outlier_count"),
                _r(F.try_divide(F.col(f"{c}__outliers"), F.col(f"{c}__rows")) * 100).alias(f"{c}__outlier_pct")]
    return _stack(row.select(*sel), cols, fields)


def distribution_labels(features: DataFrame, cols: list[str] | None = None, kurtosis_cut: float = 3.0) -> DataFrame:
    """Skewness / kurtosis labels in both vocabularies (PRO8).

    The kurtosis compared with ``kurtosis_cut`` is the excess kurtosis (D7).
    """
    cols = cols or NUMERIC_MEASURES
    m = features.agg(*_moments(cols))
    sel = []
    for c in cols:
        skew, kurt = _bias_corrected(c)
        sel += [_r(skew).alias(f"{c}__skewness"), _r(kurt).alias(f"{c}__kurtosis")]
    st = _stack(m.select(*sel), cols, ["skewness", "kurtosis"])
    s, k = F.col("skewness"), F.col("kurtosis")
    # Labels of skewness and kurtosis.
    return st.withColumns({
        "skew_label": F.when(F.abs(s) < 0.5, "approximately symmetric").when(s > 0.5, "right-skewed")
                       .otherwise("left-skewed"),
        "tail_label": F.when(k > kurtosis_cut, "heavy-tailed").when(k < kurtosis_cut, "light-tailed")
                       .otherwise("normal-like tails"),
        "kurtosis_label": F.when(k > kurtosis_cut, "leptokurtic").when(k < kurtosis_cut, "platykurtic")
                           .otherwise("mesokurtic"),
    })


# --- categorical statistics ----------------------------------------------------------------------

def _value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for each string column, null values dropped."""
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {parts}) AS (column_name, value)").filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_stats(trips: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct count, most and least common value with % per string column (PRO9)."""
    cols = cols or STRING_COLUMNS
    vc = _value_counts(trips, cols)
    return vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"),
        _r(F.max("n") / F.sum("n") * 100).alias("most_common_pct"),
        F.max_by("value", F.struct(-F.col("n"), F.col("value"))).alias("least_common"),
        _r(F.min("n") / F.sum("n") * 100).alias("least_common_pct"))


def categorical_top5(trips: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """Top-k values per string column with counts and % (PRO9).

    The column totals are an aggregate of their own (a row per column), so
    that ``row_number() <= k`` is planned with a map-side group limit: k rows
    per column and task reach the final sort.
    """
    cols = cols or STRING_COLUMNS
    vc = _value_counts(trips, cols)
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    tot = vc.groupBy("column_name").agg(F.sum("n").alias("_total"))
    return (vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .join(tot, "column_name").withColumn("share_pct", _r(F.col("n") / F.col("_total") * 100))
            .select("column_name", "rank", "value", F.col("n").alias("count"), "share_pct"))


def with_route(trips: DataFrame) -> DataFrame:
    """``trips`` plus ``route``, both postcodes: a string with far more values than either."""
    return trips.withColumn("route", F.concat("pickup_postcode", F.lit(" > "), "dropoff_postcode"))


def frequent_values(trips: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """Top-k values of strings with many values, from candidates that are proven or else counted in full (PRO9, PRO16)."""
    return heavy_hitters(with_route(trips), cols or [*STRING_COLUMNS, "route"], k)


def business_benchmarks(features: DataFrame) -> DataFrame:
    """Revenue, fare, tip, distance, duration and per-unit revenue (PRO10)."""
    a = features.agg(F.sum("total_amount").alias("_rev"), F.avg("fare_amount").alias("_fare"),
                     F.avg("tip_amount").alias("_tip"), F.sum("tip_amount").alias("_tips"),
                     F.sum("fare_amount").alias("_fares"), F.avg("distance_km").alias("_d"),
                     F.avg("duration_min").alias("_t"), F.sum("distance_km").alias("_ds"),
                     F.sum("duration_min").alias("_ts"), F.avg("passenger_count").alias("_p"),
                     F.sum("passenger_count").alias("_ps"))
    rev = F.col("_rev")
    return a.select(
        _r(rev, 2).alias("total_revenue"), _r(F.col("_fare")).alias("avg_fare"), _r(F.col("_tip")).alias("avg_tip"),
        _r(F.try_divide(F.col("_tips"), F.col("_fares")) * 100).alias("tip_rate_pct"),
        _r(F.col("_d")).alias("avg_distance"), _r(F.col("_t")).alias("avg_duration"),
        _r(F.try_divide(rev, F.col("_ds"))).alias("revenue_per_km"),
        _r(F.try_divide(rev, F.col("_ts"))).alias("revenue_per_minute"),
        _r(F.col("_p")).alias("avg_passengers"), _r(F.try_divide(rev, F.col("_ps"))).alias("revenue_per_passenger"))


# --- missing values ----------------------------------------------------------------------------

def missing_by_column(trips: DataFrame) -> DataFrame:
    """Null count, % and dtype per column, most missing first (PRO11)."""
    return (column_info(trips)
            .select("column_name", F.col("null_count").alias("missing_count"),
                    _r(F.try_divide(F.col("null_count"), F.col("null_count") + F.col("non_null")) * 100, 2)
                    .alias("missing_pct"), "dtype")
            .orderBy(F.desc("missing_count"), "column_name"))


def missing_recommendations(trips: DataFrame) -> DataFrame:
    """Severity and imputation advice for every column with nulls (PRO12)."""
    m = missing_by_column(trips).filter(F.col("missing_count") > 0)
    p = F.col("missing_pct")
    text = F.col("dtype") == "string"
    # Severity bands and the advice vocabulary.
    return m.withColumns({
        "severity": F.when(p > 50, "Critical").when(p > 10, "Moderate").otherwise("Low"),
        "advice": F.when(p > 50, "remove column")
                   .when(p > 20, F.when(text, "mode imputation or Unknown category").otherwise("median imputation"))
                   .when(p > 5, F.when(text, "mode imputation").otherwise("mean/median imputation"))
                   .otherwise("drop rows or simple imputation"),
    })


def _null_cells(cols):
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def missing_patterns(trips: DataFrame) -> DataFrame:
    """Rows with every value null and rows with some but not all null (PRO13)."""
    n = len(trips.columns)
    k = _null_cells(trips.columns)
    return trips.agg(F.count_if(k == n).alias("all_null_rows"),
                     F.count_if((k >= 1) & (k < n)).alias("partial_null_rows"))


def completeness_score(trips: DataFrame) -> DataFrame:
    """Null cells, null %, completeness % and its band (PRO14)."""
    n = len(trips.columns)
    a = trips.agg(F.count(F.lit(1)).alias("total_rows"), F.sum(_null_cells(trips.columns)).alias("null_cells"))
    cells = F.col("total_rows") * n
    score = F.try_divide(cells - F.col("null_cells"), cells) * 100
    return a.select("total_rows", cells.alias("total_cells"), F.coalesce("null_cells", F.lit(0)).alias("null_cells"),
                    _r(F.try_divide(F.col("null_cells"), cells) * 100).alias("null_pct"),
                    _r(score).alias("completeness_pct"),
                    F.when(score >= 95, "Excellent").when(score >= 80, "Good").when(score >= 60, "Fair")
                     .otherwise("Poor").alias("completeness_band"))


def duplicate_rows(trips: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, and their % (PRO15).

    Nulls are equal, like in row duplication checks.  What is shuffled is a
    128-bit hash of each row (two seeded 64-bit ones; nulls are marked apart) and a
    count, combined in each task, so a hot row ships one small row per task.
    """
    cells = [x for c in trips.columns for x in (F.col(c), F.col(c).isNull())]
    g = (trips.groupBy(F.xxhash64(F.lit(1), *cells).alias("_h1"), F.xxhash64(F.lit(2), *reversed(cells)).alias("_h2"))
         .agg(F.count(F.lit(1)).alias("_c")))
    a = g.agg(F.sum(F.col("_c") - 1).alias("dups"), F.sum("_c").alias("_n"))
    return a.select(F.coalesce("dups", F.lit(0)).alias("duplicate_rows"),
                    _r(F.try_divide(F.col("dups"), F.col("_n")) * 100).alias("duplicate_pct"))


def unique_values(features: DataFrame, k: int = 10) -> DataFrame:
    """Distinct count (null counts as a value) and the first k sorted values
    of every string column (PRO16).

    Values are collected only after ``row_number() <= k`` (planned with a
    map-side group limit), so at most k values per column reach one task.
    """
    cols = [f.name for f in features.schema.fields if f.dataType.simpleString() == "string"]
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = features.selectExpr(f"stack({len(cols)}, {parts}) AS (feature, value)")
    d = long.groupBy("feature", "value").agg(F.lit(1).alias("_one"))
    counts = d.groupBy("feature").agg(F.count(F.lit(1)).alias("unique_count"))
    w = Window.partitionBy("feature").orderBy(F.asc_nulls_last("value"))
    first = (d.filter(F.col("value").isNotNull()).withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= k)
             .groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("first_values")))
    return counts.join(first, "feature", "left")


def postcode_examples(features: DataFrame, n: int = 10) -> DataFrame:
    """Distinct (postcode, area) pairs, first n by postcode (PRO17)."""
    return (features.select("pickup_postcode", "pickup_area").dropna().distinct()
            .orderBy("pickup_postcode", "pickup_area").limit(n))


# --- imputation --------------------------------------------------------------------------------

def impute_median(trips: DataFrame, cols: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Fill numeric nulls with the column median (FIL4).

    The medians are selected first, by rank, when the frame is built; they fill
    the nulls as constants of a single projection.
    """
    numeric = [f.name for f in trips.schema.fields
               if f.dataType.simpleString() in ("double", "int", "bigint", "float")]
    cols = cols or numeric
    med = quantiles(trips, cols, [0.5], accuracy)
    # Integer columns come back as double, as a median need not be whole.
    out = [(F.coalesce(F.col(c).cast("double"), _number(med[c][0])).alias(c) if c in cols else F.col(c))
           for c in trips.columns]
    return trips.select(*out)


# --- DuckDB oracle -----------------------------------------------------------------------------

_DT = {"ts": "timestamp_ntz", "passenger_count": "int", "distance_km": "double", "duration_min": "double",
       "fare_amount": "double", "tip_amount": "double", "total_amount": "double"}


def _dt(c):
    return _DT.get(c, "string")


def _colinfo_sql(cols):
    return " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, '{_dt(c)}' AS dtype, count({c}) AS non_null, "
        f"count(*) - count({c}) AS null_count FROM trips" for i, c in enumerate(cols, 1))


def _numeric_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        q1, q3 = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
        out = f"(SELECT count(*) FROM f WHERE f.{c} < s.lo OR f.{c} > s.hi)"
        parts.append(f"""SELECT '{c}' AS column_name, round(mean, 4) AS mean, round(median, 4) AS median,
          round(std, 4) AS std, min, max, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
          round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis, round(std / nullif(mean, 0) * 100, 4) AS cv_pct,
          round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, CAST({out} AS DOUBLE) AS outlier_count,
          round({out} / nullif(n, 0) * 100, 4) AS outlier_pct
          FROM (SELECT *, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM (
            SELECT avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS std, min({x}) AS min,
              max({x}) AS max, {q1} AS q1, {q3} AS q3, skewness({x}) AS skew, kurtosis({x}) AS kurt, count(*) AS n
            FROM f)) s""")
    return " UNION ALL ".join(parts)


def _describe_sql(cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
        round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM f"""
        for c in cols)


def _vc_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM trips WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols)


_SKEW = ("CASE WHEN abs(skewness) < 0.5 THEN 'approximately symmetric' WHEN skewness > 0.5 THEN 'right-skewed' "
         "ELSE 'left-skewed' END")


def _unique_sql():
    from glenfare.operators.features import ENGINEERED_COLUMNS
    strs = ["pickup_postcode", "dropoff_postcode", "tip_pct_raw", "payment_type", "day_name", "time_of_day",
            "pickup_area", "dropoff_area", "pickup_area_type", "dropoff_area_type", "country"]
    assert set(strs) - {"pickup_postcode", "dropoff_postcode", "tip_pct_raw", "payment_type"} <= set(ENGINEERED_COLUMNS)
    d = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, {c} AS value FROM f" for c in strs)
    return with_ctes("""SELECT c.feature, c.unique_count, v.first_values FROM
      (SELECT feature, count(*) AS unique_count FROM d GROUP BY feature) c LEFT JOIN
      (SELECT feature, array_to_string(list_sort(list(value)), ', ') AS first_values FROM
        (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn FROM d
         WHERE value IS NOT NULL) WHERE rn <= 10 GROUP BY feature) v ON c.feature = v.feature""",
                     f"d AS ({d})")


_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in TRIP_COLUMNS)

SQL = {
    "dataset_overview": with_ctes("""SELECT count(*) AS n_rows, 11 AS n_columns,
      strftime(min(ts), '%Y-%m-%d') AS min_date, strftime(max(ts), '%Y-%m-%d') AS max_date,
      CAST(date_sub('day', min(ts), max(ts)) AS BIGINT) AS span_days,
      round(sum(total_amount), 2) AS total_revenue, round(avg(fare_amount), 4) AS avg_fare FROM trips"""),
    "column_info": with_ctes(_colinfo_sql(TRIP_COLUMNS)),
    "dtype_summary": with_ctes(f"SELECT dtype, count(*) AS n_columns FROM ({_colinfo_sql(TRIP_COLUMNS)}) GROUP BY dtype"),
    "quick_stats": with_ctes("""SELECT count(DISTINCT pickup_postcode) AS unique_pickup_postcodes,
      count(DISTINCT dropoff_postcode) AS unique_dropoff_postcodes, count(*) AS total_trips,
      round(avg(distance_km), 4) AS avg_distance, round(avg(duration_min), 4) AS avg_duration,
      round(sum(tip_amount) / nullif(sum(fare_amount), 0) * 100, 4) AS tip_rate_pct FROM trips"""),
    "describe_numeric": with_ctes(_describe_sql(NUMERIC_MEASURES)),
    "numeric_stats": with_ctes(_numeric_sql(NUMERIC_MEASURES)),
    "distribution_labels": with_ctes(f"""SELECT column_name, skewness, kurtosis, {_SKEW} AS skew_label,
      CASE WHEN kurtosis > 3 THEN 'heavy-tailed' WHEN kurtosis < 3 THEN 'light-tailed' ELSE 'normal-like tails' END
        AS tail_label,
      CASE WHEN kurtosis > 3 THEN 'leptokurtic' WHEN kurtosis < 3 THEN 'platykurtic' ELSE 'mesokurtic' END
        AS kurtosis_label
      FROM ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(skewness(CAST({c} AS DOUBLE)), 4) AS skewness, round(kurtosis(CAST({c} AS DOUBLE)), 4) AS kurtosis FROM f" for c in NUMERIC_MEASURES)})"""),
    "categorical_stats": with_ctes(f"""SELECT column_name, count(*) AS n_unique,
      arg_min(value, (-n, value)) AS most_common, round(max(n) / sum(n) * 100, 4) AS most_common_pct,
      arg_max(value, (-n, value)) AS least_common, round(min(n) / sum(n) * 100, 4) AS least_common_pct
      FROM ({_vc_sql(STRING_COLUMNS)}) GROUP BY column_name"""),
    "frequent_values": with_ctes(
        "SELECT column_name, rank, value, count, share_pct FROM ("
        "SELECT column_name, value, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY column_name) "
        "* 100, 4) AS share_pct, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {e} AS value FROM trips" for c, e in [
            *[(c, c) for c in STRING_COLUMNS], ("route", "pickup_postcode || ' > ' || dropoff_postcode")])
        + ") WHERE value IS NOT NULL GROUP BY column_name, value) WHERE rank <= 5"),
    "categorical_top5": with_ctes(f"""SELECT column_name, rank, value, count, share_pct FROM (
      SELECT column_name, value, n AS count, round(n / sum(n) OVER (PARTITION BY column_name) * 100, 4) AS share_pct,
        row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank
      FROM ({_vc_sql(STRING_COLUMNS)})) WHERE rank <= 5"""),
    "business_benchmarks": with_ctes("""SELECT round(sum(total_amount), 2) AS total_revenue,
      round(avg(fare_amount), 4) AS avg_fare, round(avg(tip_amount), 4) AS avg_tip,
      round(sum(tip_amount) / nullif(sum(fare_amount), 0) * 100, 4) AS tip_rate_pct,
      round(avg(distance_km), 4) AS avg_distance, round(avg(duration_min), 4) AS avg_duration,
      round(sum(total_amount) / nullif(sum(distance_km), 0), 4) AS revenue_per_km,
      round(sum(total_amount) / nullif(sum(duration_min), 0), 4) AS revenue_per_minute,
      round(avg(passenger_count), 4) AS avg_passengers,
      round(sum(total_amount) / nullif(sum(passenger_count), 0), 4) AS revenue_per_passenger FROM f"""),
    "missing_by_column": with_ctes(f"""SELECT column_name, null_count AS missing_count,
      round(null_count / nullif(null_count + non_null, 0) * 100, 2) AS missing_pct, dtype
      FROM ({_colinfo_sql(TRIP_COLUMNS)}) ORDER BY missing_count DESC, column_name"""),
    "missing_recommendations": with_ctes(f"""SELECT column_name, missing_count, missing_pct, dtype,
      CASE WHEN missing_pct > 50 THEN 'Critical' WHEN missing_pct > 10 THEN 'Moderate' ELSE 'Low' END AS severity,
      CASE WHEN missing_pct > 50 THEN 'remove column'
           WHEN missing_pct > 20 THEN CASE WHEN dtype = 'string' THEN 'mode imputation or Unknown category'
                                          ELSE 'median imputation' END
           WHEN missing_pct > 5 THEN CASE WHEN dtype = 'string' THEN 'mode imputation' ELSE 'mean/median imputation' END
           ELSE 'drop rows or simple imputation' END AS advice
      FROM (SELECT column_name, null_count AS missing_count,
                   round(null_count / nullif(null_count + non_null, 0) * 100, 2) AS missing_pct, dtype
            FROM ({_colinfo_sql(TRIP_COLUMNS)})) WHERE missing_count > 0"""),
    "missing_patterns": with_ctes(f"""SELECT count(*) FILTER (WHERE k = 11) AS all_null_rows,
      count(*) FILTER (WHERE k >= 1 AND k < 11) AS partial_null_rows FROM (SELECT {_NULLS} AS k FROM trips)"""),
    "completeness_score": with_ctes(f"""SELECT total_rows, total_rows * 11 AS total_cells, null_cells,
      round(null_cells / nullif(total_rows * 11, 0) * 100, 4) AS null_pct,
      round((total_rows * 11 - null_cells) / nullif(total_rows * 11, 0) * 100, 4) AS completeness_pct,
      CASE WHEN (total_rows * 11 - null_cells) / nullif(total_rows * 11, 0) * 100 >= 95 THEN 'Excellent'
           WHEN (total_rows * 11 - null_cells) / nullif(total_rows * 11, 0) * 100 >= 80 THEN 'Good'
           WHEN (total_rows * 11 - null_cells) / nullif(total_rows * 11, 0) * 100 >= 60 THEN 'Fair'
           ELSE 'Poor' END AS completeness_band
      FROM (SELECT count(*) AS total_rows, CAST(coalesce(sum({_NULLS}), 0) AS BIGINT) AS null_cells FROM trips)"""),
    "duplicate_rows": with_ctes(f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows,
      round(sum(c - 1) / nullif(sum(c), 0) * 100, 4) AS duplicate_pct
      FROM (SELECT count(*) AS c FROM trips GROUP BY {', '.join(TRIP_COLUMNS)})"""),
    "unique_values": _unique_sql(),
    "postcode_examples": with_ctes("""SELECT DISTINCT pickup_postcode, pickup_area FROM f
      WHERE pickup_postcode IS NOT NULL AND pickup_area IS NOT NULL ORDER BY 1, 2 LIMIT 10"""),
    "impute_median": with_ctes(f"""SELECT ts, pickup_postcode, dropoff_postcode,
      {", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM trips)) AS {c}" for c in
                 ["distance_km", "duration_min", "fare_amount"])},
      tip_pct_raw, coalesce(tip_amount, (SELECT quantile_cont(tip_amount, 0.5) FROM trips)) AS tip_amount,
      coalesce(total_amount, (SELECT quantile_cont(total_amount, 0.5) FROM trips)) AS total_amount, payment_type,
      coalesce(CAST(passenger_count AS DOUBLE), (SELECT quantile_cont(passenger_count, 0.5) FROM trips))
        AS passenger_count FROM trips"""),
}

QUERIES = {
    **{n: ("trips", globals()[n]) for n in
       ["dataset_overview", "column_info", "dtype_summary", "quick_stats", "categorical_stats", "categorical_top5", "frequent_values",
        "missing_by_column", "missing_recommendations", "missing_patterns", "completeness_score", "duplicate_rows",
        "impute_median"]},
    **{n: ("features", globals()[n]) for n in
       ["describe_numeric", "numeric_stats", "distribution_labels", "business_benchmarks", "unique_values",
        "postcode_examples"]},
}
