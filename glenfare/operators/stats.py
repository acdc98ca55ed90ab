"""Outliers, box statistics, histograms, correlation and ANOVA (OUT, COR, STA).

Patterns used throughout:

* quantile fences are selected by rank (``plans/quantiles.py``) and the
  counting pass reads them as constants: the trips are never shuffled;
* correlation never materialises a row x column matrix: Pearson is one
  aggregate of co-moments for each pattern of nulls; Spearman ranks are computed
  over *distinct values* (value -> count), so a value shared by a third of all
  rows is one row of the rank table.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glenfare.functions import expr as X
from glenfare.oracle import with_ctes
from glenfare.plans.joins import attach_scalars
from glenfare.plans.quantiles import grouped_quantiles, quantiles
from glenfare.plans.stages import stored
from glenfare.sources.schema import NUMERIC_MEASURES


def _r(c, n=4):
    return F.round(c, n)


def _stack(row: DataFrame, cols: list[str], fields: list[str], key: str = "column_name") -> DataFrame:
    parts = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{f}`" for f in fields) for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {parts}) AS ({key}, {', '.join(fields)})")


# --- IQR and z-score outliers (OUT1-OUT4) -------------------------------------------------------

def _fences(features: DataFrame, cols: list[str], accuracy: int | None) -> dict[str, tuple]:
    """Per column q1, q3 and the Tukey fences: numbers, which the counting pass reads as constants."""
    q = quantiles(features, cols, [0.25, 0.75], accuracy)
    return {c: (q1, q3, *((q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5) if q1 is not None else (None, None)))
            for c, (q1, q3) in q.items()}


def _double(v: float | None) -> Column:
    return F.lit(v).cast("double")


def _iqr_counts(cols: list[str], fences: dict[str, tuple]) -> list[Column]:
    return [F.count_if((F.col(c) < _double(fences[c][2])) | (F.col(c) > _double(fences[c][3]))).alias(f"{c}__iqr_out") for c in cols]


def _with_moments(features: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` and beside each its mean and population std."""
    first = features.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__sd"))])
    return attach_scalars(features.select(*cols), first)


def _z_counts(cols: list[str]) -> list[Column]:
    return [F.count_if(F.abs(F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd"))) > 3).alias(f"{c}__z_out") for c in cols]


def outliers_iqr(features: DataFrame, cols: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Tukey-fence outliers per column, % of all rows; all-null columns skipped (OUT1)."""
    cols = cols or NUMERIC_MEASURES
    fences = _fences(features, cols, accuracy)
    row = features.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"{c}__n") for c in cols], *_iqr_counts(cols, fences))
    sel = [e for c in cols for e in (
        F.col(f"{c}__n").cast("bigint").alias(f"{c}__n"),
        *[_r(_double(v), n).alias(f"{c}__{k}") for k, v, n in zip(("q1", "q3", "lower_bound", "upper_bound"), fences[c], (4, 4, 6, 6))],
        F.col(f"{c}__iqr_out").alias(f"{c}__outlier_count"),
        _r(F.try_divide(F.col(f"{c}__iqr_out"), F.col("_rows")) * 100).alias(f"{c}__outlier_pct"))]
    out = _stack(row.select(*sel), cols, ["n", "q1", "q3", "lower_bound", "upper_bound", "outlier_count", "outlier_pct"])
    return out.filter(F.col("n") > 0).drop("n")


def outliers_zscore(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """|x - mean| / population std > 3 per column, % of all rows (OUT2).

    A constant column has no z-scores (division by zero gives null)."""
    cols = cols or NUMERIC_MEASURES
    row = _with_moments(features, cols).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"{c}__n") for c in cols], *_z_counts(cols),
        # the same in every row
        *[F.max(f"{c}__{k}").alias(f"{c}__{k}") for c in cols for k in ("mean", "sd")])
    sel = [e for c in cols for e in (
        F.col(f"{c}__n").cast("bigint").alias(f"{c}__n"), _r(F.col(f"{c}__mean")).alias(f"{c}__mean"),
        _r(F.col(f"{c}__sd")).alias(f"{c}__std_pop"), F.col(f"{c}__z_out").alias(f"{c}__outlier_count"),
        _r(F.try_divide(F.col(f"{c}__z_out"), F.col("_rows")) * 100).alias(f"{c}__outlier_pct"))]
    out = _stack(row.select(*sel), cols, ["n", "mean", "std_pop", "outlier_count", "outlier_pct"])
    return out.filter(F.col("n") > 0).drop("n")


def outlier_quality(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Total IQR / z outliers, their rates and the data-quality label (OUT3)."""
    cols = cols or NUMERIC_MEASURES
    fences = _fences(features, cols, None)
    row = _with_moments(features, cols).agg(F.count(F.lit(1)).alias("_rows"), *_iqr_counts(cols, fences), *_z_counts(cols))
    iqr = sum((F.col(f"{c}__iqr_out") for c in cols), F.lit(0))
    z = sum((F.col(f"{c}__z_out") for c in cols), F.lit(0))
    rate = F.try_divide(iqr, F.col("_rows"))
    return row.select(
        F.col("_rows").alias("total_rows"), iqr.alias("iqr_outliers"), z.alias("zscore_outliers"),
        _r(rate * 100, 2).alias("iqr_outlier_pct"), _r(F.try_divide(z, F.col("_rows")) * 100, 2).alias("zscore_outlier_pct"),
        # Quality bands on the IQR outlier rate.
        F.when(rate < 0.05, "EXCELLENT").when(rate < 0.10, "GOOD").otherwise("NEEDS ATTENTION").alias("quality"))


# Per-variable alert threshold (share of all rows) and the two
# messages (high rate, normal rate).
ALERTS = [
    ("distance_km", 0.05, "Check for GPS errors or unusual routes", "Some long/short trips expected"),
    ("duration_min", 0.05, "Check for traffic delays or system errors", "Traffic variations expected"),
    ("fare_amount", 0.05, "Check for pricing errors or premium services", "Fare variations expected"),
    ("tip_amount", 0.10, "Normal for tipping behavior", "Customer generosity varies"),
]


def outlier_alerts(features: DataFrame) -> DataFrame:
    """Alert per monitored variable with at least one IQR outlier (OUT4)."""
    spark = features.sparkSession
    rows = ", ".join(f"('{c}', {t}, '{hi}', '{lo}')" for c, t, hi, lo in ALERTS)
    dims = spark.sql(f"SELECT * FROM VALUES {rows} AS t(column_name, threshold, high_msg, normal_msg)")
    o = outliers_iqr(features, [c for c, *_ in ALERTS]).filter(F.col("outlier_count") > 0)
    share = F.col("outlier_pct") / 100
    return (o.join(dims, "column_name")
            .select("column_name", "outlier_count", "outlier_pct",
                    F.when(share > F.col("threshold"), "high").otherwise("normal").alias("alert"),
                    F.when(share > F.col("threshold"), F.col("high_msg")).otherwise(F.col("normal_msg")).alias("message")))


# --- box statistics (OUT5, DEM6) ---------------------------------------------------------------

BOX_METRICS = ["distance_km", "duration_min", "fare_amount", "tip_amount", "total_amount"]


def box_stats(df: DataFrame, key: str, metrics: list[str], accuracy: int | None = None) -> DataFrame:
    """Box-plot statistics of each metric per ``key`` value: quartiles,
    whiskers (most extreme values inside 1.5 IQR) and flier count.

    The quartiles of all keys and metrics are selected together, by rank, in
    the same passes; what they give, one row per key, is joined back for the
    counting pass.  Rows are unpivoted within the scan, never shuffled.
    """
    base = df.filter(F.col(key).isNotNull())
    if accuracy is None:
        q = stored(grouped_quantiles(base, metrics, [0.25, 0.5, 0.75], [key]), "box-quartiles")
    else:
        q = base.groupBy(key).agg(*[X.quantiles(F.col(m).cast("double"), [0.25, 0.5, 0.75], accuracy).alias(f"{m}__q") for m in metrics])
    fences = q.select(key, *[e for m in metrics for e in (
        F.col(f"{m}__q"),
        (F.col(f"{m}__q")[0] - (F.col(f"{m}__q")[2] - F.col(f"{m}__q")[0]) * 1.5).alias(f"{m}__lo"),
        (F.col(f"{m}__q")[2] + (F.col(f"{m}__q")[2] - F.col(f"{m}__q")[0]) * 1.5).alias(f"{m}__hi"))])
    j = base.select(key, *metrics).join((fences.drop(*[f"{m}__q" for m in metrics])), key)
    aggs = []
    for m in metrics:
        x, lo, hi = F.col(m), F.col(f"{m}__lo"), F.col(f"{m}__hi")
        inside = (x >= lo) & (x <= hi)
        aggs += [F.count(x).alias(f"{m}__n"), F.min(F.when(inside, x)).cast("double").alias(f"{m}__whisker_low"),
                 F.max(F.when(inside, x)).cast("double").alias(f"{m}__whisker_high"),
                 F.count_if(~inside).alias(f"{m}__n_fliers")]
    b = j.groupBy(key).agg(*aggs).join(fences.select(key, *[f"{m}__q" for m in metrics]), key)
    parts = ", ".join(
        f"'{m}', `{m}__n`, round(`{m}__q`[0], 4), round(`{m}__q`[1], 4), round(`{m}__q`[2], 4), "
        f"`{m}__whisker_low`, `{m}__whisker_high`, `{m}__n_fliers`" for m in metrics)
    return b.selectExpr(key, f"stack({len(metrics)}, {parts}) AS "
                             "(metric, n, q1, median, q3, whisker_low, whisker_high, n_fliers)")


def hourly_box_stats(features: DataFrame) -> DataFrame:
    """Box statistics by hour for distance, duration, fare, tip and total (OUT5)."""
    return box_stats(features, "hour", BOX_METRICS)


def metric_limits(features: DataFrame, accuracy: int | None = None) -> DataFrame:
    """1st / 99th percentile display limits of each box metric (OUT5)."""
    q = quantiles(features, BOX_METRICS, [0.01, 0.99], accuracy)
    row = features.sparkSession.range(1).select(*[_r(_double(v)).alias(f"{m}__{k}") for m in BOX_METRICS for k, v in zip(("p01", "p99"), q[m])])
    return _stack(row, BOX_METRICS, ["p01", "p99"], key="metric")


# --- equal-width histograms (OUT6) -------------------------------------------------------------

def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins over [min, max], last bin right-closed; empty
    bins are emitted with 0.  One global min/max row (broadcast), one grouped
    count over at most ``bins`` keys, then a left join from the bin list."""
    x = F.col(c).cast("double")
    mm = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = attach_scalars(df.select(x.alias("_x")).filter(F.col("_x").isNotNull()), mm)
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.least(F.floor(F.try_divide((F.col("_x") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))),
                  F.lit(bins - 1))
    counts = j.groupBy(F.coalesce(idx, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = attach_scalars(spark.range(bins).select(F.col("id").cast("int").alias("bin")), mm)
    return (grid.join(counts, "bin", "left")
            .select("bin", _r(F.col("_lo") + F.col("bin") * width, 6).alias("bin_start"),
                    _r(F.col("_lo") + (F.col("bin") + 1) * width, 6).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
            .filter(F.col("bin_start").isNotNull()))


def revenue_histogram(features: DataFrame) -> DataFrame:
    return histogram(features, "total_amount")


def price_histogram(features: DataFrame) -> DataFrame:
    from glenfare.operators.pricing import price_trimmed
    return histogram(price_trimmed(features), "price_per_km")


def tip_histogram(features: DataFrame) -> DataFrame:
    from glenfare.operators.pricing import trimmed_trips
    return histogram(trimmed_trips(features), "tip_rate")


# --- correlation (COR1-COR3) -------------------------------------------------------------------

def _pairs(cols):
    return list(combinations(cols, 2))


def _null_mask(cols: list[str]) -> Column:
    """Bit i is set where column i has a value."""
    return sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)), F.lit(0))


def _centres(df: DataFrame, cols: list[str], rows: int = 1000) -> dict[str, float]:
    """A value near each column's own, from its first rows.  Sums are taken of what lies
    above it, so that they do not cancel; no result depends on it otherwise."""
    head = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).limit(rows).collect()
    seen = {c: sorted(r[c] for r in head if r[c] is not None and math.isfinite(r[c])) for c in cols}
    return {c: v[len(v) // 2] if v else 0.0 for c, v in seen.items()}


def _comoments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, varies) of each pair of columns i <= j over its complete rows.

    One scan adds up, for each pattern of nulls, the centred values and their
    products; a pattern's rows are complete for all pairs that it holds, and patterns (at most
    one for each set of columns) are added up pair by pair."""
    centre = _centres(df, cols)
    k = range(len(cols))
    base = df.select(_null_mask(cols).alias("_mask"), *[(F.col(c).cast("double") - F.lit(centre[c])).alias(f"x{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in k for j in k if i <= j]
    sums = base.groupBy("_mask").agg(
        F.count(F.lit(1)).alias("n"), *[e for i in k for e in (F.sum(f"x{i}").alias(f"s{i}"), F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    parts = ", ".join(f"{i}, {j}, s{i}, s{j}, p{i}_{i}, p{j}_{j}, p{i}_{j}, lo{i}, hi{i}, lo{j}, hi{j}" for i, j in pairs)
    each = sums.selectExpr("_mask", "n", f"stack({len(pairs)}, {parts}) AS (i, j, sx, sy, sxx, syy, sxy, lox, hix, loy, hiy)")
    both = F.expr("shiftleft(1, i) | shiftleft(1, j)")
    complete = each.filter(F.col("_mask").bitwiseAND(both) == both)
    return complete.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        ((F.min("lox") < F.max("hix")) & (F.min("loy") < F.max("hiy"))).alias("varies"))


def _names(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, var1, var2) for every pair of columns, both ways round, and the diagonal."""
    rows = ", ".join(f"({min(i, j)}, {max(i, j)}, '{a}', '{b}')" for i, a in enumerate(cols) for j, b in enumerate(cols))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(i, j, var1, var2)")


def correlation_pearson(features: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson matrix, pairwise-complete rows, null where undefined (COR1)."""
    cols = cols or NUMERIC_MEASURES
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    r = F.try_divide(F.col("sxy") - sx * sy / n, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))
    pairs = _comoments(features, cols).select("i", "j", F.when(F.col("varies"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(r)).alias("r"))
    return _names(features, cols).join(pairs, ["i", "j"], "left").select("var1", "var2", _r(F.col("r"), digits).alias("r"))


def _rank_sets(df: DataFrame, cols: list[str]) -> tuple[list[frozenset], dict[tuple[int, int], int]]:
    """The different sets of null patterns that some pair of columns is complete in, and each pair's set."""
    masks = [r["m"] for r in df.select(_null_mask(cols).alias("m")).distinct().collect()]  # at most one for each set of columns
    sets: list[frozenset] = []
    of = {}
    for i, j in combinations(range(len(cols)), 2):
        both = 1 << i | 1 << j
        s = frozenset(m for m in masks if m & both == both)
        if s not in sets:
            sets.append(s)
        of[i, j] = sets.index(s)
    return sets, of


def _average_ranks(df: DataFrame, cols: list[str], sets: list[frozenset]) -> DataFrame:
    """(c, v, r): the average rank of each value of each column within each set of patterns, centred.

    Values with their counts are dealt to ranges; a window partition is a range of one
    column, and the counts of the ranges below are added as an offset."""
    parts = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(cols))
    long = df.select(_null_mask(cols).alias("m"), *cols).selectExpr("m", f"stack({len(cols)}, {parts}) AS (c, v)").filter("v IS NOT NULL")
    k = range(len(sets))
    counts = long.groupBy("c", "v").agg(*[F.count_if(F.col("m").isin(*sets[s])).alias(f"n{s}") for s in k])
    ranged = stored(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "spearman-values")
    run = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("c", "part").agg(*[F.sum(f"n{s}").alias(f"t{s}") for s in k])
    below = sums.select("c", "part", *[(F.sum(f"t{s}").over(run) - F.col(f"t{s}")).alias(f"b{s}") for s in k],
                        *[F.sum(f"t{s}").over(Window.partitionBy("c")).alias(f"all{s}") for s in k])
    w = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.select("c", "part", "v", *[f"n{s}" for s in k], *[F.sum(f"n{s}").over(w).alias(f"u{s}") for s in k])
    # the mean of all ranks is (all + 1) / 2
    ranks = [(F.col(f"b{s}") + F.col(f"u{s}") - F.col(f"n{s}") / 2 - F.col(f"all{s}") / 2).alias(f"r{s}") for s in k]
    return stored(inside.join(below, ["c", "part"]).select("c", "v", *ranks), "spearman-ranks")


def correlation_spearman(features: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Spearman matrix with average ranks over each pair's complete rows (COR2).

    Ranks differ between pairs only through the rows that a pair is complete in, so
    they are made for each such set of rows (one, where there are no nulls).  A row looks its
    ranks up by value: small rank tables are broadcast, large ones joined by
    shuffles whose hot values Spark splits.  One scan then adds up the products."""
    cols = cols or NUMERIC_MEASURES
    sets, of = _rank_sets(features, cols)
    rows = features.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    if of:
        ranks = _average_ranks(features, cols, sets)
        for i in range(len(cols)):
            needed = sorted({s for pair, s in of.items() if i in pair})
            table = ranks.filter(F.col("c") == i).select(F.col("v").alias(f"x{i}"), *[F.col(f"r{s}").alias(f"r{i}_{s}") for s in needed])
            rows = rows.join(table, f"x{i}", "left")
    both = {p: F.col(f"x{p[0]}").isNotNull() & F.col(f"x{p[1]}").isNotNull() for p in of}

    def total(p, a, b):
        return F.sum(F.when(both[p], F.col(f"r{a}_{of[p]}") * F.col(f"r{b}_{of[p]}")))
    # a column's squares are the same for all pairs of a set; both members of a pair are complete in it
    squares = {(a, of[p]): p for p in of for a in p}
    row = rows.agg(*[total(p, *p).alias(f"p{p[0]}_{p[1]}") for p in of], *[total(p, a, a).alias(f"q{a}_{s}") for (a, s), p in squares.items()],
                   *[F.when(F.min(f"x{i}") < F.max(f"x{i}"), 1.0).alias(f"d{i}") for i in range(len(cols))])
    values = [f"{i}, {j}, try_divide(p{i}_{j}, sqrt(q{i}_{s}) * sqrt(q{j}_{s}))" for (i, j), s in of.items()]
    values += [f"{i}, {i}, d{i}" for i in range(len(cols))]
    long = row.selectExpr(f"stack({len(values)}, {', '.join(values)}) AS (i, j, r)")
    return _names(features, cols).join(long, ["i", "j"], "left").select("var1", "var2", _r(F.col("r"), digits).alias("r"))


# Business tags of strong pairs (unordered column pairs).
PAIR_TAGS = [
    ("distance_km", "duration_min", "longer trips take more time"),
    ("distance_km", "fare_amount", "distance-based pricing"),
    ("fare_amount", "total_amount", "tips are additional to base fare"),
]


def strong_correlations(features: DataFrame, cols: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Pairs (in column order) with |r| > cut, strength label and tag (COR3)."""
    cols = cols or NUMERIC_MEASURES
    order = {c: i for i, c in enumerate(cols)}
    pr = correlation_pearson(features, cols)
    pos1 = F.element_at(F.create_map(*[e for c in cols for e in (F.lit(c), F.lit(order[c]))]), F.col("var1"))
    pos2 = F.element_at(F.create_map(*[e for c in cols for e in (F.lit(c), F.lit(order[c]))]), F.col("var2"))
    tag = None
    for a, b, t in PAIR_TAGS:
        cond = ((F.col("var1") == a) & (F.col("var2") == b)) | ((F.col("var1") == b) & (F.col("var2") == a))
        tag = F.when(cond, t) if tag is None else tag.when(cond, t)
    r = F.abs(F.col("r"))
    return (pr.filter((pos1 < pos2) & (r > cut))
            .select("var1", "var2", "r",
                    F.when(r > 0.8, "VERY STRONG").when(r > 0.6, "STRONG").otherwise("MODERATE").alias("strength"),
                    tag.alias("business_tag")))


# --- one-way ANOVA (STA1) ----------------------------------------------------------------------

def _anova_parts(features: DataFrame, value: str, group: str) -> DataFrame:
    """df1, df2, the sums of squares and F, unrounded, from one grouped scan:
    the grand mean follows from the groups."""
    d = features.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total_n"),
              # between groups: the variance of the group means, weighted by size
              F.collect_list(F.struct("n", "m")).alias("_groups"),
              F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"))
    mean = F.try_divide(F.aggregate("_groups", F.lit(0.0), lambda s, x: s + x["n"] * x["m"]), F.col("total_n"))
    a = a.withColumn("_mean", mean)
    a = a.withColumn("ssb", F.aggregate("_groups", F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["m"] - F.col("_mean"), 2)))
    df1, df2 = F.col("k") - 1, F.col("total_n") - F.col("k")
    return a.select(df1.cast("bigint").alias("df_between"), df2.cast("bigint").alias("df_within"),
                    F.when(F.col("k") > 0, F.col("ssb")).alias("ss_between"), F.col("ssw").alias("ss_within"),
                    F.try_divide(F.try_divide(F.col("ssb"), df1), F.try_divide(F.col("ssw"), df2)).alias("f_stat"))


def anova_fare_hour(features: DataFrame, value: str = "fare_amount", group: str = "hour") -> DataFrame:
    """One-way ANOVA F statistic of fare across hours (STA1)."""
    p = _anova_parts(features, value, group)
    return p.select("df_between", "df_within", *[_r(F.col(c), 4).alias(c) for c in ("ss_between", "ss_within", "f_stat")])


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b) without the cancellation of lgamma(b) - lgamma(a + b) for a large b."""
    a, b = min(a, b), max(a, b)
    if b < 1e4:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def stirling(z):  # ln gamma(z) less its leading terms
        return 1 / (12 * z) - 1 / (360 * z ** 3)
    drop = (b - 0.5) * math.log1p(a / b) + a * math.log(a + b) - a  # leading terms of lgamma(a + b) - lgamma(b)
    return math.lgamma(a) - drop - stirling(a + b) + stirling(b)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated until it stands still."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h, m = d, 0
    while True:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                  -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + t * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + t / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-14:
            return h
        if m > 100 + 20 * math.sqrt(a + b):  # it needs about sqrt(max(a, b)) terms
            raise ArithmeticError(f"the F tail did not converge for {a}, {b}, {x}")


def _gamma_tail(s: float, u: float) -> float:
    """Regularised upper incomplete gamma function Q(s, u)."""
    front = math.exp(s * math.log(u) - u - math.lgamma(s))
    if u < s + 1:  # series of the lower part
        term = total = 1.0 / s
        k = s
        while term > total * 1e-17:
            k += 1
            term *= u / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b, c, n = u + 1 - s, 1 / tiny, 0
    d = h = 1 / b
    while True:
        n += 1
        t = -n * (n - s)
        b += 2
        d = 1 / (t * d + b)
        c = b + t / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h


def f_sf(f: float | None, d1: float | None, d2: float | None) -> float:
    """Upper tail P(F > f) of the F(d1, d2) distribution: the incomplete beta
    function at x = d2 / (d2 + d1 f).  For a large d2 that x is too close to 1 to
    tell, and the tail is Q(d1 / 2, -T ln x), T = d2 / 2 + (d1 / 2 - 1) / 2, with a
    relative error of the order of (d1 / d2)^2."""
    if f is None or not d1 or not d2 or d1 < 0 or d2 < 0 or f != f:
        return float("nan")
    if f <= 0:
        return 1.0
    a, b = d2 / 2.0, d1 / 2.0
    if a > 1e5 and b < a / 1e4:
        return _gamma_tail(b, (a + (b - 1) / 2) * math.log1p(d1 * f / d2))
    x, y = d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)  # x + y = 1, each without cancelling
    front = math.exp(-a * math.log1p(d1 * f / d2) + b * math.log(y) - _log_beta(a, b))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, y) / b


def anova_significance(features: DataFrame, alpha: float = 0.05) -> DataFrame:
    """F, p-value and significance label (STA1).  The test statistic is one row;
    its p-value, from the unrounded F, is computed where the plan is built."""
    row = _anova_parts(features, "fare_amount", "hour").first()
    p = f_sf(row["f_stat"], row["df_between"], row["df_within"])
    verdict = "significant fare differences across hours" if p < alpha else "no significant fare differences across hours"
    return anova_fare_hour(features).withColumns({"p_value": F.lit(p), "significant": F.lit(verdict)})


# --- DuckDB oracle -----------------------------------------------------------------------------

def _outlier_sql(cols, kind):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        stats = (f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, avg({x}) AS mean, "
                 f"stddev_pop({x}) AS sd, count({c}) AS n, count(*) AS rows FROM f)")
        lo, hi = "(s.q1 - (s.q3 - s.q1) * 1.5)", "(s.q3 + (s.q3 - s.q1) * 1.5)"
        iqr = f"(SELECT count(*) FROM f WHERE f.{c} < {lo} OR f.{c} > {hi})"
        z = f"(SELECT count(*) FROM f WHERE abs((f.{c} - s.mean) / nullif(s.sd, 0)) > 3)"
        if kind == "iqr":
            parts.append(f"""SELECT '{c}' AS column_name, round(q1, 4) AS q1, round(q3, 4) AS q3,
              round({lo}, 6) AS lower_bound, round({hi}, 6) AS upper_bound, {iqr} AS outlier_count,
              round({iqr} / rows * 100, 4) AS outlier_pct FROM {stats} s WHERE n > 0""")
        elif kind == "z":
            parts.append(f"""SELECT '{c}' AS column_name, round(mean, 4) AS mean, round(sd, 4) AS std_pop,
              {z} AS outlier_count, round({z} / rows * 100, 4) AS outlier_pct FROM {stats} s WHERE n > 0""")
        else:
            parts.append(f"SELECT {iqr} AS iqr, {z} AS z, rows FROM {stats} s")
    return " UNION ALL ".join(parts)


def _box_sql(src, key, metrics):
    parts = []
    for m in metrics:
        x = f"CAST({m} AS DOUBLE)"
        parts.append(f"""SELECT d.{key}, '{m}' AS metric, count({m}) AS n, round(any_value(q.q1), 4) AS q1,
          round(any_value(q.q2), 4) AS median, round(any_value(q.q3), 4) AS q3,
          CAST(min(CASE WHEN {m} >= q.lo AND {m} <= q.hi THEN {m} END) AS DOUBLE) AS whisker_low,
          CAST(max(CASE WHEN {m} >= q.lo AND {m} <= q.hi THEN {m} END) AS DOUBLE) AS whisker_high,
          count(*) FILTER (WHERE NOT ({m} >= q.lo AND {m} <= q.hi) AND {m} IS NOT NULL) AS n_fliers
          FROM {src} d JOIN (SELECT {key}, q1, q2, q3, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM
            (SELECT {key}, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3
             FROM {src} WHERE {key} IS NOT NULL GROUP BY {key})) q ON d.{key} = q.{key} GROUP BY d.{key}""")
    return " UNION ALL ".join(parts)


def _hist_sql(src, c, bins=30):
    return f"""SELECT g.bin, round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_start,
      round(lo + (g.bin + 1) * (hi - lo) / {bins}, 6) AS bin_end, CAST(coalesce(h.cnt, 0) AS BIGINT) AS count
      FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g
      CROSS JOIN (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM {src}) mm
      LEFT JOIN (SELECT CAST(coalesce(least(floor((x - lo) * {bins} / nullif(hi - lo, 0)), {bins - 1}), 0) AS INTEGER) AS bin,
                        count(*) AS cnt
                 FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL),
                      (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM {src}) GROUP BY 1) h
      ON g.bin = h.bin WHERE lo IS NOT NULL"""


def _pearson_sql(cols):
    rows = []
    for a, b in _pairs(cols) + [(c, c) for c in cols]:
        flt = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        r = (f"round(covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FILTER (WHERE {flt}) / "
             f"nullif(stddev_pop(CAST({a} AS DOUBLE)) FILTER (WHERE {flt}) * "
             f"stddev_pop(CAST({b} AS DOUBLE)) FILTER (WHERE {flt}), 0), 6)")
        rows.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {r} AS r FROM f")
        if a != b:
            rows.append(f"SELECT '{b}' AS var1, '{a}' AS var2, {r} AS r FROM f")
    return " UNION ALL ".join(rows)


def _spearman_sql(cols):
    rows = []
    for a, b in _pairs(cols) + [(c, c) for c in cols]:
        rk = (f"(SELECT rank() OVER (ORDER BY CAST({a} AS DOUBLE)) + (count(*) OVER (PARTITION BY CAST({a} AS DOUBLE)) - 1) / 2.0 AS rx, "
              f"rank() OVER (ORDER BY CAST({b} AS DOUBLE)) + (count(*) OVER (PARTITION BY CAST({b} AS DOUBLE)) - 1) / 2.0 AS ry "
              f"FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
        r = ("round(CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END, 6)")
        rows.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {r} AS r FROM {rk}")
        if a != b:
            rows.append(f"SELECT '{b}' AS var1, '{a}' AS var2, {r} AS r FROM {rk}")
    return " UNION ALL ".join(rows)


def _strong_sql(cols):
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(cols))
    tag = " ".join(f"WHEN (var1 = '{a}' AND var2 = '{b}') OR (var1 = '{b}' AND var2 = '{a}') THEN '{t}'"
                   for a, b, t in PAIR_TAGS)
    return f"""SELECT var1, var2, r,
      CASE WHEN abs(r) > 0.8 THEN 'VERY STRONG' WHEN abs(r) > 0.6 THEN 'STRONG' ELSE 'MODERATE' END AS strength,
      CASE {tag} END AS business_tag
      FROM ({_pearson_sql(cols)}) p JOIN (VALUES {order}) o1(c, i) ON p.var1 = o1.c
      JOIN (VALUES {order}) o2(c, i) ON p.var2 = o2.c WHERE o1.i < o2.i AND abs(r) > 0.5"""


def _sql():
    from glenfare.operators.pricing import _P, _T1, _T2
    cols = NUMERIC_MEASURES
    alerts = ", ".join(f"('{c}', {t}, '{hi}', '{lo}')" for c, t, hi, lo in ALERTS)
    anova = """(SELECT count(*) AS k, any_value(total_n) AS total_n,
        sum(n * (m - grand_mean) * (m - grand_mean)) AS ssb, sum(coalesce((n - 1) * v, 0)) AS ssw FROM
        (SELECT hour, count(*) AS n, avg(fare_amount) AS m, var_samp(fare_amount) AS v FROM f
         WHERE fare_amount IS NOT NULL AND hour IS NOT NULL GROUP BY hour),
        (SELECT count(*) AS total_n, avg(fare_amount) AS grand_mean FROM f
         WHERE fare_amount IS NOT NULL AND hour IS NOT NULL))"""
    return {
        "outliers_iqr": with_ctes(_outlier_sql(cols, "iqr")),
        "outliers_zscore": with_ctes(_outlier_sql(cols, "z")),
        "outlier_quality": with_ctes(f"""SELECT any_value(rows) AS total_rows, sum(iqr) AS iqr_outliers,
          sum(z) AS zscore_outliers, round(sum(iqr) / any_value(rows) * 100, 2) AS iqr_outlier_pct,
          round(sum(z) / any_value(rows) * 100, 2) AS zscore_outlier_pct,
          CASE WHEN sum(iqr) / any_value(rows) < 0.05 THEN 'EXCELLENT' WHEN sum(iqr) / any_value(rows) < 0.10 THEN 'GOOD'
               ELSE 'NEEDS ATTENTION' END AS quality FROM ({_outlier_sql(cols, 'all')})"""),
        "outlier_alerts": with_ctes(f"""SELECT o.column_name, outlier_count, outlier_pct,
          CASE WHEN outlier_pct / 100 > threshold THEN 'high' ELSE 'normal' END AS alert,
          CASE WHEN outlier_pct / 100 > threshold THEN high_msg ELSE normal_msg END AS message
          FROM ({_outlier_sql([c for c, *_ in ALERTS], 'iqr')}) o
          JOIN (VALUES {alerts}) a(column_name, threshold, high_msg, normal_msg) ON o.column_name = a.column_name
          WHERE outlier_count > 0"""),
        "hourly_box_stats": with_ctes(_box_sql("f", "hour", BOX_METRICS)),
        "hourly_demand_box": with_ctes(_box_sql("dh", "hour", ["trip_count"]).replace("'trip_count' AS metric, ", ""),
                                       """dh AS (SELECT strftime(ts, '%Y-%m-%d') AS date, hour, count(*) AS trip_count
                                          FROM f WHERE ts IS NOT NULL GROUP BY 1, 2)"""),
        "metric_limits": with_ctes(" UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(quantile_cont(CAST({m} AS DOUBLE), 0.01), 4) AS p01, "
            f"round(quantile_cont(CAST({m} AS DOUBLE), 0.99), 4) AS p99 FROM f" for m in BOX_METRICS)),
        "revenue_histogram": with_ctes(_hist_sql("f", "total_amount")),
        "price_histogram": with_ctes(_hist_sql("t1", "price_per_km"), _P, _T1),
        "tip_histogram": with_ctes(_hist_sql("t", "tip_rate"), _P, _T1, _T2),
        "correlation_pearson": with_ctes(_pearson_sql(cols)),
        "correlation_spearman": with_ctes(_spearman_sql(cols)),
        "strong_correlations": with_ctes(_strong_sql(cols)),
        "anova_fare_hour": with_ctes(f"""SELECT CAST(k - 1 AS BIGINT) AS df_between, CAST(total_n - k AS BIGINT) AS df_within,
          round(ssb, 4) AS ss_between, round(ssw, 4) AS ss_within,
          round((ssb / nullif(k - 1, 0)) / nullif(ssw / nullif(total_n - k, 0), 0), 4) AS f_stat FROM {anova}"""),
    }


SQL = _sql()

QUERIES = {**{name: ("features", globals()[name]) for name in SQL if name != "hourly_demand_box"},
           "anova_significance": ("features", anova_significance)}
