"""Most frequent values of strings with many values: candidates, exact counts, and a proof.

A value count shuffles every distinct value once a task.  Where a few values hold much of
the rows it is enough to find candidates by a mergeable sketch of bounded size (Spark's
``approx_top_k``, one a column, in one scan) and to count these exactly in a second one.
No other value can have more rows than

* all rows that are not of a candidate, and
* the sketch's error: a value that it does not return has at most twice 3.5 / (map size) of
  all rows, or, where it returns as many as it was asked for, at most the least of its estimates.

If the k-th exact count is above the lesser of the two, the answer is proven; a column without that
proof (values of about equal counts) is counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that a sketch follows, and candidates that it is asked for.
TRACKED, CANDIDATES = 10_000, 100
#: Twice 3.5 / (map size), where a sketch that follows t values has a map of at least t / 0.75.
UNSEEN = 2 * 3.5 * 0.75

SCHEMA = "column_name string, value string, n bigint, total bigint"


def candidates(df: DataFrame, cols: list[str], k: int, tracked: int) -> dict[str, tuple[int, list[str], float]]:
    """column -> (known rows, candidate values, most rows that a value the sketch did not return may have)."""
    wanted = max(CANDIDATES, 4 * k)
    tracked = max(tracked, wanted)
    aggs = [e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"),
        F.expr(f"approx_top_k(`{c}`, {wanted}, {tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"top{i}"))]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        n, top = row[f"n{i}"], row[f"top{i}"] or []
        unseen = UNSEEN * n / tracked
        if len(top) >= wanted:
            unseen = max(unseen, top[-1]["count"])
        out[c] = (n, [t["item"] for t in top], unseen)
    return out


def exact_counts(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """(column_name, value, n) of the given values alone."""
    hits = F.array(*[F.when(F.col(c).isin(v), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")))
                     for c, v in values.items()])
    return (df.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.*")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def proven(df: DataFrame, cols: list[str], k: int, tracked: int = TRACKED) -> list[tuple[str, str, int, int]]:
    """(column, value, n, known rows) of the candidates of those columns whose top ``k`` is proven; the driver
    holds at most ``CANDIDATES`` (or 4 k) values a column."""
    found = candidates(df, cols, k, tracked)
    named = {c: v for c, (_, v, _) in found.items() if v}
    counts: dict[str, list[tuple[str, int]]] = {c: [] for c in cols}
    if named:
        for r in exact_counts(df, named).collect():
            counts[r["column_name"]].append((r["value"], r["n"]))
    out = []
    for c, (n, _, unseen) in found.items():
        got = sorted((x for _, x in counts[c]), reverse=True)
        rest = n - sum(got)
        if rest == 0 or (len(got) >= k and got[k - 1] > min(rest, unseen)):
            out += [(c, v, x, n) for v, x in counts[c]]
    return out


def heavy_hitters(df: DataFrame, cols: list[str], k: int = 5, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values of each string column, exact, ties by value: column_name, rank, value,
    count, share_pct of the known rows.  A column without known rows has none."""
    spark = df.sparkSession
    sure = proven(df, cols, k, tracked)
    counted = spark.createDataFrame(sure, SCHEMA)
    done = {c for c, *_ in sure}
    for c in cols:
        if c not in done:
            full = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            known = df.agg(F.count(c).alias("total"))
            counted = counted.union(full.select(F.lit(c), "value", "n", known.scalar()))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return (counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("column_name", "rank", "value", F.col("n").alias("count"),
                    F.round(F.col("n") / F.col("total") * 100, 4).alias("share_pct")))
