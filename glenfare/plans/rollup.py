"""Many key figures from one scan: cells, and rollups of the cells.

``cells`` groups the trips once by all dimensions that a result needs; a task
sends at most one row for each combination that it has seen.  ``levels`` adds the
cells up by each dimension alone (grouping sets over cells, never over trips),
and a result reads its figures from that small table.  Counts and sums add up;
means are sums over counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(features: DataFrame, dims: list[str], sums: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """``trips`` of each combination of ``dims`` (null is a value), ``<c>_sum`` and ``<c>_n`` (not null) of each measure,
    and further aggregates that add up."""
    return features.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("trips"),
        *[e for c in sums for e in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))],
        *[e.alias(name) for name, e in more.items()])


def levels(cell: DataFrame, dims: list[str]) -> DataFrame:
    """One row for each value (null too) of each of ``dims``: ``level`` names the dimension, the other ones are
    null, and every further column is added up."""
    out = cell.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("_gid"), *[F.sum(c).alias(c) for c in cell.columns if c not in dims])
    every = (1 << len(dims)) - 1
    level = F.coalesce(*[F.when(F.col("_gid") == every - (1 << (len(dims) - 1 - i)), F.lit(d)) for i, d in enumerate(dims)])
    return out.withColumn("level", level).drop("_gid")


def at(dim: str) -> Column:
    """True for the rows of ``levels`` that hold a known value of ``dim``."""
    return (F.col("level") == dim) & F.col(dim).isNotNull()


def total(column: str, dim: str) -> Column:
    """``column`` over all trips: the sum of the values, null too, of any one dimension."""
    return F.sum(F.when(F.col("level") == dim, F.col(column)))


def first_by(dim: str, *order: Column) -> Column:
    """The known value of ``dim`` that sorts first by ``order``, then by itself."""
    return F.min_by(dim, F.when(at(dim), F.struct(*order, F.col(dim))))
