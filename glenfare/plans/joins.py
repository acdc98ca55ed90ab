"""Attaching one-row aggregates.

``attach_scalars`` puts the columns of a one-row aggregate (means, bounds,
quantiles) beside every row as a scalar subquery: Spark computes the row once,
before the stage that reads it, and the values are constants in that stage's
generated code.  There is no join, and an aggregate without a row gives nulls.

Dimension joins carry no broadcast hint: Spark knows the size of what it has
read or computed and picks the join from bytes, at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus every column of ``one_row``, a frame of at most one row."""
    names = one_row.columns
    taken = {c.lower() for c in [*df.columns, *names]}
    row = next(n for n in ("_" * k + "row" for k in range(1, len(taken) + 2)) if n not in taken)
    # the struct is a column of its own: read by field from the subquery, it would be planned once for each field
    held = df.select("*", one_row.select(F.struct(*names)).scalar().alias(row))
    return held.select(*[F.col(c) for c in df.columns], *[F.col(row)[c].alias(c) for c in names])
