"""Dimension tables built by rule (no lookup files).

``holiday_dim`` lists the Scottish bank holidays of given years: nine rows a
year and one for each substitute day, for the years that occur in the data and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glenfare.functions import expr as X


def _first_monday(y, m):
    d = F.make_date(y, F.lit(m), F.lit(1))
    return F.date_add(d, (F.lit(7) - F.weekday(d)) % 7)


def holiday_dim(years: DataFrame) -> DataFrame:
    """``(date, name)`` for every Scottish bank holiday of the years in ``years``
    (one column; repeats and nulls do not matter).

    One row per distinct year, exploded into that year's
    holidays computed directly, with the substitutes of those on a weekend: the same calendar as
    ``scottish_holiday_name`` (tested equal in ``tests/``).
    """
    y = F.col("year")
    may31 = F.make_date(y, F.lit(5), F.lit(31))
    # Scottish bank holidays, in calendar order.
    days = [
        (F.make_date(y, F.lit(1), F.lit(1)), "New Year's Day"),
        (F.make_date(y, F.lit(1), F.lit(2)), "New Year Holiday"),
        (F.date_sub(X.easter_sunday(y), 2), "Good Friday"),
        (_first_monday(y, 5), "May Day"),
        (F.date_sub(may31, F.weekday(may31)), "Spring Bank Holiday"),
        (_first_monday(y, 8), "Summer Bank Holiday"),
        (F.make_date(y, F.lit(11), F.lit(30)), "Saint Andrew's Day"),
        (F.make_date(y, F.lit(12), F.lit(25)), "Christmas Day"),
        (F.make_date(y, F.lit(12), F.lit(26)), "Boxing Day"),
    ]
    listed = [(F.lit(True), d, n) for d, n in days]
    # a pair of days in a row, or one: the first on Saturday or Sunday moves on by 2 days, as the second on
    # Saturday does; the second on Sunday by 2, St Andrew's Day to the Monday
    for first, second in ((0, 1), (7, 8)):
        (a, name_a), (b, name_b) = days[first], days[second]
        listed += [(F.weekday(a) >= 5, F.date_add(a, 2), f"{name_a} (substitute day)"),
                   (F.weekday(b) >= 5, F.date_add(b, 2), f"{name_b} (substitute day)")]
    andrew, name = days[6]
    listed.append((F.weekday(andrew) >= 5, F.date_add(andrew, F.lit(7) - F.weekday(andrew)), f"{name} (substitute day)"))
    arr = F.array_compact(F.array(*[F.when(on, F.struct(d.alias("date"), F.lit(n).alias("name"))) for on, d, n in listed]))
    return (years.select(F.col(years.columns[0]).cast("int").alias("year")).filter("year IS NOT NULL").distinct()
            .select(F.explode(arr).alias("h")).select("h.date", "h.name"))
