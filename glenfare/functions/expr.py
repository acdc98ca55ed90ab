"""Column expressions (scalar functions) shared by all operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``;
nothing is a Python UDF, so every expression stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Area codes treated as commercial (city centre districts).
COMMERCIAL_AREAS = ("G1", "G2", "G3", "G4")

# The whitespace set Python's str.strip() removes for ASCII text.
_WS = " \t\n\x0b\x0c\r"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_double() -> Column:
    return F.lit(None).cast("double")


def parse_pct(c) -> Column:
    """'10%' -> 10.0; '', '%', 'abc', null -> null (EXP1/EXP2)."""
    s = F.replace(col(c).cast("string"), F.lit("%"), F.lit(""))
    v = F.nullif(s, F.lit("")).try_cast("double")
    return F.nanvl(v, null_double())


def strip(c) -> Column:
    """Remove leading/trailing ASCII whitespace, like Python's str.strip()."""
    return F.trim(col(c), F.lit(_WS))


def postcode_area(c, strip_inner: bool = False) -> Column:
    """Outward code of a UK postcode (EXP8).

    trim + upper, then length 6 -> first 3 characters, length 5 -> first 2,
    anything else -> null.  An inner space is kept ('G1 1AA' -> 'G1 ') unless
    ``strip_inner`` is set (D13).
    """
    p = F.upper(strip(c))
    if strip_inner:
        p = F.replace(p, F.lit(" "), F.lit(""))
    n = F.length(p)
    return F.when(n.isin(5, 6), F.substring(p, F.lit(1), n - 3))


def has_postcode_area(c) -> Column:
    """Whether ``postcode_area`` gives an area: the stripped code has 5 or 6 characters."""
    return F.length(F.upper(strip(c))).isin(5, 6)


def area_type(area, commercial=COMMERCIAL_AREAS) -> Column:
    """null -> Unknown, listed districts -> Commercial, else Residential (EXP9)."""
    a = col(area)
    return (F.when(a.isNull(), F.lit("Unknown"))
             .when(a.isin(*commercial), F.lit("Commercial"))
             .otherwise(F.lit("Residential")))


def time_of_day(hour) -> Column:
    """6-11 Morning, 12-16 Afternoon, 17-21 Evening, else Night (EXP6)."""
    h = col(hour)
    return (F.when((h >= 6) & (h < 12), "Morning")
             .when((h >= 12) & (h < 17), "Afternoon")
             .when((h >= 17) & (h < 22), "Evening")
             .otherwise("Night"))


def is_peak(hour) -> Column:
    """Commute peaks 7-9 and 17-19 inclusive (EXP13)."""
    h = col(hour)
    return h.between(7, 9) | h.between(17, 19)


def peak_type(hour) -> Column:
    """Label of the peak hour (DEM13)."""
    h = col(hour)
    return (F.when(h.isin(7, 8, 9), "Morning Commute")
             .when(h.isin(17, 18, 19), "Evening Commute")
             .when(h.isin(21, 22, 23), "Night Life")
             .otherwise("Other Peak"))


def safe_ratio(num, den) -> Column:
    """num / den with x/0 -> null (EXP10, D3)."""
    return F.try_divide(col(num), col(den))


def weekday0(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts))


def is_weekend(ts) -> Column:
    return F.weekday(col(ts)).isin(5, 6).cast("int")


# Right-closed distance bins (km) and their labels.
DISTANCE_BINS = [(0.0, 5.0, "0-5km"), (5.0, 10.0, "5-10km"), (10.0, 20.0, "10-20km"),
                 (20.0, 50.0, "20-50km"), (50.0, 100.0, "50+km")]


def distance_bin(c) -> Column:
    """pd.cut with right-closed edges; outside (0, 100] -> null (EXP15)."""
    d = col(c)
    out = None
    for lo, hi, label in DISTANCE_BINS:
        cond = (d > lo) & (d <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def easter_sunday(year) -> Column:
    """Gregorian Easter Sunday (anonymous Gregorian computus) as a date."""
    y = col(year).cast("int")
    a = y % 19
    b = F.floor(y / 100).cast("int")
    c = y % 100
    d = F.floor(b / 4).cast("int")
    e = b % 4
    f = F.floor((b + 8) / 25).cast("int")
    g = F.floor((b - f + 1) / 3).cast("int")
    h = (a * 19 + b - d - g + 15) % 30
    i = F.floor(c / 4).cast("int")
    k = c % 4
    ll = (F.lit(32) + e * 2 + i * 2 - h - k) % 7
    m = F.floor((a + h * 11 + ll * 22) / 451).cast("int")
    month = F.floor((h + ll - m * 7 + 114) / 31).cast("int")
    day = (h + ll - m * 7 + 114) % 31 + 1
    return F.make_date(y, month, day)


def scottish_holiday_name(date) -> Column:
    """Name of the Scottish bank holiday on ``date`` or null (EXP7).

    Rule-based calendar, no lookup table: New Year (1 and 2 January), Good
    Friday, first Monday of May, last Monday of May, first Monday of August,
    St Andrew's Day (30 November), Christmas and Boxing Day.  A fixed day on a
    weekend has a substitute on the next weekday that is no holiday itself: 3 and 4
    January, 27 and 28 December and 1 or 2 December, where these are a Monday
    or (second of two days in a row) a Tuesday.
    """
    d = col(date)
    mo, dom, wd = F.month(d), F.dayofmonth(d), F.weekday(d)
    good_friday = F.date_sub(easter_sunday(F.year(d)), 2)
    return (F.when((mo == 1) & (dom == 1), "New Year's Day")
             .when((mo == 1) & (dom == 2), "New Year Holiday")
             .when(d == good_friday, "Good Friday")
             .when((mo == 5) & (wd == 0) & (dom <= 7), "May Day")
             .when((mo == 5) & (wd == 0) & (dom >= 25), "Spring Bank Holiday")
             .when((mo == 8) & (wd == 0) & (dom <= 7), "Summer Bank Holiday")
             .when((mo == 11) & (dom == 30), "Saint Andrew's Day")
             .when((mo == 12) & (dom == 25), "Christmas Day")
             .when((mo == 12) & (dom == 26), "Boxing Day")
             .when((mo == 1) & (dom == 3) & wd.isin(0, 1), "New Year's Day (substitute day)")
             .when((mo == 1) & (dom == 4) & wd.isin(0, 1), "New Year Holiday (substitute day)")
             .when((mo == 12) & dom.isin(1, 2) & (wd == 0), "Saint Andrew's Day (substitute day)")
             .when((mo == 12) & (dom == 27) & wd.isin(0, 1), "Christmas Day (substitute day)")
             .when((mo == 12) & (dom == 28) & wd.isin(0, 1), "Boxing Day (substitute day)"))


def is_holiday(ts) -> Column:
    """1 on a Scottish bank holiday, else 0 (EXP7).

    Fixed dates and first / last Mondays are tests of month, day and weekday.
    The Easter computus runs only on Fridays of March and April, inside a
    lambda: it stays out of the generated code of the projection, which it
    would push past the JVM's method limit."""
    d = F.to_date(col(ts))
    mo, dom, wd = F.month(d), F.dayofmonth(d), F.weekday(d)
    good_friday = F.element_at(F.transform(F.array(d), lambda x: F.date_sub(easter_sunday(F.year(x)), 2) == x), 1)
    rule = (((mo == 1) & (dom <= 2)) | ((mo == 5) & (wd == 0) & ((dom <= 7) | (dom >= 25)))
            | ((mo == 8) & (wd == 0) & (dom <= 7)) | ((mo == 11) & (dom == 30)) | ((mo == 12) & dom.isin(25, 26))
            | (((mo == 1) & dom.isin(3, 4)) | ((mo == 12) & dom.isin(27, 28))) & wd.isin(0, 1)
            | ((mo == 12) & (dom <= 2) & (wd == 0))
            | F.when(mo.isin(3, 4) & (wd == 4), good_friday).otherwise(False))
    return F.coalesce(rule, F.lit(False)).cast("int")


def quantiles(c, probs, accuracy: int | None = None) -> Column:
    """Array of quantiles of ``c`` with linear interpolation.

    ``accuracy=None`` is the exact ``percentile`` aggregate (its partial
    state is a value -> count map, so memory follows the number of distinct
    values, not rows); an integer switches to the mergeable sketch
    ``percentile_approx`` with relative rank error ``1/accuracy``, the choice
    for high-cardinality columns at scale.
    """
    probs = list(probs)
    if accuracy is None:
        return F.percentile(col(c), probs)
    return F.percentile_approx(col(c), probs, accuracy)
