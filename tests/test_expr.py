import datetime as dt

from pyspark.sql import functions as F

from glenfare.functions import expr as X


def _one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_postcode_area(spark):
    cases = {"G11AA": "G1", "G121AA": "G12", " g11aa ": "G1", "G1 1AA": "G1 ", "G12 8QQ": None, "": None,
             None: None, "G1A": None, "G1234567": None}
    df = _one_col(spark, list(cases)).select("v", X.postcode_area("v").alias("a"))
    got = {r.v: r.a for r in df.collect()}
    assert got == cases


def test_postcode_area_strip_inner(spark):
    df = _one_col(spark, ["G1 1AA"]).select(X.postcode_area("v", strip_inner=True).alias("a"))
    assert df.first().a == "G1"


def test_area_type(spark):
    df = _one_col(spark, [None, "G1", "G4", "G12"]).select("v", X.area_type("v").alias("t"))
    assert {r.v: r.t for r in df.collect()} == {None: "Unknown", "G1": "Commercial", "G4": "Commercial",
                                                  "G12": "Residential"}


def test_parse_pct(spark):
    cases = {"10%": 10.0, "7.5": 7.5, "": None, "%": None, "abc": None, None: None, "nan": None}
    df = _one_col(spark, list(cases)).select("v", X.parse_pct("v").alias("p"))
    assert {r.v: r.p for r in df.collect()} == cases


def test_time_of_day_and_peak(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    rows = {r.h: (r.t, r.p) for r in df.select("h", X.time_of_day("h").alias("t"),
                                                X.is_peak("h").alias("p")).collect()}
    assert rows[5][0] == "Night" and rows[6][0] == "Morning" and rows[11][0] == "Morning"
    assert rows[12][0] == "Afternoon" and rows[16][0] == "Afternoon" and rows[17][0] == "Evening"
    assert rows[21][0] == "Evening" and rows[22][0] == "Night"
    assert [h for h in range(24) if rows[h][1]] == [7, 8, 9, 17, 18, 19]


def test_distance_bins_right_closed(spark):
    vals = [0.0, 5.0, 5.01, 10.0, 20.0, 50.0, 100.0, 100.1, None]
    df = _one_col(spark, vals, "double").select("v", X.distance_bin("v").alias("b"))
    got = {r.v: r.b for r in df.collect()}
    assert got == {0.0: None, 5.0: "0-5km", 5.01: "5-10km", 10.0: "5-10km", 20.0: "10-20km", 50.0: "20-50km",
                   100.0: "50+km", 100.1: None, None: None}


def test_safe_ratio_zero_is_null(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r.r for r in df.select(X.safe_ratio("a", "b").alias("r")).collect()] == [None, 2.5, None]


def test_easter_known_years(spark):
    df = spark.createDataFrame([(2024,), (2025,), (2000,), (1961,)], "y int")
    got = {r.y: r.e for r in df.select("y", X.easter_sunday("y").alias("e")).collect()}
    assert got == {2024: dt.date(2024, 3, 31), 2025: dt.date(2025, 4, 20), 2000: dt.date(2000, 4, 23),
                   1961: dt.date(1961, 4, 2)}


def test_holiday_dim_equals_rule(spark):
    from glenfare.sources.dims import holiday_dim
    dim = holiday_dim(spark.createDataFrame([(y,) for y in [2020, 2021, 2022, 2023, 2024, 2025, 2026, 2024, None]], "y int"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2026, 12, 31))))
                                 .alias("date"))
    rule = days.select("date", X.scottish_holiday_name("date").alias("name")).filter("name IS NOT NULL")
    moved = [(2020, 12, 28), (2021, 1, 4), (2021, 12, 27), (2021, 12, 28), (2022, 1, 3), (2022, 1, 4), (2022, 12, 27),
             (2023, 1, 3), (2024, 12, 2), (2025, 12, 1), (2026, 12, 28)]
    substitutes = dim.filter("name LIKE '%(substitute day)'").select("date").collect()
    assert sorted(r.date for r in substitutes) == [dt.date(*d) for d in moved]
    assert dim.count() == 63 + len(moved)
    assert rule.exceptAll(dim).count() == 0 and dim.exceptAll(rule).count() == 0
    names = {r.name for r in dim.filter(F.year("date") == 2024).collect()}
    assert "Good Friday" in names and "Saint Andrew's Day" in names
    assert dim.filter(F.col("date") == dt.date(2024, 3, 29)).first().name == "Good Friday"
    flags = days.filter(X.is_holiday("date") == 1).select("date")
    assert flags.exceptAll(dim.select("date")).count() == 0 and flags.count() == 63 + len(moved)


def test_holidays_have_no_last_year(spark):
    df = spark.createDataFrame([(dt.datetime(y, 12, 25, 8), f) for y, f in [(2150, 1), (1850, 1), (9999, 1)]]
                               + [(dt.datetime(2150, 4, 10), 1), (dt.datetime(2150, 4, 3), 0), (None, 0)], "ts timestamp_ntz, f int")
    assert df.filter(X.is_holiday("ts") != F.col("f")).count() == 0
