"""Rollups: one scan a figure, and figures added up from cells equal those taken from trips."""

import datetime as dt
import random
import statistics

import pytest

from conftest import trips_frame
from glenfare.operators import cuboid, demand, revenue
from glenfare.operators.features import with_features
from glenfare.plans.report import report_summary
from glenfare.plans.rollup import cells, levels

T0 = dt.datetime(2024, 3, 4)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(300):
        area = None if i % 11 == 0 else f"G{1 if i % 3 else 2 + i % 5}1AA"  # one area holds two thirds
        ts = None if i % 17 == 0 else T0 + dt.timedelta(hours=i % 200)
        out.append((ts, area, "G25QS", None if i % 13 == 0 else rnd.uniform(0, 20), 10.0, 5.0, "10%", 1.0,
                    None if i % 19 == 0 else 1e9 + rnd.uniform(0, 1), "Card" if i % 4 else None, i % 5 or None))
    return out


@pytest.fixture(scope="module")
def feats(spark, rows):
    return with_features(trips_frame(spark, rows))


def scans(df, like="ExistingRDD"):
    return df._jdf.queryExecution().executedPlan().toString().count(like)


@pytest.mark.parametrize("fn", [revenue.business_insights, revenue.exec_concentration, revenue.risk_flags,
                                revenue.exec_metrics, demand.fleet_summary])
def test_a_kpi_row_is_one_scan(feats, fn):
    assert scans(fn(feats)) == 1


def test_levels_add_up(feats, rows):
    dims = ["pickup_area", "hour", "payment_type"]
    got = levels(cells(feats, dims, ("total_amount",)), dims).collect()
    for d in dims:
        mine = [r for r in got if r["level"] == d]
        assert len({r[d] for r in mine}) == len(mine)
        assert sum(r["trips"] for r in mine) == len(rows)
        assert all(r[o] is None for r in mine for o in dims if o != d)
    want = sum(1 for r in rows if r[9] is None)
    assert [r["trips"] for r in got if r["level"] == "payment_type" and r["payment_type"] is None] == [want]


def test_board_far_from_zero(feats, rows):
    """Spread of one around a mean of 1e9: squares that were not centred would lose it."""
    got = {(r["level"], r["key"]): r for r in cuboid.kpi_board(feats).collect()}
    for pay in ("Card", None):
        mine = [r[8] for r in rows if r[9] == pay and r[8] is not None]
        r = got["payment_type", pay]
        assert r["std_total"] == pytest.approx(statistics.stdev(mine), rel=1e-4)
        assert r["trips"] == sum(1 for x in rows if x[9] == pay)
    assert sum(r["trips"] for (lev, _), r in got.items() if lev == "distance_band") == len(rows)
    assert {k for lev, k in got if lev == "distance_band"} == {"short", "medium", "long", None}


def test_board_reads_a_given_cuboid(feats):
    c = cuboid.kpi_cuboid(feats).cache()
    key = lambda r: (r["level"], r["key"] or "")
    assert sorted(cuboid.kpi_board(cuboid=c).collect(), key=key) == sorted(cuboid.kpi_board(feats).collect(), key=key)
    c.unpersist()


def test_no_trips(spark):
    f = with_features(trips_frame(spark, []))
    assert revenue.business_insights(f).first().asDict()["total_trips"] == 0
    assert revenue.risk_flags(f).first()["top_area"] is None
    assert {r["metric"]: r["value"] for r in revenue.exec_metrics(f).collect()}["Total Trips"] == 0
    assert demand.fleet_summary(f).first()["total_trips"] == 0
    assert cuboid.kpi_board(f).count() == 0
    assert report_summary(trips_frame(spark, [])).first()["total_trips"] == 0
