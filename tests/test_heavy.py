"""Frequent values: proven from candidates, or counted in full, and right either way."""

import random
from collections import Counter

import pytest

from glenfare.plans import heavy


def brute(values, k):
    return sorted(((v, n) for v, n in Counter(x for x in values if x is not None).items()), key=lambda t: (-t[1], t[0]))[:k]


def frame(spark, **cols):
    return spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} string" for c in cols)).repartition(6)


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(6)
    n = 6000
    skewed = ["hot"] * (n // 3) + [f"w{i % 5}" for i in range(n // 3)] + [f"u{i}" for i in range(n - 2 * (n // 3))]
    flat = [f"f{i}" for i in range(n)]  # every value once: no candidate is proven, ties go by value
    few = [None if i % 7 == 0 else "ab"[i % 2] for i in range(n)]
    for x in (skewed, flat, few):
        rnd.shuffle(x)
    return {"skewed": skewed, "flat": flat, "few": few, "none": [None] * n}


def test_top_values_match_brute_force(spark, values):
    df = frame(spark, **values)
    for k, tracked in ((5, 200), (6, 200), (5, 10_000), (1, 100)):
        got = heavy.heavy_hitters(df, list(values), k, tracked).collect()
        for c, v in values.items():
            mine = sorted((r["rank"], r["value"], r["count"], r["share_pct"]) for r in got if r["column_name"] == c)
            known = sum(x is not None for x in v)
            assert mine == [(i + 1, x, n, round(n / known * 100, 4)) for i, (x, n) in enumerate(brute(v, k))]


def test_what_is_proven(spark, values):
    df = frame(spark, **values)
    sure = {c for c, *_ in heavy.proven(df, ["skewed", "flat", "few"], 5, 200)}
    assert sure == {"skewed", "few"}  # few holds two values, and no rows beside them
    plan = heavy.heavy_hitters(df, ["skewed", "few"], 5, 200)._jdf.queryExecution().toString()
    assert "ExistingRDD[skewed" not in plan  # proven columns are counted already: nothing reads the rows again
    # the sixth of skewed is one of thousands that come once
    assert {c for c, *_ in heavy.proven(df, ["skewed"], 7, 200)} == set()


def test_no_rows(spark, values):
    df = frame(spark, **values).limit(0)
    assert heavy.heavy_hitters(df, list(values)).count() == 0
