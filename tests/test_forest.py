"""Forests grown on cells: the same trees as on the rows, and every row drawn."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from conftest import trips_frame
from glenfare.operators import forecast
from glenfare.operators.features import with_features
from glenfare.plans import forest

T0 = dt.datetime(2024, 3, 4)
COLS = ["a", "b", "c", "d"]


def _rows(n, seed=5):
    rnd = random.Random(seed)
    rows = [(rnd.gauss(0, 3), float(rnd.randrange(7)), 4.0, round(rnd.expovariate(1), 1)) for _ in range(n)]
    return [(*r, math.sin(r[0]) * 3 + r[1] * r[3] + rnd.uniform(0, 1)) for r in rows]


def _cells(rows, cuts, w=None):
    *x, y = np.array(rows).T
    w = np.ones(len(y)) if w is None else w
    cells, at = np.unique(forest.cells_of(x, cuts), return_inverse=True)
    stats = np.stack([np.bincount(at, w * v) for v in (np.ones(len(y)), y, y * y)])
    return np.stack(np.unravel_index(cells, [len(c) + 1 for c in cuts])), stats


@pytest.mark.parametrize("n, depth, bins", [(2500, 6, 32), (400, 10, 8), (30, 3, 32)])
def test_a_tree_of_cells_is_sparks_tree_of_the_rows(spark, tmp_path, n, depth, bins):
    rows = _rows(n)
    df = VectorAssembler(inputCols=COLS, outputCol="features").transform(spark.createDataFrame(rows, [*COLS, "y"]))
    own = RandomForestRegressor(labelCol="y", numTrees=1, maxDepth=depth, maxBins=bins, featureSubsetStrategy="all", seed=1)
    own = own.setBootstrap(False).fit(df)
    own.write().save(f"{tmp_path}/own")
    want = [r["nodeData"].asDict(True) for r in spark.read.parquet(f"{tmp_path}/own/data").orderBy("nodeData.id").collect()]
    cuts = [forest.cut_points(x, min(bins, n)) for x in np.array(rows).T[:-1]]
    nodes = forest.merged(forest.grow(*_cells(rows, cuts), cuts, depth, lambda k: np.ones((k, 4), bool)))
    got = [forest.saved(v, i) for i, v in enumerate(nodes)]

    def flat(nodes, i=0):  # in one order, whatever the numbering
        v = nodes[i]
        told = (v["prediction"], v["rawCount"], v["gain"], v["split"]["featureIndex"], *v["split"]["leftCategoriesOrThreshold"],
                v["leftChild"] >= 0 and v["impurity"], *v["impurityStats"])  # a leaf has its own, or -1
        return [told] + [t for c in (v["leftChild"], v["rightChild"]) if c >= 0 for t in flat(nodes, c)]
    assert len(want) == len(got) > 5
    for a, b in zip(flat(want), flat(got)):
        assert b == pytest.approx(a, rel=1e-6, abs=1e-9)


def test_draws_are_poisson_quantiles():
    class Bits:
        def integers(self, lo, hi, shape, kind):
            return np.arange(65536, dtype=kind).reshape(shape)

        def random(self, k):
            return np.full(k, 0.75)
    got = forest.drawn(Bits(), 256, 256).ravel()
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
    assert got.tolist() == np.searchsorted(cdf, (np.arange(65536) + 0.75) / 65536, side="right").tolist()
    assert 1 < (forest.DRAW < 0).sum() < 20
    real = forest.drawn(np.random.default_rng(1), 4000, 50)
    assert real.mean() == pytest.approx(1, abs=0.01) and real.var() == pytest.approx(1, abs=0.02)


def _sums(rows, size, trees=40):
    key, y = (np.array(v) for v in zip(*sorted(rows)))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:i + size], pa.int64()), pa.array(y[i:i + size], pa.float64())], names=["key", "y"])
               for i in range(0, len(key), size)]
    found = {}
    for b in forest.sums([batches[0].slice(0, 0), *batches], trees, 7):
        for r in b.to_pylist():
            for k, *v in zip(*(r[c] for c in ("keys", "n", "s", "q"))):
                assert (r["tree"], k) not in found
                found[r["tree"], k] = v
    return found


def test_every_row_is_drawn_for_every_tree_whatever_the_batches(monkeypatch):
    rnd = random.Random(1)
    rows = [(0 if i % 3 == 0 else rnd.randrange(30), float(rnd.randrange(1, 9))) for i in range(9000)]
    whole = _sums(rows, 9000)
    monkeypatch.setattr(forest, "BLOCK", 4)
    monkeypatch.setattr(forest, "DRAWN", 50)
    split = _sums(rows, 50)
    assert set(whole) == {(t, k) for t in range(40) for k in range(30)} == set(split)
    n = np.array([sum(v[0] for (t, _), v in whole.items() if t == i) for i in range(40)])
    assert len(set(n)) > 30 and n.mean() == pytest.approx(9000, rel=0.01) and n.std() == pytest.approx(9000 ** 0.5, rel=0.5)
    for k in (0, 7):
        own = [y for c, y in rows if c == k]
        for i, f in enumerate((1.0, None, None)):
            want = sum(f or y ** i for y in own)
            assert np.mean([whole[t, k][i] for t in range(40)]) == pytest.approx(want, rel=0.05)


def test_crowded_cells_are_dealt_to_several_keys():
    cuts = [np.array([0.5]), np.array([])]
    b = pa.RecordBatch.from_arrays([pa.array(v) for v in ([0.0, 1.0, 0.5, 1.0, 1.0], [3.0] * 5, [1.0, 2, 3, 4, 5], [0, 1, 2, 3, 7])],
                                   names=["x0", "x1", "y", "at"])
    assert next(forest.keyed([b], cuts, {}))["key"].to_pylist() == [0, 1, 0, 1, 1]
    assert next(forest.keyed([b], cuts, {1: 3}))["key"].to_pylist() == [0, 1 + 2 * 1, 0, 1, 1 + 2 * 1]
    assert next(forest.keyed([b.slice(0, 0)], cuts, {1: 3})).num_rows == 0


@pytest.fixture
def many(monkeypatch):
    """More rows than are fitted as they come, in cells that are dealt; the estimators fitted on rows."""
    seen, own = [], RandomForestRegressor._fit
    monkeypatch.setattr(forecast, "FEW_ROWS", 100)
    monkeypatch.setattr(forest, "MANY_ROWS", 400)
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: (seen.append(df.count()), own(self, df))[1])
    return seen


@pytest.fixture(scope="module")
def trips(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(3000):
        d, m, p, h = rnd.uniform(1, 30), rnd.uniform(2, 60), 1 + (i % 5 == 0), 18 if i % 2 else rnd.randrange(24)
        fare = 3 + 1.5 * d + 0.2 * m + (5 if h > 19 else 0) + rnd.uniform(-1, 1)
        rows.append((T0 + dt.timedelta(days=i % 9, hours=h), "G11AA", "G25QS", d, m, fare, "10%", 1.0, fare + 1, "Card", p))
    return with_features(trips_frame(spark, rows)).cache()


def test_a_forest_of_cells_predicts_like_sparks(spark, trips, many):
    data = forecast._fare_data(trips)
    estimator = forecast._forest(forecast.FARE_TARGET, seed=9)
    cells = forecast._fit(estimator, data, forecast.FARE_FEATURES)
    assert many == [] and cells.getNumTrees == 100 and max(t.depth for t in cells.trees) == 10
    assert (cells.getMaxDepth(), cells.getMaxBins(), cells.getSeed(), cells.getLabelCol()) == (10, 32, 9, "fare_amount")
    rows = estimator.fit(data.filter("split = 'train'"))
    test = data.filter("split = 'test'")
    a, b = (forecast.regression_metrics(m.transform(test), forecast.FARE_TARGET).first() for m in (cells, rows))
    assert a.n == b.n > 500 and a.r2 > 0.95 and a.r2 == pytest.approx(b.r2, abs=0.01) and a.rmse == pytest.approx(b.rmse, rel=0.1)
    assert cells.featureImportances.toArray() == pytest.approx(rows.featureImportances.toArray(), abs=0.06)
    near = np.array([t.predict(v) for t in cells.trees[:2] for v in [test.first().features]])
    assert len(set(near)) == 2  # trees differ


def test_other_parameters_and_many_features_are_fitted_on_the_rows(spark, trips, many):
    data = forecast._fare_data(trips)
    small = forecast._forest(forecast.FARE_TARGET, trees=2)
    for e in (small.copy().setMinInstancesPerNode(5), small.copy().setMaxBins(64)):
        forecast._fit(e, data, forecast.FARE_FEATURES)
    assert len(many) == 2


def test_the_model_does_not_depend_on_partitions(spark, trips, many, monkeypatch):
    data = forecast._fare_data(trips)
    train, (_, facts) = forecast._train(data)
    e = forecast._forest(forecast.FARE_TARGET, trees=5)
    monkeypatch.setattr(forest, "MANY_ROWS", 10 ** 6)
    a, b = (forest.fit(e, t, forecast.FARE_FEATURES, facts[0]) for t in (train.coalesce(1), train.repartition(5)))
    test = data.filter("split = 'test'")
    p, q = ([r.prediction for r in m.transform(test).orderBy(*forecast.FARE_FEATURES, forecast.FARE_TARGET).collect()] for m in (a, b))
    assert p == pytest.approx(q, rel=1e-9)


def test_f1_assessment_grows_its_forest_on_cells(trips, many):
    got = forecast.fare_model_assessment(trips).first()
    assert many == [] and got.best_model in ("Linear Regression", "Random Forest") and got.r2 > 0.95 and got.quality == "EXCELLENT"


def test_f2_forest_predicts_every_hold_out_row(trips, many):
    got = forecast.fare_random_forest(trips)
    assert many == [] and got.columns == [*forecast.FARE_FEATURES, forecast.FARE_TARGET, "prediction"]
    assert got.count() == forecast._fare_data(trips).filter("split = 'test'").count() > 500
    assert got.filter("abs(prediction - fare_amount) < 10").count() > 0.95 * got.count()


def test_f3_metrics_are_those_of_both_models(trips, many):
    got = {r.model: r for r in forecast.fare_model_metrics(trips).collect()}
    n = forecast._fare_data(trips).filter("split = 'test'").count()
    assert many == [] and {m: r.n for m, r in got.items()} == {"Linear Regression": n, "Random Forest": n}
    p = forecast.fare_random_forest(trips)
    assert got["Random Forest"].rmse == pytest.approx(p.agg(F.sqrt(F.avg((p.prediction - p.fare_amount) ** 2))).first()[0], abs=1e-4)
    assert all(0.95 < r.r2 < 1 for r in got.values())


def test_f4_importances_come_from_the_forest_of_cells(trips, many):
    got = forecast.fare_feature_importance(trips).orderBy("rank").collect()
    assert many == [] and [r.feature for r in got][:2] == ["distance_km", "duration_min"] and got[0].importance > 0.6
    assert sum(r.importance for r in got) == pytest.approx(1, abs=1e-3)
