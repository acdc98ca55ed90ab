"""A model is fitted once for given rows and parameters."""

import datetime as dt
import random

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from conftest import trips_frame
from glenfare.operators import forecast, segment
from glenfare.operators.features import with_features
from glenfare.plans import models

T0 = dt.datetime(2024, 3, 4)


def _rows(n, seed):
    rnd = random.Random(seed)
    return [(T0 + dt.timedelta(hours=i), "G11AA", "G25QS", d, 2 * d, 3 + d, "10%", 1.0, 4 + d, "Card", 1 + i % 3)
            for i in range(n) for d in [rnd.uniform(1, 30)]]


@pytest.fixture
def fits(monkeypatch):
    """Names of the estimators whose ``fit`` was called."""
    seen = []
    for cls in (KMeans, LinearRegression, RandomForestRegressor):
        own = cls._fit
        monkeypatch.setattr(cls, "_fit", lambda self, df, own=own, name=cls.__name__: (seen.append(name), own(self, df))[1])
    return seen


def test_version_names_the_rows(spark):
    a = spark.createDataFrame([(1.0, "x"), (2.0, None), (2.0, None)], "a double, b string")
    same = a.orderBy(F.desc("a")).repartition(3)
    assert models.version(a, ["a", "b"]) == models.version(same, ["a", "b"])
    for other in (a.distinct(), a.fillna(""), a.limit(0), a.withColumn("a", F.col("a") + 1e-15)):
        assert models.version(other, ["a", "b"]) != models.version(a, ["a", "b"])
    assert models.version(a, ["a"]) != models.version(a, ["b"])


def test_key_names_class_and_parameters():
    keys = {models.key_of(e, "v") for e in (KMeans(k=2, seed=1), KMeans(k=3, seed=1), KMeans(k=2, seed=2),
                                           LinearRegression(), LinearRegression(regParam=0.1))}
    assert len(keys) == 5 and models.key_of(KMeans(k=2, seed=1), "v") in keys
    assert models.key_of(KMeans(k=2, seed=1), "w") not in keys


def test_clusters_profiles_and_elbow_share_a_fit(spark, fits):
    f = with_features(trips_frame(spark, _rows(60, 1)))
    first = [r.asDict() for r in segment.customer_clusters(f, n_init=2).orderBy("cluster").collect()]
    assert fits == ["KMeans"] * 2
    segment.cluster_profiles(f, n_init=2).collect()
    segment.cluster_highlights(f, n_init=2).collect()
    again = [r.asDict() for r in segment.customer_clusters(f, n_init=2).orderBy("cluster").collect()]
    assert fits == ["KMeans"] * 2 and again == first
    assert len(segment.kmeans_elbow(f, ks=range(1, 6), n_init=2).collect()) == 5
    assert len(fits) == 2 + 2 * 3  # k = 2, 3, 5; k = 1 has a closed form and k = 4 is there
    segment.cluster_profiles(with_features(trips_frame(spark, _rows(61, 1))), n_init=2).collect()
    assert len(fits) == 2 + 2 * 4  # other rows, another model


def test_loaded_models_predict_alike(spark, fits):
    f = with_features(trips_frame(spark, _rows(200, 2)))
    metrics = forecast.fare_model_metrics(f).orderBy("model").collect()
    assert sorted(fits) == ["LinearRegression", "RandomForestRegressor"]
    assert forecast.fare_model_metrics(f).orderBy("model").collect() == metrics
    assert forecast.fare_model_assessment(f).first()["best_model"] in {r["model"] for r in metrics}
    assert forecast.fare_feature_importance(f).count() == 4
    forecast.fare_linear_regression(f).collect()
    forecast.fare_random_forest(f).collect()
    assert len(fits) == 2


def test_a_fit_that_dies_leaves_no_entry(spark):
    def broken():
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        models.fit_once(spark, "dies", broken, None)
    assert models.find(spark, "dies") is None
