"""Fare regression and hour-ahead demand forecasting (MOD1-MOD6, FOR1-FOR7).

* The 80/20 split is a seeded hash of each row's feature values
  (``pmod(xxhash64(seed, cols), 10) < 8``): stable under repartitioning and
  executor retries, unlike ``randomSplit``.
* Models are ``pyspark.ml`` estimators; metrics are plain aggregates over
  the prediction frame (one pass, partial aggregation), so nothing is
  collected except the fitted model and the k-row importance vectors.
* A model is fitted once for given rows and parameters and kept in the shared
  folder (``plans/models.py``): metrics, importances, assessment and
  comparison read the fit of the forecast itself.
* The gradient-boosted model (``GBTRegressor``) stands for both boosting
  libraries of the reference; the seasonal model is the seasonal-naive
  forecast of ``series``.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glenfare.operators import series as S
from glenfare.plans import forest
from glenfare.plans.models import fit_once, key_of, versioned
from glenfare.plans.stages import stored

FARE_FEATURES = ["distance_km", "duration_min", "passenger_count", "hour"]
FARE_TARGET = "fare_amount"
#: Depth of every forest, a parameter of the model.  Spark grows trees level by
#: level, at most 30 of them, so depth is time: at sf0.01 the demand forest took
#: minutes with 15 levels.  Pass ``max_depth`` for deeper trees.
MAX_DEPTH = 10
#: Train rows that are fitted in the partitions that they come in, and the most in a partition of more.
FEW_ROWS, MOST_ROWS = 100_000, 1_000_000
MODELS = {LinearRegression: LinearRegressionModel, RandomForestRegressor: RandomForestRegressionModel,
          GBTRegressor: GBTRegressionModel}


def _r(c, n=4):
    return F.round(c, n)


def hash_split(df: DataFrame, cols: list[str], train_pct: int = 80, seed: int = 42) -> DataFrame:
    """Add ``split`` = 'train' / 'test' from a seeded hash of ``cols`` (MOD1)."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(100))
    return df.withColumn("split", F.when(h < train_pct, "train").otherwise("test"))


def _fare_data(features: DataFrame) -> DataFrame:
    d = features.select(*FARE_FEATURES, FARE_TARGET).dropna()
    d = d.select(*[F.col(c).cast("double").alias(c) for c in FARE_FEATURES + [FARE_TARGET]])
    a = VectorAssembler(inputCols=FARE_FEATURES, outputCol="features").transform(d)
    return hash_split(a, FARE_FEATURES + [FARE_TARGET])


def _dealt(train: DataFrame, n: int) -> DataFrame:
    """``train`` in as many equal partitions as there are cores, or a multiple of that from ``MOST_ROWS`` in each on.

    A file's row groups are few and uneven, and a tree's levels wait for the largest partition; more partitions than needed
    would each send statistics of every node.  Up to ``FEW_ROWS`` the rows stay as they are."""
    if n <= FEW_ROWS:
        return train
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = cores * math.ceil(n / (cores * MOST_ROWS))
    return train.repartition(parts).sortWithinPartitions(*[c for c in train.columns if c != "features"])


def _train(data: DataFrame) -> tuple[DataFrame, tuple]:
    """The train rows, and their version and number."""
    train = data.filter(F.col("split") == "train").drop("split")
    return train, versioned(train, [c for c in train.columns if c != "features"])


def _fit(estimator, data: DataFrame, inputs: list[str] | None = None, known: tuple | None = None):
    """``estimator`` fitted on the train rows, once for these rows and parameters.  ``inputs``: the columns that ``features`` holds;
    a forest over few of them reads more than ``FEW_ROWS`` rows once (``plans/forest.py``).  ``known``: ``_train(data)``, where
    the caller has it."""
    train, (seen, facts) = known or _train(data)

    def fit():
        if inputs and facts[0] > FEW_ROWS and forest.serves(estimator, len(inputs)):
            return forest.fit(estimator, train, inputs, facts[0]), None
        label = estimator.getLabelCol()
        kept = _dealt(train, facts[0]).select("features", label).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return estimator.fit(kept), None
        finally:
            kept.unpersist()

    return fit_once(data.sparkSession, key_of(estimator, seen), fit, MODELS[type(estimator)])[0]


def _forest(label: str, trees: int = 100, seed: int = 42, max_depth: int = MAX_DEPTH) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, seed=seed, maxDepth=max_depth)


def _fare_models(features: DataFrame, trees: int = 100, seed: int = 42, max_depth: int = MAX_DEPTH):
    data = _fare_data(features)
    known = _train(data)
    lr = _fit(LinearRegression(featuresCol="features", labelCol=FARE_TARGET, regParam=0.0), data, known=known)
    rf = _fit(_forest(FARE_TARGET, trees, seed, max_depth), data, FARE_FEATURES, known)
    return data, {"Linear Regression": lr, "Random Forest": rf}


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """n, MSE, RMSE, MAE, R^2 of a prediction frame in one aggregate (MOD4)."""
    e = F.col(label) - F.col(prediction)
    a = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                 F.sum(e * e).alias("_sse"), F.var_pop(label).alias("_var"), F.avg(label).alias("mean_actual"))
    r2 = 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))
    return a.select("n", _r(F.col("mse")).alias("mse"), _r(F.sqrt("mse")).alias("rmse"), _r(F.col("mae")).alias("mae"),
                    _r(r2).alias("r2"), _r(F.col("mean_actual")).alias("mean_actual"))


def fare_linear_regression(features: DataFrame) -> DataFrame:
    """Ordinary least squares of fare on distance, duration, passengers, hour:
    intercept and coefficients (MOD2)."""
    data = _fare_data(features)
    m = _fit(LinearRegression(featuresCol="features", labelCol=FARE_TARGET, regParam=0.0), data)
    rows = [("intercept", float(m.intercept))] + [(f, float(c)) for f, c in zip(FARE_FEATURES, m.coefficients)]
    return features.sparkSession.createDataFrame(rows, "term string, value double")


def fare_random_forest(features: DataFrame, trees: int = 100, seed: int = 42, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Random-forest fare predictions on the hold-out rows (MOD3)."""
    data = _fare_data(features)
    m = _fit(_forest(FARE_TARGET, trees, seed, max_depth), data, FARE_FEATURES)
    return m.transform(data.filter(F.col("split") == "test")).select(*FARE_FEATURES, FARE_TARGET, "prediction")


def fare_model_metrics(features: DataFrame) -> DataFrame:
    """RMSE, MAE, R^2 and MSE of both fare models on the hold-out rows (MOD4)."""
    data, models = _fare_models(features)
    test = data.filter(F.col("split") == "test")
    parts = [regression_metrics(m.transform(test), FARE_TARGET).withColumn("model", F.lit(name))
             for name, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "n", "rmse", "mae", "r2", "mse", "mean_actual")


# Importance cut-offs and the two messages (above, below).
IMPORTANCE_LABELS = {
    "distance_km": (0.5, "Strong distance-based pricing model", "Distance is important but not dominant"),
    "duration_min": (0.3, "Time-based pricing significant", "Duration has moderate influence"),
    "hour": (0.1, "Time-of-day pricing relevant", "Hour has limited impact on pricing"),
    "passenger_count": (0.1, "Passenger-based pricing considered", "Passenger count has minimal impact"),
}


def _importances(spark: SparkSession, names: list[str], values) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def fare_feature_importance(features: DataFrame) -> DataFrame:
    """Random-forest importances, ranked, with business labels (MOD5)."""
    data = _fare_data(features)
    m = _fit(_forest(FARE_TARGET), data, FARE_FEATURES)
    imp = _importances(features.sparkSession, FARE_FEATURES, m.featureImportances)
    lab = None
    for f, (cut, hi, lo) in IMPORTANCE_LABELS.items():
        cond = F.col("feature") == f
        v = F.when(F.col("importance") > cut, hi).otherwise(lo)
        lab = F.when(cond, v) if lab is None else lab.when(cond, v)
    w = Window.orderBy(F.desc("importance"), "feature")
    return imp.select((F.row_number().over(w)).alias("rank"), "feature", _r(F.col("importance")).alias("importance"),
                      lab.alias("interpretation"))


def fare_model_assessment(features: DataFrame) -> DataFrame:
    """Best model by R^2, quality and error labels (MOD6)."""
    m = fare_model_metrics(features)
    best = m.orderBy(F.desc("r2"), "model").limit(1)
    r2, ratio = F.col("r2"), F.try_divide(F.col("rmse"), F.col("mean_actual"))
    return best.select(
        F.col("model").alias("best_model"), "r2", "rmse", "mae", F.col("mean_actual").alias("avg_fare"),
        _r(ratio * 100, 2).alias("rmse_pct_of_avg"), _r(F.try_divide(F.col("mae"), F.col("mean_actual")) * 100, 2)
        .alias("mae_pct_of_avg"),
        F.when(r2 > 0.9, "EXCELLENT").when(r2 > 0.8, "GOOD").when(r2 > 0.6, "MODERATE").otherwise("POOR").alias("quality"),
        F.when(ratio < 0.1, "LOW").when(ratio < 0.2, "MODERATE").otherwise("HIGH").alias("error_level"))


# --- hour-ahead demand forecasting -------------------------------------------------------------

def _forecast_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glenfare.plans.registry import features
    m = S.forecast_features(features(spark, sf_dir), weather=S.weather_fixture(spark, sf_dir))
    # a row for each hour of the span: stored, it is built from the trips once, and the plan of the trees' stages is short
    return stored(S.forecast_split(m), "forecast-matrix")


def _assembled(split: DataFrame) -> tuple[DataFrame, list[str]]:
    cols = [c for c in S.FORECAST_FEATURES if c in split.columns]
    d = split.select("ts_hour", "trip_count", "split", *[F.col(c).cast("double").alias(c) for c in cols])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(d), cols


def _tree_forecast(split: DataFrame, estimator):
    data, cols = _assembled(split)
    model = _fit(estimator, data)
    pred = model.transform(data.filter(F.col("split") == "test"))
    return pred.select("ts_hour", F.col("trip_count").alias("actual"), _r(F.col("prediction")).alias("prediction")), \
        model, cols


def _gbt(seed=42):
    return GBTRegressor(featuresCol="features", labelCol="trip_count", maxIter=100, maxDepth=5, stepSize=0.1, seed=seed)


def _rf(seed=42, max_depth: int = MAX_DEPTH):
    return _forest("trip_count", seed=seed, max_depth=max_depth)


def forecast_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees, last-24-hour hold-out predictions (FOR1)."""
    return _tree_forecast(_forecast_inputs(spark, sf_dir), _gbt())[0]


def forecast_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest, last-24-hour hold-out predictions (FOR2)."""
    return _tree_forecast(_forecast_inputs(spark, sf_dir), _rf())[0]


def _all_forecasts(split: DataFrame) -> dict[str, tuple[DataFrame, object]]:
    kept = split.persist(StorageLevel.MEMORY_AND_DISK)  # for the two fits; the results are lazy plans on ``split``
    try:
        gbt, gm, cols = _tree_forecast(kept, _gbt())
        rf, rm, _ = _tree_forecast(kept, _rf())
    finally:
        kept.unpersist()
    return {"Gradient Boosting": (gbt, gm, cols), "Random Forest": (rf, rm, cols),
            "Seasonal AR": (S.forecast_seasonal_ar(split), None, cols),
            "Seasonal Naive": (S.forecast_seasonal_naive(split), None, cols),
            "Mean Baseline": (S.forecast_mean_baseline(split), None, cols)}


def _comparison(forecasts) -> DataFrame:
    parts = [regression_metrics(p, "actual").withColumn("model", F.lit(name)) for name, (p, _, _) in forecasts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.orderBy("mae", "model")
    return out.select("model", "mae", "mse", "rmse", "r2").withColumn("mae_rank", F.row_number().over(w))


def forecast_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE, MSE, RMSE, R^2 per model; rank by MAE (FOR5)."""
    return _comparison(_all_forecasts(_forecast_inputs(spark, sf_dir)))


def forecast_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and best-model (lowest MAE) predictions for the last 24 hours,
    rounded to 0.1 (FOR6)."""
    fc = _all_forecasts(_forecast_inputs(spark, sf_dir))
    best = _comparison(fc).filter(F.col("mae_rank") == 1).select("model").first()[0]
    return fc[best][0].select("ts_hour", "actual", F.round("prediction", 1).alias("prediction"),
                              F.lit(best).alias("model"))


def forecast_feature_importance(spark: SparkSession, sf_dir: str, top: int = 15) -> DataFrame:
    """Top feature importances of the best tree model (FOR7)."""
    fc = _all_forecasts(_forecast_inputs(spark, sf_dir))
    cmp = _comparison(fc).filter(F.col("model").isin("Gradient Boosting", "Random Forest"))
    best = cmp.orderBy("mae", "model").select("model").first()[0]
    _, model, cols = fc[best]
    imp = _importances(spark, cols, model.featureImportances)
    w = Window.orderBy(F.desc("importance"), "feature")
    return (imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select("rank", "feature", _r(F.col("importance")).alias("importance"), F.lit(best).alias("model")))


QUERIES = {
    **{n: ("features", globals()[n]) for n in ["fare_linear_regression", "fare_random_forest", "fare_model_metrics",
                                                "fare_feature_importance", "fare_model_assessment"]},
    **{n: ("raw", globals()[n]) for n in ["forecast_gbt", "forecast_rf", "forecast_comparison", "forecast_vs_actual",
                                           "forecast_feature_importance"]},
}
