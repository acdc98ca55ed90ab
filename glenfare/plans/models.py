"""Fitted models, kept in the shared folder: fit once, use often.

``fit_once`` looks a model up by what it was fitted on and how: the version of the
rows, the estimator's class and all of its parameters.  The version is taken from the
rows themselves in one scan (their number, sums of both ends of one hash of each row
and the exclusive or of another), so it does not depend on their order, their partitions
or the plan that makes them, and changed rows never meet an old model.

A model is saved under a name of its own; the entry that points to it is written
after it is whole, so a fit that dies halfway leaves nothing that a later one could
read, and of two fits at once either may be read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from glenfare.session import checkpoint_dir

ENTRY = "path string, cost double"


def versioned(df: DataFrame, cols: list[str], *facts: Column) -> tuple[str, Row]:
    """``version`` and, from the same scan, the aggregates ``facts``."""
    known = [F.col(c).isNull() for c in cols]  # null and '' differ
    a, b = F.xxhash64(F.lit(1), *cols, *known), F.xxhash64(F.lit(2), *cols, *known)
    # 24 bits at each end: as longs, their sums hold half a billion times a thousand rows
    low, high = a.bitwiseAND(F.lit((1 << 24) - 1)), F.shiftright(a, 40)
    row = df.agg(F.count(F.lit(1)), F.sum(low), F.sum(high), F.bit_xor(b), *facts).first()
    types = ",".join(f"{c} {t}" for c, t in df.select(*cols).dtypes)
    return f"{types};{';'.join(map(str, row[:4]))}", row


def version(df: DataFrame, cols: list[str]) -> str:
    """Names the values of ``cols`` in the rows of ``df``, repeated rows counted, whatever their order."""
    return versioned(df, cols)[0]


def key_of(estimator: Estimator, *parts) -> str:
    """The name of a model: the estimator's class, its parameters by name, and ``parts``."""
    params = {p.name: repr(v) for p, v in estimator.extractParamMap().items()}
    said = json.dumps([type(estimator).__name__, params, *map(str, parts)], sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/models"


def find(spark: SparkSession, key: str):
    """(path, cost) of the model named ``key``, or None."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{_folder(spark)}/{key}/entry").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fit_once(spark: SparkSession, key: str, fit: Callable[[], tuple[Model, float | None]],
             model_class: type) -> tuple[Model, float | None]:
    """The model named ``key`` and its training cost: loaded, or fitted by ``fit`` and saved."""
    entry = find(spark, key)
    if entry is not None:
        return model_class.load(entry["path"]), entry["cost"]
    model, cost = fit()
    path = f"{_folder(spark)}/{key}/{uuid.uuid4().hex}"
    model.write().save(path)
    spark.createDataFrame([(path, cost)], ENTRY).coalesce(1).write.mode("append").parquet(f"{_folder(spark)}/{key}/entry")
    return model, cost
