"""What the operators of this package share: reading tables, tables in the
shared folder, and shipping their helper functions to Python workers."""

from __future__ import annotations

import sys
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.session import checkpoint_dir

#: Rows in one Arrow batch of a Python stage: texts may be 100 KB and more.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once,
    its lineage ends there, and it survives the loss of executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send the functions of ``module`` to the executors by value, so that they
    need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings (dots written as two underscores) for the jobs inside."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_key(*others: str) -> Column:
    """With doc_id, tells rows apart whose doc_id is repeated or null."""
    return F.xxhash64("text", *others)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that are (or resemble) columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in ("_" * k + name for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def rows_in(docs: DataFrame, keys: DataFrame, *others: str, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_key) is in ``keys``; with
    ``once``, equal keys stay once."""
    own_id, own_text, key_id, key_text = unused(docs, "own_id", "own_text", "key_id", "key_text")
    k = keys.select(F.col("doc_id").alias(key_id), F.col("text_key").alias(key_text)).distinct()
    d = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_text: text_key(*others)})
    out = d.join(k, F.col(own_id).eqNullSafe(F.col(key_id)) & (F.col(own_text) == F.col(key_text)), "left_semi")
    if once and not keys.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([own_id, own_text])
    return out.select(docs.columns)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` where ``value`` is computed once, however often ``body``
    (also inside its own lambdas) reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)

