"""Results that a later pass reads: written once to the shared folder.

A table stored here is computed once, ends its lineage, and survives the loss of
executors, as ``spark.checkpoint.dir`` is shared by the driver and all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from glenfare.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
