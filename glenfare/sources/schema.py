"""Trip schema, readers and the projection of the driver's ``lineitem`` table.

The engine works on one flat table of trips.  Column names are snake case;
the left column of ``REFERENCE_HEADERS`` is the engine name, the right the
header used by CSV exports of the original application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIP_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("pickup_postcode", T.StringType(), True),
    T.StructField("dropoff_postcode", T.StringType(), True),
    T.StructField("distance_km", T.DoubleType(), True),
    T.StructField("duration_min", T.DoubleType(), True),
    T.StructField("fare_amount", T.DoubleType(), True),
    T.StructField("tip_pct_raw", T.StringType(), True),
    T.StructField("tip_amount", T.DoubleType(), True),
    T.StructField("total_amount", T.DoubleType(), True),
    T.StructField("payment_type", T.StringType(), True),
    T.StructField("passenger_count", T.IntegerType(), True),
])

TRIP_COLUMNS = [f.name for f in TRIP_SCHEMA.fields]

# CSV header names of the trip export, in file order.
REFERENCE_HEADERS = {
    "ts": "Timestamp",
    "pickup_postcode": "Pickup Postcode",
    "dropoff_postcode": "Dropoff Postcode",
    "distance_km": "Distance (km)",
    "duration_min": "Duration (minutes)",
    "fare_amount": "Fare Amount (£)",
    "tip_pct_raw": "Tip (%)",
    "tip_amount": "Tip Amount (£)",
    "total_amount": "Total Amount (£)",
    "payment_type": "Payment Type",
    "passenger_count": "Passenger Count",
}

# The numeric measures every multi-column statistic runs over (D17: fixed set,
# not "whatever numeric columns exist now").
NUMERIC_MEASURES = ["distance_km", "duration_min", "fare_amount", "tip_pct",
                    "tip_amount", "total_amount", "passenger_count"]


class MissingColumnsError(ValueError):
    """Raised when a trips frame lacks columns an operator needs."""


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {missing}")


def _nan_to_null(c: str) -> Column:
    # pandas treats NaN as missing; Spark's avg/count would not (D2).
    return F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)


def _coerced(df: DataFrame, field: T.StructField) -> Column:
    """The column of ``field`` in its type; null where the cell does not fit."""
    c = F.col(field.name)
    if df.schema[field.name].dataType != field.dataType:
        if isinstance(field.dataType, T.TimestampNTZType):
            c = F.expr(f"try_cast(`{field.name}` as timestamp_ntz)")
        else:
            c = F.expr(f"try_cast(`{field.name}` as {field.dataType.simpleString()})")
    if isinstance(field.dataType, T.DoubleType):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return c


def rejected_cells(df: DataFrame) -> DataFrame:
    """One row for each number and time column: ``cells``, those ``missing`` (null, blank or NaN) and those ``rejected``,
    which hold something that ``normalize`` reads as null.  Frame as scanned, before ``normalize``; one pass."""
    require_columns(df, TRIP_COLUMNS)
    fields = [f for f in TRIP_SCHEMA.fields if not isinstance(f.dataType, T.StringType)]
    counts = [F.count(F.lit(1)).alias("cells")]
    for f in fields:
        text = F.lower(F.trim(F.col(f.name).cast("string")))
        missing = text.isNull() | text.isin("", "nan")
        counts += [F.count_if(missing).alias(f"{f.name}__missing"),
                   F.count_if(~missing & _coerced(df, f).isNull()).alias(f"{f.name}__rejected")]
    parts = ", ".join(f"'{f.name}', `{f.name}__missing`, `{f.name}__rejected`" for f in fields)
    return df.agg(*counts).selectExpr("cells", f"stack({len(fields)}, {parts}) AS (column_name, missing, rejected)") \
        .select("column_name", "cells", "missing", "rejected")


def normalize(df: DataFrame) -> DataFrame:
    """Cast an arbitrary trips frame onto TRIP_SCHEMA with ANSI-safe casts.

    Bad numbers and timestamps become null instead of failing the job;
    ``rejected_cells`` counts them.  Columns outside the schema are
    kept unchanged after the schema columns.
    """
    require_columns(df, TRIP_COLUMNS)
    out = [_coerced(df, field).alias(field.name) for field in TRIP_SCHEMA.fields]
    extra = [F.col(c) for c in df.columns if c not in TRIP_COLUMNS]
    return df.select(*out, *extra)


def read_trips_csv(spark: SparkSession, path: str, reference_headers: bool = True) -> DataFrame:
    """CSV scan with header (SRC1).

    Everything is read as string and then coerced with ``try_cast``, so a
    malformed cell is a null rather than a failed task; permissive mode keeps
    short rows.
    """
    return normalize(scan_trips_csv(spark, path, reference_headers))


def scan_trips_csv(spark: SparkSession, path: str, reference_headers: bool = True) -> DataFrame:
    """The cells of a trips CSV as text, for ``normalize`` and ``rejected_cells``."""
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE")
              .option("nullValue", "").option("encoding", "UTF-8"))
    raw = reader.csv(path)
    if reference_headers:
        rename = {v: k for k, v in REFERENCE_HEADERS.items()}
        raw = raw.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in raw.columns])
    return raw


def load(spark: SparkSession, source: DataFrame | str | None = None, reference_headers: bool = True) -> DataFrame:
    """Trips from a CSV path or an existing frame (SRC1, SRC2), on TRIP_SCHEMA:
    casts are safe, NaN is null.  Without a source it raises (SRC3)."""
    if source is None:
        raise ValueError("give a trips frame or the path of a CSV file")
    if isinstance(source, str):
        return read_trips_csv(spark, source, reference_headers)
    rename = {v: k for k, v in REFERENCE_HEADERS.items() if v in source.columns} if reference_headers else {}
    return normalize(source.withColumnsRenamed(rename))


def write_trips_csv(df: DataFrame, path: str, reference_headers: bool = True) -> None:
    """CSV sink in the export layout (used by the CSV round-trip query)."""
    out = df.select(*[
        (F.date_format("ts", "yyyy-MM-dd HH:mm:ss") if c == "ts" else F.col(c))
        .alias(REFERENCE_HEADERS[c] if reference_headers else c)
        for c in TRIP_COLUMNS])
    out.write.mode("overwrite").option("header", True).csv(path)


def trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Deterministic projection of ``lineitem`` onto the trip schema.

    One trip per lineitem row; the same expressions are written in DuckDB
    SQL in ``glenfare.oracle.TRIPS_CTE`` so the two engines see equal rows.
    """
    li = F.col
    fare = (F.floor(li("l_extendedprice") / 10).cast("double") / F.lit(100.0))
    tip = (F.floor(li("l_extendedprice") * li("l_discount") / 10).cast("double") / F.lit(100.0))
    supp25 = li("l_suppkey") % 25
    return lineitem.select(
        F.expr("l_shipdate + make_dt_interval(0, CAST(l_partkey % 5 + l_suppkey % 20 AS INT), "
               "CAST(l_orderkey % 60 AS INT), 0)").alias("ts"),
        F.when(supp25 == 0, F.lit(None).cast("string"))
         .when(supp25 == 1, F.lit("G12 8QQ"))
         .otherwise(F.concat(F.lit("G"), (li("l_suppkey") % 14 + 1).cast("string"),
                             (li("l_partkey") % 9 + 1).cast("string"), F.lit("AA")))
         .alias("pickup_postcode"),
        F.concat(F.lit("G"), (li("l_partkey") % 20 + 1).cast("string"), F.lit("5"), F.lit("QS"))
         .alias("dropoff_postcode"),
        ((li("l_quantity") - 1) * F.lit(1.25)).alias("distance_km"),
        (li("l_quantity") * F.lit(1.5) + li("l_linenumber") - 2).alias("duration_min"),
        fare.alias("fare_amount"),
        F.concat(F.round(li("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
         .alias("tip_pct_raw"),
        tip.alias("tip_amount"),
        (fare + tip).alias("total_amount"),
        F.when(li("l_returnflag") == "A", "Card").when(li("l_returnflag") == "N", "Cash")
         .otherwise("App").alias("payment_type"),
        F.when(li("l_orderkey") % 50 == 0, F.lit(None).cast("int"))
         .otherwise(li("l_linenumber")).alias("passenger_count"),
    )


def load_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips over the driver's parquet test tables (column-pruned scan)."""
    return trips_from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
