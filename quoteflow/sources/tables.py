"""Parquet table access with explicit column pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.session import apply_runtime_conf

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one driver table; selecting ``columns`` here keeps the scan's ReadSchema narrow."""
    apply_runtime_conf(spark)
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def epoch_ms(df: DataFrame, col: str):
    """Epoch milliseconds of a timestamp column, independent of the session zone
    for TIMESTAMP_NTZ input (the driver tables load as NTZ)."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_millis(F.col(col))


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a Parquet table (duplicates are kept, like the reference's inserts)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, sort: bool = True) -> None:
    """Store ``df`` as a catalog table bucketed (and sorted) on ``keys``.

    Two tables bucketed the same way on their join keys join without a
    shuffle (e.g. orders and venue status reports on (exchange, order_id));
    the bucket count should give buckets of a few hundred MB."""
    w = df.write.mode("overwrite").bucketBy(int(buckets), *keys)
    if sort:
        w = w.sortBy(*keys)
    w.saveAsTable(table)
