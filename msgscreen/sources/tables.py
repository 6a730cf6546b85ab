"""Readers for the driver's parquet tables.

Each reader selects only the columns a job needs, so the scan's ReadSchema is
pruned; filters applied later are pushed into the parquet scan by Catalyst.
Timestamps arrive as TIMESTAMP_NTZ and are cast to TIMESTAMP (session time
zone UTC) because watermarks and event-time windows need the zoned type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one driver table, optionally projected to ``cols``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if cols:
        df = df.select(*cols)
    return df


def events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``events`` with ``ts`` as a zoned TIMESTAMP."""
    df = table(spark, sf_dir, "events", *cols)
    if "ts" in df.columns:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df
