"""Sinks and read-back sources.

History and feedback are append-only and partitioned by date, so readers
prune partitions; split and evaluation outputs are overwritten atomically
per job. Paths must be on shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = ("timestamp timestamp, date date, classification string, is_smishing boolean, "
                  "confidence double, via_sms boolean, message_length long, from_number_hash string")
# microsecond precision in JSON (Spark's default JSON format keeps milliseconds)
JSON_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
FEEDBACK_SCHEMA = ("message string, predicted_label string, true_label string, feedback_type string, "
                   "notes string, timestamp timestamp")


def write_history(history: DataFrame, path: str, fmt: str = "json") -> None:
    """Append history records (no text), partitioned by ``date``."""
    history.write.mode("append").partitionBy("date").option("timestampFormat", JSON_TS).format(fmt).save(path)


def read_history(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read history / archive records back with an explicit schema."""
    return spark.read.schema(HISTORY_SCHEMA).option("timestampFormat", JSON_TS).format(fmt).load(path)


def write_feedback(feedback: DataFrame, path: str) -> None:
    """Append corrections as JSON lines, partitioned by day."""
    feedback.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day") \
        .option("timestampFormat", JSON_TS).json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA + ", day date").option("timestampFormat", JSON_TS).json(path).drop("day")


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    """S5 as a file-stream source (new JSON files are picked up as they land)."""
    return spark.readStream.schema(FEEDBACK_SCHEMA + ", day date").option("timestampFormat", JSON_TS).json(path)


def write_splits(split_df: DataFrame, path: str) -> DataFrame:
    """The corpus partitioned by ``split`` plus a one-row summary table
    (sizes from one aggregate, not one count per split)."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/corpus")
    written = split_df.sparkSession.read.parquet(f"{path}/corpus")          # the corpus is computed once
    summary = written.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("label") == "spam").alias("spam_count"),
        F.count_if(F.col("label") == "ham").alias("ham_count"),
        F.count_if(F.col("is_smishing")).alias("smishing_count"),
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "val").alias("val_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
    ).withColumn("created_at", F.current_timestamp())
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
    return split_df.sparkSession.read.parquet(f"{path}/summary")


def write_evaluation(metrics: DataFrame, select, path: str) -> None:
    """Save metrics of all models (a small table) and the recommendation
    that ``select`` makes of what was written."""
    metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
    select(metrics.sparkSession.read.parquet(f"{path}/metrics")).coalesce(1).write.mode("overwrite").parquet(f"{path}/recommendation")


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S7 read side; the metrics table has one row per model, so callers may
    broadcast it."""
    return spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/recommendation")
