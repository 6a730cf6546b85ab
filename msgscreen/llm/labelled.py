"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, n: int):
    """crc32(id as text) mod n; null ids have remainder 1, so they are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(1).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: dict[int, int], doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """(text, label): for each class the ``per_class`` labelled rows that come first by a hash of the id, whole texts.

    Ids with several labels take the largest. At most ``sum(per_class)`` ids
    are chosen, each by a bounded top-n, and only their texts leave Spark.
    """
    known = (labels.where(F.col(label).isin(*per_class) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
             .withColumnRenamed(doc_id, "key"))
    rows = docs.select(F.col(doc_id).alias("key")).where(usable).join(known, "key").distinct()
    lot = [F.xxhash64("key"), F.col("key")]
    chosen = None
    for y, n in per_class.items():
        part = rows.where(F.col("y") == y).orderBy(*lot).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), chosen.schema) if chosen is not None else rows
    found = docs.select(F.col(doc_id).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    out = found.select("key", "text", F.col("y").cast("int").alias("y")).toPandas()
    return out.sort_values(["key", "text"]).drop_duplicates(["text", "y"]).reset_index(drop=True)
