"""Corpus built from the message view: four sources with different label
conventions, unified, de-duplicated and split (plan A of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as CO
from .message_view import message_view

# source -> (dataset, quality, rank in the union)
SOURCES = {
    "pages": ("pages_sms", "high", 0),
    "events": ("events_a2p", "medium", 1),
    "orders": ("orders_a2p", "low", 2),
    "documents": ("documents_corpus", "medium", 3),
}


def _base(mv: DataFrame, source: str, raw_label) -> DataFrame:
    dataset, quality, rank = SOURCES[source]
    df = mv.filter(F.col("source") == source).select(
        "message_id", F.col("text").alias("message"), raw_label.alias("label"), "a2p_type")
    return CO.tag_source(df, source, dataset, quality).withColumn("source_rank", F.lit(rank))


def corpus_sources(mv: DataFrame) -> list[DataFrame]:
    """pages carry smishing labels (unified, C2/C3); events carry upper-case
    labels and orders/documents plain ones (normalised, C1; unlabelled
    documents drop out)."""
    pages = CO.unify_labels(_base(mv, "pages", F.when(F.col("is_smishing"), F.lit("smishing"))
                                  .otherwise(F.col("true_label"))), unknown="ham")
    events = CO.normalise_labels(_base(mv, "events", F.upper("true_label")))
    orders = CO.normalise_labels(_base(mv, "orders", F.col("true_label")))
    docs = CO.normalise_labels(_base(mv, "documents", F.col("true_label")))
    return [pages, events, orders, docs]


UNION_COLS = ["message_id", "message", "label", "original_label", "is_smishing", "a2p_type",
              "source", "dataset", "quality", "source_rank"]


def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.union_sources(corpus_sources(message_view(spark, sf_dir))).select(*UNION_COLS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-duplicated corpus."""
    return CO.priority_dedup(corpus_union(spark, sf_dir))


def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 over the de-duplicated corpus (the split checkpoints its input)."""
    return CO.stratified_split(corpus(spark, sf_dir))
