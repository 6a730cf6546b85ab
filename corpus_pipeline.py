"""The corpus pipeline over ``documents``.

Toxic and bad documents go, one document of each group of near copies stays,
passages that repeat are cut, and what is left is packed into sequences. Each
stage's rows are written as Parquet and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgscreen.llm import jaccard, packing, quality, suffixdedup, toxicity
from msgscreen.llm.common import stash, table
from msgscreen.llm.queries import vocabulary_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixdedup.cut_text(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    parts = packing.pieces(docs, vocabulary_file(), chunks_kept=150_000)
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_bad), ("n-gram Jaccard join", drop_near_copies),
          ("suffix-array dedup", cut_repeats), ("best-fit packing", pack)]
#: Trained models and a packing plan are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stash(docs, "pipeline")
    return docs
