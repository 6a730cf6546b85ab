"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen.llm import alignment, bpe, hardnegatives, jaccard, packing, pstable, quality, sharding, sitetree, suffixdedup, topk, toxicity, warc
from msgscreen.llm.common import table


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of passages of 200 bytes that repeat."""
    rows = suffixdedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of 2048."""
    parts = packing.pieces(table(spark, sf_dir, "documents"), vocabulary_file())
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded, as digests."""
    rows = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_file())
    return rows.select("doc_id", (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.95 or more."""
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by learned subword vectors."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by compression distance."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles agree to 80 of 100."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards that match the mixture of sources; law: rows."""
    placed = sharding.interleave(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    rows = sitetree.extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens under two vocabularies, grouped at shared ends, links counted over all documents."""
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector's positives; every seventh vector's label is moved by one."""
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10))


QUERIES = {"op1_warc": op1_warc, "op2_quality": op2_quality, "op8_toxicity": op8_toxicity, "op3_pstable": op3_pstable, "op4_topk": op4_topk, "op5_suffixdedup": op5_suffixdedup, "op6_packing": op6_packing, "op7_bpe": op7_bpe, "op9_jaccard": op9_jaccard, "op10_sharding": op10_sharding, "op11_sitetree": op11_sitetree, "op12_alignment": op12_alignment, "op13_hardnegatives": op13_hardnegatives}
