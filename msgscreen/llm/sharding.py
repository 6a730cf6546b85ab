"""Operator 10: proportional stratified interleaving of documents into shards. Native.

Rows of each source are shuffled by a seeded hash and ranked; row ``r`` of
``n`` gets the fractional rank (2r - 1) / 2n. Sorted by fractional rank, every
stretch of the order holds each source in its share of the corpus, so equal
cuts of the order make shards that all match the mixture and whose row counts
differ by one at most (law ``rows``).

No window spans a source or the table: rows are ranked inside ``BUCKETS``
hash (then rank) ranges, and a table of counts per range, at most
sources x ``BUCKETS`` rows, gives each range its offset.

Defined cases: a null source is a source of its own; a null text has no bytes;
a null id hashes as the word null; repeated rows are ranked side by side and
each takes a slot; an empty table gives an empty result; other columns are
ignored unless named in ``carry``, and may have any name but the results'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import stash

SHARDS = 24
SEED = "interleave-1"
#: Ranges that are ranked apart: a third of 10 billion rows in one source makes 0.8 million rows a range.
BUCKETS = 4096


def interleave(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, doc_id: str = "doc_id",
               text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Return (doc_id, size, text_crc32, source_key, shard, slot) and the columns ``carry``, a row per row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("source_key"),
        *[F.col(c) for c in carry],
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32").cast("string"))
    base = stash(base.withColumn("h", F.md5(key)).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")), "shard-base")

    counts = base.groupBy("source_key", "bucket").agg(F.count("*").alias("c"))
    by_source = Window.partitionBy("source_key")
    offsets = counts.select("source_key", "bucket", F.sum("c").over(by_source).alias("n"),
                            (F.sum("c").over(by_source.orderBy("bucket")) - F.col("c")).alias("before"))
    here = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = (base.withColumn("rn", F.row_number().over(here)).join(offsets, ["source_key", "bucket"])
              .withColumn("r", F.col("before") + F.col("rn")))
    ranked = ranked.withColumn("frac", (2 * F.col("r") - 1).cast("double") / (2 * F.col("n")).cast("double"))
    ranked = ranked.withColumn("cut", F.floor(F.col("frac") * BUCKETS).cast("int"))
    ranked = stash(ranked.drop("h", "bucket", "rn", "before", "n"), "shard-ranked")

    # at most BUCKETS rows in this window without a partition
    cuts = ranked.groupBy("cut").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(F.lit(0))
    cuts = cuts.select("cut", F.sum("c").over(whole).alias("total"), (F.sum("c").over(whole.orderBy("cut")) - F.col("c")).alias("before"))
    inside = Window.partitionBy("cut").orderBy("frac", "source_key", "r")
    placed = (ranked.withColumn("rn", F.row_number().over(inside)).join(cuts, "cut")
              .withColumn("pos", F.col("before") + F.col("rn") - 1)
              .withColumn("shard", F.expr(f"(pos * {n_shards}) div total")))
    return placed.select("doc_id", "size", "text_crc32", "source_key", F.col("shard").cast("int").alias("shard"),
                         (F.col("pos") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"), *carry)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the documents' rows under ``path``/shard=N, each shard's rows in slot order."""
    rows = interleave(docs, carry=tuple(c for c in docs.columns if c != options.get("doc_id", "doc_id")), **options)
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
