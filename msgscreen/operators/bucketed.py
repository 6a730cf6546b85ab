"""C11 over a bucketed corpus: new texts are added without moving the old ones.

The corpus is a table bucketed by text (a 64-bit hash and the text itself) beside
a Bloom filter of its texts: a table of 64-bit words, of bounded size whatever
the corpus. A batch of new rows is first reduced to one row a text, then checked
against the filter. Texts that it doesn't know are certainly new and meet the
corpus no more. The others are shuffled into the corpus' buckets and anti-joined
there: the plan has no exchange on the corpus' side. What is new is appended to
the table in its buckets and its bits are added to the filter.

Two appends to one corpus must not run at the same time. Null texts take no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .corpus import priority_dedup

#: Bits of the filter: 2^20 words of 64. With many more texts it lets more pass; the join behind it decides.
FILTER_BITS = 26
HASHES = 3


def _spots(key):
    """The places of a text's bits, from two halves of its hash."""
    low, high = F.pmod(key, F.lit(1 << 32)), F.pmod(F.shiftright(key, 32), F.lit(1 << 32))
    return [F.pmod(low + high * i + i * i, F.lit(1 << FILTER_BITS)) for i in range(HASHES)]


class Corpus:
    """A bucketed corpus table and its filter, both under ``path`` in a folder the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int, key: str):
        self.spark, self.path, self.name, self.buckets, self.key = spark, path, name, buckets, key
        self.part = 0  # the filter's version: it is written anew beside the one that is read

    @classmethod
    def create(cls, rows: DataFrame, buckets: int = 64, path: str | None = None, key: str = "message") -> Corpus:
        """A new corpus of the rows as they are (repeated texts too); ``key`` holds the text."""
        spark = rows.sparkSession
        corpus = cls(spark, path or scratch_path(spark, "corpus"), f"corpus_{uuid.uuid4().hex}", buckets, key)
        corpus._append(rows.where(F.col(key).isNotNull()), "overwrite")
        corpus._write_filter(corpus.table())
        return corpus

    def _append(self, rows: DataFrame, mode: str) -> None:
        (rows.withColumn("text_hash", F.xxhash64(self.key)).write.mode(mode).format("parquet").bucketBy(self.buckets, "text_hash", self.key)
         .option("path", f"{self.path}/table").saveAsTable(self.name))

    def table(self) -> DataFrame:
        """The corpus, with ``text_hash``."""
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table; its files stay until their folder is removed."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _filter(self) -> DataFrame:
        return self.spark.read.schema("word long, bits long").parquet(f"{self.path}/filter-{self.part}")

    def _write_filter(self, added: DataFrame, before: DataFrame | None = None, part: int = 0) -> None:
        spots = added.select(F.explode(F.array(*_spots(F.col("text_hash")))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")).alias("bits"))
        if before is not None:
            words = before.unionByName(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        words.write.mode("overwrite").parquet(f"{self.path}/filter-{part}")
        self.part = part

    def split_known(self, new: DataFrame) -> DataFrame:
        """``new`` (with ``text_hash``) and ``maybe_known``: false means that no corpus text is this one."""
        words = F.broadcast(self._filter())  # at most 2^20 rows of 16 bytes
        hit = F.lit(True)
        out = new
        for i, spot in enumerate(_spots(F.col("text_hash"))):
            out = out.withColumn(f"_spot{i}", spot)
            out = out.join(words.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}")), F.shiftright(f"_spot{i}", 6) == F.col(f"_word{i}"), "left")
            hit = hit & (F.coalesce(F.expr(f"shiftright(_bits{i}, CAST(_spot{i} % 64 AS INT))"), F.lit(0).cast("long")).bitwiseAND(F.lit(1)) == 1)
        return out.withColumn("maybe_known", hit).select(*new.columns, "maybe_known")

    def unseen(self, new: DataFrame) -> DataFrame:
        """The rows of ``new`` (one a text, with ``text_hash``) whose text the corpus does not hold."""
        asked = self.split_known(new)
        left = asked.where("maybe_known").drop("maybe_known").join(self.table().select("text_hash", self.key), ["text_hash", self.key], "left_anti")
        return asked.where("NOT maybe_known").drop("maybe_known").select(*new.columns).unionByName(left.select(*new.columns))

    def integrate(self, batch: DataFrame) -> DataFrame:
        """Add the texts of ``batch`` that are new, one row a text (C6); returns the rows added."""
        one = priority_dedup(batch.where(F.col(self.key).isNotNull()), self.key).drop("quality_rank").withColumn("text_hash", F.xxhash64(self.key))
        columns = self.table().columns
        found = self.unseen(one).select(*columns)
        path = f"{self.path}/added-{self.part + 1}"
        found.write.mode("overwrite").parquet(path)  # computed once, from the corpus as it was
        added = self.spark.read.schema(found.schema).parquet(path)
        self._append(added.drop("text_hash"), "append")
        self._write_filter(added, self._filter(), self.part + 1)
        return added
