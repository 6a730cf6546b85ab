"""U15 with mergeable sketches: distinct senders and frequent domains in bounded state.

The exact rollups count distinct senders per domain, which needs every (domain,
sender) pair once more at each read. Here a part of the traffic (a day, a
delivery) leaves one row per domain with HyperLogLog sketches, and one
frequent-items sketch; parts are kept and merged at will, and the exact form
stays for reports that need it.

Errors: a HyperLogLog sketch of 2^12 registers has a relative standard error of
1.6 %; :func:`sender_bound` is three of them. The frequent-items sketch tracks
``TRACKED`` items: a count is off by at most 3.5 / ``TRACKED`` of all rows, and
exact while there are fewer distinct items than about three quarters of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_REGISTERS = 12
TRACKED = 1 << 14


def netloc_sketches(feats: DataFrame, part: list | None = None) -> DataFrame:
    """(part..., netloc, n_urls, risk_sum, senders, messages): counts and sketches (binary) of each domain."""
    return feats.groupBy(*(part or []), "netloc").agg(
        F.count(F.lit(1)).alias("n_urls"), F.sum("url_risk_score").alias("risk_sum"),
        F.hll_sketch_agg("sender", F.lit(LG_REGISTERS)).alias("senders"), F.hll_sketch_agg("message_id", F.lit(LG_REGISTERS)).alias("messages"))


def merged(stored: DataFrame) -> DataFrame:
    """Parts of :func:`netloc_sketches` merged per domain."""
    return stored.groupBy("netloc").agg(F.sum("n_urls").alias("n_urls"), F.sum("risk_sum").alias("risk_sum"),
                                        F.hll_union_agg("senders").alias("senders"), F.hll_union_agg("messages").alias("messages"))


def estimates(stored: DataFrame) -> DataFrame:
    """(netloc, n_urls, avg_risk, senders, messages) with the estimated numbers of distinct senders and messages."""
    return stored.select("netloc", "n_urls", (F.col("risk_sum") / F.col("n_urls")).alias("avg_risk"),
                         F.hll_sketch_estimate("senders").alias("senders"), F.hll_sketch_estimate("messages").alias("messages"))


def sender_bound(exact):
    """How far an estimate may be off: three standard errors, and one."""
    return exact * (3 * 1.04 / (1 << LG_REGISTERS) ** 0.5) + 1


def frequent_items(rows: DataFrame, column: str, part: list | None = None, tracked: int = TRACKED) -> DataFrame:
    """(part..., items): a frequent-items sketch of the column's values."""
    return rows.groupBy(*(part or [])).agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("items"))


def top_items(stored: DataFrame, k: int, into: str = "item", tracked: int = TRACKED) -> DataFrame:
    """(``into``, count): the k most frequent items of merged sketches, ties in the items' order."""
    whole = stored.agg(F.expr(f"approx_top_k_combine(items, {tracked})").alias("items"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(items, {tracked // 2})")).alias("x")).select(F.col("x.item").alias(into), F.col("x.count").alias("count"))
    return found.orderBy(F.desc("count"), into).limit(k)
