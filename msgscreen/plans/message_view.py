"""The message view: a deterministic message table derived from the driver tables.

The driver tables hold no spam phrases and no real URLs, so every job and
test reads this view, which turns ``pages``, ``events``, ``orders`` and
``documents`` (with ``labels``) into SMS-like messages covering every branch
of the scorer. It is a plain union of four narrow projections plus one join
(documents ⟕ labels, sort-merge or broadcast as AQE decides at runtime), so
it grows linearly with the tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SOURCE_PARTITIONS
from ..sources.tables import events, table

COLUMNS = ["message_id", "sender", "text", "true_label", "is_smishing", "a2p_type", "source"]

def _s(c):
    return c.cast("string")


def page_messages(pages: DataFrame) -> DataFrame:
    return pages.select(*_page_columns())


@functools.lru_cache(maxsize=1)
def _page_columns():
    url, pid = F.col("url"), F.col("page_id")
    path = F.regexp_replace(url, "^https?://[^/?#]*", "")
    k = pid % 12
    code = _s(F.lit(100000) + pid)
    text = (F.when(k == 0, F.concat(F.lit("URGENT! Your bank account is locked! Verify NOW! http://bit.ly"), path))
            .when(k == 1, F.concat(F.lit("Congratulations! You won $5000! Claim your FREE prize now: "
                                             "http://prize-winner.xyz"), path))
            .when(k == 2, F.concat(F.lit("Click here for amazing prizes: http://192.168.1.1"), path))
            .when(k == 3, F.concat(F.lit("Your Amazon order has shipped. Track: https://www.amazon.com"), path))
            .when(k == 4, F.concat(F.lit("Unusual activity detected. Confirm: https://secure-bank-verify.top"),
                                   path, F.lit(" or "), url))
            .when(k == 5, F.concat(F.lit("Your verification code is "), code, F.lit(". "), url))
            .when(k == 6, F.concat(F.lit("Confirm code "), code,
                                   F.lit(" at http://10.0.0.1/login/account?x=1&y=2&z=3")))
            .when(k == 7, F.concat(F.lit("Fwd: see "), url, F.lit(" and "), url))
            .when(k == 8, F.concat(F.lit("Account suspended: http://[bad"), path))
            .when(k == 9, F.concat(F.lit("hello "), url))
            .when(k == 10, F.concat(F.lit("URGENT! VERIFY NOW! CLAIM YOUR FREE $$$ CASH PRIZE! "
                                              "http://x7kq9zvw3mfp.bit.ly.secure-login.xyz/a/b/c/d?u=1&v=2&w=3&x=4"), path))
            .otherwise(F.concat(F.lit("$$$ FREE CASH! WIN $"), _s(F.lit(1000) + pid),
                                F.lit(" NOW! HURRY! $$$"))))
    return (
        F.concat(F.lit("pg"), _s(pid)).alias("message_id"),
        F.concat(F.lit("+1555"), _s(F.lit(1000000) + pid % 37)).alias("sender"),
        text.alias("text"),
        F.when(k.isin(0, 1, 2, 4, 6, 8, 10, 11), F.lit("spam")).otherwise(F.lit("ham")).alias("true_label"),
        k.isin(0, 2, 4, 6, 8, 10).alias("is_smishing"),
        F.when(k == 3, F.lit("transactional")).when(k == 5, F.lit("2fa")).alias("a2p_type"),
        F.lit("pages").alias("source"),
    )


@functools.lru_cache(maxsize=1)
def event_text():
    """Text of the event message (A2P templates keyed by event_id % 4)."""
    eid = F.col("event_id")
    m = eid % 4
    return (F.when(m == 0, F.concat(_s(F.lit(100000) + eid), F.lit(" is your Google security code")))
            .when(m == 1, F.concat(F.lit("Nike: "), _s(F.lit(20) + m * 10),
                                   F.lit("% off! Shop now. Reply STOP to unsubscribe")))
            .when(m == 2, F.lit("Appointment reminder: Dentist tomorrow at 2pm"))
            .otherwise(F.concat(F.lit("Hey, are we still meeting at "), _s(eid % 12), F.lit("pm?"))))


def event_messages(ev: DataFrame) -> DataFrame:
    return ev.select(*_event_columns())


@functools.lru_cache(maxsize=1)
def _event_columns():
    eid = F.col("event_id")
    m = eid % 4
    text = event_text()
    return (
        F.concat(F.lit("ev"), _s(eid)).alias("message_id"),
        F.concat(F.lit("+1555"), _s(F.lit(2000000) + F.col("user_id"))).alias("sender"),
        text.alias("text"),
        F.lit("ham").alias("true_label"),
        F.lit(False).alias("is_smishing"),
        F.when(m == 0, F.lit("2fa")).when(m == 1, F.lit("marketing"))
         .when(m == 2, F.lit("alerts")).alias("a2p_type"),
        F.lit("events").alias("source"),
    )


def order_messages(orders: DataFrame) -> DataFrame:
    return orders.select(*_order_columns())


@functools.lru_cache(maxsize=1)
def _order_columns():
    ok = F.col("o_orderkey")
    return (
        F.concat(F.lit("or"), _s(ok)).alias("message_id"),
        F.concat(F.lit("+1555"), _s(F.lit(3000000) + F.col("o_custkey"))).alias("sender"),
        F.concat(F.lit("Your Target order #"), _s(ok), F.lit(" has shipped")).alias("text"),
        F.lit("ham").alias("true_label"),
        F.lit(False).alias("is_smishing"),
        F.lit("transactional").alias("a2p_type"),
        F.lit("orders").alias("source"),
    )


def document_messages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(labels, "doc_id", "left").select(*_document_columns())


@functools.lru_cache(maxsize=1)
def _document_columns():
    return (
        F.concat(F.lit("dc"), _s(F.col("doc_id"))).alias("message_id"),
        F.lit(None).cast("string").alias("sender"),
        F.col("text"),
        F.when(F.col("toxic") == 1, F.lit("spam")).when(F.col("toxic") == 0, F.lit("ham")).alias("true_label"),
        F.lit(False).alias("is_smishing"),
        F.lit(None).cast("string").alias("a2p_type"),
        F.lit("documents").alias("source"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over as many partitions as the session asks for in
    ``spark.msgscreen.sourcePartitions``; without it the scan's own partitions
    stay (the rule at scale, where tables have many files)."""
    n = df.sparkSession.conf.get(SOURCE_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 7-column message view over the driver tables (see module doc)."""
    # ``spread`` sits under each branch's literal ``source`` projection, so a
    # filter on ``source`` still prunes whole union branches.
    return (page_messages(spread(table(spark, sf_dir, "pages", "page_id", "url")))
            .unionByName(event_messages(spread(events(spark, sf_dir, "event_id", "user_id"))))
            .unionByName(order_messages(spread(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))))
            .unionByName(document_messages(spread(table(spark, sf_dir, "documents", "doc_id", "text")),
                                           table(spark, sf_dir, "labels", "doc_id", "toxic"))))
