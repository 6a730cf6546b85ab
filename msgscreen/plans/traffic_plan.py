"""Inbound traffic derived from ``events`` (plan C of the survey).

Every event is a request at ``ts`` from ``+1555<2000000+user_id>``; a quarter
of them (event_id % 4 == 0) carry page messages, the rest their own event
message. Pages are dealt to the carrying events in turn: the k-th event (by
id, from 0) carries the page whose place among the page ids is k modulo their
number, so each page is carried as often as any other, give or take one. ``value`` is the scoring latency, an ``error`` event is a failed
request, ``view`` events arrive over the web API, all others by SMS. The body
is forward-stripped (H9) and scored with the smishing upgrade (H7), as on the
SMS path. Only SMS are charged; only answered requests are recorded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as T
from ..operators import classify as C
from ..operators import traffic as TR
from ..sources.tables import events, table
from .message_view import event_text, page_messages, spread


# Daily limit of the registered queries: the events hold some 270 SMS a day, so that some days
# close early, as the service's own limit would at its traffic.
LIMIT = "3.9"


def arrivals(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The requests without their bodies."""
    ev = spread(events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value"))
    return ev.select(
        "event_id", "ts", F.concat(F.lit("+1555"), (F.lit(2000000) + F.col("user_id")).cast("string")).alias("sender"),
        "event_type", F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"),
        (F.col("event_type") != "view").alias("via_sms"), F.to_date("ts").alias("date"), *more)


#: Ids that share a range agree in all but so many bits; a level's ranges share ranges of the next.
RANGE_BITS = 20


def id_places(ids: DataFrame, key: str) -> DataFrame:
    """(key, place): each distinct non-null id's place, from 0, in ascending order.

    Prefix counts by levels of ranges of 2^20 neighbouring ids or ranges: no
    window holds more than 2^20 rows (two numbers each), the last at most 2^24,
    and as many as a millionth of the ids' span. Ids may be sparse or negative;
    repeated ids collapse before the shuffle."""
    levels = [ids.select(F.col(key).cast("long").alias("r")).where("r IS NOT NULL").groupBy("r").agg(F.lit(1).cast("long").alias("n"))]
    for _ in range(2):
        levels.append(levels[-1].groupBy(F.shiftright("r", RANGE_BITS).alias("r")).agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = levels[-1].select("r", before.alias("place"))
    for level in reversed(levels[:-1]):
        within = Window.partitionBy("up").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        inner = level.withColumn("up", F.shiftright("r", RANGE_BITS)).withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        places = (inner.join(places.select(F.col("r").alias("up"), F.col("place").alias("base")), "up")
                  .select("r", (F.col("base") + F.col("before")).alias("place")))
    return places.select(F.col("r").alias(key), "place")


def carried_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, page_text): which page's message a carrying event holds."""
    pages = table(spark, sf_dir, "pages", "page_id", "url").where("page_id IS NOT NULL").groupBy("page_id").agg(F.min("url").alias("url"))
    n = pages.select(F.count(F.lit(1))).scalar()
    carriers = events(spark, sf_dir, "event_id").where(F.col("event_id") % 4 == 0)
    turn = id_places(carriers, "event_id").select("event_id", F.pmod("place", F.greatest(n, F.lit(1).cast("long"))).alias("place"))
    texts = page_messages(pages).select(F.substring("message_id", 3, 20).cast("long").alias("page_id"), F.col("text").alias("page_text"))
    return turn.join(id_places(pages, "page_id").join(texts, "page_id"), "place").select("event_id", "page_text")


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with their bodies: equi-joins that reach every page."""
    j = arrivals(spark, sf_dir, event_text().alias("own_text")).join(carried_pages(spark, sf_dir), "event_id", "left")
    return j.withColumn("body", F.coalesce("page_text", "own_text")).drop("page_text", "own_text")


def with_cost(requests: DataFrame) -> DataFrame:
    """What a request costs: web requests nothing."""
    return requests.withColumn("cost", F.when(F.col("via_sms"), F.lit(D.COST_PER_MESSAGE).cast(TR.MONEY)).otherwise(F.lit(0).cast(TR.MONEY)))


def score_bodies(requests: DataFrame) -> DataFrame:
    return C.score(requests.withColumn("text", T.strip_forward(F.col("body"))), upgrade=True)


def scored_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request scored, failed ones too."""
    return score_bodies(inbound(spark, sf_dir))


def recorded_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored requests that enter the history: neither refused nor failed."""
    answered = (~F.col("via_sms") | F.col("accepted")) & ~F.col("is_error")
    return score_bodies(TR.accept(with_cost(inbound(spark, sf_dir)), limit=LIMIT).where(answered))
