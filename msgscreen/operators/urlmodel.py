"""M2 with a model: every distinct URL is scored once and its score joined back.

URLs repeat (a campaign's link may be in a third of all messages), and a model
is the slow path, so messages never reach it: their URLs are collapsed by a
partially aggregated count, the distinct ones go through the caller's scorer
(``mapInPandas``, built once per task) and the scores are written as a table
keyed by URL. The table can be kept and grown: :func:`grow_scores` scores only
URLs it doesn't hold yet.

The join back knows how often each URL occurs. Rows of URLs that occur more than
``HOT_ROWS`` times take their score from a broadcast of these few (there are at
most rows / ``HOT_ROWS``; beyond ``HOT_URLS`` none is broadcast and adaptive
execution has to split the skewed partition); all others join by shuffle. So a
hot URL's rows are never moved to one task.

A failing batch is scored row by row; a URL on which the scorer fails gets a
row with ``error`` and no label, and doesn't vote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .models import url_vote

Scorer = Callable[[list[str]], list[tuple[str, float]]]
SCORE_SCHEMA = "url string, messages long, url_label string, url_conf double, error string"
#: A URL with more rows than this takes its score from a broadcast; so many URLs may.
HOT_ROWS, HOT_URLS = 100_000, 100_000


def distinct_urls(url_rows: DataFrame, url: str = "url") -> DataFrame:
    """(url, messages): each URL once, with the number of its rows."""
    return url_rows.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("messages"))


def _score(urls: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            try:
                found = [(label, float(conf), None) for label, conf in scorer(batch["url"].tolist())]
            except Exception:  # isolate the failing URLs
                found = []
                for u in batch["url"]:
                    try:
                        label, conf = scorer([u])[0]
                        found.append((label, float(conf), None))
                    except Exception as e:  # noqa: BLE001
                        found.append((None, None, str(e)))
            yield batch[["url", "messages"]].assign(**pd.DataFrame(found, columns=["url_label", "url_conf", "error"], index=batch.index))

    return urls.mapInPandas(run, SCORE_SCHEMA)


def score_urls(url_rows: DataFrame, make_scorer: Callable[[], Scorer], url: str = "url") -> DataFrame:
    """(url, messages, url_label, url_conf, error): the written table of scores, a row per distinct URL."""
    return materialize(_score(distinct_urls(url_rows, url), make_scorer))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).parquet(f"{path}/batch=*")


def grow_scores(url_rows: DataFrame, path: str, make_scorer: Callable[[], Scorer], batch: str, url: str = "url") -> DataFrame:
    """Score the URLs that the table at ``path`` (a shared folder) doesn't hold, as its part ``batch``, and return the table.

    A part that is written again replaces itself, so a repeated batch scores
    its own URLs anew but leaves none twice. ``messages`` counts the rows of
    the batch in which a URL came first.
    """
    spark = url_rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [str(s.getPath()) for s in fs.listStatus(hadoop) if s.getPath().getName() != f"batch={batch}"] if fs.exists(hadoop) else []
    urls = distinct_urls(url_rows, url)
    if parts:
        urls = urls.join(spark.read.schema(SCORE_SCHEMA).parquet(*parts).select("url"), "url", "left_anti")
    _score(urls, make_scorer).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return read_scores(spark, path)


def with_scores(url_rows: DataFrame, scores: DataFrame, url: str = "url", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``url_rows`` with ``url_label`` and ``url_conf``; URLs without a score are left out."""
    scores = scores.where("url_label IS NOT NULL").select(F.col("url").alias("_url"), "messages", "url_label", "url_conf")
    hot = scores.where(F.col("messages") > hot_rows).select(F.col("_url").alias("_hot"), F.struct("url_label", "url_conf").alias("_hot_score"))
    rest = scores.select("_url", F.struct("url_label", "url_conf").alias("_score"))
    if not 0 < hot.count() <= HOT_URLS:
        rows = url_rows.join(rest, F.col(url) == F.col("_url"))
        return rows.select(*url_rows.columns, "_score.*")
    rows = url_rows.join(F.broadcast(hot), F.col(url) == F.col("_hot"), "left")
    # a row that has its score joins with nothing, under a key that spreads such rows
    key = F.when(F.col("_hot").isNull(), F.concat(F.lit("u"), F.col(url))).otherwise(F.concat(F.lit("-"), F.xxhash64(*url_rows.columns).cast("string")))
    rows = rows.withColumn("_key", key).join(rest.withColumn("_key", F.concat(F.lit("u"), "_url")), "_key", "left")
    rows = rows.withColumn("_score", F.coalesce("_hot_score", "_score")).where("_score IS NOT NULL")
    return rows.select(*url_rows.columns, "_score.*")


def url_model_vote(url_rows: DataFrame, messages: DataFrame, scores: DataFrame, id_col: str = "message_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """M2: any phishing URL -> spam with the largest phishing confidence; scored URLs but none phishing -> ham 0.7; none -> ham 0.5."""
    return url_vote(with_scores(url_rows, scores, hot_rows=hot_rows).select(id_col, "url_label", "url_conf"), messages, id_col)
