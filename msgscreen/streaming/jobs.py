"""Structured Streaming forms of the inbound-SMS jobs (X1–X6). Delivery to tables is in
:mod:`delivery`, the gate for rows out of order in :mod:`ordered`, X7 and X8 in :mod:`stateful`.

Event time everywhere: ``ts`` must be a zoned TIMESTAMP (the driver's parquet
loads as TIMESTAMP_NTZ, which ``withWatermark`` rejects, so sources cast it).
State lives in the query checkpoint, so a restarted query (or a lost
executor) resumes without lost or double-counted updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as T
from ..operators import classify as C
from ..operators import traffic as TR

INBOUND_SCHEMA = ("event_id long, ts timestamp, sender string, body string, event_type string, "
                  "latency_ms double, message_sid string")


def inbound_stream(spark: SparkSession, path: str, schema: str = INBOUND_SCHEMA,
                   max_files: int | None = None) -> DataFrame:
    """A file stream of inbound messages (parquet), ``ts`` cast to TIMESTAMP."""
    r = spark.readStream.schema(schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def classify_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Inbound -> de-duplicate redelivered webhooks by ``message_sid``
    (by ``event_id`` where it has none: the id is optional) within the
    watermark -> forward-strip -> score (with the smishing upgrade) -> reply
    text. A failed request or one without a body has no classification and
    gets the error reply. Stateless apart from the dedup state."""
    key = F.coalesce(F.concat(F.lit("sid "), "message_sid"), F.concat(F.lit("event "), F.col("event_id").cast("string")))
    s = stream.withColumn("_key", key).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["_key"])
    s = s.withColumn("text", T.strip_forward(F.col("body")))
    scored = C.score(s, upgrade=True)
    answered = (F.col("event_type") != "error") & F.col("label").isNotNull()
    reply = T.reply_text(F.col("is_spam"), F.col("is_smishing"), F.col("confidence"), F.col("risk_level"), F.col("reasoning"))
    return scored.select(
        "event_id", "ts", F.to_date("ts").alias("date"), "sender", F.when(answered, F.col("label")).alias("classification"),
        *[F.when(answered, F.col(c)).alias(c) for c in ("is_spam", "is_smishing", "confidence", "risk_level")], "latency_ms",
        (~answered).alias("is_error"), (F.col("event_type") != "view").alias("via_sms"), F.length("text").alias("message_length"),
        F.when(answered, reply).otherwise(F.lit(D.REPLY_ERROR)).alias("reply"))


def _wm(df: DataFrame, watermark: str | None) -> DataFrame:
    """Apply a watermark unless the upstream already defined one (X1 does)."""
    return df.withWatermark("ts", watermark) if watermark else df


def daily_counters_stream(scored: DataFrame, watermark: str | None = None) -> DataFrame:
    """T2 live — tumbling 1-day event-time windows; rows later than the
    watermark (X1's 1 day, or ``watermark``) are dropped (late-data rule)."""
    spam = F.col("classification").isin("spam", "smishing") | F.col("is_smishing")
    return (_wm(scored, watermark).filter(~F.col("is_error"))
            .groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total_messages"), F.count_if(spam).alias("spam_count"),
                 F.count_if(spam & F.col("is_smishing")).alias("smishing_count"),
                 F.count_if(~spam).alias("ham_count"), F.count_if(F.col("via_sms")).alias("sms_received"))
            .select(F.to_date(F.col("w.start")).alias("date"), "total_messages", "spam_count",
                    "smishing_count", "ham_count", "sms_received"))


def start_spend_gate(stream: DataFrame, path: str, checkpoint: str, limit: str = D.DAILY_SPEND_LIMIT,
                     available_now: bool = True):
    """The T7 gate live. Per micro-batch, the batch gate's two-level prefix
    sums on top of a table of one row per day, ``path``/state/<batch>, that
    holds what the day's accepted messages have cost. ``stream`` may have a
    ``cost`` column. Each batch overwrites its own outputs from its
    predecessor's state, so a repeated batch changes nothing. Results are under
    ``path``/gate (:func:`read_gate`). Parity with the batch gate holds for
    input that arrives in time order; no day is handled by a single task."""
    lim = F.lit(limit).cast(TR.MONEY)

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        spent = spark.read.parquet(f"{path}/state/{n - 1}") if n else spark.createDataFrame([], f"date date, spent {TR.MONEY}")
        cost = F.col("cost") if "cost" in batch.columns else F.lit(D.COST_PER_MESSAGE)
        rows = batch.withColumn("date", F.to_date("ts")).withColumn("cost", cost.cast(TR.MONEY)).select("event_id", "ts", "date", "cost")
        rows = TR.running_sum(rows, "cost", "date", "ts", "event_id", 60).join(spent, "date", "left")
        before = F.col("_before") + F.coalesce("spent", F.lit(0).cast(TR.MONEY))
        rows = rows.withColumn("asked_before", before.cast(TR.MONEY)).withColumn("accepted", F.col("asked_before") < lim)
        rows = rows.withColumn("alert", F.col("accepted") & (F.col("asked_before") + F.col("cost") >= lim))
        rows.select("event_id", "ts", "date", "cost", "accepted", "alert").write.mode("overwrite").parquet(f"{path}/gate/batch={n}")
        paid = spark.read.parquet(f"{path}/gate/batch={n}").filter("accepted").select("date", F.col("cost").alias("spent"))
        (spent.unionByName(paid).groupBy("date").agg(F.sum("spent").cast(TR.MONEY).alias("spent"))
         .write.mode("overwrite").parquet(f"{path}/state/{n}"))

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/gate").drop("batch")


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and return what it wrote to ``path``;
    in complete mode each batch replaces the table."""
    w = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", path).start().awaitTermination()
    else:
        w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dashboard_feed(scored: DataFrame, bucket: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Per-bucket totals for the live dashboard (written every 30 s by
    :func:`start_dashboard_feed`)."""
    spam = F.col("classification").isin("spam", "smishing") | F.col("is_smishing")
    return (_wm(scored, watermark).filter(~F.col("is_error")).groupBy(F.window("ts", bucket).alias("w"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(spam).alias("spam"),
                 F.count_if(~spam).alias("ham"))
            .select(F.col("w.start").alias("bucket_start"), "total", "spam", "ham"))


def traffic_metrics_stream(scored: DataFrame, width: str = "1 minute", slide: str | None = None,
                           watermark: str | None = None) -> DataFrame:
    """X6 live: requests, rate, error rate, approximate latency percentiles and
    the prediction mix per event-time window (``percentile_approx``: bounded
    state per window)."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (_wm(scored, watermark).groupBy(win.alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"),
                 *[F.count_if(F.col("classification") == x).alias(x) for x in ("ham", "spam", "smishing")],
                 F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 1000).alias("p"))
            .withColumn("seconds", (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6)
            .select(F.col("w.start").alias("window_start"), "requests", (F.col("requests") / F.col("seconds")).alias("rate_per_s"),
                    (F.col("errors") / F.col("requests")).alias("error_rate"), "ham", "spam", "smishing",
                    F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99")))


def start_dashboard_feed(scored: DataFrame, table_path: str, checkpoint: str, every: str = "30 seconds"):
    """Start X5: append finished buckets to a parquet table every ``every``."""
    return (dashboard_feed(scored).writeStream.outputMode("append").format("parquet")
            .option("path", table_path).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())


def feedback_trigger_stream(feedback: DataFrame, every: int = D.FEEDBACK_RETRAIN_EVERY) -> DataFrame:
    """X4 live: running count of corrections and the number of retrains it
    has triggered (one per ``every``). A global streaming aggregate: its
    state is one counter, merged from partial counts (complete mode)."""
    return (feedback.groupBy().agg(F.count(F.lit(1)).alias("feedback_count"))
            .withColumn("retrains_triggered", F.floor(F.col("feedback_count") / every).cast("long")))
