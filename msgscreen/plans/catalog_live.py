"""Registered queries of the live jobs: each runs its stream over delivered files and reads what it wrote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import delivery as DE
from ..streaming import jobs as SJ
from ..streaming import ordered as OG
from ..streaming import stateful as ST
from ..streaming.parts import ddl
from . import corpus_plan as CP
from . import traffic_plan as TP
from .catalog import _SALT, _classified, _landed, _money, _overrides, _round_all, _sms, _ts, r6, register
from ..sources.tables import table

#: Rows may arrive this much later than others of their time.
DELAY = dt.timedelta(hours=6)


#: A delivery of more rows comes as several files, which tasks write and read side by side.
FILE_ROWS = 100_000


def _deliver(rows: DataFrame, path: str, shuffled: bool, files: int = 6, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write rows as ``files`` deliveries in order of arrival and read them as a stream, one delivery a micro-batch.

    ``shuffled``: each row arrives up to ``DELAY`` after its time, by a hash of its id.
    All deliveries have the same number of files (empty ones fill up), so that a micro-batch never mixes two."""
    spark = rows.sparkSession
    wait = F.pmod(F.xxhash64("event_id"), F.lit(int(DELAY.total_seconds()) - 1)) if shuffled else F.lit(0)
    arrival = rows.withColumn("_at", F.unix_seconds("ts") + wait)
    cuts = arrival.agg(F.percentile_approx("_at", [i / files for i in range(1, files)], 1000).alias("c")).first().c or []
    number = sum((F.when(F.col("_at") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    arrival.withColumn("_file", number).drop("_at").write.partitionBy("_file").parquet(f"{path}-sorted")
    dealt = spark.read.schema(f"{ddl(rows)}, _file int").parquet(f"{path}-sorted")
    most = max((r["count"] for r in dealt.groupBy("_file").count().collect()), default=0)  # a row a delivery
    each = max(1, -(-most // file_rows))
    for i in range(files):
        dealt.where(F.col("_file") == i).drop("_file").repartition(each).write.mode("append").parquet(path)
        for _ in range((i + 1) * each - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def _closing(rows: DataFrame) -> DataFrame:
    """A row behind the others of a feed, so that the watermark passes them all."""
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).where("ts IS NOT NULL")
    return rows.unionByName(last, allowMissingColumns=True)


@register("x3_stream_gate_shuffled")
def x3_shuffled(spark: SparkSession, sf_dir: str):
    """The live gate where requests arrive up to six hours late, in six deliveries."""
    path = scratch_path(spark, "gate")
    rows = _deliver(OG.gate_rows(_sms(spark, sf_dir)), f"{path}/in", shuffled=True)
    OG.start_ordered_gate(rows, f"{path}/out", f"{path}/ck", TP.LIMIT, DELAY).awaitTermination()
    OG.close_gate(spark, f"{path}/out", TP.LIMIT)
    return _money(OG.read_gate(spark, f"{path}/out").select("event_id", "date", "accepted", "alert", "spend_before"), ["spend_before"])


@register("t10_stream_override")
def t10_live(spark, sf_dir):
    """The live gate with a stream of manual overrides, both out of order."""
    path = scratch_path(spark, "overrides")
    rows = OG.gate_rows(_sms(spark, sf_dir)).unionByName(OG.override_rows(_overrides(spark, sf_dir)))
    OG.start_ordered_gate(_deliver(rows, f"{path}/in", shuffled=True), f"{path}/out", f"{path}/ck", TP.LIMIT, DELAY).awaitTermination()
    OG.close_gate(spark, f"{path}/out", TP.LIMIT)
    g = OG.read_gate(spark, f"{path}/out").withColumn("service_enabled", F.col("accepted"))
    return _money(g.select("event_id", "date", "override", "service_enabled", "alert", "spend_before"), ["spend_before"])


@register("x7_stream_rate_limit")
def x7_live(spark, sf_dir):
    """The live rate limit, requests up to six hours late; one message a sender and hour as in the batch query."""
    path = scratch_path(spark, "rate")
    rows = _closing(TP.arrivals(spark, sf_dir).select("event_id", "ts", "sender"))
    with ST.stream_settings(spark):
        stream = ST.sender_rate_stream(_deliver(rows, f"{path}/in", shuffled=True), 1, 3600, "6 hours")
        out = SJ.run_available(stream, f"{path}/out", f"{path}/ck")
    return out.select("event_id", "sender", "recent", "throttled")


@register("x8_stream_sessions")
def x8_sessions(spark, sf_dir):
    """Live sender sessions, requests up to six hours late."""
    path = scratch_path(spark, "sessions")
    rows = _closing(TP.arrivals(spark, sf_dir).select("event_id", "ts", "sender"))
    with ST.stream_settings(spark):
        stream = ST.sender_sessions_stream(_deliver(rows, f"{path}/in", shuffled=True), min_messages=1, watermark="6 hours")
        out = SJ.run_available(stream, f"{path}/out", f"{path}/ck")
    return out.select("sender", "messages", _ts(F.col("session_start")).alias("session_start"), _ts(F.col("session_end")).alias("session_end"), "unusual")


@register("x8_stream_spikes")
def x8_spikes(spark, sf_dir):
    """Live volume spikes, requests up to six hours late."""
    path = scratch_path(spark, "spikes")
    rows = _closing(TP.arrivals(spark, sf_dir).select("event_id", "ts", "is_error"))
    with ST.stream_settings(spark):
        ST.start_volume_spikes(_deliver(rows, f"{path}/in", shuffled=True), f"{path}/out", f"{path}/ck", factor=1.5, watermark="6 hours").awaitTermination()
    s = ST.read_spikes(spark, f"{path}/out")
    return _round_all(s.withColumn("bucket_start", _ts(F.col("bucket_start"))), ["trailing_mean", "error_rate"])


@register("x1_stream_outbox_history")
def x1_two_sinks(spark, sf_dir):
    """Replies and history records that the stream committed together."""
    path = _landed(spark, sf_dir)
    DE.start_outbox(_classified(spark, path), f"{path}/out", f"{path}/ck", _SALT).awaitTermination()
    history = DE.read_history(spark, f"{path}/out").select("event_id", "date", "message_length", "from_number_hash")
    return DE.read_outbox(spark, f"{path}/out").select("event_id", "classification", r6(F.col("confidence")).alias("confidence"), "is_error", "reply").join(history, "event_id", "left")


@register("x2_stream_counters_upserted")
def x2_update(spark, sf_dir):
    """Daily counters in update mode: the table of the days' latest rows."""
    path = _landed(spark, sf_dir)
    windows = SJ.daily_counters_stream(SJ.classify_stream(_deliver(spark.read.parquet(f"{path}/in"), f"{path}/feed", shuffled=True)))
    DE.start_upsert(windows, ["date"], f"{path}/out", f"{path}/ck", fold_every=3).awaitTermination()
    return DE.read_upserted(spark, f"{path}/out", DE.ddl(windows), ["date"])


@register("x5_stream_dashboard_upserted")
def x5_update(spark, sf_dir):
    """The dashboard's minutes in update mode."""
    path = _landed(spark, sf_dir)
    windows = SJ.dashboard_feed(SJ.classify_stream(_deliver(spark.read.parquet(f"{path}/in"), f"{path}/feed", shuffled=True)))
    DE.start_upsert(windows, ["bucket_start"], f"{path}/out", f"{path}/ck", fold_every=3).awaitTermination()
    out = DE.read_upserted(spark, f"{path}/out", DE.ddl(windows), ["bucket_start"])
    return out.withColumn("bucket_start", _ts(F.col("bucket_start")))


@register("x4_stream_retraining_sets")
def x4_live(spark, sf_dir):
    """Corrections as a stream; every hundred become a retraining set over the corpus of page and event messages."""
    path = scratch_path(spark, "feedback")
    rows = (table(spark, sf_dir, "documents", "doc_id", "text").join(table(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id")
            .select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("message"), F.when(F.col("toxic") == 1, "spam").otherwise("ham").alias("true_label"),
                    F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 37).alias("timestamp")))
    feed = _deliver(rows.withColumnsRenamed({"feedback_id": "event_id", "timestamp": "ts"}), f"{path}/in", shuffled=False, files=3)
    corpus = CP.corpus(spark, sf_dir).where("source IN ('pages', 'documents')")
    DE.start_feedback_chain(feed.withColumnsRenamed({"event_id": "feedback_id", "ts": "timestamp"}), f"{path}/out", f"{path}/ck", corpus).awaitTermination()
    taken = DE.read_corrections(spark, f"{path}/out").groupBy("trigger").agg(F.count(F.lit(1)).alias("corrections"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("trigger_ts"))
    sets = DE.retraining_set_sizes(spark, f"{path}/out")
    return taken.join(sets, "trigger").select(F.col("trigger").cast("long").alias("trigger"), "corrections", _ts(F.col("first_ts")).alias("first_ts"), _ts(F.col("trigger_ts")).alias("trigger_ts"), "from_feedback", "from_corpus")
