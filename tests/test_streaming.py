"""Stream vs batch parity (file source + availableNow trigger)."""

import tempfile

from pyspark.sql import functions as F

from msgscreen.operators import traffic as TR
from msgscreen.plans import traffic_plan as TP
from msgscreen.streaming import jobs as SJ

from .conftest import SF0001


def _write_inbound(spark):
    d = tempfile.mkdtemp(prefix="msgscreen-stream-")
    t = TP.inbound(spark, SF0001).select(
        "event_id", "ts", "sender", "body", "event_type", "latency_ms",
        F.col("event_id").cast("string").alias("message_sid"))
    # several files landing in ts order, as a live feed would write them
    for lo in range(1, 32, 6):
        (t.filter((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < lo + 6)).coalesce(1)
          .sortWithinPartitions("ts").write.mode("append").parquet(d + "/in"))
    return d


def _run(df, d, name, mode="append"):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", d + "/ck-" + name).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_parity(spark):
    d = _write_inbound(spark)
    src = SJ.inbound_stream(spark, d + "/in", max_files=2)
    scored = _run(SJ.classify_stream(src), d, "x1_out")
    batch = TP.scored_traffic(spark, SF0001)
    a = scored.select("event_id", "classification", "is_smishing")
    ok = ~F.col("is_error")
    b = batch.select("event_id", F.when(ok, F.col("label")).alias("classification"), F.when(ok, F.col("is_smishing")).alias("is_smishing"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0

    counters = _run(SJ.daily_counters_stream(SJ.classify_stream(SJ.inbound_stream(spark, d + "/in"))), d,
                    "x2_out", mode="complete")
    hist = TR.privacy_projection(batch.filter(~F.col("is_error")), "salt")
    exp = TR.daily_counters(hist).drop("spam_rate", "smishing_rate")
    assert counters.exceptAll(exp.select(*counters.columns)).count() == 0

    # several micro-batches, each from its predecessor's state
    SJ.start_spend_gate(SJ.inbound_stream(spark, d + "/in", max_files=2), d + "/x3", d + "/ck-x3", limit="0.20").awaitTermination()
    gate = SJ.read_gate(spark, d + "/x3")
    bg = TR.accept(TP.inbound(spark, SF0001), limit="0.20").select("event_id", "accepted", "alert")
    assert bg.filter("NOT accepted").count() > 0
    assert gate.select("event_id", "accepted", "alert").exceptAll(bg).count() == 0
    assert gate.count() == bg.count()


def test_trigger_stream(spark):
    d = _write_inbound(spark)
    fb = spark.range(250).select(F.col("id").cast("string").alias("message"))
    fb.write.mode("overwrite").json(d + "/fb")
    src = spark.readStream.schema("message string").json(d + "/fb")
    trig = _run(SJ.feedback_trigger_stream(src), d, "x4_out", mode="complete").first()
    assert trig["feedback_count"] == 250 and trig["retrains_triggered"] == 2


def test_dashboard_and_metrics_streams(spark):
    d = _write_inbound(spark)
    scored = SJ.classify_stream(SJ.inbound_stream(spark, d + "/in"))
    feed = _run(SJ.dashboard_feed(scored, "1 hour"), d, "x5_out")
    batch = TP.scored_traffic(spark, SF0001).filter(~F.col("is_error"))
    spam = F.col("label").isin("spam", "smishing") | F.col("is_smishing")
    exp = batch.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(spam).alias("spam"), F.count_if(~spam).alias("ham")) \
        .select(F.col("w.start").alias("bucket_start"), "total", "spam", "ham")
    # append mode emits a bucket once the watermark (1 day) has passed it
    got = feed.collect()
    assert len(got) > 0 and feed.exceptAll(exp).count() == 0

    m = _run(SJ.traffic_metrics_stream(SJ.classify_stream(SJ.inbound_stream(spark, d + "/in")), "1 hour"),
             d, "x6_out")
    cnt = {r["window_start"]: (r["requests"], r["ham"] + r["spam"] + r["smishing"]) for r in m.collect()}
    ref = {r["bucket_start"]: r["total"] for r in exp.collect()}
    assert cnt and all(ref.get(k, 0) == v[1] and v[0] >= v[1] for k, v in cnt.items())


def test_missing_ids_and_bodies(spark, tmp_path):
    """Requests without a message id are not copies of one another; without a body they are errors."""
    rows = [(i, f"2024-01-01 00:00:0{i}", "+1", None if i == 4 else f"hello {i}", "signup", 1.0, None if i < 5 else "SM1") for i in range(6)]
    df = spark.createDataFrame(rows + [rows[5]], "event_id long, ts string, sender string, body string, event_type string, latency_ms double, message_sid string")
    df.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    out = {r["event_id"]: r for r in SJ.run_available(SJ.classify_stream(SJ.inbound_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck").collect()}
    assert len(out) == 6 and out[4]["classification"] is None and out[4]["is_error"] and "Error" in out[4]["reply"]
    assert out[3]["classification"] == "ham"
