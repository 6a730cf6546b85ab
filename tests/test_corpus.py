"""Corpus preparation: label policies, priority dedup, exact split, readers."""

from pyspark.sql import functions as F

from msgscreen.operators import corpus as CO
from msgscreen.plans import corpus_plan as CP
from msgscreen.sources import delimited as DL

from .conftest import SF0001


def test_unify_policies(spark):
    df = spark.createDataFrame([("Smishing",), ("SPAM",), ("ham",), ("phishing",), ("other",)], "label string")
    for policy, other in [("ham", "ham"), ("null", None), ("keep", "other")]:
        rows = {r["original_label"]: r for r in CO.unify_labels(df, unknown=policy).collect()}
        assert rows["smishing"]["label"] == "spam" and rows["smishing"]["is_smishing"]
        assert rows["phishing"]["is_smishing"] and rows["spam"]["label"] == "spam"
        assert rows["other"]["label"] == other


def test_normalise_filters(spark):
    df = spark.createDataFrame([("HAM",), ("Spam",), ("junk",), (None,)], "label string")
    assert sorted(r[0] for r in CO.normalise_labels(df).collect()) == ["ham", "spam"]


def test_priority_dedup_high_wins(spark):
    df = spark.createDataFrame([
        ("b", "same text", "ham", "low", 0), ("a", "same text", "spam", "high", 1),
        ("c", "same text", "ham", "medium", 0), ("d", "other", "ham", "low", 2)],
        "message_id string, message string, label string, quality string, source_rank int")
    rows = {r["message"]: r for r in CO.priority_dedup(df).collect()}
    assert rows["same text"]["message_id"] == "a" and rows["same text"]["label"] == "spam"
    assert len(rows) == 2


def test_split_exact_sizes_and_no_leaks(spark):
    s = CP.split_corpus(spark, SF0001)
    counts = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab in ("ham", "spam"):
        n = sum(v for (l_, _), v in counts.items() if l_ == lab)
        tr, va = counts.get((lab, "train"), 0), counts.get((lab, "val"), 0)
        assert tr == (70 * n) // 100 and tr + va == (85 * n) // 100
    assert CO.split_leaks(s).count() == 0
    assert s.select("message").distinct().count() == s.count()


def test_split_matches_single_window(spark):
    """The bucketed rank equals a plain per-label row_number."""
    from pyspark.sql import Window
    c = CP.corpus(spark, SF0001)
    a = CO.stratified_split(c, prefix=1).select("message_id", "split")
    w = Window.partitionBy("label").orderBy(CO.split_hash(), "message_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    r = F.row_number().over(w)
    b = c.select("message_id", F.when(r * 100 <= n * 70, "train").when(r * 100 <= n * 85, "val")
                 .otherwise("test").alias("split"))
    assert a.exceptAll(b).count() == 0


def test_delimited_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ham\thello there\nspam\tWIN cash now\n")
    (tmp_path / "b.csv").write_text("v1,v2,x\nham,hi,1\nspam,\"free, money\",2\n")
    (tmp_path / "c.csv").write_text("id,SMS Category,Message Text\n1,spam,buy now\n")
    (tmp_path / "d.csv").write_text("id,foo\n1,bar\n")
    a = DL.read_delimited(spark, str(tmp_path / "a.tsv"), sep="\t", header=False).collect()
    assert [tuple(r) for r in a] == [("ham", "hello there"), ("spam", "WIN cash now")]
    b = DL.read_delimited(spark, str(tmp_path / "b.csv")).collect()
    assert [tuple(r) for r in b] == [("ham", "hi"), ("spam", "free, money")]
    c = DL.read_delimited(spark, str(tmp_path / "c.csv")).collect()
    assert [tuple(r) for r in c] == [("spam", "buy now")]
    assert DL.read_delimited(spark, str(tmp_path / "d.csv")).count() == 0
    assert DL.detect_roles(["class_a", "label", "text", "sms_body"]) == ("label", "sms_body")


def test_a2p_generator(spark):
    """Per index the messages of the nested loops over templates (and services)."""
    idx = spark.range(6).withColumnRenamed("id", "i")
    rows = [r for r in CO.a2p_messages(idx).collect() if r["i"] == 4]
    got = {k: {r["message"] for r in rows if r["a2p_type"] == k} for k in ("2fa", "transactional", "marketing", "alerts")}
    assert len(rows) == 39
    assert got["2fa"] == {t.format(service=s, code="100052") for t in CO.OTP_TEMPLATES for s in CO.OTP_SERVICES}
    assert got["transactional"] == {"Your Target order #10004 has shipped", "Payment of $14.00 to John successful",
                                    "Target: Appointment confirmed for Monday"}
    assert got["marketing"] == {"Macy's: 20% off! Shop now. Reply STOP to unsubscribe", "Macy's Rewards: You have 140 points!",
                                "Weekend Sale at Macy's: Up to 20% off"}
    assert got["alerts"] == {"Appointment reminder: Dentist tomorrow at 2pm", "Weather Alert: Rain expected tonight",
                             "Dentist bill due: $50 due by Friday"}


def test_threat_generator(spark):
    idx = spark.range(6).withColumnRenamed("id", "i")
    rows = [r for r in CO.threat_messages(idx).collect() if r["i"] == 5]
    got = {k: {r["message"] for r in rows if (r["label"], r["is_smishing"]) == k} for k in (("spam", False), ("spam", True), ("ham", False))}
    assert [len(x) for x in got.values()] == [10, 10, 10]
    assert "Congratulations ur awarded iPhone 15! Collect from www.claim-prize5.com" in got["spam", False]
    assert "Text WIN to 80005 for your FREE gift worth £500" in got["spam", False]
    assert "Your payment to Mike Johnson failed. Retry: secure-verify5.xyz/login" in got["spam", True]
    assert "Reminder: doctor on Tuesday at tomorrow" in got["ham", False]
    assert "Can you pick up milk, bread from home?" in got["ham", False]
