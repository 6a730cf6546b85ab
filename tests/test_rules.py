"""Rule scorer against values computed by hand from the published weights
(the code is taken as truth where the reference's own tests disagree)."""

import pytest
from pyspark.sql import functions as F

from msgscreen.functions import text as T
from msgscreen.operators import classify as C

CASES = [
    # message, score, label, risk
    ("URGENT! Your account locked. Click bit.ly/verify NOW!", 0.308239, "ham", "low"),
    ("Congratulations! You've won $5000! Text WIN now!", 0.269, "ham", "low"),
    ("Check this out: bit.ly/suspicious123", 0.007333, "ham", "safe"),
    ("URGENT! Click bit.ly/verify to unlock your account NOW!", 0.305152, "ham", "low"),
    ("URGENT! Your bank account locked. Click http://bit.ly/verify123 NOW!", 0.621920, "smishing", "medium"),
]


def _score(spark, msgs, upgrade=False):
    df = spark.createDataFrame([(str(i), m) for i, m in enumerate(msgs)], "message_id string, text string")
    return {r["text"]: r for r in C.score(df, upgrade=upgrade).collect()}


def test_hand_computed(spark):
    got = _score(spark, [c[0] for c in CASES])
    for m, s, lab, risk in CASES:
        r = got[m]
        assert round(r["spam_score"], 6) == pytest.approx(s, abs=1e-6), m
        assert r["label"] == lab and r["risk_level"] == risk, m


def test_url_risk_of_shortener_message(spark):
    r = _score(spark, [CASES[4][0]])[CASES[4][0]]
    assert round(r["max_url_risk"], 6) == 0.368439
    assert r["url_level"] == "low"


def test_otp_gate(spark):
    m = "Your verification code is 123456. Valid for 10 minutes."
    r = _score(spark, [m])[m]
    assert r["otp"] and r["label"] == "ham" and r["confidence"] == 0.99 and r["risk_level"] == "safe"
    assert r["reasoning"] == "Legitimate OTP/2FA message"


def test_otp_needs_standalone_code(spark):
    msgs = ["é1234é verification code", "verification code ١٢٣٤٥", "verification code 123456789",
            "security code 4321, account locked"]
    got = _score(spark, msgs)
    assert not got[msgs[0]]["otp"]          # letters around the digits: no word boundary
    assert got[msgs[1]]["otp"]              # Unicode digits count
    assert not got[msgs[2]]["otp"]          # 9 digits is not a code
    assert not got[msgs[3]]["otp"]          # anti-OTP phrase


def test_substring_keyword_quirks(spark):
    # 'win' inside 'window' and 'now' inside 'know' count (distinct phrases)
    r = _score(spark, ["I know the window"])["I know the window"]
    assert r["spam_keywords"] == pytest.approx(1 / 3) and r["urgency_score"] == 0.5


def test_upgrade_only_on_sms_path(spark):
    m = "Confirm code 104567 at http://10.0.0.1/login/account?x=1&y=2&z=3"
    a = _score(spark, [m])[m]
    b = _score(spark, [m], upgrade=True)[m]
    assert a["label"] == "spam" and not a["is_smishing"]
    assert b["is_smishing"]


def test_empty_and_null_text(spark):
    df = spark.createDataFrame([("a", ""), ("b", None)], "message_id string, text string")
    rows = {r["message_id"]: r for r in C.batch_classify(df).collect()}
    assert rows["a"]["spam_type"] == "ham" and rows["a"]["error"] is None
    assert rows["b"]["error"] == "message text is null" and rows["b"]["spam_type"] is None


def test_preview(spark):
    long = "x" * 150
    df = spark.createDataFrame([("a", long)], "message_id string, text string")
    assert C.batch_classify(df).first()["message"] == "x" * 100 + "..."


FORWARDS = [
    ("Fwd: URGENT! Click here", "URGENT! Click here"),
    ("FWD: Your code is 123456", "Your code is 123456"),
    ("Forwarded: Win a prize!", "Win a prize!"),
    ("Forwarded message: Account locked", "Account locked"),
    ("> Click this link now", "Click this link now"),
    ("Regular message without prefix", "Regular message without prefix"),
    ("  fwd message:  spaced  ", "spaced"),
    ("\tFwd: x\n", "x"),
]


def test_forward_strip(spark):
    df = spark.createDataFrame([(a,) for a, _ in FORWARDS], "body string")
    got = [r[0] for r in df.select(T.strip_forward(F.col("body"))).collect()]
    assert got == [b for _, b in FORWARDS]


def test_reply_texts(spark):
    df = spark.createDataFrame([(True, True, 0.95, "high", "Urgent/pressure tactics"),
                                (True, False, 0.125, "medium", "Spam keywords present"),
                                (False, False, 0.925, "safe", "No significant spam indicators")],
                               "s boolean, sm boolean, c double, r string, why string")
    rows = df.select(T.reply_text(F.col("s"), F.col("sm"), F.col("c"), F.col("r"), F.col("why")).alias("t"),
                     T.short_reply(F.col("s"), F.col("sm"), F.col("c")).alias("short")).collect()
    assert rows[0]["t"].startswith("\U0001F6A8 SMISHING DETECTED\nConfidence: 95%\nRisk: HIGH\n\n• Urgent language\n")
    assert "DO NOT CLICK LINKS" in rows[0]["t"]
    assert rows[1]["t"].startswith("⚠️ SPAM DETECTED\nConfidence: 12%")      # half-to-even
    assert rows[1]["t"].endswith("Recommend: Delete message")
    assert rows[2]["t"] == "✅ SAFE (92% confidence)\n\nThis message appears legitimate."
    assert all(len(r["short"]) < 160 for r in rows)


def test_reply_url_warnings_cap_at_four(spark):
    df = spark.createDataFrame([(True, True, 0.9, "high", "Urgent/pressure tactics, prize winner")],
                               "s boolean, sm boolean, c double, r string, why string")
    t = df.select(T.reply_text(F.col("s"), F.col("sm"), F.col("c"), F.col("r"), F.col("why"),
                               url_has=F.lit(True), url_shortener=F.lit(True), url_suspicious=F.lit(True),
                               url_risk=F.lit(0.8)).alias("t")).first()["t"]
    warns = [line for line in t.split("\n") if line.startswith("•")]
    assert warns == ["• URL shortener detected", "• Suspicious link found", "• High-risk URL", "• Urgent language"]


def test_null_texts_have_no_score(spark):
    df = spark.createDataFrame([("a", None), ("b", "FREE prize! Click now http://bit.ly/x")], "message_id string, text string")
    r = {x["message_id"]: x for x in C.score(df).collect()}
    assert all(r["a"][k] is None for k in ("caps_ratio", "spam_score", "label", "confidence", "risk_level", "reasoning", "is_spam", "is_smishing", "otp"))
    assert r["b"]["label"] is not None
    assert C.label_rollup(C.score(df)).filter("label IS NULL").count() == 0
    assert C.batch_classify(df).filter("message_id = 'a' AND error IS NOT NULL").count() == 1


def test_phrases_are_searched_in_groups(spark):
    """One search tells that a text holds none of a group; the counts are those of single searches, null texts stay null."""
    from msgscreen import dictionaries as D
    lists = [D.SPAM_KEYWORDS, D.SMISHING_KEYWORDS, D.LEGITIMATE_PATTERNS, D.URGENCY_WORDS, D.MONEY_TOKENS, D.OTP_PHRASES, D.ANTI_OTP_PHRASES]
    for phrases in lists:
        groups = T.probes(phrases)
        assert sorted(p for _, g in groups for p in g) == sorted(phrases) and all(probe in p for probe, g in groups for p in g)
    assert sum(len(T.probes(x)) for x in lists) < 0.85 * sum(map(len, lists))
    every = [p for x in lists for p in x]
    texts = [*every, *[p[1:] for p in every], *[f"{a} {b}" for a, b in zip(every, every[7:], strict=False)], " ".join(every), "", None]
    low = F.col("low")
    rows = spark.createDataFrame([(t,) for t in texts], "low string").select("low", *[c.alias(f"{k}{i}") for i, x in enumerate(lists) for k, c in (("n", T._hits(low, x)), ("any", T._any(low, x)))]).collect()
    for r in rows:
        for i, x in enumerate(lists):
            want = None if r.low is None else sum(p in r.low for p in x)
            assert r[f"n{i}"] == want and r[f"any{i}"] == (None if want is None else want > 0)
