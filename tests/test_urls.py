"""URL features: hand cases, edge cases and a property test against an
independent Python model built on the same URL parser semantics."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from msgscreen.functions import urls as U
from msgscreen.operators import classify as C
from msgscreen.operators import urls as UO

from . import pychecker as P


def _feats(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select("url", U.url_features(F.col("url")).alias("f")).collect()
    return {r["url"]: r["f"].asDict() for r in rows}


HAND = ["http://bit.ly/abc", "http://secure-login.xyz/verify", "https://www.paypal.com/signin",
        "http://192.168.1.1/login", "https://www.google.com", "http://microsoft.com",
        "http://[bad/x", "http://[::1]:80/x", "http://[1.2.3.4]/x", "http://[v1.x]/a",
        "http://example.com:8080/a;b/c;params?q=1", "http://a.b.c.d.e.f/x/y/z/w/v/u",
        "http://groups.com/", "https://ups.com.evil.top"]


def test_hand_cases_match_python_model(spark):
    got = _feats(spark, HAND)
    for u in HAND:
        exp = P.url_features(u)
        for k, v in exp.items():
            assert got[u][k] == pytest.approx(v, abs=1e-9), (u, k)


def test_documented_quirks(spark):
    got = _feats(spark, ["http://microsoft.com", "http://groups.com/", "http://[bad/x"])
    assert got["http://microsoft.com"]["is_shortener"] == 1.0          # t.co inside microsoft.com
    assert got["http://microsoft.com"]["is_legitimate_domain"] == 1.0
    assert got["http://groups.com/"]["is_legitimate_domain"] == 1.0     # ups.com inside groups.com
    assert got["http://[bad/x"]["url_risk_score"] == 0.5                # unparseable -> defaults


def test_extraction_rules(spark):
    df = spark.createDataFrame([("see HTTP://x.com and http://a.com/b#frag, http://c.com/d.",)], "t string")
    urls = df.select(U.extract_urls(F.col("t"))).first()[0]
    assert urls == ["http://a.com/b", "http://c.com/d."]                # scheme is case-sensitive


URLISH = st.text(alphabet="abcxyz0123456789.-/:?=&%@[];_~#", min_size=0, max_size=30)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http://", "https://"]), URLISH), min_size=1, max_size=8))
def test_property_url_features(spark, parts):
    urls = [a + b for a, b in parts]
    urls = [m for u in urls for m in P.URL_RX.findall(u)]
    if not urls:
        return
    got = _feats(spark, urls)
    for u in urls:
        exp = P.url_features(u)
        for k, v in exp.items():
            assert got[u][k] == pytest.approx(v, abs=1e-9), (u, k)


TEXTISH = st.text(alphabet=st.characters(codec="utf-8", categories=["Lu", "Ll", "Nd", "Zs", "Po", "Sc"],
                                         max_codepoint=0x24F), max_size=60)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(TEXTISH, st.sampled_from(["", " http://bit.ly/x", " https://a.top/p?q=1", " FREE win now"])),
                min_size=1, max_size=6))
def test_property_score(spark, parts):
    msgs = [a + b for a, b in parts]
    df = spark.createDataFrame([(str(i), m) for i, m in enumerate(msgs)], "message_id string, text string")
    got = {r["message_id"]: r["spam_score"] for r in C.score(df).select("message_id", "spam_score").collect()}
    for i, m in enumerate(msgs):
        assert got[str(i)] == pytest.approx(P.score(m), abs=1e-9), m


def test_inrow_equals_exploded(spark):
    from msgscreen.plans.message_view import message_view
    from tests.conftest import SF0001
    mv = message_view(spark, SF0001)
    cols = ["has_urls", "num_urls", "max_url_risk", "avg_url_risk", "has_shortener", "has_suspicious_tld",
            "has_ip_url", "has_legitimate_domain", "all_https", "max_domain_entropy", "has_suspicious_url_keywords"]
    a = C.with_url_rollup(mv).select("message_id", *[F.round(c, 9).alias(c) for c in cols])
    b = UO.message_url_rollup(mv, UO.url_feature_rows(UO.url_rows(mv))).select(
        "message_id", *[F.round(c, 9).alias(c) for c in cols])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
