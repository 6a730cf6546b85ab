"""Evaluation, ensembles and routing on small hand-built tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.operators import evaluate as EV
from msgscreen.operators import models as MO


def _preds(spark):
    rows = [("1", "m", "spam", 0.9, 1.0, None), ("2", "m", "smishing", 0.8, 2.0, None),
            ("3", "m", "ham", 0.7, 3.0, None), ("4", "m", "spam", 0.6, 10.0, None),
            ("1", "n", "ham", 0.5, 0.0, "boom"), ("2", "n", "ham", 0.9, 5.0, None),
            ("3", "n", "ham", 0.9, 5.0, None), ("4", "n", "ham", 0.9, 5.0, None)]
    p = spark.createDataFrame(rows, "message_id string, model string, label string, confidence double, "
                                    "latency_ms double, error string")
    t = spark.createDataFrame([("1", "spam", None, True), ("2", "spam", None, False), ("3", "ham", "2fa", False),
                               ("4", "ham", "marketing", False)],
                              "message_id string, label string, a2p_type string, is_smishing boolean")
    return p, t


def test_metrics(spark):
    p, t = _preds(spark)
    m = {r["model"]: r for r in EV.model_metrics(EV.align(p, t)).collect()}
    r = m["m"]
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 0)
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == 1.0
    assert r["f1_score"] == pytest.approx(0.8) and r["a2p_fpr"] == 0.5
    assert r["latency_p95"] == pytest.approx(np.percentile([1.0, 2.0, 3.0, 10.0], 95))
    n = m["n"]
    assert n["precision"] == 0.0 and n["f1_score"] == 0.0 and n["a2p_fpr"] == 0.0   # zero division -> 0
    assert n["meets_a2p_fpr"] and not n["meets_f1"]


def test_selection_and_candidates(spark):
    p, t = _preds(spark)
    m = EV.model_metrics(EV.align(p, t))
    s = EV.select_model(m).first()
    assert s["recommended"] is None and s["best_f1_model"] == "m"
    c = EV.ensemble_candidates(m, 0.5).collect()
    assert [r["model"] for r in c] == ["m"] and not c[0]["built"]


def test_voting_and_weighted(spark):
    p, _ = _preds(spark)
    v = {r["message_id"]: r for r in MO.voting(p).collect()}
    assert v["1"]["label"] == "ham" and v["1"]["confidence"] == 0.5       # tie -> ham
    w = spark.createDataFrame([("m", 3.0), ("n", 1.0)], "model string, weight double")
    x = {r["message_id"]: r for r in MO.weighted(p, w).collect()}
    assert x["1"]["label"] == "spam" and x["1"]["confidence"] == pytest.approx(0.675)


def test_router_scores_only_unsure(spark):
    fast = spark.createDataFrame([("1", "ham", 0.95), ("2", "spam", 0.6)], "message_id string, label string, confidence double")
    seen = []

    def slow(df):
        seen.append(df)
        return df.select("message_id", F.lit("spam").alias("label"), F.lit(0.99).alias("confidence"))
    r = {x["message_id"]: x for x in MO.route(fast, slow, 0.85).collect()}
    assert r["1"]["routed_to"] == "fast_model" and r["2"]["routed_to"] == "slow_model"
    assert [x["message_id"] for x in seen[0].collect()] == ["2"]
    st = MO.routing_stats(MO.route(fast, slow, 0.85)).first()
    assert (st["fast_count"], st["slow_count"], st["fast_percentage"]) == (1, 1, 50.0)


def test_python_model_scoring(spark):
    df = spark.createDataFrame([("1", "FREE stuff"), ("2", "hello"), ("3", "boom")], "message_id string, text string")

    def make():
        def score(texts):
            if "boom" in texts:
                raise ValueError("bad row")
            return [("spam", 0.8) if "free" in t.lower() else ("ham", 0.6) for t in texts]
        return score
    rows = {r["message_id"]: r for r in MO.score_with(df, make, "kw").collect()}
    assert rows["1"]["label"] == "spam" and rows["2"]["label"] == "ham"
    assert rows["3"]["error"] == "bad row" and rows["3"]["label"] == "ham" and rows["3"]["confidence"] == 0.5
