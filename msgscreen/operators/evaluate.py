"""Model evaluation over a long predictions table.

Predictions: ``message_id, model, label, confidence, latency_ms, error``.
Truth: ``message_id, label, a2p_type, is_smishing`` (+ ``split``).
Everything is one equi-join (E11) and grouped aggregates with partial
aggregation; percentiles use Spark's exact ``percentile``, whose buffer is a
value -> count map (bounded by distinct latency values, not by rows) and is
merged map-side; ``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D


def fold(c):
    """Binary view: smishing counts as spam."""
    return F.when(c.isin("spam", "smishing"), F.lit("spam")).otherwise(c)


def align(preds: DataFrame, truth: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Equi-join predictions to truth on the message id (never by position)."""
    t = truth.select(id_col, F.col("label").alias("true_label"), "a2p_type", "is_smishing")
    p = preds.select(id_col, "model", fold(F.col("label")).alias("pred"), "confidence", "latency_ms", "error")
    return p.join(t, id_col)


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(approx: bool = False) -> list:
    pred, true = F.col("pred"), F.col("true_label")
    tp = F.count_if((true == "spam") & (pred == "spam"))
    fp = F.count_if((true == "ham") & (pred == "spam"))
    tn = F.count_if((true == "ham") & (pred == "ham"))
    fn = F.count_if((true == "spam") & (pred == "ham"))
    a2p = F.col("a2p_type").isNotNull()
    n_a2p = F.count_if(a2p)
    a2p_fp = F.count_if(a2p & (true == "ham") & (pred == "spam"))
    lat = F.col("latency_ms")
    pct = (F.percentile_approx(lat, [0.5, 0.95, 0.99], 10000) if approx
           else F.percentile(lat, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))))
    return [
        F.count(F.lit(1)).alias("n"),
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        _div(F.count_if(pred == true), F.count(F.lit(1))).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _div(fp, fp + tn).alias("fpr"),
        F.when(n_a2p > 0, _div(a2p_fp, n_a2p)).alias("a2p_fpr"),
        F.avg(lat).alias("latency_avg"),
        pct.alias("_pct"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    df = (df.withColumn("latency_p50", F.col("_pct")[0]).withColumn("latency_p95", F.col("_pct")[1])
            .withColumn("latency_p99", F.col("_pct")[2]).drop("_pct"))
    return (df.withColumn("meets_f1", F.col("f1_score") >= D.TARGET_F1)
              .withColumn("meets_a2p_fpr", F.coalesce(F.col("a2p_fpr") < D.TARGET_A2P_FPR, F.lit(True)))
              .withColumn("meets_latency", F.col("latency_p95") < D.TARGET_P95_MS)
              .withColumn("meets_all", F.col("meets_f1") & F.col("meets_a2p_fpr") & F.col("meets_latency")))


def model_metrics(aligned: DataFrame, approx: bool = False) -> DataFrame:
    """Per model accuracy, precision, recall, F1 (positive = spam,
    0 on zero division), confusion counts, FPR, A2P FPR (null without A2P
    rows), latency mean/p50/p95/p99 and the target flags."""
    return _finish(aligned.groupBy("model").agg(*metric_columns(approx)))


def confusion(aligned: DataFrame) -> DataFrame:
    """Confusion counts per model x true label x predicted label
    (pivot over the fixed class list; other labels dropped)."""
    return (aligned.filter(F.col("true_label").isin("ham", "spam"))
            .groupBy("model", "true_label").pivot("pred", ["ham", "spam"]).count()
            .na.fill(0, ["ham", "spam"])
            .withColumnsRenamed({"ham": "pred_ham", "spam": "pred_spam"}))


def a2p_breakdown(aligned: DataFrame) -> DataFrame:
    """A2P false-positive rate per model and per A2P type, with a
    per-model subtotal (rollup)."""
    a = aligned.filter(F.col("a2p_type").isNotNull())
    fp = F.count_if((F.col("true_label") == "ham") & (F.col("pred") == "spam"))
    return a.rollup("model", "a2p_type").agg(
        F.count(F.lit(1)).alias("n"), fp.alias("a2p_fp"),
        _div(fp, F.count(F.lit(1))).alias("a2p_fpr")).filter(F.col("model").isNotNull())


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by F1 descending (name breaks ties) with rank."""
    w = Window.orderBy(F.desc("f1_score"), F.asc("model"))
    return metrics.select("model", "f1_score", "a2p_fpr", "latency_p95", "meets_all",
                          F.row_number().over(w).alias("rank"))


def select_model(metrics: DataFrame) -> DataFrame:
    """recommended = best F1 among models meeting all targets (null if
    none); ``best_f1_model`` is shown either way. Ties: by name."""
    key = F.struct((-F.col("f1_score")).alias("k"), F.col("model").alias("model"))
    return metrics.agg(
        F.min(F.when(F.col("meets_all"), key)).alias("_rec"),
        F.min(key).alias("_best"),
    ).select(F.col("_rec.model").alias("recommended"), F.col("_best.model").alias("best_f1_model"))


def ensemble_candidates(metrics: DataFrame, min_f1: float = D.ENSEMBLE_MIN_F1) -> DataFrame:
    """Models with F1 >= min_f1, weight = F1 normalised over candidates;
    ``built`` says whether there are at least two."""
    c = metrics.filter(F.col("f1_score") >= min_f1).select("model", "f1_score")
    w = Window.partitionBy()
    return (c.withColumn("weight", F.col("f1_score") / F.sum("f1_score").over(w))
             .withColumn("built", F.count(F.lit(1)).over(w) >= 2))


def subset_metrics(aligned: DataFrame) -> DataFrame:
    """Metrics for all rows, A2P rows and smishing rows in one pass
    (rows are tagged with their subsets and exploded, not scanned 3 times)."""
    tags = F.array_compact(F.array(F.lit("all"),
                                   F.when(F.col("a2p_type").isNotNull(), F.lit("a2p")),
                                   F.when(F.col("is_smishing"), F.lit("smishing"))))
    x = aligned.withColumn("subset", F.explode(tags))
    pred, true = F.col("pred"), F.col("true_label")
    tp = F.count_if((true == "spam") & (pred == "spam"))
    fp = F.count_if((true == "ham") & (pred == "spam"))
    fn = F.count_if((true == "spam") & (pred == "ham"))
    return x.groupBy("model", "subset").agg(
        F.count(F.lit(1)).alias("n"),
        _div(F.count_if(pred == true), F.count(F.lit(1))).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def feedback_agreement(feedback: DataFrame) -> DataFrame:
    """Corrections by predicted x true label, with the feedback type."""
    p, t = fold(F.col("predicted_label")), F.col("true_label")
    kind = (F.when((p == "spam") & (t == "ham"), F.lit("false_positive"))
            .when((p == "ham") & (t == "spam"), F.lit("false_negative")).otherwise(F.lit("correct")))
    return feedback.groupBy(p.alias("predicted_label"), t.alias("true_label"), kind.alias("feedback_type")) \
        .agg(F.count(F.lit(1)).alias("n"))
