"""Monitoring (D1–D4; documented in the reference, no code there).

D1 drift is the population stability index over fixed bins of each feature
between a baseline and a current period: histogram counts are a grouped
aggregate (partial, map-side), the two histograms meet in a full outer join
on a table of at most features x bins rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D

EPS = 1e-6


def unpivot(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long form (``feature``, ``value``) via ``stack``."""
    pairs = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    return df.selectExpr(*ids, f"stack({len(features)}, {pairs}) AS (feature, value)")


def feature_drift(long: DataFrame, period_col: str = "period", bins: int = 10,
                  baseline: str = "baseline", current: str = "current") -> DataFrame:
    """PSI per feature = sum over bins (q - p) * ln(q / p), shares floored
    at 1e-6; values in [0, 1] fall in ``bins`` equal bins (1.0 in the last).
    Both periods are counted in one pass over the rows."""
    b = long.filter("value IS NOT NULL").withColumn("bin", F.least(F.floor(F.col("value") * bins), F.lit(bins - 1)).cast("int"))
    h = b.groupBy("feature", "bin").agg(F.count_if(F.col(period_col) == baseline).alias("p"),
                                        F.count_if(F.col(period_col) == current).alias("q")).filter("p + q > 0")
    tot = Window.partitionBy("feature")

    def share(c):
        return F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(tot)), F.lit(0.0)), F.lit(EPS))

    h = h.withColumn("pp", share("p")).withColumn("qq", share("q"))
    pp, qq = F.col("pp"), F.col("qq")
    return (h.groupBy("feature").agg(F.sum((qq - pp) * F.log(qq / pp)).alias("psi"))
             .withColumn("drift_alert", F.col("psi") > D.DRIFT_ALERT))


def prediction_drift(history: DataFrame) -> DataFrame:
    """Daily spam share against the share over the whole history."""
    spam = F.col("classification").isin("spam", "smishing")
    d = history.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if(spam).alias("spam"))
    allw = Window.partitionBy()
    return (d.withColumn("spam_share", F.col("spam") / F.col("n"))
             .withColumn("baseline_share", F.sum("spam").over(allw) / F.sum("n").over(allw))
             .withColumn("share_delta", F.col("spam_share") - F.col("baseline_share")))


def performance_drift(feedback: DataFrame, period: str = "date") -> DataFrame:
    """D3: accuracy of predictions against feedback per period and its change
    from the previous period (``lag`` over the small per-period table)."""
    ok = F.col("predicted_label") == F.col("true_label")
    g = feedback.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"))
    w = Window.orderBy(period)
    return (g.withColumn("accuracy", F.col("correct") / F.col("n"))
             .withColumn("accuracy_change", F.col("accuracy") - F.lag("accuracy").over(w)))


def alert_rules(metrics: DataFrame, rules: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Unpivot metric columns and keep the breaches of a (small,
    broadcast) rule table ``metric, op ('>' or '<'), threshold``."""
    long = unpivot(metrics, ids, features).withColumnRenamed("feature", "metric")
    j = long.join(rules, "metric")
    breach = (F.when(F.col("op") == ">", F.col("value") > F.col("threshold"))
              .otherwise(F.col("value") < F.col("threshold")))
    return j.filter(breach)


def default_rules(spark) -> DataFrame:
    """The documented alert thresholds: A2P FPR > 1 %, p95 > 50 ms,
    drift > 0.3, error rate > 1 %."""
    return spark.createDataFrame(
        [("a2p_fpr", ">", D.TARGET_A2P_FPR), ("latency_p95", ">", D.TARGET_P95_MS),
         ("psi", ">", D.DRIFT_ALERT), ("error_rate", ">", D.ERROR_RATE_ALERT)],
        "metric string, op string, threshold double")
