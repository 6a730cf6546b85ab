"""Rule scoring of message tables (U12 in-row form, U14, H1–H8, H11).

The whole scorer is a *narrow* transformation: URL features are computed
in-row over each message's URL array (``transform``/``exists``/``forall``),
so scoring a table never shuffles and scales linearly with partitions.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U


def _f(x):
    return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))


def _url_columns(text):
    """Level 1: the URL array (only texts containing 'http' run the regex)."""
    return F.when(text.contains("http"), U.extract_urls(text)).otherwise(F.array().cast("array<string>"))


def _url_feats_column():
    """Level 2: per-URL feature structs (higher-order functions only for rows with URLs)."""
    return F.when(F.size("urls") > 0, F.transform(F.transform("urls", U.url_parts), U.features_of_parts))


def _rollup_columns() -> dict:
    """Level 3: the 11 per-message URL rollup columns (U12, in-row form)."""
    feats = F.col("url_feats")
    n = F.size("urls")
    has = n > 0

    def mx(field):
        return F.array_max(F.transform(feats, lambda f: f[field]))

    def anyf(field):
        return _f(F.exists(feats, lambda f: f[field] != 0))

    risk_sum = F.aggregate(feats, F.lit(0.0), lambda acc, f: acc + f["url_risk_score"])
    cols = {
        "has_urls": _f(has),
        "num_urls": F.least(n / F.lit(3.0), F.lit(1.0)),
        "max_url_risk": mx("url_risk_score"),
        "avg_url_risk": risk_sum / n,
        "has_shortener": anyf("is_shortener"),
        "has_suspicious_tld": anyf("suspicious_tld"),
        "has_ip_url": anyf("is_ip_address"),
        "has_legitimate_domain": anyf("is_legitimate_domain"),
        "all_https": _f(F.forall(feats, lambda f: f["has_https"] != 0)),
        "max_domain_entropy": mx("domain_entropy"),
        "has_suspicious_url_keywords": anyf("has_suspicious_keywords"),
    }
    return {k: (F.when(has, v).otherwise(F.lit(0.0)) if k not in ("has_urls", "num_urls") else v)
            for k, v in cols.items()}


def _analysis_columns() -> dict:
    """Level 4 (needs the rollup): per-URL details, URL level, max risk."""
    has = F.size("urls") > 0
    details = F.transform(
        F.arrays_zip(F.col("urls").alias("url"), F.col("url_feats").alias("f")),
        lambda z: F.struct(z["url"].alias("url"),
                           z["f"]["url_risk_score"].alias("risk_score"),
                           U.indicators(z["f"]).alias("indicators")))
    return {"url_details": F.when(has, details),
            "url_level": U.risk_level(F.col("max_url_risk"), has),
            "max_risk_score": F.when(has, F.col("max_url_risk"))}


def _indicator_column():
    """Level 5: distinct, sorted indicator strings (empty without URLs)."""
    has = F.size("urls") > 0
    return (F.when(has, F.array_sort(F.array_distinct(F.flatten(
        F.transform("url_details", lambda d: d["indicators"])))))
            .otherwise(F.array().cast("array<string>")))


# Features are flat columns, not structs: Catalyst inlines struct-field
# extracts when it collapses projections, which would re-evaluate a feature at
# every use; a flat non-trivial column referenced several times is kept in its
# own projection and computed once. Columns are added in dependency levels (one
# ``withColumns`` per level) to keep plan analysis cheap.


def with_url_rollup(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``urls``, ``url_feats`` and the 11 rollup columns (U12, in-row)."""
    df = df.withColumn("urls", _url_columns(F.col(text_col)))
    df = df.withColumn("url_feats", _url_feats_column())
    return df.withColumns(_rollup_columns())


def with_url_analysis(df: DataFrame) -> DataFrame:
    """U13–U14 on top of :func:`with_url_rollup`: per-URL details, distinct
    sorted indicators, max risk (null without URLs) and the URL risk level."""
    df = df.withColumns(_analysis_columns())
    return df.withColumn("suspicious_indicators", _indicator_column())


@functools.lru_cache(maxsize=16)
def _score_levels(text_col: str, upgrade: bool) -> tuple:
    """The scorer's columns, one dict per dependency level. Column objects are
    immutable, unresolved expressions, so they are built once per (text
    column, upgrade) and reused: building them costs ~1 s of py4j calls."""
    text, col = F.col(text_col), F.col
    otp, s, ok = col("otp"), col("spam_score"), text.isNotNull()

    def given(columns):
        """Null in, null out: ``least`` and ``greatest`` would skip nulls."""
        return {k: F.when(ok, v) for k, v in columns.items()}

    return (
        {"urls": _url_columns(text), "_low": F.lower(text)},
        {"url_feats": _url_feats_column()},
        _rollup_columns(),
        {**_analysis_columns(), **given(T.text_feature_columns(text, col("_low")))},
        {"suspicious_indicators": _indicator_column(),
         **given({"otp": T.otp_gate(text, col("url_level"), col("_low")), "spam_score": T.spam_score(col, col)})},
        given({"label": T.label(s, col, col, otp), "confidence": T.confidence(s, otp),
               "risk_level": T.risk_level(s, otp), "reasoning": T.reasoning(col, col, otp)}),
        given({"is_spam": col("label").isin("spam", "smishing"),
               "is_smishing": T.is_smishing(col("label"), col, col("url_level"), upgrade)}),
    )


def score(df: DataFrame, text_col: str = "text", upgrade: bool = False) -> DataFrame:
    """H1–H7 (a null text has null results): add the URL columns, the 10 text-feature columns, ``otp``,
    ``spam_score``, ``label``, ``confidence``, ``risk_level``, ``reasoning``,
    ``is_spam`` and ``is_smishing`` (with the H7 upgrade if ``upgrade``)."""
    for level in _score_levels(text_col, upgrade):
        df = df.withColumns(level)
    return df


def preview(text_col: str = "text", n: int = 100):
    t = F.col(text_col)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def batch_classify(messages: DataFrame, text_col: str = "text", id_col: str = "message_id") -> DataFrame:
    """H8: score every message; one output row per input row.

    A row whose text is null gets an ``error`` instead of failing the batch
    (the per-row try/except of the reference becomes a null-safe column).
    """
    scored = score(messages, text_col, upgrade=False)
    ok = F.col(text_col).isNotNull()
    return scored.select(
        F.col(id_col).alias("message_id"),
        preview(text_col).alias("message"),
        "is_spam", "is_smishing", F.round("confidence", 6).alias("confidence"), F.col("label").alias("spam_type"),
        "risk_level", F.round("spam_score", 6).alias("spam_score"), "reasoning",
        F.when(~ok, F.lit("message text is null")).alias("error"),
    )


def label_rollup(scored: DataFrame) -> DataFrame:
    """Messages and mean score per label x risk level x reason (a message
    counts once under each of its reasons, null texts under none; partial
    aggregation map-side)."""
    reasons = scored.filter(F.col("label").isNotNull()).select(
        "label", "risk_level", "spam_score",
        F.explode(F.split("reasoning", ", ")).alias("reason"))
    return (reasons.groupBy("label", "risk_level", "reason")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("spam_score"), 6).alias("avg_score")))
