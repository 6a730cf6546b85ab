"""Column builders for text features, the OTP gate, scoring and labels (H1–H7, H9).

Keyword hits count *distinct phrases found as substrings* of the lower-cased
text (so ``win`` hits ``window`` and ``now`` hits ``know``) — the published
scorer's behaviour, kept on purpose. All of it is plain column arithmetic and
compiles into one whole-stage-codegen projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D

TEXT_FEATURES = [k for k, _ in D.SCORE_WEIGHTS[:10]]
URL_ROLLUP_FEATURES = ["has_urls", "num_urls", "max_url_risk", "avg_url_risk", "has_shortener",
                       "has_suspicious_tld", "has_ip_url", "has_legitimate_domain", "all_https",
                       "max_domain_entropy", "has_suspicious_url_keywords"]

UPPER_PATTERN = r"\p{IsUppercase}"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT_RUN_PATTERN = r"\p{Nd}+"
TEXT_SPECIAL_PATTERN = "[" + D.TEXT_SPECIAL_CHARS + "]"


def probes(phrases: list[str], least: int = 4) -> list[tuple[str, list[str]]]:
    """The phrases dealt into groups, each with a string that all of the group contain (a phrase alone: itself): one search
    for it tells that a text holds none of them. The largest groups are formed first."""
    left, out = list(phrases), []
    while left:
        parts = {p[i:j] for p in left for i in range(len(p)) for j in range(i + least, len(p) + 1)} | set(left)
        probe = max(sorted(parts), key=lambda x: (sum(x in p for p in left), len(x)))
        group = [p for p in left if probe in p]
        if len(group) == 1:
            return out + [(p, [p]) for p in left]
        out.append((probe, group))
        left = [p for p in left if probe not in p]
    return out


def _found(low: Column, phrases: list[str], all_of, nothing):
    """Per group of :func:`probes`: ``all_of`` its phrases' tests where the probe is found, else ``nothing`` (null for a null text)."""
    for probe, group in probes(phrases):
        if len(group) == 1:
            yield all_of([low.contains(probe)])
        else:
            tests = [F.lit(True) if p == probe else low.contains(p) for p in group]
            yield F.when(low.contains(probe), all_of(tests)).when(low.isNotNull(), F.lit(nothing))


def _hits(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a + b, _found(low, phrases, lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests]), 0))


def _any(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, _found(low, phrases, lambda tests: reduce(lambda a, b: a | b, tests), False))


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are one of ``chars``: each is searched for byte by byte, where ``translate``
    would look up every character of the text."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(text) - F.length(left)


def _cap(x: Column, div: float) -> Column:
    return F.least(x / F.lit(div), F.lit(1.0))


def text_feature_columns(text: Column, low: Column | None = None) -> dict[str, Column]:
    """H1: the 10 text features (name -> Column), each in [0, 1].

    ``low`` is ``lower(text)``; pass a precomputed column so the ~70 substring
    tests share one lower-casing pass."""
    low = F.lower(text) if low is None else low
    n = F.length(text)
    # Exact counts without per-match allocations where possible: ``translate``
    # deletes a character set in one pass; the Unicode regexes run only for
    # texts that are not pure ASCII (or, for digits, that contain one).
    ascii_only = F.octet_length(text) == n
    caps = F.when(ascii_only, n - F.length(F.translate(text, ASCII_UPPER, ""))) \
        .otherwise(F.regexp_count(text, F.lit(UPPER_PATTERN)))
    no_ascii_digit = ~text.rlike("[0-9]")
    runs = F.when(ascii_only & no_ascii_digit, F.lit(0)) \
        .otherwise(F.regexp_count(text, F.lit(DIGIT_RUN_PATTERN)))
    feats = {
        "length_score": (F.when(n < 20, F.lit(0.3)).when(n > 200, F.lit(0.4))
                         .otherwise(F.lit(0.0))),
        "caps_ratio": F.when(n > 0, F.least(caps / n * F.lit(2.0), F.lit(1.0))).otherwise(F.lit(0.0)),
        "exclamation_score": _cap(_count_of(text, "!"), 3.0),
        "spam_keywords": _cap(_hits(low, D.SPAM_KEYWORDS), 3.0),
        "smishing_keywords": _cap(_hits(low, D.SMISHING_KEYWORDS), 2.0),
        "legitimate_patterns": _cap(_hits(low, D.LEGITIMATE_PATTERNS), 2.0),
        "number_score": _cap(runs, 5.0),
        "special_chars": _cap(_count_of(text, D.TEXT_SPECIAL_CHARS), 5.0),
        "urgency_score": _cap(_hits(low, D.URGENCY_WORDS), 2.0),
        "money_score": _cap(_hits(low, D.MONEY_TOKENS), 2.0),
    }
    return feats


def text_features(text: Column, low: Column | None = None) -> Column:
    """H1 as one struct column (for ad-hoc use; jobs use flat columns)."""
    return F.struct(*[v.alias(k) for k, v in text_feature_columns(text, low).items()])


def otp_gate(text: Column, url_level: Column, low: Column | None = None) -> Column:
    """H2: a legitimate one-time-code message (never flagged).

    ``url_level`` is the message's URL risk level (none/low/medium/high).
    """
    low = F.lower(text) if low is None else low
    return (_any(low, D.OTP_PHRASES)
            & text.rlike(D.OTP_CODE_PATTERN)
            & ~url_level.isin("high", "medium")
            & ~_any(low, D.ANTI_OTP_PHRASES))


def spam_score(tf, uf) -> Column:
    """H3: clamp(sum(weight * feature) / 10) with the fixed summation order.

    ``tf`` / ``uf`` map a feature name to its Column (e.g. ``F.col``)."""
    s = F.lit(0.0)
    for i, (k, w) in enumerate(D.SCORE_WEIGHTS):
        src = tf if i < 10 else uf
        s = s + src(k) * F.lit(w)
    return F.greatest(F.lit(0.0), F.least(s / F.lit(D.SCORE_DIVISOR), F.lit(1.0)))


def label(score: Column, tf, uf, otp: Column) -> Column:
    """H4: ham / spam / smishing."""
    smish = ((tf("smishing_keywords") > 0.2) | (uf("max_url_risk") > 0.5)
             | (uf("has_shortener") > 0))
    return (F.when(otp, F.lit("ham"))
            .when(score < D.HAM_BELOW, F.lit("ham"))
            .when(score > D.SMISHING_ABOVE, F.when(smish, F.lit("smishing")).otherwise(F.lit("spam")))
            .when(score > D.SPAM_ABOVE, F.lit("spam"))
            .otherwise(F.lit("ham")))


def confidence(score: Column, otp: Column) -> Column:
    """H4: score for spam-ish labels, 1 - score for ham, 0.99 for OTP."""
    return (F.when(otp, F.lit(D.OTP_CONFIDENCE))
            .when(score < D.HAM_BELOW, F.lit(1.0) - score)
            .when(score > D.SPAM_ABOVE, score)
            .otherwise(F.lit(1.0) - score))


def risk_level(score: Column, otp: Column) -> Column:
    """H5: safe / low / medium / high (OTP messages are safe)."""
    return (F.when(otp, F.lit("safe"))
            .when(score > D.RISK_HIGH_ABOVE, F.lit("high"))
            .when(score > D.RISK_MEDIUM_ABOVE, F.lit("medium"))
            .when(score > D.RISK_LOW_ABOVE, F.lit("low"))
            .otherwise(F.lit("safe")))


def reasoning(tf, uf, otp: Column) -> Column:
    """H6: fixed reason strings in fixed order joined by ', '."""
    parts = F.array_compact(F.array(
        F.when(tf("smishing_keywords") > 0.3, F.lit(D.REASON_SMISHING)),
        F.when(tf("spam_keywords") > 0.3, F.lit(D.REASON_SPAM)),
        F.when(tf("urgency_score") > 0.5, F.lit(D.REASON_URGENT)),
        F.when(tf("legitimate_patterns") > 0.5, F.lit(D.REASON_LEGIT)),
        F.when((uf("has_urls") != 0) & (uf("max_url_risk") > 0.5), F.lit(D.REASON_URL)),
        F.when(uf("has_shortener") != 0, F.lit(D.REASON_SHORTENER)),
        F.when(uf("has_legitimate_domain") != 0, F.lit(D.REASON_LEGIT_DOMAIN)),
    ))
    return (F.when(otp, F.lit(D.REASON_OTP))
            .when(F.size(parts) == 0, F.lit(D.REASON_NONE))
            .otherwise(F.array_join(parts, ", ")))


def is_smishing(lbl: Column, tf, url_level: Column, upgrade: bool) -> Column:
    """H7: smishing flag; with ``upgrade`` a spam label with a medium/high URL
    level or strong smishing language is flagged too (single and SMS paths)."""
    base = lbl == "smishing"
    if not upgrade:
        return base
    return base | ((lbl == "spam") & (url_level.isin("high", "medium")
                                      | (tf("smishing_keywords") > 0.3)))


# Characters a Python-style strip() removes (ASCII whitespace, separators, 0x1c-0x1f, NEL).
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}]"
STRIP_PATTERN = f"^{WS}+|{WS}+$"


def pystrip(c: Column) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does
    (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def strip_forward(body: Column) -> Column:
    """H9: strip; drop the first matching forward prefix (case-insensitive); strip."""
    t = pystrip(body)
    low = F.lower(t)
    out = None
    for p in D.FORWARD_PREFIXES:
        cut = pystrip(F.substring(t, len(p) + 1, 1 << 30))
        out = F.when(low.startswith(p), cut) if out is None else out.when(low.startswith(p), cut)
    return out.otherwise(t)


def _pct(conf: Column) -> Column:
    """``f"{x*100:.0f}"``: half-to-even rounding of the percentage."""
    return F.bround(conf * 100.0, 0).cast("long").cast("string")


def reply_text(is_spam: Column, is_smishing: Column, conf: Column, risk: Column, reasoning_col: Column,
               url_has: Column | None = None, url_shortener: Column | None = None,
               url_suspicious: Column | None = None, url_risk: Column | None = None) -> Column:
    """The SMS reply. Safe: title + confidence + one line. Spam: title,
    confidence, risk, up to 4 warnings (URL warnings only when a URL summary
    with those keys is given), advice."""
    pct = _pct(conf)
    safe = F.concat(F.lit(D.REPLY_SAFE_ICON + " SAFE ("), pct, F.lit("% confidence)\n\n" + D.REPLY_SAFE_BODY))
    title = F.when(is_smishing, F.lit(D.REPLY_SMISHING_TITLE)).otherwise(F.lit(D.REPLY_SPAM_TITLE))
    rl = F.lower(reasoning_col)
    has = url_has if url_has is not None else F.lit(False)
    warns = F.array_compact(F.array(
        F.when(has & F.coalesce(url_shortener, F.lit(False)), F.lit(D.REPLY_WARN_SHORTENER)) if url_shortener is not None else F.lit(None).cast("string"),
        F.when(has & F.coalesce(url_suspicious, F.lit(False)), F.lit(D.REPLY_WARN_SUSPICIOUS)) if url_suspicious is not None else F.lit(None).cast("string"),
        F.when(has & (F.coalesce(url_risk, F.lit(0.0)) > 0.7), F.lit(D.REPLY_WARN_HIGH_RISK)) if url_risk is not None else F.lit(None).cast("string"),
        F.when(rl.contains("urgent") | rl.contains("immediate"), F.lit(D.REPLY_WARN_URGENT)),
        F.when(rl.contains("prize") | rl.contains("winner"), F.lit(D.REPLY_WARN_PRIZE)),
        F.when(rl.contains("account") & rl.contains("verify"), F.lit(D.REPLY_WARN_VERIFY)),
        F.when(rl.contains("credential"), F.lit(D.REPLY_WARN_CREDENTIAL)),
    ))
    w = F.slice(warns, 1, D.REPLY_MAX_WARNINGS)
    warn_txt = F.when(F.size(w) > 0, F.concat(F.array_join(w, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    advice = F.when(is_smishing, F.lit(D.REPLY_SMISHING_ADVICE)).otherwise(F.lit(D.REPLY_SPAM_ADVICE))
    spam = F.concat(title, F.lit("\nConfidence: "), pct, F.lit("%\nRisk: "), F.upper(risk), F.lit("\n\n"),
                    warn_txt, advice)
    return F.when(is_spam, spam).otherwise(safe)


def short_reply(is_spam: Column, is_smishing: Column, conf: Column) -> Column:
    """H10 short form (< 160 characters)."""
    pct = _pct(conf)
    return (F.when(~is_spam, F.concat(F.lit(D.REPLY_SAFE_ICON + " SAFE ("), pct, F.lit("%)")))
            .when(is_smishing, F.concat(F.lit(D.REPLY_SHORT_SMISHING[0]), pct, F.lit(D.REPLY_SHORT_SMISHING[1])))
            .otherwise(F.concat(F.lit(D.REPLY_SHORT_SPAM[0]), pct, F.lit(D.REPLY_SHORT_SPAM[1]))))
