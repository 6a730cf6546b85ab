"""Column builders for URL extraction and per-URL risk features.

Every builder takes a URL Column and returns a Column, so the same code runs
(a) on an exploded ``url`` column, where it is whole-stage code-generated, and
(b) inside ``F.transform`` over a message's URL array (the in-row form, which
needs no shuffle and can run before a stateful streaming stage).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D

URL_PATTERN = D.URL_PATTERN
NETLOC_PATTERN = r"^https?://([^/?#]*)"
PATH_PATTERN = r"^https?://[^/?#]*([^?#]*)"
IP_PATTERN = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"

# A bracketed host is accepted by the URL splitter only when it is an IPvFuture
# literal or an IPv6 address (optionally with a zone id); anything else makes
# the URL unparseable and it gets the fixed default features.
_H = "[0-9a-fA-F]{1,4}"
_O = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_O}\.{_O}\.{_O}\.{_O}"
_IPV6 = "|".join([
    rf"({_H}:){{7}}{_H}",
    rf"({_H}:){{1,7}}:",
    rf"({_H}:){{1,6}}:{_H}",
    rf"({_H}:){{1,5}}(:{_H}){{1,2}}",
    rf"({_H}:){{1,4}}(:{_H}){{1,3}}",
    rf"({_H}:){{1,3}}(:{_H}){{1,4}}",
    rf"({_H}:){{1,2}}(:{_H}){{1,5}}",
    rf"{_H}:(:{_H}){{1,6}}",
    rf":((:{_H}){{1,7}}|:)",
    rf"({_H}:){{6}}{_V4}",
    rf"::({_H}:){{0,5}}{_V4}",
    rf"({_H}:){{1}}:({_H}:){{0,4}}{_V4}",
    rf"({_H}:){{2}}:({_H}:){{0,3}}{_V4}",
    rf"({_H}:){{3}}:({_H}:){{0,2}}{_V4}",
    rf"({_H}:){{4}}:({_H}:){{0,1}}{_V4}",
    rf"({_H}:){{5}}:{_V4}",
])
BRACKET_HOST_OK = rf"^(v[a-fA-F0-9]+\..+|({_IPV6})(%[^%]+)?)$"
BRACKET_HOST_PATTERN = r"\[([^\]]*)"

FEATURES = [k for k, _ in D.URL_RISK_WEIGHTS]


def alternation(needles: list[str]) -> str:
    """Regex matching any of the literal ``needles`` (one pass per string)."""
    return "(?:" + "|".join(re.escape(n) for n in needles) + ")"


SHORTENER_RX = alternation(D.URL_SHORTENERS)
TLD_RX = alternation(D.SUSPICIOUS_TLDS) + "$"
LEGIT_RX = alternation(D.LEGITIMATE_DOMAINS)
KEYWORD_RX = alternation(D.URL_KEYWORDS)


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _cap(x: Column, div: float) -> Column:
    return F.least(x / F.lit(div), F.lit(1.0))


def extract_urls(text: Column) -> Column:
    """All URL matches of a message, in order (array<string>)."""
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), 0)


def raw_netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC_PATTERN, 1)


def netloc(url: Column) -> Column:
    """Lower-cased network location (keeps user-info and port)."""
    return F.lower(raw_netloc(url))


def path(url: Column) -> Column:
    """Lower-cased path without the ``;params`` of its last segment."""
    p = F.regexp_extract(url, PATH_PATTERN, 1)
    return F.lower(F.regexp_replace(p, ";[^/]*$", ""))


def is_bad(url: Column) -> Column:
    """True when the URL splitter rejects the netloc (bracket rules)."""
    nl = raw_netloc(url)
    has_open = nl.contains("[")
    has_close = nl.contains("]")
    host = F.regexp_extract(nl, BRACKET_HOST_PATTERN, 1)
    return ((has_open != has_close)
            | (has_open & has_close & ~host.rlike(BRACKET_HOST_OK)))


def count_char(s: Column, ch: str) -> Column:
    """Occurrences of the single character ``ch`` in ``s``."""
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def entropy(s: Column) -> Column:
    """Shannon entropy (bits) of the characters of ``s``; 0 for ''."""
    n = F.length(s)
    chars = F.array_distinct(F.split(s, ""))

    def term(acc, c):
        p = (n - F.length(F.replace(s, c, F.lit("")))) / n
        return acc + p * F.log2(p)

    h = F.aggregate(chars, F.lit(0.0), term)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(0.0) - h)


def url_parts(url: Column) -> Column:
    """The parsed pieces every feature reads, computed once per URL."""
    return F.struct(url.alias("url"), netloc(url).alias("dom"), F.lower(url).alias("low"),
                    path(url).alias("path"), is_bad(url).alias("bad"))


def features_of_parts(p: Column) -> Column:
    """Struct of the 11 features and ``url_risk_score`` from
    :func:`url_parts` (a URL the splitter rejects gets the fixed defaults)."""
    url, dom = p["url"], p["dom"]
    label = F.substring_index(dom, ".", 1)
    feats = {
        "is_shortener": _flag(dom.rlike(SHORTENER_RX)),
        "suspicious_tld": _flag(dom.rlike(TLD_RX)),
        "is_ip_address": _flag(dom.rlike(IP_PATTERN)),
        "domain_entropy": _cap(entropy(label), 5.0),
        "has_suspicious_keywords": _flag(p["low"].rlike(KEYWORD_RX)),
        "is_legitimate_domain": _flag(dom.rlike(LEGIT_RX)),
        "has_https": _flag(url.startswith("https")),
        "num_subdomains": _cap(F.greatest(F.lit(0), count_char(dom, ".") - 1), 3.0),
        "url_length": _cap(F.length(url), 100.0),
        "special_chars": _cap(F.regexp_count(url, F.lit("[@?=&%]")), 10.0),
        "path_depth": _cap(F.size(F.filter(F.split(p["path"], "/"), lambda x: x != "")), 5.0),
    }
    risk = F.lit(0.0)
    for k, w in D.URL_RISK_WEIGHTS:
        risk = risk + feats[k] * F.lit(w)
    feats["url_risk_score"] = F.greatest(F.lit(0.0), _cap(risk, D.URL_RISK_DIVISOR))
    return F.struct(*[
        F.when(p["bad"], F.lit(D.BAD_URL_FEATURES[k])).otherwise(v).alias(k)
        for k, v in feats.items()
    ])


def url_features(url: Column) -> Column:
    """U2–U11 for one URL column (exploded form)."""
    return features_of_parts(url_parts(url))


def indicators(f: Column) -> Column:
    """Indicator strings of one URL's feature struct, in fixed order."""
    return F.array_compact(F.array(
        F.when(f["is_shortener"] != 0, F.lit(D.IND_SHORTENER)),
        F.when(f["suspicious_tld"] != 0, F.lit(D.IND_TLD)),
        F.when(f["is_ip_address"] != 0, F.lit(D.IND_IP)),
        F.when(f["domain_entropy"] > 0.7, F.lit(D.IND_RANDOM)),
        F.when(f["has_suspicious_keywords"] != 0, F.lit(D.IND_KEYWORDS)),
        F.when((f["is_legitimate_domain"] == 0) & (f["has_https"] == 0), F.lit(D.IND_NO_HTTPS)),
    ))


def risk_level(max_risk: Column, has_urls: Column) -> Column:
    """URL risk level of a message: none / low / medium / high."""
    return (F.when(~has_urls, F.lit("none"))
            .when(max_risk > D.RISK_HIGH_ABOVE, F.lit("high"))
            .when(max_risk > D.RISK_MEDIUM_ABOVE, F.lit("medium"))
            .otherwise(F.lit("low")))
