"""A tiny independent Python model of the scorer's documented semantics,
used only by the tests (property checks against the Spark columns)."""

import math
import re
from urllib.parse import urlparse

from msgscreen import dictionaries as D

URL_RX = re.compile(D.URL_PATTERN)


def url_features(url):
    try:
        p = urlparse(url)
    except ValueError:
        return dict(D.BAD_URL_FEATURES)
    dom, path, low = p.netloc.lower(), p.path.lower(), url.lower()
    label = dom.split(".")[0] if "." in dom else dom
    ent = 0.0
    if label:
        ent = -sum((label.count(c) / len(label)) * math.log2(label.count(c) / len(label)) for c in set(label))
    f = {
        "is_shortener": float(any(s in dom for s in D.URL_SHORTENERS)),
        "suspicious_tld": float(any(dom.endswith(t) for t in D.SUSPICIOUS_TLDS)),
        "is_ip_address": float(bool(re.match(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", dom))),
        "domain_entropy": min(ent / 5.0, 1.0),
        "has_suspicious_keywords": float(any(k in low for k in D.URL_KEYWORDS)),
        "is_legitimate_domain": float(any(d in dom for d in D.LEGITIMATE_DOMAINS)),
        "has_https": float(p.scheme == "https"),
        "num_subdomains": min(max(0, len(dom.split(".")) - 2) / 3.0, 1.0),
        "url_length": min(len(url) / 100.0, 1.0),
        "special_chars": min(sum(1 for c in url if c in "@?=&%") / 10.0, 1.0),
        "path_depth": min(len([x for x in path.split("/") if x]) / 5.0, 1.0),
    }
    r = sum(f[k] * w for k, w in D.URL_RISK_WEIGHTS)
    f["url_risk_score"] = max(0, min(r / 5.0, 1.0))
    return f


def text_features(m):
    low = m.lower()
    n = len(m)
    return {
        "length_score": 0.3 if n < 20 else (0.4 if n > 200 else 0.0),
        "caps_ratio": min(sum(1 for c in m if c.isupper()) / n * 2, 1.0) if n else 0.0,
        "exclamation_score": min(m.count("!") / 3.0, 1.0),
        "spam_keywords": min(sum(1 for k in D.SPAM_KEYWORDS if k in low) / 3.0, 1.0),
        "smishing_keywords": min(sum(1 for k in D.SMISHING_KEYWORDS if k in low) / 2.0, 1.0),
        "legitimate_patterns": min(sum(1 for k in D.LEGITIMATE_PATTERNS if k in low) / 2.0, 1.0),
        "number_score": min(len(re.findall(r"\d+", m)) / 5.0, 1.0),
        "special_chars": min(sum(1 for c in m if c in D.TEXT_SPECIAL_CHARS) / 5.0, 1.0),
        "urgency_score": min(sum(1 for w in D.URGENCY_WORDS if w in low) / 2.0, 1.0),
        "money_score": min(sum(1 for w in D.MONEY_TOKENS if w in low) / 2.0, 1.0),
    }


def score(m):
    urls = URL_RX.findall(m)
    fs = [url_features(u) for u in urls]
    uf = {"has_urls": float(bool(urls)), "num_urls": min(len(urls) / 3.0, 1.0)}
    if fs:
        uf.update(max_url_risk=max(f["url_risk_score"] for f in fs),
                  has_shortener=float(any(f["is_shortener"] for f in fs)),
                  has_suspicious_tld=float(any(f["suspicious_tld"] for f in fs)),
                  has_ip_url=float(any(f["is_ip_address"] for f in fs)),
                  has_legitimate_domain=float(any(f["is_legitimate_domain"] for f in fs)),
                  max_domain_entropy=max(f["domain_entropy"] for f in fs),
                  has_suspicious_url_keywords=float(any(f["has_suspicious_keywords"] for f in fs)))
    else:
        uf.update(max_url_risk=0.0, has_shortener=0.0, has_suspicious_tld=0.0, has_ip_url=0.0,
                  has_legitimate_domain=0.0, max_domain_entropy=0.0, has_suspicious_url_keywords=0.0)
    tf = text_features(m)
    allf = {**tf, **uf}
    s = 0.0
    for k, w in D.SCORE_WEIGHTS:
        s += allf[k] * w
    return max(0, min(s / 10.0, 1.0))
