"""DuckDB SQL twins of the registered Spark queries (the correctness oracle).

The SQL is written independently of the Spark code (URL features in exploded
form with UNNEST + GROUP BY, where Spark computes them in-row) but generated
from the same fixed dictionaries, so both sides use identical word lists.
Tables ``pages events orders documents labels`` are DuckDB views.
"""

from __future__ import annotations

from .. import dictionaries as D
from ..functions import urls as U
from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(n)})" for n in needles) + ")"


def any_endswith(expr: str, needles) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {q(n)})" for n in needles) + ")"


def hits(expr: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {q(n)}) AS INTEGER)" for n in needles) + ")"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def cap(expr: str, div: float) -> str:
    return f"least(({expr}) / {div!r}, 1.0)"


def rcount(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


# --------------------------------------------------------------------------
# message view (FIXTURES.md §3)
# --------------------------------------------------------------------------
MESSAGE_VIEW = """
pg AS (SELECT page_id, url, regexp_replace(url, '^https?://[^/?#]*', '') AS path, page_id % 12 AS k FROM pages),
m AS (
SELECT concat('pg', cast(page_id AS string)) AS message_id, concat('+1555', cast(1000000 + page_id % 37 AS string)) AS sender,
  CASE k WHEN 0 THEN concat('URGENT! Your bank account is locked! Verify NOW! http://bit.ly', path)
   WHEN 1 THEN concat('Congratulations! You won $5000! Claim your FREE prize now: http://prize-winner.xyz', path)
   WHEN 2 THEN concat('Click here for amazing prizes: http://192.168.1.1', path)
   WHEN 3 THEN concat('Your Amazon order has shipped. Track: https://www.amazon.com', path)
   WHEN 4 THEN concat('Unusual activity detected. Confirm: https://secure-bank-verify.top', path, ' or ', url)
   WHEN 5 THEN concat('Your verification code is ', cast(100000 + page_id AS string), '. ', url)
   WHEN 6 THEN concat('Confirm code ', cast(100000 + page_id AS string), ' at http://10.0.0.1/login/account?x=1&y=2&z=3')
   WHEN 7 THEN concat('Fwd: see ', url, ' and ', url)
   WHEN 8 THEN concat('Account suspended: http://[bad', path)
   WHEN 9 THEN concat('hello ', url)
   WHEN 10 THEN concat('URGENT! VERIFY NOW! CLAIM YOUR FREE $$$ CASH PRIZE! http://x7kq9zvw3mfp.bit.ly.secure-login.xyz/a/b/c/d?u=1&v=2&w=3&x=4', path)
   ELSE concat('$$$ FREE CASH! WIN $', cast(1000 + page_id AS string), ' NOW! HURRY! $$$') END AS text,
  CASE WHEN k IN (0,1,2,4,6,8,10,11) THEN 'spam' ELSE 'ham' END AS true_label, k IN (0,2,4,6,8,10) AS is_smishing,
  CASE WHEN k = 3 THEN 'transactional' WHEN k = 5 THEN '2fa' END AS a2p_type, 'pages' AS source FROM pg
UNION ALL
SELECT concat('ev', cast(event_id AS string)), concat('+1555', cast(2000000 + user_id AS string)),
  CASE event_id % 4 WHEN 0 THEN concat(cast(100000 + event_id AS string), ' is your Google security code')
   WHEN 1 THEN concat('Nike: ', cast(20 + event_id % 4 * 10 AS string), '% off! Shop now. Reply STOP to unsubscribe')
   WHEN 2 THEN 'Appointment reminder: Dentist tomorrow at 2pm' ELSE concat('Hey, are we still meeting at ', cast(event_id % 12 AS string), 'pm?') END,
  'ham', false, CASE event_id % 4 WHEN 0 THEN '2fa' WHEN 1 THEN 'marketing' WHEN 2 THEN 'alerts' END, 'events' FROM events
UNION ALL
SELECT concat('or', cast(o_orderkey AS string)), concat('+1555', cast(3000000 + o_custkey AS string)),
  concat('Your Target order #', cast(o_orderkey AS string), ' has shipped'), 'ham', false, 'transactional', 'orders' FROM orders
UNION ALL
SELECT concat('dc', cast(d.doc_id AS string)), CAST(NULL AS string), d.text,
  CASE WHEN l.toxic = 1 THEN 'spam' WHEN l.toxic = 0 THEN 'ham' END, false, CAST(NULL AS string), 'documents' FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


# --------------------------------------------------------------------------
# URL features, exploded form
# --------------------------------------------------------------------------
def _url_feature_exprs() -> dict[str, str]:
    dom = "dom"
    label = "split_part(dom, '.', 1)"
    ent = (f"(CASE WHEN length({label}) = 0 THEN 0.0 ELSE 0.0 - list_sum(list_transform("
           f"list_distinct(string_split({label}, '')), lambda c: "
           f"((length({label}) - length(replace({label}, c, ''))) / length({label})) * "
           f"log2((length({label}) - length(replace({label}, c, ''))) / length({label})))) END)")
    return {
        "is_shortener": flag(any_contains(dom, D.URL_SHORTENERS)),
        "suspicious_tld": flag(any_endswith(dom, D.SUSPICIOUS_TLDS)),
        "is_ip_address": flag(f"regexp_matches(dom, {q(U.IP_PATTERN)})"),
        "domain_entropy": cap(ent, 5.0),
        "has_suspicious_keywords": flag(any_contains("lower(url)", D.URL_KEYWORDS)),
        "is_legitimate_domain": flag(any_contains(dom, D.LEGITIMATE_DOMAINS)),
        "has_https": flag("starts_with(url, 'https')"),
        "num_subdomains": cap("greatest(0, length(dom) - length(replace(dom, '.', '')) - 1)", 3.0),
        "url_length": cap("length(url)", 100.0),
        "special_chars": cap("length(url) - length(regexp_replace(url, '[@?=&%]', '', 'g'))", 10.0),
        "path_depth": cap("len(list_filter(string_split(upath, '/'), lambda x: x <> ''))", 5.0),
    }


def url_ctes(src: str = "m") -> str:
    """CTEs ``url_rows`` (message_id, pos, url), ``url_feats`` (+ features) over ``src``."""
    f = _url_feature_exprs()
    risk = "0.0"
    for k, w in D.URL_RISK_WEIGHTS:
        risk = f"({risk} + {k} * {w!r})"
    bad = ("((contains(rnl, '[') <> contains(rnl, ']')) OR (contains(rnl, '[') AND contains(rnl, ']') AND NOT "
           f"regexp_matches(regexp_extract(rnl, {q(U.BRACKET_HOST_PATTERN)}, 1), {q(U.BRACKET_HOST_OK)})))")
    inner = ",\n  ".join(f"{v} AS {k}" for k, v in f.items())
    outer = ",\n  ".join(
        f"CASE WHEN bad THEN {D.BAD_URL_FEATURES[k]!r} ELSE {k} END AS {k}" for k in f)
    return f"""
mu AS (SELECT message_id, sender, regexp_extract_all(text, {q(D.URL_PATTERN)}) AS urls FROM {src}),
url_rows AS (SELECT mu.message_id, mu.sender, r.pos, mu.urls[r.pos] AS url FROM mu, range(1, len(mu.urls) + 1) r(pos)),
url_parts AS (SELECT *, regexp_extract(url, {q(U.NETLOC_PATTERN)}, 1) AS rnl,
  lower(regexp_extract(url, {q(U.NETLOC_PATTERN)}, 1)) AS dom,
  lower(regexp_replace(regexp_extract(url, {q(U.PATH_PATTERN)}, 1), ';[^/]*$', '')) AS upath FROM url_rows),
url_f0 AS (SELECT message_id, sender, pos, url, dom, upath, {bad} AS bad,
  {inner} FROM url_parts),
url_f1 AS (SELECT *, greatest(0.0, least({risk} / {D.URL_RISK_DIVISOR!r}, 1.0)) AS url_risk_score FROM url_f0),
url_feats AS (SELECT message_id, sender, pos, url, dom, upath,
  {outer},
  CASE WHEN bad THEN {D.BAD_URL_FEATURES['url_risk_score']!r} ELSE url_risk_score END AS url_risk_score FROM url_f1)"""


def rollup_ctes(src: str = "m") -> str:
    """CTE ``mu_roll``: per-message URL rollup (U12) joined back to every message."""
    return url_ctes(src) + f""",
url_agg AS (SELECT message_id, count(*) AS n_urls, max(url_risk_score) AS max_url_risk,
  avg(url_risk_score) AS avg_url_risk, max(is_shortener) AS has_shortener, max(suspicious_tld) AS has_suspicious_tld,
  max(is_ip_address) AS has_ip_url, max(is_legitimate_domain) AS has_legitimate_domain, min(has_https) AS all_https,
  max(domain_entropy) AS max_domain_entropy, max(has_suspicious_keywords) AS has_suspicious_url_keywords,
  list(CASE WHEN is_shortener <> 0 THEN {q(D.IND_SHORTENER)} END) AS i1,
  list(CASE WHEN suspicious_tld <> 0 THEN {q(D.IND_TLD)} END) AS i2,
  list(CASE WHEN is_ip_address <> 0 THEN {q(D.IND_IP)} END) AS i3,
  list(CASE WHEN domain_entropy > 0.7 THEN {q(D.IND_RANDOM)} END) AS i4,
  list(CASE WHEN has_suspicious_keywords <> 0 THEN {q(D.IND_KEYWORDS)} END) AS i5,
  list(CASE WHEN is_legitimate_domain = 0 AND has_https = 0 THEN {q(D.IND_NO_HTTPS)} END) AS i6
  FROM url_feats GROUP BY message_id),
mu_roll AS (SELECT m0.*, coalesce(a.n_urls, 0) AS n_urls,
  CASE WHEN a.n_urls > 0 THEN 1.0 ELSE 0.0 END AS has_urls,
  least(coalesce(a.n_urls, 0) / 3.0, 1.0) AS num_urls,
  coalesce(a.max_url_risk, 0.0) AS max_url_risk, coalesce(a.avg_url_risk, 0.0) AS avg_url_risk,
  coalesce(a.has_shortener, 0.0) AS has_shortener, coalesce(a.has_suspicious_tld, 0.0) AS has_suspicious_tld,
  coalesce(a.has_ip_url, 0.0) AS has_ip_url, coalesce(a.has_legitimate_domain, 0.0) AS has_legitimate_domain,
  coalesce(a.all_https, 0.0) AS all_https, coalesce(a.max_domain_entropy, 0.0) AS max_domain_entropy,
  coalesce(a.has_suspicious_url_keywords, 0.0) AS has_suspicious_url_keywords,
  CASE WHEN a.n_urls IS NULL THEN 'none' WHEN a.max_url_risk > 0.7 THEN 'high'
       WHEN a.max_url_risk > 0.4 THEN 'medium' ELSE 'low' END AS url_level,
  a.max_url_risk AS max_risk_score,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(
     flatten([a.i1, a.i2, a.i3, a.i4, a.i5, a.i6]), lambda x: x IS NOT NULL))), '; '), '') AS suspicious_indicators
  FROM {src} m0 LEFT JOIN url_agg a ON m0.message_id = a.message_id)"""


# --------------------------------------------------------------------------
# text features and score
# --------------------------------------------------------------------------
def _text_feature_exprs(t: str = "text") -> dict[str, str]:
    low = f"lower({t})"
    n = f"length({t})"
    return {
        "length_score": f"(CASE WHEN {n} < 20 THEN 0.3 WHEN {n} > 200 THEN 0.4 ELSE 0.0 END)",
        "caps_ratio": f"(CASE WHEN {n} > 0 THEN least({rcount(t, r'\p{Lu}')} / {n} * 2.0, 1.0) ELSE 0.0 END)",
        "exclamation_score": cap(f"{n} - length(replace({t}, '!', ''))", 3.0),
        "spam_keywords": cap(hits(low, D.SPAM_KEYWORDS), 3.0),
        "smishing_keywords": cap(hits(low, D.SMISHING_KEYWORDS), 2.0),
        "legitimate_patterns": cap(hits(low, D.LEGITIMATE_PATTERNS), 2.0),
        "number_score": cap(rcount(t, T.DIGIT_RUN_PATTERN), 5.0),
        "special_chars": cap(rcount(t, T.TEXT_SPECIAL_PATTERN), 5.0),
        "urgency_score": cap(hits(low, D.URGENCY_WORDS), 2.0),
        "money_score": cap(hits(low, D.MONEY_TOKENS), 2.0),
    }


def scored_ctes(src: str = "m") -> str:
    """CTE ``sc``: every message of ``src`` with features, OTP gate, score,
    label, confidence, risk level, reasoning and smishing flags."""
    tf = _text_feature_exprs()
    tf_sql = ",\n  ".join(f"{v} AS {k}" for k, v in tf.items())
    score = "0.0"
    for k, w in D.SCORE_WEIGHTS:
        score = f"({score} + {k} * {w!r})"
    low = "lower(text)"
    otp = (f"({any_contains(low, D.OTP_PHRASES)} AND regexp_matches(text, {q(D.OTP_CODE_PATTERN)}) "
           f"AND url_level NOT IN ('high', 'medium') AND NOT {any_contains(low, D.ANTI_OTP_PHRASES)})")
    reasons = ", ".join([
        f"CASE WHEN smishing_keywords > 0.3 THEN {q(D.REASON_SMISHING)} END",
        f"CASE WHEN spam_keywords > 0.3 THEN {q(D.REASON_SPAM)} END",
        f"CASE WHEN urgency_score > 0.5 THEN {q(D.REASON_URGENT)} END",
        f"CASE WHEN legitimate_patterns > 0.5 THEN {q(D.REASON_LEGIT)} END",
        f"CASE WHEN has_urls <> 0 AND max_url_risk > 0.5 THEN {q(D.REASON_URL)} END",
        f"CASE WHEN has_shortener <> 0 THEN {q(D.REASON_SHORTENER)} END",
        f"CASE WHEN has_legitimate_domain <> 0 THEN {q(D.REASON_LEGIT_DOMAIN)} END",
    ])
    return rollup_ctes(src) + f""",
tfe AS (SELECT *, {tf_sql} FROM mu_roll),
s0 AS (SELECT *, {otp} AS otp, greatest(0.0, least({score} / {D.SCORE_DIVISOR!r}, 1.0)) AS spam_score,
  list_filter([{reasons}], lambda x: x IS NOT NULL) AS reason_list FROM tfe),
sc AS (SELECT *,
  CASE WHEN otp THEN 'ham' WHEN spam_score < {D.HAM_BELOW} THEN 'ham'
       WHEN spam_score > {D.SMISHING_ABOVE} THEN CASE WHEN smishing_keywords > 0.2 OR max_url_risk > 0.5 OR has_shortener > 0
                                    THEN 'smishing' ELSE 'spam' END
       WHEN spam_score > {D.SPAM_ABOVE} THEN 'spam' ELSE 'ham' END AS label,
  CASE WHEN otp THEN {D.OTP_CONFIDENCE} WHEN spam_score < {D.HAM_BELOW} THEN 1.0 - spam_score
       WHEN spam_score > {D.SPAM_ABOVE} THEN spam_score ELSE 1.0 - spam_score END AS confidence,
  CASE WHEN otp THEN 'safe' WHEN spam_score > 0.7 THEN 'high' WHEN spam_score > 0.4 THEN 'medium'
       WHEN spam_score > 0.2 THEN 'low' ELSE 'safe' END AS risk_level,
  CASE WHEN otp THEN {q(D.REASON_OTP)} WHEN len(reason_list) = 0 THEN {q(D.REASON_NONE)}
       ELSE array_to_string(reason_list, ', ') END AS reasoning
  FROM s0),
scu AS (SELECT *, label IN ('spam', 'smishing') AS is_spam,
  label = 'smishing' AS is_smishing_batch,
  label = 'smishing' OR (label = 'spam' AND (url_level IN ('high', 'medium') OR smishing_keywords > 0.3)) AS is_smishing_up
  FROM sc)"""


def with_view(body: str) -> str:
    return "WITH " + MESSAGE_VIEW.strip() + "," + body.strip() + "\n"


def r6(x: str) -> str:
    return f"round({x}, 6)"
