"""Corpus preparation (C1–C8, C11, C12): label clean-up, provenance, union,
priority de-duplication, stratified split, summary, incremental integration.

Skew: one message text (or one label) may hold a third of all rows.
* Dedup (C6) is a grouped ``min`` over a priority struct: partial aggregation
  collapses duplicates map-side, so a hot message never lands in one task.
* The split (C7) has only two keys (ham/spam); a window partitioned by label
  would sort half the corpus in one task. Rows are instead ranked inside
  hash-prefix buckets, and bucket offsets come from a small per-bucket count
  table whose size is bounded by ``labels x 16**prefix`` (not by data size).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUALITY_RANK = {"high": 0, "medium": 1, "low": 2}
SPAM_LABELS = ("spam", "smishing", "phishing")
SMISHING_LABELS = ("smishing", "phishing")


def normalise_labels(df: DataFrame, label_col: str = "label", keep=("ham", "spam")) -> DataFrame:
    """Lower-case the label and keep only the given classes."""
    return df.withColumn(label_col, F.lower(F.col(label_col))).filter(F.col(label_col).isin(*keep))


def unify_labels(df: DataFrame, label_col: str = "label", unknown: str = "ham",
                 smishing=SMISHING_LABELS) -> DataFrame:
    """C2 + C3: keep ``original_label`` (lower-cased, copied *before* unifying),
    flag smishing, fold spam-like labels into ``spam``. ``unknown`` is the
    policy for any other label: ``ham`` | ``null`` | ``keep``."""
    low = F.lower(F.col(label_col))
    other = {"ham": F.lit("ham"),
             "null": F.when(low == "ham", F.lit("ham")),
             "keep": low}[unknown]
    return (df.withColumn("original_label", low)
              .withColumn("is_smishing", F.coalesce(low.isin(*smishing), F.lit(False)))
              .withColumn(label_col, F.when(low.isin(*SPAM_LABELS), F.lit("spam")).otherwise(other)))


def tag_source(df: DataFrame, source: str, dataset: str, quality: str) -> DataFrame:
    """C4: constant provenance columns."""
    return df.withColumns({"source": F.lit(source), "dataset": F.lit(dataset), "quality": F.lit(quality)})


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Stack sources with different columns; a missing smishing flag is false."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    if "is_smishing" in out.columns:
        out = out.withColumn("is_smishing", F.coalesce(F.col("is_smishing"), F.lit(False)))
    return out


def priority_dedup(df: DataFrame, key: str = "message", order=("quality_rank", "source_rank", "message_id")) -> DataFrame:
    """One row per exact ``key``; the survivor is the smallest ``order``
    tuple (quality high < medium < low, then source order, then id).

    A grouped ``min(struct(order..., payload...))``: the aggregate is partial,
    so each map task already keeps one row per text before the shuffle."""
    df = df.withColumn("quality_rank", F.coalesce(
        F.create_map(*[x for k, v in QUALITY_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("quality")],
        F.lit(len(QUALITY_RANK)))) if "quality_rank" in order and "quality_rank" not in df.columns else df
    payload = [c for c in df.columns if c != key and c not in order]
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in payload])).alias("b")
    # group on (64-bit hash, text): the sort-based aggregate then compares
    # long texts only on hash ties
    out = df.groupBy(F.xxhash64(key).alias("_kh"), key).agg(best)
    return out.select(key, *[F.col(f"b.{c}").alias(c) for c in list(order) + payload])


def split_hash(key: str = "message", seed: int = 42):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))


def stratified_split(df: DataFrame, label_col: str = "label", key: str = "message", seed: int = 42,
                     train: int = 70, val: int = 85, prefix: int = 4, tie: str = "message_id",
                     checkpoint: bool = True) -> DataFrame:
    """Exact per-class 70/15/15 split. Rows of each label are ranked by
    ``md5(seed|key)`` (ties by ``tie``); rank r (1-based) of n goes to train if
    100r <= 70n, to val if 100r <= 85n, else to test. Deterministic and
    reproducible in SQL (``row_number`` over the same order).

    Ranks are computed without a per-label window: rank = offset of the
    row's hash-prefix bucket + rank inside the bucket. The input is read
    twice (bucket counts, then ranks), so it is checkpointed once first."""
    if checkpoint:
        from ..session import materialize
        df = materialize(df)
    h = df.withColumn("_h", split_hash(key, seed)).withColumn("_b", F.substring("_h", 1, prefix))
    counts = h.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wl = Window.partitionBy(label_col)
    # at most (labels x 16**prefix) rows; labels may be many (``unknown="keep"``), so the size at run time decides
    offsets = counts.select(label_col, "_b",
                            F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"),
                            F.sum("_c").over(wl).alias("_n"))
    j = h.join(offsets, [label_col, "_b"])
    wb = Window.partitionBy(label_col, "_b").orderBy("_h", tie)
    r = F.col("_off") + F.row_number().over(wb)
    n = F.col("_n")
    split = (F.when(r * 100 <= n * train, F.lit("train"))
             .when(r * 100 <= n * val, F.lit("val")).otherwise(F.lit("test")))
    return j.withColumn("split", split).drop("_h", "_b", "_off", "_n")


def corpus_summary(df: DataFrame) -> DataFrame:
    """One pass, grouping sets (), (label), (source), (a2p_type), (split, label)."""
    return df.groupingSets(
        [[], ["label"], ["source"], ["a2p_type"], ["split", "label"]],
        "label", "source", "a2p_type", "split",
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == "spam").alias("spam_count"),
        F.count_if(F.col("label") == "ham").alias("ham_count"),
        F.count_if(F.col("is_smishing")).alias("smishing_count"),
        F.grouping_id().alias("gid"),
    ).withColumns({f"{k}_pct": F.round(F.col(f"{k}_count") * 100.0 / F.col("n"), 6) for k in ("spam", "ham", "smishing")})


def split_leaks(split_df: DataFrame, key: str = "message") -> DataFrame:
    """Leak check: texts present in more than one split (must be empty), in
    one aggregate."""
    return split_df.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(key)


def integrate(existing: DataFrame, new: DataFrame, key: str = "message") -> DataFrame:
    """C11: add only texts not already in the corpus (``left_anti``), then the
    caller re-dedups and re-splits. Callers pre-dedup ``new`` so a hot text
    is one row before the shuffle; AQE's skew-join split covers the rest."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def retraining_set(corpus: DataFrame, feedback: DataFrame, key: str = "message") -> DataFrame:
    """Corpus plus corrected feedback; feedback has top priority and the
    latest correction of a text wins (one row per text)."""
    fb = (feedback.select(F.col("message").alias(key), F.col("true_label").alias("label"),
                          F.col("timestamp"))
          .withColumn("prio", F.lit(0)).withColumn("neg_ts", -F.col("timestamp").cast("double")))
    base = (corpus.select(key, "label").withColumn("prio", F.lit(1))
            .withColumn("neg_ts", F.lit(0.0)).withColumn("timestamp", F.lit(None).cast("timestamp")))
    both = fb.unionByName(base)
    best = F.min(F.struct("prio", "neg_ts", "label")).alias("b")
    return both.groupBy(key).agg(best).select(
        key, F.col("b.label").alias("label"),
        F.when(F.col("b.prio") == 0, F.lit("feedback")).otherwise(F.lit("corpus")).alias("origin"))


def retraining_changes(corpus: DataFrame, feedback: DataFrame, by: str, key: str = "message") -> DataFrame:
    """C12 for many sets of corrections at once, as what differs from the corpus (one row per text): per ``by`` the corrected texts
    with the label of the latest correction; ``known`` where the text takes the place of one of the corpus."""
    best = F.min(F.struct((-F.col("timestamp").cast("double")).alias("neg_ts"), F.col("true_label").alias("label"))).alias("b")
    fb = feedback.withColumn("_h", F.xxhash64("message")).groupBy(by, "_h", F.col("message").alias(key)).agg(best).select(by, "_h", key, F.col("b.label").alias("label"))
    held = corpus.select(F.xxhash64(key).alias("_kh"), F.col(key).alias("_key"), F.lit(True).alias("_held"))
    same = (F.col("_h") == F.col("_kh")) & F.col(key).eqNullSafe(F.col("_key"))
    return fb.join(held, same, "left").select(by, key, "label", F.coalesce("_held", F.lit(False)).alias("known"))


# FIXED VALUES: legitimate A2P message templates and their field lists.
OTP_TEMPLATES = ["Your {service} verification code is {code}", "{code} is your {service} security code",
                 "Use {code} to verify your {service} account"]
OTP_SERVICES = ["Google", "Apple", "Amazon", "PayPal", "Chase", "Facebook", "Instagram", "Netflix", "Uber",
                "Microsoft"]
TRANS_TEMPLATES = ["Your {service} order #{order} has shipped", "Payment of ${amount} to {person} successful",
                   "{service}: Appointment confirmed for {date}"]
TRANS_SERVICES = ["Amazon", "Target", "Uber"]
TRANS_PEOPLE = ["John", "Jane"]
TRANS_DATES = ["Monday", "tomorrow"]
MARKETING_TEMPLATES = ["{brand}: {percent}% off! Shop now. Reply STOP to unsubscribe",
                       "{brand} Rewards: You have {points} points!", "Weekend Sale at {brand}: Up to {percent}% off"]
MARKETING_BRANDS = ["Target", "Nike", "Sephora", "Best Buy", "Macy's"]
MARKETING_PERCENTS = [20, 30, 40, 50]
ALERT_TEMPLATES = ["Appointment reminder: {service} tomorrow at {time}", "Weather Alert: {condition} expected tonight",
                   "{service} bill due: ${amount} due by {date}"]
ALERT_SERVICES = ["Dentist", "Doctor"]
ALERT_TIMES = ["2pm", "10am"]
ALERT_CONDITIONS = ["Rain", "Snow"]
ALERT_AMOUNTS = [50, 100]
ALERT_DATES = ["Friday", "Monday"]


def _pick(values, idx):
    """``values[idx % len(values)]`` as a column (0-based ``idx``)."""
    return F.element_at(F.array(*[F.lit(str(v)) for v in values]), (idx % len(values)).cast("int") + 1)


def _fill(template, fields: dict):
    for k, v in fields.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def _every_template(index: DataFrame, col: str, families: dict[str, tuple[list[str], dict]]) -> DataFrame:
    """(i, kind, message): each index value with each template of each family,
    the fields filled by the family's rules. A generator (one ``explode`` of a
    literal array per row), not a join, so it scales with the index table."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, (templates, _) in families.items() for t in templates])
    x = index.select(F.col(col).cast("long").alias("i"), F.explode(rows).alias("r")).select("i", "r.kind", "r.t")
    message = None
    for k, (_, fields) in families.items():
        filled = _fill(F.col("t"), fields)
        message = F.when(F.col("kind") == k, filled) if message is None else message.when(F.col("kind") == k, filled)
    return x.select("i", "kind", message.alias("message"))


def a2p_messages(index: DataFrame, col: str = "i") -> DataFrame:
    """Legitimate A2P messages generated from an index column: every
    template of the 2FA (with every service), transactional, marketing and
    alert families for every index; fields are picked by ``i mod n``."""
    i = F.col("i")
    families = {
        "2fa": ([t.replace("{service}", s) for t in OTP_TEMPLATES for s in OTP_SERVICES],
                {"code": F.substring((F.lit(100000) + (i * 13) % 900000).cast("string"), 1, 6)}),
        "transactional": (TRANS_TEMPLATES, {
            "service": _pick(TRANS_SERVICES, i), "order": (F.lit(10000) + i).cast("string"),
            "amount": F.concat((F.lit(10) + i % 90).cast("string"), F.lit(".00")),
            "person": _pick(TRANS_PEOPLE, i), "date": _pick(TRANS_DATES, i)}),
        "marketing": (MARKETING_TEMPLATES, {
            "brand": _pick(MARKETING_BRANDS, i), "percent": _pick(MARKETING_PERCENTS, i),
            "points": (F.lit(100) + i * 10).cast("string")}),
        "alerts": (ALERT_TEMPLATES, {
            "service": _pick(ALERT_SERVICES, i), "time": _pick(ALERT_TIMES, i), "condition": _pick(ALERT_CONDITIONS, i),
            "amount": _pick(ALERT_AMOUNTS, i), "date": _pick(ALERT_DATES, i)}),
    }
    x = _every_template(index, col, families)
    return x.select("i", "message", F.lit("ham").alias("label"), F.lit("a2p_synthetic").alias("source"),
                    F.concat(F.lit("a2p_"), F.col("kind")).alias("dataset"), F.lit("high").alias("quality"),
                    F.col("kind").alias("a2p_type"), F.lit(False).alias("is_smishing"))


# FIXED VALUES: threat / ham fallback templates and their field lists.
SPAM_TEMPLATES = [
    "URGENT! Free entry in 2 a weekly competition to win FA Cup final tkts",
    "XXXMobileMovieClub: To use your credit, click the WAP link",
    "Free msg: Txt: CALL to No: 86888 & claim your reward of 3 hours",
    "SIX chances to win CASH! From 100 to 20,000 pounds txt> CSH11",
    "WINNER!! As a valued network customer you have been selected",
    "Congratulations ur awarded {prize}! Collect from {url}",
    "PRIVATE! Your 2003 Account Statement for {number} shows {amount}",
    "This is the 2nd time we have tried to contact you. Call {number}",
    "{service} final notice: your subscription expires in {days} days",
    "Text WIN to {number} for your FREE gift worth £{amount}",
]
SPAM_PRIZES = ["$5000", "iPhone 15", "£1000", "iPad Pro"]
SPAM_AMOUNTS = [100, 500, 1000, 2000]
SPAM_SERVICES = ["Netflix", "Spotify", "Amazon Prime", "Disney+"]
SPAM_DAYS = [3, 7, 14, 30]
SMISHING_TEMPLATES = [
    "Your {bank} account has been {action}. Verify at {url} within 24hrs",
    "URGENT: Suspicious login from {location}. Secure account: {url}",
    "Your package delivery failed. Update address: {url}",
    "{service} Security Alert: {threat}. Click: {url}",
    "IRS: Tax refund ${amount} approved. Claim: {url}",
    "Your payment to {person} failed. Retry: {url}",
    "Final notice: Outstanding balance ${amount}. Pay: {url}",
    "Account will be closed unless you verify: {url}",
    "Unusual activity detected. Confirm identity: {url}",
    "{service}: Your account compromised. Reset password: {url}",
]
SMISHING_BANKS = ["Wells Fargo", "Chase", "Bank of America", "Citibank"]
SMISHING_ACTIONS = ["suspended", "locked", "compromised"]
SMISHING_SERVICES = ["PayPal", "Venmo", "Amazon", "Apple", "Microsoft"]
SMISHING_LOCATIONS = ["Russia", "China", "Nigeria", "Unknown Location"]
SMISHING_THREATS = ["Unauthorized access detected", "New device login", "Password change attempt"]
SMISHING_AMOUNTS = [150, 350, 500, 1200]
SMISHING_PEOPLE = ["John Smith", "Jane Doe", "Mike Johnson"]
HAM_TEMPLATES = [
    "Hey, are you free for {activity} {time}?",
    "Don't forget {item} on your way home",
    "Great job on {task}! {praise}",
    "Meeting {when} in {place}",
    "Can you pick up {items} from {place}?",
    "Reminder: {appointment} on {date} at {time}",
    "{name} called earlier. Call back when you can",
    "Thanks for {action}! Really appreciate it",
    "Running {duration} late, be there soon",
    "Left {item} at {place}, can you grab it?",
]
HAM_ACTIVITIES = ["coffee", "lunch", "dinner", "drinks", "a movie"]
HAM_TIMES = ["later", "tomorrow", "this afternoon", "tonight"]
HAM_ITEMS = ["milk", "bread", "eggs", "groceries", "my charger"]
HAM_TASKS = ["the presentation", "your report", "the meeting", "the project"]
HAM_PRAISES = ["Well done!", "Impressed!", "Great work!", "Nice!"]
HAM_WHENS = ["today", "tomorrow", "next week"]
HAM_PLACES = ["home", "the office", "the store", "your desk", "the car"]
HAM_APPOINTMENTS = ["dentist", "doctor", "haircut", "car service"]
HAM_DATES = ["Monday", "Tuesday", "tomorrow", "next week"]
HAM_NAMES = ["Mom", "Dad", "Sarah", "John", "Mike"]
HAM_ACTIONS = ["your help", "dinner", "the gift", "calling"]
HAM_DURATIONS = ["5 mins", "10 mins", "15 mins"]


def threat_messages(index: DataFrame, col: str = "i") -> DataFrame:
    """Labelled fallback messages from an index column: every spam,
    smishing and ham template for every index, fields picked by ``i mod n``.
    Smishing is folded to spam with ``is_smishing`` set, as in the corpus."""
    i = F.col("i")
    families = {
        "spam": (SPAM_TEMPLATES, {
            "prize": _pick(SPAM_PRIZES, i), "url": F.concat(F.lit("www.claim-prize"), i.cast("string"), F.lit(".com")),
            "number": F.concat(F.lit("8"), F.format_string("%04d", i)), "amount": _pick(SPAM_AMOUNTS, i),
            "service": _pick(SPAM_SERVICES, i), "days": _pick(SPAM_DAYS, i)}),
        "smishing": (SMISHING_TEMPLATES, {
            "bank": _pick(SMISHING_BANKS, i), "action": _pick(SMISHING_ACTIONS, i),
            "url": F.concat(F.lit("secure-verify"), i.cast("string"), F.lit(".xyz/login")),
            "location": _pick(SMISHING_LOCATIONS, i), "service": _pick(SMISHING_SERVICES, i),
            "threat": _pick(SMISHING_THREATS, i), "amount": _pick(SMISHING_AMOUNTS, i), "person": _pick(SMISHING_PEOPLE, i)}),
        "ham": (HAM_TEMPLATES, {
            "activity": _pick(HAM_ACTIVITIES, i), "time": _pick(HAM_TIMES, i), "item": _pick(HAM_ITEMS, i),
            "task": _pick(HAM_TASKS, i), "praise": _pick(HAM_PRAISES, i), "when": _pick(HAM_WHENS, i),
            "place": _pick(HAM_PLACES, i),
            "items": F.concat(_pick(HAM_ITEMS, i), F.lit(", "), _pick(HAM_ITEMS, i + 1)),
            "appointment": _pick(HAM_APPOINTMENTS, i), "date": _pick(HAM_DATES, i), "name": _pick(HAM_NAMES, i),
            "action": _pick(HAM_ACTIONS, i), "duration": _pick(HAM_DURATIONS, i)}),
    }
    x = _every_template(index, col, families)
    return x.select("i", "message", F.when(F.col("kind") == "smishing", F.lit("spam")).otherwise(F.col("kind")).alias("label"),
                    F.lit("fallback_expanded").alias("source"), F.lit("fallback").alias("dataset"),
                    F.lit("medium").alias("quality"), (F.col("kind") == "smishing").alias("is_smishing"))
