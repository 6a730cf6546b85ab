"""Joins, near copies, repeats, search."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from msgscreen.llm import jaccard, pstable, queries, suffixdedup, topk
from msgscreen.llm.common import FILTER_BITS, FILTER_SLICES, bit_filter, components, may_be_in
from msgscreen.llm.suffixes import hashes_of, permuted_common_prefixes, suffix_array

from .conftest import SF0001, words


def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    want = brute_components({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: r for n, r in want.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_filter(spark):
    keys = [-(1 << 63), -5, 0, 77, (1 << 63) - 1]
    table = bit_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert may_be_in(table, np.array(keys, dtype=np.int64)).all()
    assert may_be_in(table, np.arange(1000, 2000) * 7919 * 104729).sum() < 5


@pytest.fixture
def gathered(monkeypatch):
    """(rows, bytes of their binary cells) of each result that collect() brings to the driver."""
    found = []

    def collect(self, of=DataFrame.collect):
        out = of(self)
        found.append((len(out), sum(len(x) for r in out for x in r if isinstance(x, bytes | bytearray))))
        return out

    monkeypatch.setattr(DataFrame, "collect", collect)
    return found


def test_bit_filter_is_gathered_at_its_own_size(spark, gathered):
    """The driver gets slices of the table, not a row for each of its words."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # the default, with which toPandas() collects
    try:
        table = bit_filter(spark.range(20_000).select(F.xxhash64("id").alias("k")), "k")
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert gathered and max(n for n, _ in gathered) <= FILTER_SLICES and sum(size for _, size in gathered) <= table.nbytes
    keys = np.array([r.k for r in spark.range(20_000).select(F.xxhash64("id").alias("k")).collect()])
    want = np.zeros(1 << FILTER_BITS, dtype=bool)
    for spot in (keys % (1 << FILTER_BITS), (keys >> FILTER_BITS) % (1 << FILTER_BITS)):
        want[spot] = True
    assert (np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool) == want).all()


def test_shingle_levels_are_made_by_tasks(spark, rows, gathered):
    """A byte for each bucket reaches the driver, not its count; the levels are those of all counts."""
    rows = rows + [(100 + i, rows[0][1]) for i in range(50)] + [(200 + i, rows[3][1]) for i in range(20)]
    _, level = jaccard.profile(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    size = 1 << jaccard.COUNT_BITS
    assert sum(n for _, n in gathered) == size
    found = np.concatenate([jaccard.shingles(t) for _, t in rows])
    counts = np.bincount((found >> np.uint64(64 - jaccard.COUNT_BITS)).astype(np.int64), minlength=size)
    assert (level == np.log2(np.maximum(1, counts / (4 * counts.mean() + 8))).astype(np.uint8)).all() and set(level.tolist()) == {0, 1, 2}


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for i, r in brute_components(range(len(rows)), links).items():
        groups[r].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in members]
    return Counter(out), groups, sets


def test_jaccard_rows(docs, rows, none):
    want, groups, sets = brute_jaccard(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    alone = sum(len(m) for r, m in groups.items() if not sets[r])
    assert kept.count() == alone + sum(1 for r in groups if sets[r])
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_jaccard_chains_and_blocks(spark, monkeypatch):
    """Near copies of near copies, in regions cut into blocks."""
    rng = random.Random(9)
    rows, text = [], words(rng, 60).split()
    for i in range(120):
        text = list(text)
        text[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(words(rng, 30).split() + rows[0][1].split()[:20])) for i in range(40)]
    want, _, _ = brute_jaccard(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == want
    monkeypatch.setattr(jaccard, "REGION_DOCS", 10)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == want


def test_region_recursion():
    """Cells of pivots find what a comparison of all pairs finds."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(20):
        base = rng.choice(1 << 40, 50, replace=False)
        for _ in range(15):
            s = base.copy()
            s[rng.integers(0, 50, rng.integers(0, 9))] = rng.integers(1 << 41, 1 << 42, 1)
            sets.append(np.unique(s).astype(np.uint64))
    region = jaccard.Region(sets)
    region.join(np.arange(len(sets)))
    py = [set(s.tolist()) for s in sets]
    links = [(i, j) for i in range(len(py)) for j in range(i) if 100 * len(py[i] & py[j]) >= 80 * len(py[i] | py[j])]
    assert {i: region.forest.root(i) for i in range(len(py))} == brute_components(range(len(py)), links)


def test_op9(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op9_jaccard(spark, SF0001).collect())) == brute_jaccard(rows)[0]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(150):
        text = [rng.randint(1, rng.randint(1, 5)) for _ in range(rng.randint(1, 60))] * rng.choice([1, 1, 3]) + [0]
        array = suffix_array(np.array(text, dtype=np.uint16))
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = permuted_common_prefixes(np.array(text, dtype=np.uint16), array)
        for a, b in zip(array[:-1].tolist(), array[1:].tolist(), strict=True):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def brute_repeats(rows, length=200):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(hash(b[i:i + length]) for i in range(len(b) - length + 1))
    out = []
    for key, t in rows:
        b, covered, done = (t or "").encode(), None, 0
        covered = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[hash(b[i:i + length])] > 1:
                covered[max(i, done):i + length] = True
                done = i + length
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out.append((key, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_rows(docs, rows, none):
    out = suffixdedup.deduplicate(docs)
    got = Counter((r.doc_id, r["cut"].n_bytes, r["cut"].n_removed, r["cut"].n_spans, hashlib.sha256(r["cut"].kept).hexdigest()) for r in out.collect())
    assert got == brute_repeats(rows)
    cut = suffixdedup.cut_text(docs)
    assert cut.columns == docs.columns and cut.where("text IS NULL").count() == sum(t is None for _, t in rows)
    assert cut.where("doc_id = 0").first().text == "" and suffixdedup.deduplicate(none).count() == 0


def test_repeats_in_blocks(spark, monkeypatch):
    """One passage in many documents, its anchors' contexts cut into blocks; periodic text."""
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 15)} {passage} {words(rng, 15)}") for i in range(60)] + [(99, "ab" * 500), (98, "xyz" * 70), (97, passage[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 20, 2000):
        monkeypatch.setattr(suffixdedup, "SHARD_BYTES", size)
        got = suffixdedup.deduplicate(df).collect()
        assert Counter((r.doc_id, r["cut"].n_bytes, r["cut"].n_removed, r["cut"].n_spans, hashlib.sha256(r["cut"].kept).hexdigest()) for r in got) == brute_repeats(rows)


def test_contexts_that_all_came_more_than_once_are_not_sorted(spark, monkeypatch):
    rng, kept, stash = random.Random(6), {}, suffixdedup.stash
    monkeypatch.setattr(suffixdedup, "stash", lambda df, tag: kept.setdefault(tag, stash(df, tag)))
    copies = [(i, t) for i, t in enumerate([words(rng, 80) for _ in range(5)] * 3)]
    near = copies[0][1]
    for rows, sorts in ((copies, False), ([*copies, (20, near[:300] + "!" + near[300:])], True)):
        kept.clear()
        got = suffixdedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r["cut"].n_bytes, r["cut"].n_removed, r["cut"].n_spans, hashlib.sha256(r["cut"].kept).hexdigest()) for r in got) == brute_repeats(rows)
        marked = kept["repeat-marked"].count()
        assert kept["repeat-distinct"].count() > marked and (marked > 0) == sorts


def test_texts_whose_sums_agree_share_nothing(spark):
    """Two texts of blocks that swap two bytes by the parity of the index's bits: sums of powers of any odd number agree."""
    rng = np.random.default_rng(8)
    pool = rng.integers(97, 123, 200_000, dtype=np.uint8)
    total, inverse = hashes_of(pool)
    h = (total[32:] - total[:-32]) * inverse[:len(pool) - 31]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    gram = pool[h.argmin():][:32].tobytes()  # the anchor of every string that holds it
    middles = [rng.integers(97, 123, 31, dtype=np.uint8).tobytes() for _ in range(128)]

    def text(odd):
        return b"".join(gram + m + bytes([48 + (i.bit_count() + odd) % 2]) for i, m in enumerate(middles)) + gram

    parts = [suffixdedup.contexts(text(x)) for x in (0, 1)]
    assert [len(p[0]) for p in parts] == [1, 1] and parts[0][0] == parts[1][0] and (parts[0][1] != parts[1][1]).any()
    assert all(len(text(x)) == 8224 for x in (0, 1))
    rows = [(1, text(0).decode()), (2, text(1).decode())]
    got = suffixdedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r["cut"].n_bytes, r["cut"].n_removed, r["cut"].n_spans, hashlib.sha256(r["cut"].kept).hexdigest()) for r in got) == brute_repeats(rows)


def test_op5(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op5_suffixdedup(spark, SF0001).collect())) == brute_repeats(rows)


def make_vectors(n=300, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n - 4, 6):
        x[i + 1] = x[i] + rng.normal(size=d) * 0.05
        x[i + 2] = x[i] * 3
        x[i + 3] = x[i]
    out = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * d, [-0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0], [1.0, 2.0]]
    return out + [(1000 + i, v) for i, v in enumerate(bad)] + [out[0], out[0], (None, out[5][1])]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicate_vectors(spark, monkeypatch):
    rows = make_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    ok = [i for i, (_, v) in enumerate(rows) if fine(v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    links = [(i, j) for i in ok for j in ok if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 - 1e-12]
    degree, groups = Counter(x for p in links for x in p), defaultdict(list)
    for i, r in brute_components(range(len(rows)), links).items():
        groups[r].append(rows[i][0])
    root = brute_components(range(len(rows)), links)
    want = Counter()
    for i, (key, _) in enumerate(rows):
        least = min((x for x in groups[root[i]] if x is not None), default=None)
        want[key, degree[i], least, key is not None and key == least] += 1
    assert Counter(map(tuple, pstable.near_duplicates(df).collect())) == want
    monkeypatch.setattr(pstable, "BLOCK", 3)
    assert Counter(map(tuple, pstable.near_duplicates(df).collect())) == want
    assert pstable.near_duplicates(df.where("false")).count() == 0


def test_hash_probability():
    """Pairs at a cosine of just 0.95 share a bucket nearly always, unrelated ones nearly never."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * o
    ha, hb = pstable.bucket_names(list(a)), pstable.bucket_names(list(b))
    assert np.mean([bool(set(x) & set(y)) for x, y in zip(ha, hb, strict=True)]) > 0.95
    assert np.mean([bool(set(x) & set(y)) for x, y in zip(ha, ha[1:], strict=False)]) < 0.02


@pytest.mark.parametrize("stripes", [None, (7, 3)])
def test_top_k(spark, monkeypatch, stripes):
    if stripes:
        monkeypatch.setattr(topk, "CANDIDATE_STRIPE", stripes[0])
        monkeypatch.setattr(topk, "QUERY_STRIPE", stripes[1])
    rows = make_vectors(60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("rank", F.lit(0))
    rows = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if fine(v)]
    want = Counter()
    for i, (q, x) in enumerate(rows):
        if q is not None and q % 10 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), c is None, c or 0) for j, (c, y) in enumerate(rows) if j != i))
            want.update((q, n, None if no else c, -s) for n, (s, no, c) in enumerate(scored[:5], 1))
    assert Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 3"), F.col("vec_id") >= 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (None, [9.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, None, 589_824), (0, 2, 1, 196_608), (0, 3, 1, 131_072)]


def test_a_worker_keeps_one_operators_caches():
    from msgscreen.llm.common import hold

    dropped = []
    hold("a", lambda: dropped.append("a"))
    hold("a", lambda: dropped.append("again"))
    assert dropped == []
    hold("b")
    hold("a")
    assert dropped == ["a"]
