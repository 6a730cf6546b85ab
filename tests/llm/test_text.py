"""Encoding, packing, classifiers."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from msgscreen.llm import bpe, packing, quality, queries, toxicity, wordtable
from msgscreen.llm.chunks import Generations

from .conftest import SF0001, VOCABULARY, words


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_vocabulary_like_library(library):
    v, rng = bpe.vocabulary(VOCABULARY), random.Random(1)
    letters = "abcdeéèñ 's 't're'LL'd 0123!?.,-\n\t\x1c\x85 ΣİΑΣß漢字\U0001f600́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["".join(rng.choice("aabnst") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["<|startoftext|>a<|endoftext|><|endoftext|> b <|end", "a" * 3000, "'s's't", "\x00\x1f\x7f", " "]
    for t in texts:
        ids = ids_of(library, t)
        assert v.cache.ids(t) == packed(ids), t
        assert packing.library_ids(VOCABULARY).ids(t) == packed(ids), t
        assert v.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids, skip_special_tokens=False), t


def test_generations_forget_nothing_needed():
    calls = []
    g = Generations(lambda keys: calls.append(len(keys)) or [k * 2 for k in keys], 3)
    for _ in range(5):
        assert g.get([1, 2, 3, 4, 5, 1, 6]) == [2, 4, 6, 8, 10, 2, 12]
    assert g.get([]) == []


def test_encode_decode_rows(spark, docs, rows, none, library):
    out = bpe.decode(bpe.encode(docs, VOCABULARY, into="tokens"), VOCABULARY, "tokens").collect()
    want = Counter((i, packed(ids_of(library, t)), library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.tokens), r.decoded) for r in out) == want
    assert out[0]["score"] == 0 and "SHARD" in out[0].asDict()
    assert bpe.encode(none, VOCABULARY).count() == 0


def test_op7_like_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for r in queries.op7_bpe(spark, SF0001).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def want_pieces(rows, library, capacity=2048):
    out = []
    for i, t in rows:
        ids = [*ids_of(library, t), 0]
        out += [(i, n, a, len(ids[a:a + capacity]), zlib.crc32(packed(ids[a:a + capacity]))) for n, a in enumerate(range(0, len(ids), capacity))]
    return Counter(out)


def check_packing(out, want, capacity=2048):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in out) // capacity)


def test_packing_rows(docs, rows, none, library):
    out = packing.pack(packing.pieces(docs, VOCABULARY)).collect()
    used, least = check_packing(out, want_pieces(rows, library))
    assert used <= least + 2
    assert packing.pack(packing.pieces(none, VOCABULARY)).count() == 0
    with_ids = packing.pieces(docs, VOCABULARY, with_ids=True).where("doc_id = 0").first()
    assert zlib.crc32(bytes(with_ids.ids)) == with_ids.ids_crc32


def test_op6(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    used, least = check_packing(queries.op6_packing(spark, SF0001).collect(), want_pieces(rows, library))
    assert used <= 1.02 * least + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(rng.choice([1, 30, 3000])))
    plan = packing.plan(dict(counts), 100)
    held = Counter()
    for config, times in plan:
        assert times > 0 and sum(k * v for k, v in config.items()) <= 100
        held += Counter({k: v * times for k, v in config.items()})
    assert held == counts
    best_fit = len(packing.best_fit(Counter(counts), 100))
    assert sum(t for _, t in plan) <= best_fit * 1.03 + 1


@pytest.mark.parametrize("counts", [{700: 1_000_000}, {3 * x: 2_000 + x for x in range(1, 683, 20)}, {1030: 1_000_000, 340: 2_000_000},
                                    {x: 300 for x in range(1025, 2048)}], ids=["one length", "multiples of 3", "two lengths", "over half"])
def test_plan_goes_on_where_no_sequence_fills(counts, monkeypatch):
    placed, best_fit_counted = [], packing.best_fit_counted
    monkeypatch.setattr(packing, "best_fit_counted", lambda left, capacity: placed.append(sum(left.values())) or best_fit_counted(left, capacity))
    plan = packing.rounded(counts)
    held = Counter()
    for config, times in plan:
        assert times > 0 and sum(k * v for k, v in config.items()) <= packing.CAPACITY
        held += Counter({k: v * times for k, v in config.items()})
    assert held == counts
    assert sum(placed) <= min(packing.REST_SHARE * sum(counts.values()), packing.REST_PIECES)
    assert sum(t for _, t in plan) <= 1.01 * sum(t for _, t in best_fit_counted(counts, packing.CAPACITY)) + 1


def lognormal(n, seed=1):
    rng = np.random.default_rng(seed)
    return Counter(np.clip(rng.lognormal(6.2, 1.0, n).astype(int), 2, 2048).tolist())


@pytest.mark.parametrize("counts", [lognormal(12_000), lognormal(60_000) + Counter({700: 30_000}), lognormal(60_000) + Counter({1100: 20_000}),
                                    Counter(np.random.default_rng(3).integers(500, 1501, 50_000).tolist()), Counter(np.random.default_rng(4).integers(600, 1001, 50_000).tolist())],
                         ids=["mixed", "half of 700", "a third of 1100", "500 to 1500", "600 to 1000"])
def test_plan_is_never_above_best_fit(counts):
    plan = packing.plan(counts)
    held = Counter()
    for config, times in plan:
        assert times > 0 and sum(k * v for k, v in config.items()) <= packing.CAPACITY
        held += Counter({k: v * times for k, v in config.items()})
    assert held == counts
    used, best = packing.sequences(plan), packing.sequences(packing.best_fit_counted(counts, packing.CAPACITY))
    assert packing.least_sequences(counts) <= used <= best


def test_lower_bound():
    assert packing.least_sequences({}) == 0 and packing.least_sequences({2048: 7}) == 7
    assert packing.least_sequences({1025: 10, 3: 4}) == 10 and packing.least_sequences({1024: 10}) == 5
    assert abs(packing.least_sequences({700: 1000}) - 500) < 1e-6  # two in a sequence


def test_texts_together_have_the_ids_of_each(rows):
    cache = packing.library_ids(VOCABULARY)
    texts = [t or "" for _, t in rows] + ["<|endoftext|> a", "a\x1cb"]
    assert cache.ids_of(texts) == [cache.ids(t) for t in texts]


def test_word_table_like_library(library, monkeypatch):
    """Long words, long texts cut into blocks, and a table that forgets."""
    rng = random.Random(9)
    letters = "aabcdEÉèñẖßİ 's 't're'LL 0123!?.,-\n\t\x00\x01\x1c\x7f\x85\xa0Σς漢字\U0001f600́̇"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["H\u0331 h\u0331 I\u0307 K\u212a A\u030a", "a'b'c'd", "x" * 24 + " " + "x" * 25 + " " + "X" * 25, "é" * 12 + " " + "é" * 13, "ab " * 500 + "c" * 3000, "", " ", "\u00a0", "'"]
    texts += ["<|endoftext|>", "a<|startoftext|>B, <|endoftext|>\x00 c", words(rng, 3000)]
    want = [packed(ids_of(library, t)) for t in texts]
    monkeypatch.setattr(wordtable.blocks, "__defaults__", (100,))
    for kept in (1, 200, 1_000_000):
        table = packing.library_ids.__wrapped__(VOCABULARY, kept)
        got = table.ids_of(texts) + [i for n in range(0, len(texts), 7) for i in table.ids_of(texts[n:n + 7])]
        assert got == want * 2
        assert table.young.n + table.old.n > 0 and (kept > 200 or table.old.n > 0)


def test_a_word_is_encoded_once(library):
    """Whatever its case and what stands beside it."""
    table, asked = packing.library_ids.__wrapped__(VOCABULARY), []
    encode = table.encode
    table.encode = lambda new: asked.extend(new) or encode(new)
    texts = ["Winding, WINDING (winding)", "winding. Winding7 ...winding,", "7 winding"]
    for _ in range(2):
        assert table.ids_of(texts) == [packed(ids_of(library, t)) for t in texts]
    assert sorted(asked) == sorted([b"winding", b",", b"(", b")", b".", b"7", b"..."])


def plain_best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - length)
    return sorted(rooms)


def test_best_fit_places_equal_pieces_together():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.choice([1, 5, 40])))
        counts = Counter({k: v * rng.randint(1, 9) for k, v in counts.items()})
        got = packing.best_fit(counts, 40)
        assert sorted(40 - sum(k * v for k, v in b.items()) for b in got) == plain_best_fit(counts, 40)
        assert sum(got, Counter()) == counts
    many = packing.best_fit_counted({700: 10**12, 300: 10**12 + 1}, 2048)
    assert len(many) <= 6 and sum((Counter({k: v * t for k, v in c.items()}) for c, t in many), Counter()) == {700: 10**12, 300: 10**12 + 1}


def test_knapsack_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 12, 4))
        prices, limits = rng.random(len(lengths)), rng.integers(1, 5, len(lengths))
        got = packing.knapsack(prices, lengths, limits, 20)
        best = -1.0
        for counts in np.ndindex(*(limits + 1)):
            if np.dot(counts, lengths) == 20:
                best = max(best, float(np.dot(counts, prices)))
        price = sum(prices[list(lengths).index(k)] * v for k, v in got.items())
        assert (not got and best < 0) or abs(price - best) < 1e-9


def test_word_hashes_know_words():
    buckets = quality.features(b"ab cd ab  ab\tcd")
    assert len(buckets[0]) == 5 and buckets[0][0] == buckets[0][2] == buckets[0][3] and buckets[0][1] == buckets[0][4]
    assert buckets[1][2] == quality.features(b"zz zz")[1][0]  # a word next to itself, whatever the word
    assert [len(x) for x in quality.features(b"")] == [0, 0, 0, 0]
    long = b"word and other " * 200_000
    assert b"".join(quality.pieces(long)) == long and max(map(len, quality.pieces(long))) <= quality.PIECE


def labelled(spark, bad):
    rng, out = random.Random(3), []
    for i in range(400):
        text = words(rng, rng.randrange(20, 200))
        y = int(rng.random() < 0.4)
        out.append((i, bad(text, rng) if y else text, y))
    docs = spark.createDataFrame([x[:2] for x in out] + [(1000, None), (1001, ""), (None, "w w"), (0, out[0][1])], "doc_id long, text string")
    return docs.withColumn("score", F.lit("mine")), out


def test_quality_learns(spark):
    docs, rows = labelled(spark, lambda t, rng: "!! ".join(t.upper().split()))
    labels = spark.createDataFrame([(i, 1 - y, 0) for i, _, y in rows] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(out[i].predicted, 1 - y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([a == b for a, b in held]) > 0.95 and 0 <= out[1001].score <= 1 and out[1000].score == out[1001].score
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.first()["score"] == "mine"
    assert {r.predicted for r in quality.classify(docs, labels.where("false")).collect()} == {1}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_toxicity_learns(spark):
    def insult(text, rng):
        w = text.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["blockheads", "nitwitted", "scoundrel", "grumbler"]))
        return " ".join(w)

    docs, rows = labelled(spark, insult)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert out[1000].predicted == out[1001].predicted == 0 and out[1000].score == out[1001].score
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {toxicity.Model(b"", b"").scores(np.array([[0, 0, 3.5]]))[0]}
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def plain_score(model, text):
    """The score by its definition, one stretch and one word after the other."""
    words = [max([float(model.weights[model.costs(w)]) for w in toxicity.windows(c)], default=0.0) for c in text.split()]
    half, best = toxicity.STRETCH // 2, 0.0
    starts = [0] if len(words) <= toxicity.STRETCH else range(0, len(words) - half, half)
    for a in starts:
        part = words[a:a + toxicity.STRETCH]
        top = sorted(part, reverse=True)[:3]
        x = [top[0] if top else 0.0, sum(top[1:]), np.log1p(max(len(part), toxicity.FEWEST))]
        best = max(best, 1 / (1 + np.exp(-(np.dot(model.curve[:-1], x) + model.curve[-1]))))
    return best


def test_toxic_passages_count_in_long_texts(spark):
    """As the plain scorer; a toxic text within 20,000 and 200,000 clean characters is found as often as alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    known = docs.join(labels, "doc_id").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0").select("text", "toxic").dropDuplicates(["text"]).collect()
    toxic = [r.text for r in sorted(known) if r.toxic == 1 and len(r.text) < 3000]
    clean = [w for r in sorted(known) if r.toxic == 0 for w in r.text.split()]
    rng, texts = random.Random(3), []
    for n in (0, 3500, 33_000):
        for t in toxic:
            a = rng.randrange(len(clean) - n)
            at = rng.randrange(n + 1)
            texts.append(" ".join([*clean[a:a + at], t, *clean[a + at:a + n]]))
    texts += [" ".join(clean[i * 5000:(i + 1) * 5000 + 33]) for i in range(20)] + [" ".join(clean[:n]) for n in (599, 600, 601, 899, 900, 901, 1200)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(rows, model).orderBy("doc_id").collect()]
    assert np.allclose(got, [plain_score(model, t or "") for t in texts], atol=1e-12)
    n = 3 * len(toxic)
    found = (np.array(got[:n]).reshape(3, -1) >= toxicity.THRESHOLD).mean(axis=1)
    assert found[0] > 0.75 and all(f >= 0.9 * found[0] for f in found[1:]), found
    assert np.mean(np.array(got[n:n + 20]) >= toxicity.THRESHOLD) <= 0.1


def test_windows_cover_long_words():
    word = "abcdefghij" * 10
    parts = toxicity.windows(word.upper() + " 12 x-y")
    assert parts[-2:] == ["x", "y"] and all(len(p) <= toxicity.LONGEST for p in parts)
    assert parts[0] == word[:32] and parts[-3].endswith(word[-4:])


def test_op2_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((queries.op2_quality, "quality", 0.95), (queries.op8_toxicity, "toxic", 0.9)):
        out = query(spark, sf)
        assert out.count() == 1000
        held = [r for r in out.collect() if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id][label] for r in held]) > least
