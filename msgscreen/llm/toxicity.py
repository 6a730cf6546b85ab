"""Operator 8: toxicity by compression distance to two zstandard dictionaries.

Training, on a bounded sample of labelled rows without near copies: the
ordinary dictionary is trained on the words of ordinary documents; the toxic
one on the windows (words) that toxic documents have significantly more often.
A window is one word in small letters and a fixed tail that both dictionaries
hold, so that compressed lengths differ by the word alone. Each window costs
some bytes with the ordinary dictionary and some with the toxic one; how often
each pair of costs occurs in toxic and in ordinary training documents gives the
pair its weight (a log odds ratio, zero where chance may explain it), and so a
threshold on the toxic cost for each ordinary cost.

The evidence of a stretch of text is the highest weight of its windows, the next
two, and how many windows it has (long stretches meet more chances); a logistic
curve fitted to the training documents turns it into a score. Whole texts are
scored, each on its own: a text's score is that of its most toxic stretch of
``STRETCH`` words, each of which overlaps the next by half, so a toxic passage
counts the same in a long text as in a short one.

Defined cases: a null or empty text has no window, no evidence and the lowest
score; without labelled rows of both classes every score is 0; letters of any
script count, long words are cut into overlapping windows; repeated rows get
equal scores; other columns are kept.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.chunks import Generations
from msgscreen.llm.common import free_name, hold, small_batches
from msgscreen.llm.labelled import remainder, sample

#: Labelled rows that training may read, by class.
TRAINING_ROWS = {0: 4000, 1: 1500}
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 8_192
#: Log likelihood ratios (chi-square, one degree): a word sets toxic documents apart; a pair of costs does.
WORD_EVIDENCE, PAIR_EVIDENCE = 20.0, 10.0
THRESHOLD = 0.5
#: Both dictionaries start with it and every window ends with it; compressors don't look for matches in a block's last bytes.
TAIL = " the of and that this with from have were which their there would"
_GUARD = bytes(range(1, 17))
LONGEST, OVERLAP, COSTS = 32, 16, 41
#: Shorter texts count as so many windows: without evidence they are not suspicious.
FEWEST = 32
#: Words of a stretch.
STRETCH = 600
_LETTERS = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    out = []
    for word in _LETTERS.findall(text.lower()):
        if len(word) <= LONGEST:
            out.append(word)
        else:
            out += [word[i:i + LONGEST] for i in range(0, len(word) - OVERLAP, LONGEST - OVERLAP)]
    return out


def likelihood_ratio(a: float, b: float, n: int, m: int) -> float:
    """G of a of n against b of m; 0 unless the first share is the larger."""
    if not n or not m or a * m <= b * n:
        return 0.0
    p = (a + b) / (n + m)
    part = lambda k, of: (k * math.log(k / of / p) if k else 0.0) + ((of - k) * math.log((1 - k / of) / (1 - p)) if k < of else 0.0)
    return 2 * (part(a, n) + part(b, m))


def without_near_copies(texts: list[str]) -> list[str]:
    """Texts whose four smallest hashes of three words in a row are all new: copies would pass for evidence."""
    seen: set = set()
    out = []
    for text in texts:
        words = windows(text)
        grams = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
        marks = [(seed, min(xxhash.xxh64_intdigest(g, seed=seed) for g in grams)) for seed in range(4)]
        if not any(m in seen for m in marks):
            out.append(text)
        seen.update(marks)
    return out


def trained(words: list[str], size: int) -> bytes:
    """A zstandard dictionary of text blocks; the text itself where there is too little to train on."""
    blocks = [(" " + " ".join(words[i:i + 12]) + " ").encode() for i in range(0, len(words), 12)]
    whole = b"".join(blocks)
    if len(whole) > 8 * size:
        return zstandard.train_dictionary(size, blocks, k=48, d=8).as_bytes()
    return whole[-size:]


@dataclass
class Model:
    """The two dictionaries, the weight of each pair of costs, and the curve; ``weight(word)`` is kept per worker."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros((COSTS, COSTS)))
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -50.0]))

    def __post_init__(self):
        self.tools = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def _tools(self):
        if self.tools is None:
            level = zstandard.ZstdCompressionParameters.from_level(
                3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=8, chain_log=15, hash_log=15, window_log=16, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=False, write_dict_id=False, write_checksum=False)
            both = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(TAIL.encode() + x + _GUARD, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                             compression_params=level) for x in (self.ordinary, self.toxic)]
            self.tools = both, [len(c.compress(TAIL.encode())) for c in both]
        return self.tools

    def costs(self, word: str) -> tuple[int, int]:
        both, empty = self._tools()
        window = f" {word}{TAIL}".encode()
        a, b = (min(COSTS - 1, max(0, len(c.compress(window)) - e)) for c, e in zip(both, empty, strict=True))
        return a, b

    def chunk_weight(self, chunk: str) -> float:
        return max((float(self.weights[self.costs(w)]) for w in windows(chunk)), default=0.0)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence @ self.curve[:-1] + self.curve[-1])))


def evidence_of(weights: list[float]) -> list[float]:
    top = sorted(weights, reverse=True)[:3] if len(weights) < 64 else np.sort(np.partition(weights, len(weights) - 3)[-3:])[::-1].tolist()
    return [top[0] if top else 0.0, sum(top[1:]), math.log1p(max(len(weights), FEWEST))]


def evidence_of_stretches(weights: list[float]) -> np.ndarray:
    """A row of evidence for each stretch of a text."""
    n, half = len(weights), STRETCH // 2
    if n <= STRETCH:
        return np.array([evidence_of(weights)])
    blocks = np.zeros((-(-n // half), half))
    blocks.ravel()[:n] = weights
    top = np.partition(blocks, half - 3, axis=1)[:, -3:]
    top = np.sort(np.hstack([top[:-1], top[1:]]), axis=1)[:, :-4:-1]
    held = np.minimum(STRETCH, n - half * np.arange(len(top)))
    return np.column_stack([top[:, 0], top[:, 1] + top[:, 2], np.log1p(np.maximum(held, FEWEST))])


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and shift of a logistic curve, by Newton steps with a little shrinkage."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, design.T @ (p - y) + 0.05 * w), -3, 3)
    return w


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model of labelled texts (1: toxic)."""
    bad = without_near_copies([t for t, y in zip(texts, toxic, strict=True) if y == 1])
    good = without_near_copies([t for t, y in zip(texts, toxic, strict=True) if y == 0])
    if not bad or not good:
        return Model(b"", b"")
    in_bad, in_good = Counter(w for t in bad for w in set(windows(t))), Counter(w for t in good for w in set(windows(t)))
    telling = sorted(((likelihood_ratio(c, in_good[w], len(bad), len(good)), w) for w, c in in_bad.items()))
    telling = [w for g, w in telling if g >= WORD_EVIDENCE]
    rng = random.Random(1)
    apart = set(telling)
    spoken = [w for w, c in in_good.items() for _ in range(c) if w not in apart]
    rng.shuffle(spoken)
    model = Model(trained(spoken, ORDINARY_BYTES), trained(telling, TOXIC_BYTES))

    known: dict[str, tuple[int, int]] = {}
    found = []
    for group in (bad, good):
        count = np.zeros((COSTS, COSTS))
        for t in group:
            pairs = set()
            for w in set(windows(t)):
                if w not in known:
                    known[w] = model.costs(w)
                pairs.add(known[w])
            for p in pairs:
                count[p] += 1
        found.append(count)
    for p in zip(*np.nonzero(found[0]), strict=True):
        a, b = found[0][p], found[1][p]
        if likelihood_ratio(a, b, len(bad), len(good)) >= PAIR_EVIDENCE:
            model.weights[p] = math.log((a + 0.5) / (len(bad) + 1)) - math.log((b + 0.5) / (len(good) + 1))
    chunk = {}
    evidence = []
    for t in bad + good:
        for c in t.split():
            if c not in chunk:
                chunk[c] = model.chunk_weight(c)
        evidence.append(evidence_of([chunk[c] for c in t.split()]))
    model.curve = fit_curve(np.array(evidence), np.array([1.0] * len(bad) + [0.0] * len(good)))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with the column ``into``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("toxicity")
        m = shared.value
        cache = Generations(lambda chunks: [m.chunk_weight(c) for c in chunks], 150_000)
        for batch in batches:
            evidence = [evidence_of_stretches(cache.get(x.split()) if isinstance(x, str) else []) for x in batch]
            if evidence:
                first = np.cumsum([0] + [len(e) for e in evidence[:-1]])
                yield pd.Series(np.maximum.reduceat(m.scores(np.concatenate(evidence)), first), dtype="float64")
            else:
                yield pd.Series([], dtype="float64")

    return docs.withColumn(into, of(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on labelled rows whose crc32(id) mod 5 is not 0."""
    rows = sample(docs, labels, "toxic", remainder("key", 5) != 0, TRAINING_ROWS, doc_id, text)
    return train(rows["text"].tolist(), rows["y"].tolist())


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    scored = score(docs.select(F.col(doc_id), F.col(text)), fit(docs, labels, doc_id, text), text)
    return scored.select(F.col(doc_id), (remainder(doc_id, 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not toxic, as they were."""
    name = free_name(docs, "toxicity")
    return score(docs, fit(docs, labels, doc_id, text), text, name).where(F.col(name) < THRESHOLD).select(*docs.columns)
