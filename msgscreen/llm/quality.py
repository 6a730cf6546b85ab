"""Operator 2: a quality classifier of supervised subword embeddings.

Features of a text are its words, its pairs of neighbouring words and its
character 3-grams and 4-grams (bytes of UTF-8, white space included), each
hashed to one of ``BUCKETS`` learned vectors. A document is the average of the
four kinds' average vectors; a softmax layer gives the classes'
probabilities. Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows.

A pair of words is hashed by the difference of the words' hashes, so a word
repeated next to itself is one feature whatever the word.

Scoring is linear in the vectors: a bucket's vector times the layer is one
number, and a text's score is the average of its features' numbers. Whole texts
are scored, in pieces of bounded size.

Defined cases: a null or empty text has no feature and gets the layer's
constant; without labelled rows of both classes every score is 1 (nothing is
rejected); repeated rows get equal scores; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.common import free_name, hold, small_batches
from msgscreen.llm.labelled import remainder, sample

#: Labelled rows that training may read, by class.
TRAINING_ROWS = {0: 1500, 1: 2500}
BUCKETS, DIMENSIONS = 1 << 15, 8
EPOCHS, RATE = 12, 4.0
THRESHOLD = 0.7
#: Bytes of text whose features are computed at once.
PIECE = 1 << 20
#: A text with fewer features of a kind counts as having so many, the rest neutral: one odd pair does not condemn a line.
FEWEST = np.array([12, 12, 48, 48])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(text: bytes) -> list[np.ndarray]:
    """Bucket numbers of the text's words, pairs of words, 3-grams and 4-grams."""
    b = np.frombuffer(text, dtype=np.uint8)
    out = [_words(b)]
    words = out[0]
    out.append((_mix((words[1:] - words[:-1]) * _ODD + np.uint64(2)) % np.uint64(BUCKETS)).astype(np.int32) if len(words) else np.zeros(0, np.int32))
    out[0] = (_mix(words + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int32)
    wide = b.astype(np.uint32)
    for n in (3, 4):
        h = np.zeros(max(0, len(b) - n + 1), dtype=np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + wide[i:len(b) - n + 1 + i] + np.uint32(1) if len(h) else h
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        out.append(((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32))
    return out


def _words(b: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes above blank: polynomials by running sums, modulo 2**64."""
    solid = np.concatenate([[False], b > 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(b))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], dtype=np.uint64)])
    return (total[end] - total[start]) * inverse[start]


_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _kept or len(_kept[0]) < n:
        size = max(n, 1 << 16)
        _kept[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64)
                    for x in (_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64)))]
    return _kept[0], _kept[1]


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of at most ``PIECE`` bytes, cut at a blank where there is one."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(b" ", at, at + PIECE), text.rfind(b"\n", at, at + PIECE))
        cut = cut + 1 if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    """``value``: each bucket's share in the log odds of class 1; ``constant``: the layer's own."""

    value: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, dtype=np.float32))
    constant: float = 50.0

    def score(self, text: bytes) -> float:
        sums, counts = np.zeros(4), np.zeros(4)
        for piece in pieces(text):
            for i, f in enumerate(features(piece)):
                sums[i] += float(self.value[f].sum(dtype=np.float64))
                counts[i] += len(f)
        return float(1 / (1 + np.exp(-np.clip((sums / np.maximum(counts, FEWEST)).sum() / 4 + self.constant, -500, 500))))


def averages(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, its weight in the average), each bucket once."""
    total = np.zeros(BUCKETS, dtype=np.float64)
    parts = [features(p) for p in pieces(text)]
    for kind in range(4):
        n = sum(len(p[kind]) for p in parts)
        for p in parts:
            total += np.bincount(p[kind], minlength=BUCKETS) / (4 * max(n, FEWEST[kind]))
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def train(texts: list[str], good: list[int], seed: int = 1) -> Model:
    """A model of labelled texts (1: good); each class counts by its rows."""
    if len(set(good)) < 2:
        return Model()
    rng = np.random.default_rng(seed)
    docs = [averages(t.encode()) for t in texts]
    vectors = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, constant = np.zeros((DIMENSIONS, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    layer[:, 1] = rng.normal(0, 1, DIMENSIONS)
    layer[:, 0] = -layer[:, 1]
    truth = np.eye(2, dtype=np.float32)[np.array(good)]
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, weight = docs[i]
            rows = vectors[at]
            hidden = weight @ rows
            odds = hidden @ layer + constant
            odds = np.exp(odds - odds.max())
            error = odds / odds.sum() - truth[i]
            back = layer @ error
            layer -= 0.02 * rate * np.outer(hidden, error)
            constant -= 0.02 * rate * error
            vectors[at] = rows - (rate * 20) * weight[:, None] * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(constant[1] - constant[0]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with the column ``into``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("quality", _kept.clear)
        m = shared.value
        for batch in batches:
            yield pd.Series([m.score(x.encode() if isinstance(x, str) else b"") for x in batch], dtype="float64")

    return docs.withColumn(into, of(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on labelled rows whose crc32(id) mod 4 is not 2."""
    rows = sample(docs, labels, "quality", remainder("key", 4) != 2, TRAINING_ROWS, doc_id, text)
    return train(rows["text"].tolist(), rows["y"].tolist())


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    scored = score(docs.select(F.col(doc_id), F.col(text)), fit(docs, labels, doc_id, text), text)
    return scored.select(F.col(doc_id), (remainder(doc_id, 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of good quality, as they were."""
    name = free_name(docs, "quality")
    return score(docs, fit(docs, labels, doc_id, text), text, name).where(F.col(name) >= THRESHOLD).select(*docs.columns)
