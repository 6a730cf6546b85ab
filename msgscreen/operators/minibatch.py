"""M3 by mini-batch descent: the fine-tuning rules, distributed.

A linear text classifier over hashed tokens is trained as the reference
fine-tunes its model: epochs of mini-batches in a shuffled order, AdamW with a
linear warm-up and linear decay, the loss on the validation split every
``eval_every`` steps, a stop after ``patience`` evaluations without a better
loss, and the best evaluation's weights as the result.

A step is a Spark job over its batch: every task sums its rows' gradients into
one vector per hashed token, Spark adds the tasks' vectors up, and the sum (at
most ``DIMS`` numbers) updates the weights, which the next step broadcasts. The
training rows are written once, a folder a batch, so that a step reads only its
own rows. A batch is ``rows / steps`` rows: with more data the
batches grow, not their number.

Rows are dealt to batches by a hash of their id and the seed, epochs visit the
batches in orders of their own; both depend on the seed alone, so a run can be
repeated. Null messages take no part; an unlabelled row counts as ham.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Hashed tokens; the last weight is the bias.
DIMS = 1 << 16


@dataclass(frozen=True)
class Rules:
    """The schedule. ``steps``: batches of an epoch."""

    epochs: int = 3
    steps: int = 40
    rate: float = 0.05
    warm_up: int = 10
    decay: float = 0.01
    eval_every: int = 10
    patience: int = 3
    seed: int = 42

    @property
    def total(self) -> int:
        return self.epochs * self.steps

    def rate_at(self, step: int) -> float:
        """Learning rate of a step (from 1): up to ``rate`` over the warm-up, then down to 0 at the end."""
        if step <= self.warm_up:
            return self.rate * step / self.warm_up
        return self.rate * (self.total - step) / max(1, self.total - self.warm_up)

    def order(self, epoch: int) -> list[int]:
        return np.random.default_rng((self.seed, epoch)).permutation(self.steps).tolist()


@dataclass
class Adam:
    """AdamW on the driver: three vectors of ``DIMS + 1`` numbers."""

    decay: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMS + 1))
    first: np.ndarray = field(default_factory=lambda: np.zeros(DIMS + 1))
    second: np.ndarray = field(default_factory=lambda: np.zeros(DIMS + 1))
    steps: int = 0

    def update(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        mean, spread = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.999**self.steps)
        shrunk = self.weights * (1 - rate * self.decay)
        shrunk[DIMS] = self.weights[DIMS]  # the bias does not decay
        self.weights = shrunk - rate * mean / (np.sqrt(spread) + 1e-8)


class Stopper:
    """Keeps the best weights and counts evaluations without a better loss."""

    def __init__(self, patience: int):
        self.patience, self.best, self.weights, self.waited = patience, float("inf"), None, 0

    def seen(self, loss: float, weights: np.ndarray) -> tuple[bool, bool]:
        """(better than before, time to stop)."""
        if loss < self.best:
            self.best, self.weights, self.waited = loss, weights, 0
            return True, False
        self.waited += 1
        return False, self.waited >= self.patience


def features(rows: DataFrame, text: str = "message") -> DataFrame:
    """Adds ``tokens``, the distinct hashed tokens of the lower-cased text."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")
    return rows.withColumn("tokens", F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(DIMS)).cast("int")))))


def _scores(tokens: pd.Series, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, flat tokens, row of each, value of each): a row's features have length 1."""
    lengths = np.array([len(t) for t in tokens])
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in tokens]) if lengths.sum() else np.zeros(0, np.int64)
    row, value = np.repeat(np.arange(len(tokens)), lengths), np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths)
    z = np.bincount(row, weights[flat] * value, minlength=len(tokens)) + weights[DIMS]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))), flat, row, value


def _loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _gradient(batch: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(sum of gradients, sum of losses, rows) of a batch."""
    sent = batch.sparkSession.sparkContext.broadcast(weights)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros(DIMS + 1), 0.0, 0
        for f in frames:
            if not len(f):
                continue
            y = f["y"].to_numpy()
            p, flat, row, value = _scores(f["tokens"], sent.value)
            total[:DIMS] += np.bincount(flat, (p - y)[row] * value, minlength=DIMS)
            total[DIMS] += (p - y).sum()
            loss, n = loss + _loss(p, y).sum(), n + len(f)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": np.concatenate([at, [-1, -2]]), "value": np.concatenate([total[at], [loss, n]])})

    sums = batch.select("tokens", "y").mapInPandas(task, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    sent.destroy()
    known = sums.set_index("at")["value"]
    gradient = np.zeros(DIMS + 1)
    inner = known[known.index >= 0]
    gradient[inner.index] = inner.to_numpy()
    return gradient, float(known.get(-1, 0.0)), int(known.get(-2, 0))


def _mean_loss(rows: DataFrame, weights: np.ndarray) -> float:
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"loss": [_loss(_scores(f["tokens"], sent.value)[0], f["y"].to_numpy()).sum()], "n": [len(f)]})

    got = rows.select("tokens", "y").mapInPandas(task, "loss double, n long").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    sent.destroy()
    return got.loss / got.n if got.n else float("inf")


CURVE = "step long, epoch long, rate double, train_loss double, eval_loss double, better boolean, stopped boolean"


@dataclass
class Trained:
    weights: np.ndarray
    curve: list[tuple]

    def predict(self, rows: DataFrame, model: str = "hashed_linear", text: str = "message", id_col: str = "message_id") -> DataFrame:
        """(id, model, label, confidence) of each row with a message."""
        sent = rows.sparkSession.sparkContext.broadcast(self.weights)

        @F.pandas_udf("double")
        def spam(tokens: pd.Series) -> pd.Series:
            return pd.Series(_scores(tokens, sent.value)[0])

        p = features(rows.where(F.col(text).isNotNull()), text).select(id_col, spam("tokens").alias("_p"))
        return p.select(id_col, F.lit(model).alias("model"), F.when(F.col("_p") >= 0.5, "spam").otherwise("ham").alias("label"),
                        F.greatest("_p", 1 - F.col("_p")).alias("confidence"))


def prepare(split_df: DataFrame, rules: Rules, text: str = "message", id_col: str = "message_id") -> DataFrame:
    """(tokens, y, split, batch), each batch in a few partitions (more with more shuffle partitions)."""
    rows = features(split_df.where(F.col(text).isNotNull() & F.col("split").isin("train", "val")), text)
    rows = rows.select("tokens", F.coalesce((F.col("label") == "spam").cast("double"), F.lit(0.0)).alias("y"), "split",
                       F.pmod(F.xxhash64(F.col(id_col), F.lit(rules.seed)), F.lit(rules.steps)).cast("int").alias("batch"),
                       F.pmod(F.xxhash64(F.col(id_col), F.lit(rules.seed + 1)), F.lit(_parts(split_df))).alias("_part"))
    return rows.repartition("split", "batch", "_part").drop("_part")


def _parts(df: DataFrame) -> int:
    """Files of a batch, read side by side."""
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)


def train(split_df: DataFrame, rules: Rules = Rules(), text: str = "message", id_col: str = "message_id", path: str | None = None) -> Trained:
    """Train on ``split`` train, evaluate on val; ``path`` (else a scratch path) takes the prepared rows."""
    spark, path = split_df.sparkSession, path or scratch_path(split_df.sparkSession, "batches")
    prepare(split_df, rules, text, id_col).write.mode("overwrite").partitionBy("split", "batch").parquet(path)
    rows = spark.read.schema("tokens array<int>, y double, split string, batch int").parquet(path)
    learn, held = rows.where("split = 'train'"), rows.where("split = 'val'")
    adam, stopper, curve, step = Adam(rules.decay), Stopper(rules.patience), [], 0
    for epoch in range(rules.epochs):
        for batch in rules.order(epoch):
            step += 1
            total, loss, n = _gradient(learn.where(F.col("batch") == batch), adam.weights)
            if n:
                adam.update(total / n, rules.rate_at(step))
            if step % rules.eval_every and step != rules.total:
                continue
            held_loss = _mean_loss(held, adam.weights)
            better, stop = stopper.seen(held_loss, adam.weights)
            curve.append((step, epoch, rules.rate_at(step), loss / n if n else None, held_loss, better, stop))
            if stop:
                return Trained(stopper.weights, curve)
    return Trained(stopper.weights if stopper.weights is not None else adam.weights, curve)
