"""Operator 13: hard negatives by Kronecker-packed products.

Components are quantised to integers. A block of candidates is packed dimension
by dimension: each candidate's component, biased so that it isn't negative, is
one field of a wide integer. An anchor's component (biased too) is multiplied
once with a dimension's wide integer, which multiplies it with every candidate
of the block; the products are added up, and the fields of the sum, unbiased,
are the exact inner products. Fields are as wide as the largest possible sum
needs, so none spills into its neighbour.

Two passes over cells of an anchor stripe and a candidate block. The first
selects each anchor's best rows of its own label (its positives); the second
knows the positives' scores and selects, for each, the best rows of other
labels whose score lies in its window. Every task selects from its block, Spark
merges the selections. Stripes and blocks hold a bounded number of components,
whatever the labels' sizes: no task groups rows by label.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; a vector of another length has zeros beyond its end; an
empty vector scores 0; rows that repeat an id are rows of their own, and each
is an anchor of its own if the id says so; a null id is never an anchor or
relabelled and comes last among ties; an anchor without positives, or a
positive without a fitting negative, gives no row; empty tables and tables
without anchors give none. Inner products that may exceed a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import runs, stash

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's.
LEAST, MOST = 50, 95
#: Components of a stripe or block (8 MB as longs), and rows at most.
CELL_COMPONENTS, CELL_ROWS = 1 << 20, 16384
#: Candidates in one wide integer.
FIELDS = 2048


def weights(cells: pd.Series, dims: int) -> np.ndarray:
    """The vectors as rows of a matrix, zeros beyond their ends."""
    out = np.zeros((len(cells), dims), dtype=np.int64)
    lengths = np.array([len(x) for x in cells], dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = np.concatenate([np.asarray(x, dtype=np.int64) for x in cells]) if len(cells) else 0
    return out


class Packed:
    """A block of candidates as one wide integer per dimension and ``FIELDS`` candidates."""

    def __init__(self, block: np.ndarray, anchor_low: int, anchor_high: int):
        """For anchors whose components lie from ``anchor_low`` to ``anchor_high``."""
        self.rows, self.dims = block.shape
        self.low, self.anchor_low = int(block.min(initial=0)), anchor_low
        high = int(block.max(initial=0))
        if self.dims * max(-self.low, high, 1) * max(-anchor_low, anchor_high, 1) >= 2**63:
            raise OverflowError("an inner product of these vectors may not fit a long")
        bits = (self.dims * (high - self.low) * (anchor_high - anchor_low)).bit_length()
        self.width = next(w for w in (4, 8, 16) if bits <= 8 * w)
        biased = (block - self.low).astype(np.uint64)
        self.sums = biased.sum(axis=1, dtype=np.uint64)
        self.wide = []
        for a in range(0, self.rows, FIELDS):
            part = biased[a:a + FIELDS]
            fields = np.zeros((self.dims, len(part), max(1, self.width // 8)), dtype="<u4" if self.width == 4 else "<u8")
            fields[:, :, 0] = part.T
            self.wide.append((len(part), [int.from_bytes(x.tobytes(), "little") for x in fields]))

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The anchor's inner product with each candidate."""
        biased = [int(x) - self.anchor_low for x in anchor]
        out = []
        for n, wide in self.wide:
            total = 0
            for component, packed in zip(biased, wide, strict=True):
                if component:
                    total += component * packed
            fields = np.frombuffer(total.to_bytes(n * self.width, "little"), dtype="<u4" if self.width == 4 else "<u8")
            out.append(fields[::max(1, self.width // 8)].astype(np.uint64))
        # sum (u + low) (v + anchor_low): unbiased modulo 2^64, in which the result fits
        fix = self.low * sum(biased) + self.dims * self.low * self.anchor_low
        found = np.concatenate(out) + self.sums * np.uint64(self.anchor_low % 2**64) + np.uint64(fix % 2**64)
        return found.view(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` the k with the highest scores, ties by the smaller id, rows without one last; ids are (has none, id)."""
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at, 1], ids[at, 0], -scores[at]))[:k]]


def positives_of(anchors: pd.DataFrame, block: pd.DataFrame, dims: int, k: int) -> Iterator[pd.DataFrame]:
    """Each anchor's k best rows of its own label in this block."""
    ids, rows, labels = block[["nameless", "id"]].to_numpy(dtype=np.int64), block["row"].to_numpy(), block["label"].to_numpy()
    asked = weights(anchors["vector"], dims)
    packed = Packed(weights(block["vector"], dims), int(asked.min(initial=0)), int(asked.max(initial=0)))
    places = {x: np.flatnonzero(labels == x) for x in set(anchors["label"])}
    for row, label, vector in zip(anchors["row"], anchors["label"], asked, strict=True):
        scores = packed.scores(vector)
        at = places[label]
        at = best(scores, ids, at[rows[at] != row], k)
        if len(at):
            yield pd.DataFrame({"anchor_row": row, "nameless": ids[at, 0], "id": ids[at, 1], "score": scores[at]})


def negatives_of(anchors: pd.DataFrame, block: pd.DataFrame, dims: int, k: int) -> Iterator[pd.DataFrame]:
    """For each score of an anchor's positives the k best rows of other labels within its window."""
    ids, labels = block[["nameless", "id"]].to_numpy(dtype=np.int64), block["label"].to_numpy()
    asked = weights(anchors["vector"], dims)
    packed = Packed(weights(block["vector"], dims), int(asked.min(initial=0)), int(asked.max(initial=0)))
    places = {x: np.flatnonzero(labels != x) for x in set(anchors["label"])}
    for row, label, vector, wanted in zip(anchors["row"], anchors["label"], asked, anchors["wanted"], strict=True):
        scores = packed.scores(vector)
        other = places[label]
        for positive in map(int, wanted):
            low, high = -(-LEAST * positive // 100), MOST * positive // 100
            if low > high:
                continue
            s = scores[other]
            at = best(scores, ids, other[(s >= low) & (s <= high)], k)
            if len(at):
                yield pd.DataFrame({"anchor_row": row, "positive_score": positive, "nameless": ids[at, 0], "id": ids[at, 1], "score": scores[at]})


def mine(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``relabel`` (the label to use instead, null to keep it)
    are Columns over ``vectors``.
    """
    kept = F.col(label).cast("long")
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), (kept if relabel is None else F.coalesce(relabel.cast("long"), kept)).alias("label"),
                       F.col(embedding).cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), kept.alias("given"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("given").isNotNull() & F.col("x").isNotNull() & fine)
    v = v.select(F.monotonically_increasing_id().alias("row"), F.col("id").isNull().cast("long").alias("nameless"), F.coalesce("id", F.lit(0)).alias("id"), "label", "asks", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("vector"))
    v = stash(v, "hardnegatives")
    size = v.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("vector")).alias("d")).first()
    dims = max(1, size.d or 0)
    rows = max(1, min(CELL_ROWS, CELL_COMPONENTS // dims))
    n_c, n_q = -(-size.n // rows) or 1, -(-size.q // rows) or 1
    lot = F.xxhash64("row")
    every = F.array().cast("array<long>")
    candidates = v.select(F.lit(1).alias("side"), F.pmod(lot, F.lit(n_c)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"),
                          "row", "nameless", "id", "label", "vector", every.alias("wanted"))

    def cells(anchors: DataFrame) -> DataFrame:
        asked = anchors.select(F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), F.pmod(lot, F.lit(n_q)).cast("int").alias("q"),
                               "row", "nameless", "id", "label", "vector", "wanted")
        return asked.unionByName(candidates).repartition(n_c * n_q, "c", "q").sortWithinPartitions("c", "q", "side")

    def search(select):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, cell in runs(batches, ["c", "q"]):
                anchors, block = cell[cell["side"] == 0], cell[cell["side"] == 1]
                if len(anchors) and len(block):
                    yield from select(anchors, block)
        return task

    asks = v.where("asks").withColumn("wanted", every)
    near = cells(asks).mapInPandas(search(lambda a, b: positives_of(a, b, dims, n_positives)), "anchor_row long, nameless long, id long, score long")
    order, name = [F.desc("score"), "nameless", "id"], F.when(F.col("nameless") == 0, F.col("id"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))).where(F.col("place") <= n_positives)
    near = stash(near, "positives")
    wanted = near.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_set("score").alias("wanted"))
    hard = cells(v.where("asks").join(wanted, "row")).mapInPandas(search(lambda a, b: negatives_of(a, b, dims, n_negatives)),
                                                                  "anchor_row long, positive_score long, nameless long, id long, score long")
    hard = (hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row", "positive_score").orderBy(*order))).where(F.col("rank") <= n_negatives)
            .select("anchor_row", "positive_score", "rank", name.alias("negative_id"), F.col("score").alias("negative_score")))
    pairs = near.join(v.where("asks").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row").select(
        "anchor_row", "anchor_id", name.alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(hard, ["anchor_row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
