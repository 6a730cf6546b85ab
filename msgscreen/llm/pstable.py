"""Operator 3: near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length one, where a cosine of 0.95 or more is a distance
of at most sqrt(0.1). A hash is ``PROJECTIONS`` random (normal, so 2-stable)
projections, each shifted at random and cut into steps of ``WIDTH``; ``TABLES``
such hashes bucket each vector. At a cosine of just 0.95 two vectors share a
bucket with probability 0.99, at 0.97 with more than 0.999; of unrelated vectors
some 2 in a million share a given table's bucket.

Equal vectors count as one with copies. Of the vectors in a bucket that of the
smallest name is the pivot, and all that met one pivot in whatever bucket form a
region, so that copies meet once and not in each table. Regions, in blocks of
``BLOCK`` vectors and a task for each pair of blocks, are compared by exact
cosines in double precision; what leaves them is a spanning forest of links.
Links are then counted, again by exact cosines, among all vectors of a connected
component, block by block. No pair leaves a task.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing; vectors of different lengths don't link; repeated
rows link with each other; a row with a null id has links, counts as a link of
others and is never the smallest of a component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import components, runs, spread_blocks, stash

THRESHOLD = 0.95
TABLES, PROJECTIONS, WIDTH = 64, 12, 1.26
SEED = 7
BLOCK = 2048


@lru_cache(maxsize=8)
def projections(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimensions])
    return rng.normal(size=(dimensions, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_names(vectors: list) -> list[list[int]]:
    """A 64-bit name for each vector's bucket in each table."""
    out: list[list[int]] = [[] for _ in vectors]
    lengths = np.array([len(v) for v in vectors])
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        lines, shift = projections(d)
        steps = np.floor((unit([vectors[i] for i in at]) @ lines + shift) / WIDTH).astype("<i4").reshape(len(at), TABLES, PROJECTIONS)
        for i, row in zip(at.tolist(), steps, strict=True):
            out[i] = [xxhash.xxh3_64_intdigest(row[t].tobytes(), seed=t * 65536 + d) - (1 << 63) for t in range(TABLES)]
    return out


def forest(x: np.ndarray) -> np.ndarray:
    """For each row the first row of its connected component by links."""
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for a in range(0, len(x), 512):
            near = x[a:a + 512] @ x.T >= THRESHOLD
            new[a:a + 512] = np.minimum(new[a:a + 512], np.where(near, label, len(x)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def spanning_links(vectors: DataFrame) -> DataFrame:
    """(a, b): links that connect what is connected; ``vectors`` (node, vector)."""

    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "buckets": bucket_names(batch["vector"].tolist())})

    met = vectors.mapInPandas(hash_all, "node long, buckets array<long>").select("node", F.explode("buckets").alias("bucket"))
    at = Window.partitionBy("bucket")
    met = met.withColumn("pivot", F.min("node").over(at)).withColumn("last", F.max("node").over(at))
    members = stash(met.where("pivot < last").select("node", "pivot").distinct(), "pstable-regions")
    members = members.join(members.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "pivot")
    full = spread_blocks(members, "blocks", "node").join(vectors, "node").select("pivot", "i", "j", "node", "vector")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in runs(batches, ["pivot", "i", "j"]):
            nodes = group["node"].to_numpy()
            lengths = group["vector"].map(len).to_numpy()
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                first = forest(unit([group["vector"].iloc[k] for k in rows]))
                linked = np.flatnonzero(first != np.arange(len(rows)))
                yield pd.DataFrame({"a": nodes[rows[linked]], "b": nodes[rows[first[linked]]]})

    return full.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "node").mapInPandas(link, "a long, b long")


def count_links(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """(node, linked): copies of other vectors that each vector links with; ``found`` (node, component)."""
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    full = spread_blocks(found.join(sizes, "component"), "blocks", "node").join(vectors, "node")
    full = full.select("component", "i", "j", "block", "node", "vector", "copies")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, i, j), group in runs(batches, ["component", "i", "j"]):
            x, copies, nodes = unit(group["vector"].tolist()), group["copies"].to_numpy(), group["node"].to_numpy()
            near = x @ x.T >= THRESHOLD
            np.fill_diagonal(near, False)
            if i != j:
                near &= group["block"].to_numpy()[:, None] != group["block"].to_numpy()[None, :]
            yield pd.DataFrame({"node": nodes, "linked": near @ copies})

    counted = full.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInPandas(count, "node long, linked long")
    return counted.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.withColumn("vector", F.when(F.coalesce(fine, F.lit(False)), F.transform("vector", lambda x: x + 0.0)))
    v = v.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    unique = v.where("node IS NOT NULL").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    unique = stash(unique, "pstable-vectors")
    found = stash(components(spanning_links(unique.select("node", "vector")), "pstable"), "pstable-components")
    linked = count_links(unique.select("node", "vector", "copies"), found)
    whole = unique.select("node", "copies", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    result = (whole.join(least, "component").join(linked, "node", "left")
              .select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"))
    out = v.select("vec_id", "node").join(result, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
