"""Shared helpers: the cluster's shared folder, cut lineage, streamed groups, components of a link graph."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A session on one machine (``local[...]``) may leave it unset and then gets
    a scratch folder; on a cluster an unset folder is an error, because a
    machine-local one would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="msgscreen-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once,
    its lineage is cut and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of a stream that is sorted by ``keys``: (key values, rows).

    Holds one group at a time; callers bound the groups' sizes beforehand.
    """
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        changed = np.zeros(len(batch), dtype=bool)
        changed[0] = True
        for v in columns:
            changed[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(changed).tolist()
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.iloc[a:b]
            key = tuple(v[a] for v in columns)
            if key != held_key and held:
                yield held_key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held_key = key
            held.append(part)
    if held:
        yield held_key, pd.concat(held) if len(held) > 1 else held[0]


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; nodes
    without an edge to another node do not appear. Alternating large-star and
    small-star rounds (Kiveris et al., 2014): each is a hash aggregation and a
    join of the edge list, each round is written to the shared folder, and the
    number of rounds grows with the logarithm of the longest path. A node with
    very many neighbours is only ever the key of a partially aggregated minimum
    and of a join that adaptive execution may split.
    """
    cur = stash(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    while True:
        # large star: every neighbour larger than u links to the smallest of u's neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        new = stash(small.where("u != v").distinct(), tag)
        # done when every node has one edge and it leads to a root
        odd = new.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
        chained = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        cur = new
        if not odd and not chained:
            break
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """At most ``rows`` rows a batch between Spark and Python: whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


#: Bits of a filter; it has this size whatever the input.
FILTER_BITS = 26
#: Parts in which it reaches the driver, and tasks that put them together.
FILTER_SLICES, FILTER_TASKS = 2048, 32


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A table of ``2 ** FILTER_BITS`` bits in which each (well mixed, long) key has set two.

    Tasks put slices of it together, so at most ``FILTER_SLICES`` rows, its own
    size, are gathered. With very many keys it lets more others pass; a join
    behind it decides.
    """
    bits = 1 << FILTER_BITS
    width = bits // 32 // FILTER_SLICES
    spots = [F.pmod(F.col(key), F.lit(bits)), F.pmod(F.shiftright(key, FILTER_BITS), F.lit(bits))]
    words = (keys.select(F.explode(F.array(*spots)).alias("bit")).select((F.col("bit") / 32).cast("int").alias("word"), (F.col("bit") % 32).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = np.zeros(bits // 32, np.uint32), np.zeros(FILTER_SLICES, dtype=bool)
        for batch in batches:
            word = batch["word"].to_numpy(dtype=np.int64)
            table[word] = batch["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
            seen[word // width] = True
        held = np.flatnonzero(seen).tolist()
        yield pd.DataFrame({"slice": held, "bits": [table[k * width:(k + 1) * width].tobytes() for k in held]}, columns=["slice", "bits"])

    slices = words.repartition(FILTER_TASKS, (F.col("word") / width).cast("int")).mapInPandas(put, "slice int, bits binary")
    table = np.zeros(bits // 32, np.uint32)
    for k, raw in slices.collect():
        table[k * width:(k + 1) * width] = np.frombuffer(raw, np.uint32)
    return table


def may_be_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have both their bits set."""
    out = np.ones(len(keys), dtype=bool)
    for spot in (keys & ((1 << FILTER_BITS) - 1), keys >> FILTER_BITS & ((1 << FILTER_BITS) - 1)):
        out &= (table[spot >> 5] >> (spot & 31).astype(np.uint32) & 1).astype(bool)
    return out


def spread_blocks(rows: DataFrame, blocks: str, block_key: str) -> DataFrame:
    """Rows of a group cut into ``blocks`` blocks, dealt to a cell (i, j) for each pair of blocks that holds theirs."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(block_key), F.col(blocks)).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return rows.withColumn("cell", F.explode(cells)).withColumns({"i": F.col("cell.i"), "j": F.col("cell.j")}).drop("cell")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first name like it that no column of ``df`` has (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_holder: dict = {"name": None, "drop": None}


def hold(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """Say at a task's start whose large caches this Python worker keeps.

    Workers outlive their tasks; when another operator's task comes, the caches
    of the one before are dropped, so a pipeline's stages don't add up."""
    if _holder["name"] != name:
        if _holder["drop"]:
            _holder["drop"]()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _holder.update(name=name, drop=drop)
