"""Operator 9: exact n-gram Jaccard join as a join in a metric space.

Distance is one minus the Jaccard similarity of two documents' sets of word
shingles, a metric; two documents link within ``1 - 80/100``.

Most documents lie at distance 1 from nearly every other, where pivots chosen
at random tell nothing apart. Regions are therefore made of what documents
share. Let ``s(n)`` be a tenth of ``n``. Two linked documents share ``s`` (that of
the smaller) of their first ``n - ceil(0.8 n) + s(n)`` shingles, in any order
fixed for all (here: commoner shingles later, by a table of counts of fixed
size). Documents that hold a shingle so are put in order of size and parted
where the next is more than 100/80 times larger, which is farther than a link
reaches; of each part the document of the smallest signature is the pivot, and a
pivot's Voronoi region are the documents that met it at any shingle. A document
in ``k`` regions that met one's pivot at fewer than ``s / k`` shingles leaves that
region: what two linked documents share, spread over the regions that hold both,
is that much in one of them. So each linked pair still meets in a region.

A region is joined recursively: several pivots, distances of all documents to
them, each document to the cell of its nearest pivot, and by the triangle
inequality also to each cell whose pivot is at most ``2 x 0.2`` farther than
the nearest. A cell that is small or no longer shrinks is joined by counting
shared shingles; pairs already connected are not compared again. Regions beyond
``REGION_DOCS`` or ``REGION_SHINGLES`` are cut into blocks, and each pair of
blocks is joined by a task of its own. Only a spanning forest of links leaves a
region, so a group of copies costs edges in proportion to its size.

Equal sets are one document throughout (64-bit signatures of 64-bit shingle
hashes). Nothing is capped and no candidate is dropped.

Defined cases: words are runs of bytes other than blank, tab, line ends and
feeds, A-Z in small letters; with one to four words the whole sequence is one
shingle; without words or text the set is empty and links with nothing; a null
id takes no part in the choice of the smallest id; repeated rows link; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import bit_filter, components, hold, may_be_in, runs, small_batches, spread_blocks, stash

WORDS = 5
#: Link where 100 * shared >= PERCENT * union.
PERCENT = 80
#: Linked documents share at least one in so many of their shingles among their first ones.
SHARED = 10
#: Bits of the table of shingle counts, which has this size whatever the input.
COUNT_BITS = 21
#: Documents and shingles that one task may join at once.
REGION_DOCS, REGION_SHINGLES = 4096, 2_000_000
LEAF, PIVOTS = 64, 8
_SLICES = 32
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for i in range(WORDS):
        h = (h ^ w[i:i + n]) * _C[i]
        h ^= h >> np.uint64(31)
    return np.unique(h)


def signature(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + max(1, n // SHARED)


def text_hash(text: str):
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0).cast("long"))


def profile(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, n_shingles, signature) of each row, and how common shingles are: a level for each count bucket."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    size = 1 << COUNT_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("jaccard", _hashes.clear)
        counts = np.zeros(size, np.int64)
        for batch in batches:
            sets = [shingles(x) for x in batch["text"]]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=size)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets], "signature": [signature(s) for s in sets], "slice": -1, "counts": None})
        width = size // _SLICES
        packed = np.minimum(counts, 65535).astype(np.uint16).reshape(_SLICES, width)
        yield pd.DataFrame({"doc_id": None, "text_hash": 0, "n_shingles": packed.sum(axis=1, dtype=np.int64), "signature": 0, "slice": range(_SLICES), "counts": [x.tobytes() for x in packed]})

    rows = stash(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), text_hash(text).alias("text_hash")).mapInPandas(
        run, "doc_id string, text_hash long, n_shingles long, signature long, slice int, counts binary"), "jaccard-profile")

    slices = rows.where("slice >= 0")
    mean = (slices.agg(F.sum("n_shingles")).first()[0] or 0) / size

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["slice"], batch["counts"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.uint16).astype(np.int64)
        level = [np.log2(np.maximum(1, x / (4 * mean + 8))).astype(np.uint8).tobytes() for x in total.values()]
        yield pd.DataFrame({"slice": list(total), "level": level}, columns=["slice", "level"])

    level = np.zeros(size, np.uint8)  # a byte a bucket, its fixed size: the counts themselves stay with the tasks
    for k, raw in slices.select("slice", "counts").repartition(_SLICES, "slice").mapInPandas(levels, "slice int, level binary").collect():
        part = np.frombuffer(raw, np.uint8)
        level[k * len(part):(k + 1) * len(part)] = part
    return rows.where("slice < 0").select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "n_shingles", "signature"), level


def regions(docs: DataFrame, text: str, level: np.ndarray) -> DataFrame:
    """(signature, n_shingles, pivot): each document that meets another of its reach at one of its first shingles, and the pivots it met."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        levels = shared.value
        hold("jaccard", _hashes.clear)
        for batch in batches:
            marks, sizes, firsts = [], [], []
            for x in batch["text"]:
                found = shingles(x)
                mark = signature(found)
                if len(found) and mark not in seen:
                    seen.add(mark)
                    order = np.argsort(levels[(found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")
                    marks.append(mark)
                    sizes.append(len(found))
                    firsts.append(found[order[:prefix_length(len(found))]].view(np.int64))
            yield pd.DataFrame({"signature": np.array(marks, dtype=np.int64), "n_shingles": np.array(sizes, dtype=np.int32), "first": firsts})

    met = docs.select(F.col(text).alias("text")).mapInPandas(run, "signature long, n_shingles int, first array<long>")
    met = met.select("signature", "n_shingles", F.explode("first").alias("shingle"))
    met = met.withColumn("all", F.count("*").over(Window.partitionBy("shingle"))).where("all > 1").drop("all")
    by_size = Window.partitionBy("shingle").orderBy("n_shingles", "signature")
    beyond = F.coalesce(100 * F.lag("n_shingles").over(by_size) < PERCENT * F.col("n_shingles"), F.lit(False))
    met = met.withColumn("beyond", beyond).withColumn("part", F.sum(F.col("beyond").cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    at = Window.partitionBy("shingle", "part")
    met = met.withColumn("pivot", F.min("signature").over(at)).withColumn("last", F.max("signature").over(at))
    met = met.where("pivot < last").groupBy("signature", "n_shingles", "pivot").agg(F.count("*").alias("met"))
    own = Window.partitionBy("signature")
    least = F.greatest(F.lit(1), F.floor(F.ceil(PERCENT * F.col("n_shingles") / 100) / SHARED))
    met = met.withColumn("total", F.sum("met").over(own)).withColumn("regions", F.count("*").over(own))
    return stash(met.where((F.col("total") >= least) & (F.col("met") * F.col("regions") >= least)).select("signature", "n_shingles", "pivot"), "jaccard-regions")


def live_sets(docs: DataFrame, text: str, live: DataFrame) -> DataFrame:
    """(signature, shingles) of the documents in ``live`` and of a few others."""
    table = bit_filter(live, "signature")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("jaccard", _hashes.clear)
        bitmap, seen = shared.value, set()
        for batch in batches:
            found = [shingles(x) for x in batch["text"]]
            signatures = np.array([signature(x) for x in found], dtype=np.int64)
            marks, sets = [], []
            for k in np.flatnonzero(may_be_in(bitmap, signatures)).tolist():
                mark = int(signatures[k])
                if len(found[k]) and mark not in seen:
                    seen.add(mark)
                    marks.append(mark)
                    sets.append(found[k].tobytes())
            yield pd.DataFrame({"signature": np.array(marks, dtype=np.int64), "shingles": sets})

    return docs.select(F.col(text).alias("text")).mapInPandas(run, "signature long, shingles binary")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        r = self.root(i)
        for j in others.tolist():
            s = self.root(j)
            if s != r:
                r, s = min(r, s), max(r, s)
                self.up[s] = r


class Region:
    """Documents of one region as rows of a sparse table, joined in memory."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        _, flat = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = flat
        self.forest = Forest(len(sets))

    def tokens(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i]:self.starts[i + 1]]

    def shared_with(self, i: int, rows: np.ndarray) -> np.ndarray:
        """How many shingles of row i each of ``rows`` has."""
        mine = np.zeros(int(self.flat.max()) + 1, dtype=np.int64)
        mine[self.tokens(i)] = 1
        return np.array([int(mine[self.tokens(j)].sum()) for j in rows.tolist()], dtype=np.int64)

    def linked(self, i: int, rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return rows[100 * shared >= PERCENT * (self.sizes[i] + self.sizes[rows] - shared)]

    def join(self, rows: np.ndarray) -> None:
        if len(rows) <= LEAF:
            return self.join_leaf(rows)
        step = max(1, len(rows) // PIVOTS)
        pivots = rows[::step][:PIVOTS]
        distance = np.empty((len(pivots), len(rows)))
        for k, p in enumerate(pivots.tolist()):
            shared = self.shared_with(p, rows)
            self.forest.join(p, self.linked(p, rows, shared))
            distance[k] = 1 - shared / (self.sizes[p] + self.sizes[rows] - shared)
        cells = distance <= distance.min(axis=0) + 2 * (1 - PERCENT / 100) + 1e-9
        done = []
        for k in range(len(pivots)):
            inside = rows[cells[k]]
            if any(len(inside) == len(d) and (inside == d).all() for d in done):
                continue
            done.append(inside)
            if len(inside) > 0.8 * len(rows):
                return self.join_leaf(rows)
        for inside in done:
            self.join(inside)
        return None

    def join_leaf(self, rows: np.ndarray) -> None:
        """Count shared shingles of each row with all others; one component, the largest, need not ask."""
        if len(rows) < 2:
            return
        flat = np.concatenate([self.tokens(i) for i in rows.tolist()])
        owner = np.repeat(np.arange(len(rows)), self.sizes[rows])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        words, ends = flat[begin], np.concatenate([begin[1:], [len(flat)]])
        roots = np.array([self.forest.root(i) for i in rows.tolist()])
        names, count = np.unique(roots, return_counts=True)
        silent = names[count.argmax()] if count.max() > 1 else -1
        for i in rows[roots != silent].tolist():
            at = np.searchsorted(words, self.tokens(i))
            lists = [owner[a:b] for a, b in zip(begin[at].tolist(), ends[at].tolist(), strict=True) if b - a > 1]
            if lists:
                shared = np.bincount(np.concatenate(lists), minlength=len(rows))
                near = np.flatnonzero(shared)
                self.forest.join(i, self.linked(i, rows[near], shared[near]))


def join_regions(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that span each region's groups; ``members`` (signature, n_shingles, pivot), ``sets`` (signature, shingles)."""
    spark = members.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / REGION_DOCS), F.ceil(F.sum("n_shingles") / REGION_SHINGLES)).cast("int")
    members = members.join(members.groupBy("pivot").agg(blocks.alias("blocks")), "pivot")
    members = spread_blocks(members, "blocks", "signature").select("pivot", "i", "j", "signature")
    sets = sets.dropDuplicates(["signature"])
    full = members.join(sets, "signature").select("pivot", "i", "j", "signature", "shingles")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in runs(batches, ["pivot", "i", "j"]):
            if len(group) > 1:
                region = Region([np.frombuffer(x, np.uint64) for x in group["shingles"]])
                region.join(np.arange(len(group)))
                marks = group["signature"].to_numpy()
                roots = np.array([region.forest.root(k) for k in range(len(group))])
                linked = np.flatnonzero(roots != np.arange(len(group)))
                if len(linked):
                    yield pd.DataFrame({"a": marks[linked], "b": marks[roots[linked]]})

    small_batches(spark)
    return full.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "signature").mapInPandas(run, "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component): a row per row; ``component`` names groups, null without words."""
    small_batches(docs.sparkSession)
    rows, level = profile(docs, doc_id, text)
    members = regions(docs, text, level)
    live = members.select("signature").distinct()
    edges = join_regions(members, live_sets(docs, text, live))
    found = components(edges, "jaccard").withColumnRenamed("node", "signature")
    full = rows.where("n_shingles > 0").join(found, "signature", "left").withColumn("component", F.coalesce("component", "signature"))
    full = stash(full.select("doc_id", "text_hash", "n_shingles", "component"), "jaccard-result")
    least = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return full.join(least, "component").select("doc_id", "text_hash", "n_shingles", "component", "component_id").unionByName(empty)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that link with none and, of each component, one row of the smallest id, as they were."""
    found = stash(join(docs, doc_id, text), "jaccard-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    chosen = found.where("component IS NOT NULL").groupBy("component").agg(first.alias("c")).select("c.doc_id", "c.text_hash", F.lit(False).alias("each"))
    chosen = chosen.unionByName(found.where("component IS NULL").select("doc_id", "text_hash", F.lit(True).alias("each")).distinct())
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("each").alias("_each"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_own"), text_hash(text).alias("_own_hash"))
    kept = rows.join(chosen, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")))
    nth = F.row_number().over(Window.partitionBy("_own", "_own_hash").orderBy(F.lit(0)))
    kept = kept.withColumn("_nth", nth).where("_each OR _nth = 1")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
