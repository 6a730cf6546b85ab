"""Operator 5: removal of passages that repeat, by suffix arrays of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
elsewhere, in whatever document. Strings are judged on the input.

Which strings can meet: each string of ``LENGTH`` bytes has an anchor, its
``GRAM``-byte substring of the smallest hash, and equal strings have equal
anchors. A run of successive strings with one anchor value is a context, the
text from the run's first byte to its last string's end. A string that repeats
stands in contexts of one anchor value; where that value has a single context,
with a single anchor, nothing repeats; where every context of the value came more
than once, all their strings repeat. All other contexts are dealt to shards by
anchor value, equal contexts once with their count. Each shard is one text, its
suffixes are sorted by induced sorting, and permuted common prefixes of
``LENGTH`` or more with a neighbour mark the strings that repeat; strings of a
context that came more than once repeat by its count. An anchor value whose
contexts exceed ``SHARD_BYTES`` is cut into blocks, a shard for each pair.

Contexts of one anchor value are named by a 128-bit hash of their bytes, whole
texts by a 64-bit hash; the comparison of strings in a shard is exact.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep all;
matches never cross documents; repeated rows repeat each other; removed bytes
may split characters (``cut_text`` drops what is left of such); other columns are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.common import bit_filter, free_name, hold, may_be_in, runs, small_batches, spread_blocks, stash
from msgscreen.llm.suffixes import hashes_of, permuted_common_prefixes, suffix_array

LENGTH, GRAM = 200, 32
SHARD_BYTES = 1 << 20
#: What tells contexts apart: anchor value and name.
CONTEXT = ["anchor", "context", "other"]


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor value, name, first string, strings, whether the anchor value stands at several places) of each context.

    The anchor value is a sum that may agree for different substrings, which only lets their contexts meet; the name,
    two columns, is a 128-bit hash of the context's bytes."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    width = length - gram + 1
    total, inverse = hashes_of(np.frombuffer(text, np.uint8))
    h = (total[gram:] - total[:-gram]) * inverse[:len(text) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    n = len(h)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(down[:n - width + 1], up[width - 1:n])
    same = least[1:] == least[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    strings = np.diff(np.concatenate([first, [len(least)]]))
    # an anchor value that leaves or enters within its run stands at another place too
    leaves = (h[:len(least)] == least) & np.concatenate([same, [False]])
    enters = (h[width - 1:] == least) & np.concatenate([[False], same])
    several = np.logical_or.reduceat(leaves | enters, first)
    view, stop = memoryview(text), first + strings - 1 + length
    names = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    return least[first].view(np.int64), np.frombuffer(names, np.int64).reshape(-1, 2), first, strings, several


def repeats(texts: list[bytes], strings: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context the runs of its strings that also start elsewhere in ``texts``."""
    sizes = np.array([len(t) + 1 for t in texts])
    start = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.zeros(int(start[-1]) + 1, dtype=np.uint16)
    whole[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    whole[:-1] += 2
    whole[start[1:] - 1] = 1
    array = suffix_array(whole)
    shared = permuted_common_prefixes(whole, array, breaks=1, enough=length + int(sizes.max()))
    long = shared >= length
    long[array[:-1]] |= shared[array[1:]] >= length
    out = []
    for a, n in zip(start[:-1].tolist(), strings, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], long[a:a + n].astype(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def named(docs: DataFrame, text: str) -> DataFrame:
    """(_row: the other columns, _text: the text or empty, _name: its hash)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c != text]).alias("_row"), whole.alias("_text"), F.xxhash64(whole).alias("_name"))


def passing(names: DataFrame, table: np.ndarray):
    shared = names.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(name: pd.Series) -> pd.Series:
        return pd.Series(may_be_in(shared.value, name.to_numpy(dtype=np.int64)))

    return test


def repeated_runs(docs: DataFrame, text: str) -> DataFrame:
    """(_name, runs): for each text its runs (from, to) of strings that repeat."""
    rows = named(docs.select(text), text).select("_name", "_text")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("suffixdedup")
        seen: dict[int, int] = {}
        for batch in batches:
            out = []
            for name, x in zip(batch["_name"].tolist(), batch["_text"], strict=True):
                seen[name] = seen.get(name, 0) + 1
                if seen[name] <= 2:  # a third copy in a task tells nothing more
                    anchor, context, first, strings, several = contexts(x.encode())
                    out.append((name, anchor, context[:, 0], context[:, 1], first << 32 | strings << 1 | several))
            yield pd.DataFrame(out, columns=["_name", *CONTEXT, "place"])

    found = rows.where(F.octet_length("_text") >= LENGTH).mapInPandas(find, "_name long, anchor array<long>, context array<long>, other array<long>, place array<long>")
    found = found.select("_name", F.explode(F.arrays_zip(*CONTEXT, "place")).alias("x")).select("_name", "x.*")
    found = found.withColumn("all", F.count("*").over(Window.partitionBy("anchor")))
    found = stash(found.where("all > 1 OR place % 2 = 1").drop("all"), "repeat-contexts")

    one = found.groupBy(*CONTEXT).agg(F.count("*").alias("copies"), F.min(F.struct("_name", "place")).alias("at"))
    size = F.shiftright("at.place", 1).bitwiseAND(F.lit(0x7FFFFFFF)) + LENGTH
    of_anchor = Window.partitionBy("anchor")
    one = one.withColumns({"bytes": F.sum(size).over(of_anchor), "least": F.min("copies").over(of_anchor)})
    one = stash(one.select(*CONTEXT, "copies", "at._name", "at.place", "least", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int").alias("blocks")), "repeat-distinct")
    # where all contexts of an anchor value came more than once, each string repeats and there is nothing to sort
    strings = F.shiftright("place", 1).bitwiseAND(F.lit(0x7FFFFFFF))
    settled = one.where("least > 1").select(*CONTEXT, F.array(F.lit(0).cast("long")).alias("from"), F.array(strings).alias("to"))
    one = one.where("least = 1")

    wanted = one.groupBy("_name").agg(F.collect_list(F.struct(*CONTEXT, "copies", "place", "blocks")).alias("cuts"))
    test = passing(one, bit_filter(one.select("_name").distinct(), "_name"))
    texts = rows.where(test("_name")).groupBy("_name").agg(F.first("_text").alias("_text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, cuts in zip(batch["_text"], batch["cuts"], strict=True):
                raw = x.encode()
                for c in cuts:
                    a, n = c["place"] >> 32, c["place"] >> 1 & 0x7FFFFFFF
                    out.append((c["anchor"], c["context"], c["other"], c["copies"], n, c["blocks"], raw[a:a + n - 1 + LENGTH]))
            yield pd.DataFrame(out, columns=[*CONTEXT, "copies", "strings", "blocks", "bytes"])

    pieces = texts.join(wanted, "_name").select("_text", "cuts").mapInPandas(cut, "anchor long, context long, other long, copies long, strings long, blocks int, bytes binary")
    total = one.agg(F.sum(strings + LENGTH)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    pieces = spread_blocks(pieces, "blocks", "context")
    lot = F.when(F.col("blocks") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    pieces = pieces.withColumn("split", F.col("blocks") > 1).withColumn("shard", lot)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in runs(batches, ["split", "shard", "i", "j"]):
            spans = repeats(group["bytes"].tolist(), group["strings"].tolist())
            out = [(*c, [(0, n)] if k > 1 else s) for *c, n, k, s in zip(*(group[x] for x in CONTEXT), group["strings"], group["copies"], spans, strict=True) if s or k > 1]
            yield pd.DataFrame([(*c, [x for x, _ in s], [y for _, y in s]) for *c, s in out], columns=[*CONTEXT, "from", "to"])

    marked = (pieces.select("split", "shard", "i", "j", *CONTEXT, "copies", "strings", "bytes").repartition("split", "shard", "i", "j")
              .sortWithinPartitions("split", "shard", "i", "j", *CONTEXT).mapInPandas(sort, "anchor long, context long, other long, from array<long>, to array<long>"))
    marked = stash(marked, "repeat-marked").unionByName(settled)
    hits = found.join(marked, CONTEXT).select("_name", "place", F.explode(F.arrays_zip("from", "to")).alias("x"))
    base = F.shiftright("place", 32)
    hits = hits.select("_name", (base + F.col("x.from")).alias("from"), (base + F.col("x.to")).alias("to")).distinct()
    return stash(hits.groupBy("_name").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs")), "repeat-runs")


def cut_out(text: bytes, found) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go and in how many runs."""
    spans: list[list[int]] = []
    for r in found:
        a, b = r["from"], r["to"] - 1 + LENGTH
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), sum(b - a for a, b in spans), len(spans)


def deduplicate(docs: DataFrame, text: str = "text", into: str = "cut", as_text: bool = False) -> DataFrame:
    """The rows without their text, with ``into``: struct of kept, n_bytes, n_removed and n_spans.

    ``kept`` is binary, or with ``as_text`` a string without the broken
    characters at cuts. No task runs more than one Python function."""
    spark = docs.sparkSession
    small_batches(spark)
    found = repeated_runs(docs, text)
    test = passing(docs, bit_filter(found.select("_name"), "_name"))
    rows = named(docs, text).withColumn("_hit", test("_name"))
    none, kind = F.lit(0).cast("long"), "string" if as_text else "binary"
    whole = rows.where("NOT _hit").select("_row", F.struct(F.col("_text").cast(kind).alias("kept"), F.octet_length("_text").cast("long").alias("n_bytes"),
                                                           none.alias("n_removed"), none.alias("n_spans")).alias("_cut"))

    @F.pandas_udf(f"struct<kept: {kind}, n_bytes: long, n_removed: long, n_spans: long>")
    def cut(texts: pd.Series, runs_of: pd.Series) -> pd.DataFrame:
        raw = [x.encode() for x in texts]
        done = [cut_out(x, [] if r is None else r) for x, r in zip(raw, runs_of, strict=True)]
        kept = [d[0].decode(errors="ignore") if as_text else d[0] for d in done]
        return pd.DataFrame({"kept": kept, "n_bytes": [len(x) for x in raw], "n_removed": [d[1] for d in done], "n_spans": [d[2] for d in done]})

    touched = rows.where("_hit").select("_row", "_text", "_name").join(found, "_name", "left").select("_row", cut("_text", "runs").alias("_cut"))
    names = [c for c in docs.columns if c != text]
    return whole.unionByName(touched).select(*[F.col("_row").getField(c).alias(c) for c in names], F.col("_cut").alias(into))


def cut_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the text that is left; broken characters at cuts are dropped, a null text stays null."""
    null, into = free_name(docs, "was_null"), free_name(docs, "cut")
    out = deduplicate(docs.withColumn(null, F.col(text).isNull()), text, into, as_text=True)
    return out.withColumn(text, F.when(~F.col(null), F.col(into)["kept"])).select(*docs.columns)
