"""Operator 6: packing token pieces into sequences by a configuration linear program.

Documents become token ids, a closing id each, cut into pieces of at most
``CAPACITY``. Only the histogram of piece lengths (at most ``CAPACITY`` rows)
reaches the driver. There the configuration program

    min  sum x_c   with   sum_c a(l, c) x_c >= n(l) for each length l,

whose variables are the ways c to fill one sequence, is solved by
multiplicative weights: a length's price is its size times a weight that starts
higher for long pieces and falls as it gets covered; a knapsack dynamic program over prices finds the best
configuration; the step takes it as often as covers ``STEP`` of the scarcest of
its lengths, rounded to whole sequences at once so that nothing is covered
twice. A pricing looks at ``PRICED`` lengths drawn by their remaining share and
at those that hold more than one in ``PRICED`` of the tokens left;
where they can't fill a sequence to the brim, at twice as many, and at last at all. Once none does, the
steps go on with the best total price at any fill; lengths that nothing left can
join are taken whole. When few pieces are left, they are placed best-fit, longest first,
equal sequences together.

The result is the better of this plan and of best-fit of all pieces, so it never
needs more sequences than best-fit; :func:`least_sequences` bounds any plan from
below. The plan has a number of configurations that grows with the logarithm of the
counts. Spark then ranks the pieces of each length (in hash ranges, no window
spans a length) and the rank alone gives sequence and offset from the plan.

Defined cases: a null or empty text is one piece with the closing id alone; a
document longer than the capacity is cut into full pieces, the last may be
shorter; repeated rows are packed each; null ids are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgscreen.llm.bpe import byte_symbols
from msgscreen.llm.chunks import BEYOND, SPLIT, chunks_of, some
from msgscreen.llm.common import hold, small_batches, stash
from msgscreen.llm.wordtable import Encoded, WordTable

CAPACITY = 2048
CLOSING_ID = 0
#: Words that a Python worker remembers, in each of two generations.
CHUNKS_KEPT = 900_000
STEP = 0.4
PRICED = 56
#: Copies of a length that a pricing of drawn lengths considers.
COPIES = 3
#: The steps end when so few pieces are left, for rounding to place.
REST_SHARE, REST_PIECES = 0.15, 12_000
#: How much more a piece of the whole capacity weighs at first than its size says.
LONG_FIRST = 8
#: How fast a length's weight falls as it gets covered.
SHARPNESS = 1.5
#: Ranges in which the pieces of one length are ranked apart.
RANGES = 1024


@lru_cache(maxsize=2)
def library_ids(path: str, kept: int = CHUNKS_KEPT) -> WordTable:
    """Ids by the tokenizers library, many new words at a time, in this thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    t = Tokenizer.from_file(path)
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}

    end = np.zeros(t.get_vocab_size(), dtype=bool)
    end[[i for x, i in t.get_vocab().items() if x.endswith("</w>")]] = True

    # the model alone, for words that are prepared here: text up to Latin, in lower case, as symbols of its bytes
    plain = Tokenizer(t.model)
    plain.pre_tokenizer = WhitespaceSplit()
    of_byte = byte_symbols()
    small = {c for x in range(0x250) for c in chr(x).lower()}  # some small forms lie beyond
    symbols = {ord(c): x for c in small - {" "} if (x := "".join(of_byte[b] for b in c.encode())) != c}

    def encode_words(text: str, words: np.ndarray) -> Encoded:
        """Words in small letters with a space between, ``words`` for each result: a word's last token, and no other, ends a word."""
        ids = np.array(plain.encode_batch_fast([text.translate(symbols)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(end[ids]) + 1])
        if len(ends) - 1 != words.sum():
            raise ValueError("the vocabulary does not end each word with a token of its own")
        borders = ends[np.concatenate([[0], np.cumsum(words)])]
        return ids, borders[:-1], np.diff(borders)

    def words_of(chunk: str) -> list[str]:
        if chunk.isalpha() and "\u0130" not in chunk:  # its small form is a letter and a mark
            return [chunk.lower()]
        return SPLIT.findall(unicodedata.normalize("NFC", chunk).lower())

    def encode(new: list[bytes]) -> Encoded:
        """Words of ASCII stand ready, other chunks are split here, those past Latin by the library."""
        ready, split, beyond = [], [], []
        for i, w in enumerate(new):
            (ready if w.isascii() and b"'" not in w else beyond if BEYOND.search(w.decode()) else split).append(i)
        parts = [(ready, encode_words(b" ".join([new[i] for i in ready]).decode(), np.ones(len(ready), np.int64)))]
        found = [[w for c in chunks_of(new[i].decode()) for w in words_of(c)] for i in split]
        parts.append((split, encode_words(" ".join([w for x in found for w in x]), np.array([len(x) for x in found], np.int64))))
        apart = [x.ids for x in t.encode_batch_fast([new[i].decode() for i in beyond], add_special_tokens=False)] if beyond else []
        counts = np.array([len(x) for x in apart], np.int64)
        parts.append((beyond, (np.array([i for x in apart for i in x], np.uint32), np.cumsum(counts) - counts, counts)))
        start, count, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), 0
        for where, (ids, first, size) in parts:
            start[where], count[where] = first + n, size
            n += len(ids)
        return np.concatenate([x[0] for _, x in parts]), start, count

    def whole(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    return WordTable(encode, whole, special, kept)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           closing: int = CLOSING_ID, with_ids: bool = False, chunks_kept: int = CHUNKS_KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids (binary): a row per piece.
    ``chunks_kept`` bounds the words that a Python worker remembers."""
    small_batches(docs.sparkSession)
    tail = np.array([closing], dtype="<u4").tobytes()

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long" + ", ids: binary" * with_ids + ">>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("packing", library_ids.cache_clear)
        cache = library_ids(path, chunks_kept)
        for batch in batches:
            out = []
            for ids in (i + tail for together in some(batch) for i in cache.ids_of(together)):
                parts = [ids[a:a + 4 * capacity] for a in range(0, len(ids), 4 * capacity)]
                out.append([{"piece": n, "start": n * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} | ({"ids": p} if with_ids else {}) for n, p in enumerate(parts)])
            yield pd.Series(out, dtype=object)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(cut(F.col(text))).alias("part")).select("doc_id", "part.*")


def knapsack(prices: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int, to_the_brim: bool = True) -> Counter:
    """Lengths, each at most ``limits`` times, that fill the capacity at the highest total price: to the brim, or none; else as far as pays."""
    best, steps, taken = np.full(capacity + 1, -np.inf if to_the_brim else 0.0), [], []
    best[0] = 0
    for i, (price, length, limit) in enumerate(zip(prices.tolist(), lengths.tolist(), limits.tolist(), strict=True)):
        left, n = min(limit, capacity // length), 1
        while left > 0:  # 1, 2, 4, ... copies at once
            n = min(n, left)
            size = n * length
            new, rest = best[:capacity + 1 - size] + n * price, best[size:]
            better = new > rest
            np.copyto(rest, new, where=better)
            steps.append((i, n, size))
            taken.append(better)
            left, n = left - n, n * 2
    at, out = capacity * bool(np.isfinite(best[capacity])), Counter()
    for (i, n, size), better in zip(reversed(steps), reversed(taken), strict=True):
        if at >= size and better[at - size]:
            out[int(lengths[i])] += n
            at -= size
    return out


def best_fit_counted(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Longest first, each into the fullest sequence that has room: (configuration, how many sequences are filled so).

    Equal sequences are filled together, all pieces of a length at once, so the
    work grows with the number of lengths and not with the pieces."""
    by_room: dict[int, list[tuple[Counter, int]]] = {}
    rooms: list[int] = []  # those of by_room, sorted

    def put(config: Counter, times: int) -> None:
        room = capacity - sum(k * v for k, v in config.items())
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((config, times))

    for length in sorted(left, reverse=True):
        n, at = left[length], bisect_left(rooms, length)
        fits = [(room, *x) for room in rooms[at:] for x in by_room[room]] + [(capacity, Counter(), n)]
        for room in rooms[at:]:
            del by_room[room]
        del rooms[at:]
        for room, config, times in fits:
            each = room // length
            whole = min(times, n // each)
            n -= whole * each
            if whole:
                put(config + Counter({length: each}), whole)
            if whole < times and n:  # less than ``each`` are left
                put(config + Counter({length: n}), 1)
                whole, n = whole + 1, 0
            if whole < times and config:
                put(config, times - whole)
    return [x for room in rooms for x in by_room[room]]


def best_fit(left: Counter, capacity: int) -> list[Counter]:
    """Each sequence of ``best_fit_counted``."""
    return [Counter(config) for config, times in best_fit_counted(left, capacity) for _ in range(times)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(configuration, how many sequences are filled so) that together hold ``counts`` pieces of each length:
    the rounded program's, or best-fit's where that needs fewer."""
    return min(rounded(counts, capacity), best_fit_counted(counts, capacity), key=sequences)


def sequences(configs: list[tuple[Counter, int]]) -> int:
    return sum(times for _, times in configs)


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> float:
    """A lower bound of any plan, from the program's dual: prices under which no configuration is worth more than 1.

    Three kinds of prices, the best counts: a piece's share of the capacity; 1 for a piece of more than half of it, and a
    half for one of just half; and steps by how many of a piece fit (1 / k for more than 1 / (k + 1) of the capacity),
    scaled by the knapsack's best configuration."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], dtype=np.float64)
    if not len(lengths):
        return 0.0
    fit = capacity // lengths
    bounds = [(n * lengths).sum() / capacity, (n * np.where(2 * lengths > capacity, 1.0, np.where(2 * lengths == capacity, 0.5, 0.0))).sum()]
    for prices in (1 / fit, np.where(fit <= 3, 1 / fit, lengths / capacity)):
        best = knapsack(prices, lengths, fit, capacity, to_the_brim=False)
        at = {x: p for x, p in zip(lengths.tolist(), prices.tolist(), strict=True)}
        worth = sum(at[k] * v for k, v in best.items())
        bounds.append((n * prices).sum() / max(worth, 1e-12))
    return float(max(bounds))


def rounded(counts: dict[int, int], capacity: int = CAPACITY, seed: int = 1) -> list[tuple[Counter, int]]:
    """The configuration program by multiplicative weights, rounded step by step."""
    out: list[tuple[Counter, int]] = []
    if counts.get(capacity):
        out.append((Counter({capacity: 1}), counts[capacity]))
    lengths = np.array(sorted(x for x in counts if x < capacity), dtype=np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
    left, rng, at = n.copy(), np.random.default_rng(seed), {x: i for i, x in enumerate(lengths.tolist())}
    to_the_brim = True
    while left.sum() > min(REST_SHARE * n.sum(), REST_PIECES):
        open_ = np.flatnonzero(left)
        alone = open_[lengths[open_] + lengths[open_[0]] > capacity]
        if len(alone):  # nothing that is left can join these
            out += [(Counter({int(lengths[i]): 1}), int(left[i])) for i in alone]
            left[alone] = 0
            continue
        share = left[open_] / n[open_]
        prices = lengths[open_] * (1 + LONG_FIRST * lengths[open_] / capacity) * np.exp(SHARPNESS * (share - share.mean()))
        tokens = left[open_] * lengths[open_]
        common = np.flatnonzero(tokens * PRICED > tokens.sum())
        config, priced = Counter(), PRICED
        while not config and priced < open_.size:
            drawn = np.union1d(rng.choice(open_.size, priced, replace=False, p=share / share.sum()), common)
            config = knapsack(prices[drawn], lengths[open_[drawn]], np.minimum(left[open_[drawn]], COPIES), capacity, to_the_brim)
            priced *= 2
        config = config or knapsack(prices, lengths[open_], left[open_], capacity, to_the_brim)
        if not config:  # what is left fills no sequence to the brim, now or later
            to_the_brim = False
            continue
        whole = min(int(left[at[k]]) // v for k, v in config.items())
        times = min(whole, max(1, int(STEP * min(left[at[k]] / v for k, v in config.items()))))
        for k, v in config.items():
            left[at[k]] -= times * v
        out.append((config, times))
    return out + best_fit_counted({int(lengths[i]): int(left[i]) for i in np.flatnonzero(left)}, capacity)


def placements(configs: list[tuple[Counter, int]]) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Rows (first rank, copies in a sequence, first sequence, offset) sorted by length and rank, and each length's rows."""
    rows, first = [], 0
    done: Counter = Counter()
    for config, times in configs:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            rows.append((length, done[length], copies, first, offset))
            done[length] += copies * times
            offset += copies * length
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    where = {int(k): (int(np.searchsorted(table[:, 0], k)), int(np.searchsorted(table[:, 0], k, side="right"))) for k in np.unique(table[:, 0])}
    return table[:, 1:], where


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    spark = parts.sparkSession
    lot = F.xxhash64("doc_id", "piece", "ids_crc32")
    parts = stash(parts.withColumn("lot", lot).withColumn("range", F.pmod("lot", F.lit(RANGES)).cast("int")), "pieces")
    by_range = stash(parts.groupBy("length", "range").agg(F.count("*").alias("c")), "piece-counts")
    histogram = {r.length: r.c for r in by_range.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most CAPACITY rows
    shared = spark.sparkContext.broadcast(placements(plan(histogram, capacity)))

    before = F.sum("c").over(Window.partitionBy("length").orderBy("range")) - F.col("c")
    here = Window.partitionBy("length", "range").orderBy("lot", "doc_id", "piece", "ids_crc32")
    ranked = (parts.withColumn("rn", F.row_number().over(here))
              .join(by_range.select("length", "range", before.alias("before")), ["length", "range"])
              .withColumn("place", (F.col("before") + F.col("rn") - 1).cast("long")).drop("lot", "range", "rn", "before"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, where = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(length), 2), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            size = int(length[group[0]])
            rows = table[slice(*where[size])]
            row = rows[np.searchsorted(rows[:, 0], rank[group], side="right") - 1]
            nth = rank[group] - row[:, 0]
            out[group, 0] = row[:, 2] + nth // row[:, 1]
            out[group, 1] = row[:, 3] + nth % row[:, 1] * size
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("at", place("length", "place")).select(*[c for c in ranked.columns if c != "place"], "at.sequence_id", "at.offset")
