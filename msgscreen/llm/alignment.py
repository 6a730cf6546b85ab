"""Operator 12: two tokenizers' tokens aligned by divide and conquer at shared cuts.

Both tokenizers encode the same bytes: space and text. A cut is an offset at
which a token of A and a token of B end. An interval of tokens is divided at a
cut near its middle: the middle token of A is looked up among B's ends by
bisect, then its neighbours on both sides, in steps that double, until a common
end is found. Both halves go on in the same way; an interval without a cut
inside is a leaf, one group. All intervals of one depth are looked up together.

Spaces between two words are cuts that need no search: neither tokenizer joins
a letter, a digit or a mark with a space that follows it. Words recur, so a
worker keeps the groups of words it has aligned (bounded, see ``WORDS_KEPT``;
this changes no result), and a text's groups are its words' groups in a row.

Each row's distinct links (id of A, id of B) and their number are written to
the shared folder. From there the links are counted over the corpus: summed in
each task, then by Spark. The table of counts has at most as many rows as links
occur and as the vocabularies have pairs. Up to ``TABLE_LINKS`` rows it is
broadcast and looked up by bisect; beyond, the rows' links are joined with it,
both sides salted, since the commonest link may be in every text.

Defined cases: null and empty texts, and texts whose tokens of A or of B don't
give back space and text, have no tokens: numbers are 0, groups are empty.
Special tokens' strings are plain text. Rows that repeat an id or a text are
rows of their own and each counts; a null id is kept; an empty table gives an
empty table with all columns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgscreen.llm.bpe import byte_symbols
from msgscreen.llm.chunks import Generations, some
from msgscreen.llm.common import hold, small_batches, stash

#: Words whose groups a worker keeps, in each of two generations.
WORDS_KEPT = 250_000
#: Longer words are aligned each time, so that what a worker keeps is bounded.
LONG_WORD = 256
#: Rows of the table of links that may be broadcast (16 bytes each).
TABLE_LINKS = 4_000_000
#: Links that a task sums before it hands them on.
SUMMED = 4_000_000
#: Salts of a link where the table is joined.
SALTS = 16
#: A space between two characters that are no white space.
_WORD_END = re.compile(r"(?<=\S) (?=\S)")
#: B's ids, and so links, are below this.
_RADIX = 1 << 16


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A's and in B's ascending ends of the ends they share, by divide and conquer.

    The last ends must be equal."""
    found_a, found_b = [np.array([len(ends_a) - 1])], [np.array([len(ends_b) - 1])]
    # intervals of inner ends, [low, high) in A and in B
    low_a, high_a = np.array([0]), np.array([len(ends_a) - 1])
    low_b, high_b = np.array([0]), np.array([len(ends_b) - 1])
    while len(low_a):
        middle, cut_a, cut_b = (low_a + high_a) // 2, np.full(len(low_a), -1), np.full(len(low_a), -1)
        seen, step = np.zeros(len(low_a), dtype=np.int64), 1
        open_ = np.flatnonzero((high_a > low_a) & (high_b > low_b))
        while len(open_):
            # the next ``step`` places on each side of those seen (at first: the middle and what precedes it)
            reach = np.arange(step)
            offset = seen[open_][:, None] + reach
            probes = np.concatenate([middle[open_][:, None] + offset, middle[open_][:, None] - 1 - offset], axis=1)
            inside = (probes >= low_a[open_][:, None]) & (probes < high_a[open_][:, None])
            ends = ends_a[np.where(inside, probes, 0)]
            at = np.searchsorted(ends_b, ends)
            hit = inside & (ends_b[np.minimum(at, len(ends_b) - 1)] == ends)
            # of several the one nearest to the middle
            distance = np.where(hit, np.concatenate([reach, reach + 0.5])[None, :], np.inf)
            nearest = distance.argmin(axis=1)
            row = np.arange(len(open_))
            got = hit[row, nearest]
            cut_a[open_[got]], cut_b[open_[got]] = probes[row, nearest][got], at[row, nearest][got]
            seen[open_] += step
            open_ = open_[~got & inside.any(axis=1)]
            step = min(2 * step, max(1, 4_000_000 // max(1, len(open_))))
        cut = np.flatnonzero(cut_a >= 0)
        found_a.append(cut_a[cut])
        found_b.append(cut_b[cut])
        low_a, high_a = np.concatenate([low_a[cut], cut_a[cut] + 1]), np.concatenate([cut_a[cut], high_a[cut]])
        low_b, high_b = np.concatenate([low_b[cut], cut_b[cut] + 1]), np.concatenate([cut_b[cut], high_b[cut]])
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligner:
    """Both tokenizers, their tokens' bytes, and the groups of words seen before."""

    def __init__(self, path_a: str, path_b: str, kept: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: n for n, c in enumerate(byte_symbols())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        if self.b.get_piece_size() > _RADIX:
            raise ValueError(f"B may have at most {_RADIX} pieces")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: a piece with a space after another character would join words
        self.words_apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.words = Generations(self._words, kept)

    def _ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space and text, or None where the tokens' bytes differ from it."""
        if not text:
            return None
        whole = " " + text
        ids_a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text)
        raw = whole.encode()
        if b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        return ids_a, ids_b

    def _aligned(self, ids_a: list[int], ids_b: list[int], borders: np.ndarray) -> list[tuple[str, bytes, int, int]]:
        """The groups of each stretch that ends at one of the borders (byte offsets, all of them cuts)."""
        a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
        ends_a = np.cumsum(self.length_a[a])
        at_a, at_b = shared_cuts(ends_a, np.cumsum(self.length_b[b]))
        links = (a[at_a] * _RADIX + b[at_b]).astype("<u4").tobytes()
        groups, name_a, name_b = [], [self.name_a[i] for i in ids_a], [self.name_b[i] for i in ids_b]
        i = j = 0
        for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            if p == i + 1 and q == j + 1:
                groups.append(f"{name_a[i]}|{name_b[j]}")
            else:
                groups.append(f"{','.join(name_a[i:p])}|{','.join(name_b[j:q])}")
            i, j = p, q
        last = np.searchsorted(ends_a[at_a], borders)
        out, g, i, j = [], 0, 0, 0
        for h in last.tolist():
            p, q = int(at_a[h]) + 1, int(at_b[h]) + 1
            out.append((";".join(groups[g:h + 1]), links[4 * g:4 * h + 4], p - i, q - j))
            g, i, j = h + 1, p, q
        return out

    def _words(self, words: list[str]) -> list[tuple | bool]:
        """(groups, links, tokens of A, of B) of each word, False where it can't be given back. Many words in one call."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        text = " ".join(plain)
        ids = self._ids(text)
        if ids is not None:
            known = dict(zip(plain, self._aligned(*ids, np.cumsum([1 + len(w.encode()) for w in plain])), strict=True))
        elif len(plain) > 1:  # some word differs: halve until it is alone
            half = len(plain) // 2
            known = dict(zip(plain, self._words(plain[:half]) + self._words(plain[half:]), strict=True))
        else:
            known = dict.fromkeys(plain, False)
        for w in words:
            if w not in known:  # empty, or white space at an edge: alone
                ids = self._ids(w)
                known[w] = self._aligned(*ids, np.array([1 + len(w.encode())]))[0] if ids is not None else False
        return [known[w] for w in words]

    def texts(self, texts: list[str]) -> list[tuple[str, bytes, int, int]]:
        """(groups, links, tokens of A, tokens of B) of each whole text."""
        parts = [_WORD_END.split(t) if self.words_apart else [t] for t in texts]
        words = [w for p in parts for w in p]
        if max(map(len, words), default=0) <= LONG_WORD:
            known = self.words.get(words)
        else:
            short = iter(self.words.get([w for w in words if len(w) <= LONG_WORD]))
            known = [next(short) if len(w) <= LONG_WORD else self._words([w])[0] for w in words]
        out, at = [], 0
        for p in parts:
            found = known[at:at + len(p)]
            at += len(p)
            if False in found:
                out.append(("", b"", 0, 0))
            else:
                groups, links, n_a, n_b = zip(*found)
                out.append((";".join(groups), b"".join(links), sum(n_a), sum(n_b)))
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def counted(links: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order and how often each occurs, or the sums of ``times``."""
    if not len(links):
        return links, np.zeros(0, dtype=np.int64)
    if times is not None:
        order = np.argsort(links, kind="stable")
        links, times = links[order], times[order]
    else:
        links = np.sort(links)
    starts = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]]))
    sums = np.diff(np.append(starts, len(links))) if times is None else np.add.reduceat(times, starts)
    return links[starts], sums


def tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """A row per document, written to the shared folder: row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256,
    links and times (distinct links and how often each is in the text, little-endian 32-bit), and, if asked for, groups."""
    small_batches(docs.sparkSession)
    fields = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary, times binary" + ", groups string" * with_groups

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("alignment", aligner.cache_clear)
        both = aligner(path_a, path_b)
        for batch in batches:
            out = []
            for groups, raw, n_a, n_b in (found for together in some(batch["text"]) for found in both.texts(together)):
                links, times = counted(np.frombuffer(raw, dtype="<u4"))
                sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                out.append((n_a, n_b, len(raw) // 4, sha, links.astype("<u4").tobytes(), times.astype("<u4").tobytes()) + (groups,) * with_groups)
            frame = pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")], index=batch.index)
            yield pd.concat([batch[["row", "doc_id"]], frame], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(align, f"row long, doc_id string, {fields}")
    return stash(found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType)), "alignment")


def link_counts(found: DataFrame) -> DataFrame:
    """(link, n, best): how many links of the corpus hold the pair of ids, and whether no pair with this id of B has more."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def summed():
            links, times = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return counted(links, times)

        for batch in batches:
            for links, times in zip(batch["links"], batch["times"], strict=True):
                held.append((np.frombuffer(links, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)))
                n += len(held[-1][0])
                if n >= SUMMED:
                    held = [summed()]
                    n = len(held[0][0])
                    if n >= SUMMED // 2:
                        yield pd.DataFrame({"link": held[0][0].astype(np.int64), "n": held[0][1]})
                        held, n = [], 0
        if held:
            links, times = summed()
            yield pd.DataFrame({"link": links.astype(np.int64), "n": times})

    counts = stash(found.select("links", "times").mapInPandas(partial, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")), "links")
    most = counts.groupBy((F.col("link") % _RADIX).alias("b")).agg(F.max("n").alias("most"))
    return stash(counts.join(most, F.col("link") % _RADIX == F.col("b")).select("link", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _looked_up(found: DataFrame, counts: DataFrame) -> DataFrame:
    spark = found.sparkSession
    known = counts.toPandas().sort_values("link")
    table = spark.sparkContext.broadcast((known["link"].to_numpy(dtype=np.uint32), known["n"].to_numpy(dtype=np.int64), known["best"].to_numpy(dtype=bool)))

    @F.pandas_udf("struct<n_best: long, count_sum: long>")
    def look_up(links: pd.Series, times: pd.Series) -> pd.DataFrame:
        keys, n, best = table.value
        out = []
        for x, t in zip(links, times, strict=True):
            at = np.searchsorted(keys, np.frombuffer(x, dtype="<u4"))
            often = np.frombuffer(t, dtype="<u4").astype(np.int64)
            out.append((int(often[best[at]].sum()), int((often * n[at]).sum())))
        return pd.DataFrame(out, columns=["n_best", "count_sum"])

    return found.withColumn("seen", look_up("links", "times"))


def _joined(found: DataFrame, counts: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, links, times in zip(batch["row"], batch["links"], batch["times"], strict=True):
                yield pd.DataFrame({"row": row, "link": np.frombuffer(links, dtype="<u4").astype(np.int64), "times": np.frombuffer(times, dtype="<u4").astype(np.int64)})

    rows = found.select("row", "links", "times").mapInPandas(each, "row long, link long, times long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sums = rows.join(salted, ["link", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.join(sums.select("row", F.struct("n_best", "count_sum").alias("seen")), "row", "left")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False,
          table_links: int = TABLE_LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row and, if asked for, groups:
    ``a1,a2|b1;a3|b2,b3``, the ids of A and B in order."""
    found = tokens(docs, path_a, path_b, doc_id, text, with_groups)
    counts = link_counts(found)
    seen = _looked_up(found, counts) if counts.count() <= table_links else _joined(found, counts)
    n_best, count_sum = (F.coalesce(F.col(f"seen.{c}"), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum"))
    # every cut is the end of one token of A and of one of B, so a group has one link
    return seen.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), n_best, count_sum, "groups_sha256", *["groups"] * with_groups)
