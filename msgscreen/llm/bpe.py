"""Operator 7: byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A merge list fixes the tokens of a word. Instead of replaying merges, the
encoder walks the word with an Aho-Corasick automaton over all tokens, takes
the longest token at each place, and keeps it if the pair with the token before
is compatible, that is, if merging the two tokens' text again gives just these
two. If not, it tries the next shorter token, and if none is left it closes the
place and steps back one token. A sequence whose neighbours are all compatible
is the merges' own result, and each place is closed at most once, so the walk
is linear in the word.

A pair (a, b) is compatible unless some merge crosses their border: of the
parts that end a (a, its right part, that one's right part, ...) and those that
begin b, a pair that the merge list joins while both still stand alone.

Decoding copies each token's bytes, which lie in one block, from and to the
offsets in a table, a space after each but the last.

Defined cases: a null text counts as empty and has no ids and an empty decoded
text; special tokens in a text keep their ids; no truncation, no padding;
repeated rows give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from msgscreen.llm.chunks import BEYOND, SPLIT, ChunkCache, Generations
from msgscreen.llm.common import hold, small_batches

END = "</w>"
#: A word's last symbol is another symbol than the same byte elsewhere.
_LAST = 0x1000
_PAIRS_KEPT = 500_000
_WORDS_KEPT = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """The tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[a, b] = n
            whole = ids[model_text(pair)]
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (a, b), n
        self.compatible: dict[tuple[int, int], bool] = {}

        automaton, text_of = ahocorasick.Automaton(), {}
        for token, i in sorted(ids.items(), key=lambda x: self.born.get(x[1], -1)):
            if self._stands(i, text_of):
                text_of[i] = symbols(token)
        by_text = {v: k for k, v in text_of.items()}
        self.length = {i: len(s) for i, s in text_of.items()}
        self.shorter = {i: next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1) for i, s in text_of.items()}
        for i, s in text_of.items():
            automaton.add_word(s, (i, len(s)))
        automaton.make_automaton()
        self.automaton = automaton
        self.of_byte = byte_symbols()

        size = max([*ids.values(), *self.special.values()]) + 1
        texts = [b""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            texts[i] = token.encode() + b" "
        self.block = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        self.library = Tokenizer.from_file(path)
        self.words = Generations(lambda words: [np.array(self.word_ids(last_marked(w)), dtype="<u4").tobytes() for w in words], _WORDS_KEPT)
        self.cache = ChunkCache(lambda chunks: [self.chunk_ids(c) for c in chunks], self.special)

    def _edge(self, token: int, side: int, end: float) -> list[tuple[int, float]]:
        """The parts at one edge of a token, each with the merge that ends its standing alone."""
        out = [(token, end)]
        while token in self.parts:
            end, token = self.born[token], self.parts[token][side]
            out.append((token, end))
        return out

    def _crossed(self, a: int, b: int, end: float) -> bool:
        """Whether a merge before ``end`` crosses the border; of equal merges the left one comes first."""
        right = self._edge(b, 0, end)
        for x, x_end in self._edge(a, 1, end):
            for y, y_end in right:
                n = self.rank.get((x, y))
                if n is not None and n < x_end and n <= y_end and n < end:
                    return True
        return False

    def _stands(self, token: int, standing: dict) -> bool:
        """Whether merging the token's text gives the token back."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return a in standing and b in standing and not self._crossed(a, b, self.born[token])

    def fits(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > _PAIRS_KEPT:
                self.compatible.clear()
            known = self.compatible[a, b] = not self._crossed(a, b, float("inf"))
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, given as symbols."""
        longest, best = [0] * len(word), [-1] * len(word)
        for end, (token, n) in self.automaton.iter(word):
            if n > longest[end + 1 - n]:
                longest[end + 1 - n], best[end + 1 - n] = n, token
        out: list[int] = []
        ends, closed = [0], set()
        token = best[0]
        while True:
            at = ends[-1]
            while token >= 0 and (at + self.length[token] in closed or out and not self.fits(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                ends.append(at + self.length[token])
                if ends[-1] == len(word):
                    return out
                token = best[ends[-1]]
            else:
                closed.add(ends.pop())
                token = self.shorter[out.pop()]

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of text without white space: composed, in lower case, split, its words encoded.

        Letters past Latin, whose classes change from one Unicode version to
        the next, are composed and split by the library, as the file says.
        """
        if BEYOND.search(chunk):
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            words = [w for w, _ in split]
        else:
            found = SPLIT.findall(unicodedata.normalize("NFC", chunk).lower())
            words = found if chunk.isascii() and chunk.isprintable() else ["".join([self.of_byte[b] for b in w.encode()]) for w in found]
        return b"".join(self.words.get(words))

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start = self.offsets[ids]
        lengths = self.offsets[ids + 1] - start
        to = np.cumsum(lengths)
        return self.block[np.repeat(start - (to - lengths), lengths) + np.arange(to[-1])][:-1].tobytes()


def model_text(pair) -> str:
    return "".join(pair if isinstance(pair, list) else pair.split(" "))


def last_marked(word: str) -> str:
    return word[:-1] + chr(ord(word[-1]) + _LAST)


def symbols(token: str) -> str:
    return last_marked(token[: -len(END)]) if token.endswith(END) and token != END else token


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The rows with the column ``into``: ids as binary, little-endian unsigned 32-bit."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("bpe", vocabulary.cache_clear)
        v = vocabulary(path)
        for batch in batches:
            yield pd.Series([v.cache.ids(x) if isinstance(x, str) else b"" for x in batch], dtype=object)

    return docs.withColumn(into, ids_of(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the column ``into``, the text of their ids; null ids give null."""
    small_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("bpe", vocabulary.cache_clear)
        v = vocabulary(path)
        for batch in batches:
            yield pd.Series([None if x is None else v.decode(np.frombuffer(x, dtype="<u4").astype(np.int64)).decode() for x in batch], dtype=object)

    return rows.withColumn(into, text_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", into: str = "bpe") -> DataFrame:
    """The rows with ``into``: struct of ``ids`` (as by :func:`encode`) and
    ``decoded`` (as by :func:`decode`), in one pass and one Python function."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold("bpe", vocabulary.cache_clear)
        v = vocabulary(path)
        for batch in batches:
            ids = [v.cache.ids(x) if isinstance(x, str) else b"" for x in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [v.decode(np.frombuffer(x, dtype="<u4").astype(np.int64)).decode() for x in ids]})

    return docs.withColumn(into, both(F.col(text)))
