"""Token ids of whole texts from the ids of their white-space-free chunks.

The word-level vocabulary drops white space before it splits words, so a text's
ids are its chunks' ids in a row, and a chunk has the same ids wherever it
stands. Chunks repeat: each Python worker keeps the ids of chunks it has seen,
in two generations of at most ``CHUNKS_KEPT`` (this bounds memory and changes
no result).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

CHUNKS_KEPT = 600_000
#: FIXED VALUE: the word vocabulary's split pattern, its \\s written out as the Unicode property.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Past Latin the classes change from one Unicode version to the next: such chunks are the library's to split.
BEYOND = re.compile("[^\x00-\u024f]")
#: str.split() also splits at these four, which are no white space to the vocabulary.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE = regex.compile(r"\p{White_Space}+")


class Generations:
    """What ``make`` gives for keys; those used since the last turn outlive it."""

    def __init__(self, make: Callable[[list], list], kept: int):
        self.make, self.kept, self.young, self.old = make, kept, {}, {}

    def get(self, keys: list) -> list:
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
            out = [None] * len(keys)
        missing, at = [], -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            missing.append(at)
        new = []
        for k in dict.fromkeys(keys[i] for i in missing):
            if (v := self.old.get(k)) is None:
                new.append(k)
            else:
                self.young[k] = v
        if new:
            self.young.update(zip(new, self.make(new), strict=True))
        for i in missing:
            out[i] = self.young[keys[i]]
        return out


#: Characters of texts whose new chunks are encoded in one call.
TOGETHER = 1_000_000


def some(texts, most: int = TOGETHER) -> Iterator[list[str]]:
    """The texts in order, null as empty, a few at a time: up to ``most`` characters, or one text."""
    held, size = [], 0
    for x in texts:
        x = x if isinstance(x, str) else ""
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def chunks_of(text: str) -> list[str]:
    return [x for x in _WHITE.split(text) if x] if any(c in text for c in _SEPARATORS) else text.split()


class ChunkCache:
    """``encode(chunks)`` gives the ids of each chunk as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: dict[str, int], kept: int = CHUNKS_KEPT):
        self.known = Generations(encode, kept)
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def ids(self, text: str) -> bytes:
        if self.special_at and "<|" in text:
            return b"".join(self.special.get(x) or self._plain(x) for x in self.special_at.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(self.known.get(chunks_of(text)))
