"""Token ids of whole texts by a table of words, many words at a time.

As in :mod:`msgscreen.llm.chunks`, a text's ids are its chunks' ids in a row. Here
the chunks of many texts are found and looked up by numpy on the texts' bytes. A
chunk of ASCII without an apostrophe is split into its words (runs of letters,
single digits, runs of others, as the vocabulary's pattern says) and put in lower
case at once; any other chunk is looked up as it stands. A word of up to ``WIDTH``
bytes is its own key, compared in full; longer ones are kept in a dict.

New words are encoded in one call. Each worker keeps what it has looked up in two
generations of about ``kept`` words; this bounds memory and changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from msgscreen.llm.chunks import TOGETHER, some

WIDTH = 24
#: Bytes of long words, and ids, that a generation keeps for each of its words on average.
BYTES_KEPT, IDS_KEPT = 16, 16
_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[[ord("'"), *range(128, 256)]] = _WHOLE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_MASK = np.frombuffer(b"".join(b"\xff" * n + b"\0" * (WIDTH - n) for n in range(WIDTH + 1)), "<u8").reshape(-1, WIDTH // 8)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BREAK = re.compile("[ \t\n\r]")

#: Ids in a row, and each word's first place in them and count.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def ragged(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` elements from each ``start`` on, in a row."""
    end = np.cumsum(count)
    return pool[np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)]


def blocks(text: str, most: int = TOGETHER) -> Iterator[str]:
    """The text, cut at white space where it is long."""
    at = 0
    while len(text) - at > most and (found := _BREAK.search(text, at + most)):
        yield text[at:found.start()]
        at = found.end()
    yield text[at:] if at else text


class Words:
    """Open addressing: rows of a word's bytes and where its ids stand (place + 1 above 32 bits of count; 0: none)."""

    def __init__(self):
        self.rows = np.zeros((1 << 12, WIDTH // 8 + 1), np.uint64)
        self.long: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 12, np.uint32)
        self.n = self.n_ids = self.n_bytes = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _ODD[0]
        for i in range(1, keys.shape[1]):
            h += keys[:, i] * _ODD[i]
        h ^= h >> np.uint64(32)
        h *= _ODD[3]
        return (h >> np.uint64(65 - len(self.rows).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot, out = self._slots(keys), np.zeros(len(keys), np.uint64)
        rest = None
        while rest is None or len(rest):
            got = self.rows.take(slot, axis=0)
            wanted = keys if rest is None else keys[rest]
            same = got[:, 0] == wanted[:, 0]
            for i in range(1, keys.shape[1]):
                same &= got[:, i] == wanted[:, i]
            if rest is None:
                np.copyto(out, got[:, -1], where=same)
            else:
                out[rest[same]] = got[same, -1]
            further = np.flatnonzero(~same & (got[:, 0] != 0))
            rest = further if rest is None else rest[further]
            slot = slot[further] + 1 & len(self.rows) - 1
        return out

    def _insert(self, rows: np.ndarray) -> None:
        slot, rest = self._slots(rows[:, :-1]), np.arange(len(rows))
        while len(rest):
            free = np.flatnonzero(self.rows[slot, 0] == 0)
            at, first = np.unique(slot[free], return_index=True)
            self.rows[at] = rows[rest[free[first]]]
            left = np.ones(len(rest), dtype=bool)
            left[free[first]] = False
            rest, slot = rest[left], slot[left] + 1 & len(self.rows) - 1

    def _values(self, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        while self.n_ids + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.n_ids:self.n_ids + len(ids)] = ids
        values = (start + (self.n_ids + 1)).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
        self.n_ids += len(ids)
        return values

    def add(self, keys: np.ndarray, new: Encoded) -> np.ndarray:
        values = self._values(*new)
        self.n += len(keys)
        if 2 * self.n > len(self.rows):
            old = self.rows[self.rows[:, 0] != 0]
            self.rows = np.zeros((1 << (2 * self.n).bit_length(), self.rows.shape[1]), np.uint64)
            self._insert(old)
        self._insert(np.column_stack([keys, values]))
        return values

    def add_long(self, words: list[bytes], new: Encoded) -> None:
        self.long.update(zip(words, self._values(*new).tolist(), strict=True))
        self.n_bytes += sum(map(len, words))

    def ids(self, values: np.ndarray) -> Encoded:
        count = (values & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return ragged(self.pool, (values >> np.uint64(32)).astype(np.int64) - 1, count), np.cumsum(count) - count, count


class WordTable:
    """``encode(words)`` gives the ids of chunks or words in UTF-8; ``whole(text)`` those of a text that holds NUL, as little-endian bytes."""

    def __init__(self, encode: Callable[[list[bytes]], Encoded], whole: Callable[[str], bytes], special: dict[str, int], kept: int):
        self.encode, self.whole, self.kept = encode, whole, kept
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.young, self.old = Words(), Words()

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        parts, of_text = [], []
        for text in texts:
            mine: list = []
            for x in self.special_at.split(text) if self.special_at and "<|" in text else [text]:
                if x in self.special:
                    mine.append(self.special[x])
                elif "\0" in x:
                    mine.append(self.whole(x))
                else:
                    for block in blocks(x):
                        mine.append(len(parts))
                        parts.append(block)
            of_text.append(mine)
        done = [ids for together in some(parts) for ids in self._looked_up(together)]
        return [b"".join([done[m] if isinstance(m, int) else m for m in mine]) for mine in of_text]

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        if self.young.n + len(self.young.long) > self.kept or self.young.n_bytes > BYTES_KEPT * self.kept or self.young.n_ids > IDS_KEPT * self.kept:
            self.young, self.old = Words(), self.young
        encoded = [x.encode() for x in texts]
        text_at = np.cumsum([0, *[len(x) + 1 for x in encoded]])
        n = int(text_at[-1])
        raw = np.frombuffer(b"".join([b"\n".join(encoded), b"\n", bytes(WIDTH)]), np.uint8)
        at, stop, chunk_whole = self._words(raw[:n])
        # words of ASCII chunks are taken from the text in lower case, which stands first
        both = np.concatenate([_LOWER[raw], raw])
        at_both, size = at + len(raw) * chunk_whole, stop - at
        keys = np.ndarray((len(both) - WIDTH + 1,), f"V{WIDTH}", both, strides=(1,))[at_both].view("<u8").reshape(-1, WIDTH // 8)
        keys &= _MASK[np.minimum(size, WIDTH)]
        values = self.young.find(keys)
        values[size > WIDTH] = 1
        missing = np.flatnonzero(values == 0)
        if len(missing):
            new, which = np.unique(keys[missing].view(f"S{WIDTH}").ravel(), return_inverse=True)
            values[missing] = self._learn(new)[which]
        long = np.flatnonzero(size > WIDTH)
        if len(long):
            words = [both[a:a + k].tobytes() for a, k in zip(at_both[long].tolist(), size[long].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.young.long]
            if new:
                self.young.add_long(new, self.encode(new))
            values[long] = [self.young.long[w] for w in words]
        ids, start, _ = self.young.ids(values)
        borders = 4 * np.append(start, len(ids))[np.searchsorted(at, text_at)]
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]

    @staticmethod
    def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's first byte, the byte after its last, and whether it is a chunk as it stands. White space ends ``raw``."""
        kind = _KIND[raw]
        space = kind == _SPACE
        first = ~space
        first[1:] &= space[:-1]
        last = space.copy()
        last[0] = False
        last[1:] &= ~space[:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        whole = np.logical_or.reduceat(kind == _WHOLE, starts) if len(starts) else np.zeros(0, bool)
        change = kind == _DIGIT
        change[1:] |= kind[1:] != kind[:-1]
        change[0] = True
        change &= ~space
        at = np.flatnonzero(change)
        begins = first[at]
        chunk = np.cumsum(begins) - 1
        stays = begins | ~whole[chunk]
        at, chunk = at[stays], chunk[stays]
        return at, np.minimum(np.append(at[1:], len(raw))[:len(at)], ends[chunk]), whole[chunk]

    def _learn(self, new: np.ndarray) -> np.ndarray:
        """Take sorted new words from the old generation, or encode them; where their ids stand."""
        keys = new.view("<u8").reshape(-1, WIDTH // 8)
        values = self.old.find(keys)
        known = values != 0
        if known.any():
            values[known] = self.young.add(keys[known], self.old.ids(values[known]))
        if not known.all():
            values[~known] = self.young.add(keys[~known], self.encode(new[~known].tolist()))
        return values
