"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A text is an array of small integers whose last element, 0, occurs once.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the leftmost such of each run."""
    n = len(text)
    change = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = text[nearest] < text[np.minimum(nearest + 1, n - 1)]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array of all suffixes from the leftmost-smaller ones in order.

    Larger suffixes go to their letters' heads from left to right, smaller ones
    to their letters' tails from right to left. A step takes what a letter has
    got so far, all at once: what it induces under the same letter comes next.
    """
    n, letters = len(text), int(text.max()) + 1
    count = np.bincount(text, minlength=letters)
    end = np.cumsum(count)
    start = end - count
    before = np.concatenate([[0], text[:-1]]).astype(text.dtype)  # the letter before each place
    larger_before = np.concatenate([[False], ~smaller[:-1]])
    smaller_before = np.concatenate([[False], smaller[:-1]])
    array = np.zeros(n, dtype=np.int32)

    own = text[seeds]
    order = np.argsort(own, kind="stable")
    seeds = seeds[order]
    seed_end = np.cumsum(np.bincount(own, minlength=letters))
    seed_of = np.concatenate([[0], seed_end])

    def deal(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places before these, by letter in order; how many of each letter; rank within the letter."""
        letter = before[places]
        order = np.argsort(letter, kind="stable")
        number = np.bincount(letter, minlength=letters)
        letter = letter[order]
        return places[order] - 1, letter, number

    head = start.copy()
    for c in range(letters):
        at = int(start[c])
        while at < head[c]:
            to = int(head[c])
            got = array[at:to]
            at = to
            got = got[larger_before[got]]
            if len(got):
                places, letter, number = deal(got)
                first = np.cumsum(number) - number
                array[head[letter] + np.arange(len(places)) - first[letter]] = places
                head += number
        got = seeds[seed_of[c]:seed_of[c + 1]]
        got = got[larger_before[got]]
        if len(got):
            places, letter, number = deal(got)
            first = np.cumsum(number) - number
            array[head[letter] + np.arange(len(places)) - first[letter]] = places
            head += number
    tail = end.copy()
    for c in range(letters - 1, -1, -1):
        at = int(end[c])
        while at > tail[c]:
            to = int(tail[c])
            got = array[to:at][::-1]
            at = to
            got = got[smaller_before[got]]
            if len(got):
                places, letter, number = deal(got)
                first = np.cumsum(number) - number
                array[tail[letter] - 1 - (np.arange(len(places)) - first[letter])] = places
                tail -= number
        got = array[int(start[c]):int(head[c])][::-1]
        got = got[smaller_before[got]]
        if len(got):
            places, letter, number = deal(got)
            first = np.cumsum(number) - number
            array[tail[letter] - 1 - (np.arange(len(places)) - first[letter])] = places
            tail -= number
    array[0] = n - 1
    return array


def hashes_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of letters times powers of an odd number, and the powers of its inverse, modulo 2**64."""
    odd = 0x9E3779B97F4A7C15
    factors = np.full((2, len(text) + 1), odd, dtype=np.uint64)
    factors[1] = pow(odd, -1, 1 << 64)
    factors[:, 0] = 1
    power, inverse = np.cumprod(factors, axis=1, dtype=np.uint64)
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=total[1:])
    return total, inverse


def order_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names.

    Recursive: three names in a row make a new name, which covers three times
    as much, and so on while two places share a name. Places whose name is
    already their own stay.
    """
    n = len(names)
    rank = names.astype(np.int64) + 1
    step, open_ = 1, np.arange(n)
    first = True
    while True:
        second = np.zeros(len(open_), np.int64)
        third = np.zeros(len(open_), np.int64)
        inside = open_ + step < n
        second[inside] = rank[open_[inside] + step]
        inside = open_ + 2 * step < n
        third[inside] = rank[open_[inside] + 2 * step]
        by = np.lexsort((third, second, rank[open_]))
        open_, second, third = open_[by], second[by], third[by]
        own = rank[open_]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1])])
        group = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        # a group's places keep its rank and those behind the first name move up by their place in it
        place = np.arange(len(open_))
        base = np.repeat(group, np.diff(np.concatenate([group, [len(open_)]])))
        leader = np.maximum.accumulate(np.where(new, place, 0))
        if first:  # ranks become the number of smaller suffixes, plus one
            rank[open_] = leader + 1
            first = False
        else:
            rank[open_] = own + leader - base
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(open_)]]))
        tied = np.repeat(sizes > 1, sizes)
        open_ = open_[tied]
        if not len(open_):
            break
        step *= 3
    order = np.empty(n, dtype=np.int64)
    order[rank - 1] = np.arange(n)
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    smaller, seeds = classify(text)
    if len(seeds) > 1:
        rough = induce(text, smaller, seeds)  # sorts the substrings between leftmost-smaller places
        is_seed = np.zeros(len(text), dtype=bool)
        is_seed[seeds] = True
        rough = rough[is_seed[rough]].astype(np.int64)
        follows = np.full(len(text), len(text) - 1, dtype=np.int64)
        follows[seeds[:-1]] = seeds[1:]
        length = np.minimum(follows[rough] + 1, len(text)) - rough
        new = np.concatenate([[False], length[1:] != length[:-1]])
        alike = np.flatnonzero(~new[1:]) + 1  # as long as the one before: letters decide
        sizes = length[alike]
        border = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(border[-1]) - np.repeat(border[:-1], sizes)
        differ = text[np.repeat(rough[alike], sizes) + place] != text[np.repeat(rough[alike - 1], sizes) + place]
        new[alike] = np.add.reduceat(differ, border[:-1]) > 0 if len(alike) else False
        names = np.zeros(len(text), dtype=np.int64)
        names[rough] = np.cumsum(new)
        seeds = seeds[order_names(names[seeds])]
    return induce(text, smaller, seeds)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, breaks: int = -1, enough: int | None = None) -> np.ndarray:
    """For each place, how long a prefix its suffix shares with the suffix before it in the array.

    Where the letters before the two suffixes agree the length is one less than
    at the place before; only at other places, and after the letter ``breaks``,
    are letters compared, up to ``enough`` of them.
    """
    n = len(text)
    prior = np.zeros(n, dtype=np.int64)
    prior[array[1:]] = array[:-1]
    place = np.arange(n)
    prior[array[0]] = array[0]
    kept = np.zeros(n, dtype=bool)
    kept[1:] = (prior[1:] > 0) & (text[:-1] == text[np.maximum(prior[1:] - 1, 0)]) & (text[:-1] != breaks)
    kept[array[0]] = False
    base = np.flatnonzero(~kept)
    base = base[base != array[0]]
    length = np.zeros(n, dtype=np.int64)
    a, b, active = base.copy(), prior[base].copy(), np.arange(len(base))
    got = np.zeros(len(base), dtype=np.int64)
    for _ in range(n if enough is None else enough):
        if not len(active):
            break
        limit = n - np.maximum(a, b)
        same = (limit > 0) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        got[active[same]] += 1
        active, a, b = active[same], a[same] + 1, b[same] + 1
    length[base] = got
    at = np.maximum.accumulate(np.where(kept, 0, place))
    return np.maximum(np.where(kept, length[at] - (place - at), length), 0)
