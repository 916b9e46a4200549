"""Suffix arrays by induced sorting, in whole-array numpy steps, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
SMALL_ALPHABET = 600

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; kept by the worker."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any substring of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def of(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        value = (self.sums[past] - self.sums[first]) * self.down[first]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last entry is the unique smallest."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    rises = s[change] < s[change + 1]
    small = np.empty(n, bool)
    small[:-1] = np.repeat(rises, np.diff(change, prepend=-1))[:n - 1]
    small[-1] = True
    return small


def _deal(positions: np.ndarray, chars: np.ndarray, pending: list[list[np.ndarray]]) -> None:
    """Append positions to their characters' lists, in order."""
    if not len(positions):
        return
    order = np.argsort(chars, kind="stable")
    ordered = chars[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    for part in np.split(order, cuts):
        pending[chars[part[0]]].append(positions[part])


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """Suffix order induced from the leftmost-smaller suffixes in the order given.

    One pass over the buckets upwards places the larger suffixes, one downwards the smaller
    ones; a bucket is handled as a whole, with one round per repetition of its letter.
    """
    none = np.zeros(0, np.int64)
    planted: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(seeds, s[seeds], planted)
    pending: list[list[np.ndarray]] = [[] for _ in range(letters)]
    larger = []
    for c in range(letters):
        queue = np.concatenate(pending[c]) if pending[c] else none
        mine = [queue]
        while len(queue):
            before = queue[queue > 0] - 1
            before = before[~small[before]]
            chars = s[before]
            stay = chars == c
            _deal(before[~stay], chars[~stay], pending)
            queue = before[stay]
            mine.append(queue)
        larger.append(np.concatenate(mine))
        if planted[c]:
            before = np.concatenate(planted[c])
            before = before[before > 0] - 1
            before = before[~small[before]]
            _deal(before, s[before], pending)
    pending = [[] for _ in range(letters)]
    buckets = [none] * letters
    for c in range(letters - 1, -1, -1):
        queue = np.concatenate(pending[c]) if pending[c] else none
        mine = [queue]
        while len(queue):
            before = queue[queue > 0] - 1
            before = before[small[before]]
            chars = s[before]
            stay = chars == c
            _deal(before[~stay], chars[~stay], pending)
            queue = before[stay]
            mine.append(queue)
        before = larger[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        _deal(before, s[before], pending)
        buckets[c] = np.concatenate([larger[c], np.concatenate(mine)[::-1]])
    return np.concatenate([np.array([len(s) - 1]), *[b[b != len(s) - 1] for b in buckets]])


def by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over many letters: ranks of doubled length, for the suffixes that still share theirs."""
    n, width = len(names), 1
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    active = np.flatnonzero(counts[names] > 1)
    while len(active):
        follow = active + width
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + after
        order = np.argsort(key)
        active, key = active[order], key[order]
        old, at = rank[active], np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        parts = np.append(True, key[1:] != key[:-1])
        part = np.maximum.accumulate(np.where(parts, at, 0))
        rank[active] = old + part - group
        single = parts & np.append(parts[1:], True)
        active = active[~single]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string that ends with its unique smallest value.

    Suffixes are classified, the leftmost-smaller substrings sorted by induction and named,
    and the string of names sorted in turn: by the same method while its alphabet is small, by
    doubling ranks once most names differ.  A last induction gives all suffixes.
    """
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    letters = int(s.max()) + 1
    if letters > 1 << 16:
        return by_doubling(np.asarray(s, np.int64))
    s = s.astype(np.uint16)  # short letters sort by radix
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(s, small, lms, letters)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # substrings run to the next leftmost-smaller position, inclusive
    place = np.zeros(n, np.int64)
    place[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n - 1)
    hashes = Hashes(2 * s.astype(np.uint64) + small.astype(np.uint64) + np.uint64(1))
    last = np.minimum(ends[place[ordered]] + 1, n)
    value, length = hashes.of(ordered, last), last - ordered
    new = np.ones(len(ordered), bool)
    new[1:] = (value[1:] != value[:-1]) | (length[1:] != length[:-1])
    names = np.zeros(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(new) - 1
    count = int(new.sum())
    if count < len(lms):
        order = suffix_array(names) if count <= SMALL_ALPHABET else by_doubling(names)
        ordered = lms[order]
    return induce(s, small, ordered, letters)


def common_prefixes(s: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position, the length shared with its predecessor in suffix order.

    Nothing is counted beyond ``room``, the characters from a position to the end of its
    piece.  Going one to the right inside both pieces loses at most one character, so only
    positions whose left neighbours differ or that start a piece are measured (by hashes, halving the
    range); the others follow.
    """
    n = len(s)
    previous = np.empty(n, np.int64)
    previous[order[0]] = -1
    previous[order[1:]] = order[:-1]
    at = np.arange(n)
    begins = np.append(True, room[1:] != room[:-1] - 1)
    fresh = begins | (previous < 0) | begins[previous]
    inner = ~fresh
    fresh[inner] = s[at[inner] - 1] != s[previous[inner] - 1]
    todo = np.flatnonzero(fresh & (previous >= 0))
    hashes = Hashes(s.astype(np.uint64) + np.uint64(1))
    a, b = todo, previous[todo]
    low, high = np.zeros(len(todo), np.int64), np.minimum(room[a], room[b])
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    length = np.zeros(n, np.int64)
    length[todo] = low
    start = np.maximum.accumulate(np.where(fresh, at, -1))
    return np.maximum(length[np.maximum(start, 0)] - (at - start), 0)
