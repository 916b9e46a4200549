"""Periodic runs of words: stretches that repeat one period at least three times over.

Method: maximal pairs.  A run of period q and length q + l is a pair of places q apart that share exactly l words
to the right and whose left neighbours differ.  So each text's suffixes are sorted, and the tree of intervals of common
prefixes is walked bottom up: where intervals meet, places of different branches share exactly the interval's
prefix (they are maximal to the right), and places of different left-word classes are maximal to the left.
Only pairs not further apart than the prefix over ``periods - 1`` can be runs.  For those the pairs of
neighbours are enough: with a third place between the two, the prefix would have two periods that
together fit into it, so a smaller one.  Such a pair is a run as it stands and needs no extension; of several
periods for one stretch (multiples of the smallest) the smallest counts.

Suffixes of texts in one batch are sorted together over disjoint alphabets, so they never meet.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import texts

MIN_WORDS, MIN_PERIODS = 24, 3
BATCH_WORDS = 400_000  # words sorted at once, or one longer text
BLOCK = 1_000


class Places:
    """Ascending places of an interval, in blocks, so that an insertion moves few of them."""

    def __init__(self, place: int):
        self.blocks, self.tops, self.size = [[place]], [place], 1

    def neighbours(self, place: int) -> tuple[int | None, int | None]:
        """The nearest places before and after."""
        b = bisect_left(self.tops, place)
        if b == len(self.tops):
            return self.tops[-1], None
        block = self.blocks[b]
        i = bisect_left(block, place)
        return block[i - 1] if i else self.tops[b - 1] if b else None, block[i]

    def add(self, place: int) -> None:
        b = min(bisect_left(self.tops, place), len(self.tops) - 1)
        block = self.blocks[b]
        insort(block, place)
        if len(block) > 2 * BLOCK:
            self.blocks[b:b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[b:b + 1] = [block[BLOCK - 1], block[-1]]
        else:
            self.tops[b] = block[-1]
        self.size += 1

    def __iter__(self):
        for block in self.blocks:
            yield from block


def sorted_suffixes(letters: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of a string of small integers, and the ranks of its substrings of 1, 2, 4, ... letters."""
    n = len(letters)
    counts = np.bincount(letters)
    rank = (np.cumsum(counts) - counts)[letters]
    active = np.flatnonzero(counts[letters] > 1)
    history = [np.append(rank, -1).astype(np.int32)]
    width = 1
    while len(active):
        follow = active + width
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + after
        order = np.argsort(key)
        active, key = active[order], key[order]
        at = np.arange(len(active))
        old = rank[active]
        bucket = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        opens = np.append(True, key[1:] != key[:-1])
        rank[active] = old + np.maximum.accumulate(np.where(opens, at, 0)) - bucket
        active = active[~(opens & np.append(opens[1:], True))]
        history.append(np.append(rank, -1).astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, history


def prefix_lengths(order: np.ndarray, history: list[np.ndarray], least: int) -> np.ndarray:
    """Letters that each suffix shares with the one before it in order; 0 where fewer than ``least``.

    Exact: ranks of substrings of 2^k letters are compared, from the longest down.
    """
    shared = np.zeros(len(order), np.int64)
    base = min(len(history) - 1, least.bit_length() - 1)
    level = history[base]
    todo = np.flatnonzero(level[order[1:]] == level[order[:-1]]) + 1
    a, b = order[todo - 1], order[todo]
    for k in range(len(history) - 1, -1, -1):
        step = np.where(history[k][a] == history[k][b], 1 << k, 0)
        a, b = a + step, b + step
        shared[todo] += step
    shared[shared < least] = 0
    return shared


def tight_groups(order: np.ndarray, shared: np.ndarray, periods: int) -> list[tuple[list[int], list[int]]]:
    """Branches of the interval tree that can hold a run: (places in suffix order, shared lengths).

    A branch whose closest two places lie further apart than its longest prefix allows is left out.
    """
    linked = np.flatnonzero(shared)
    if not len(linked):
        return []
    cut = np.append(True, np.diff(linked) > 1)
    firsts = np.flatnonzero(cut)
    sizes = np.diff(np.append(firsts, len(linked)))
    group = np.repeat(np.arange(len(firsts)), sizes)
    heads = linked[firsts] - 1
    place = np.concatenate([order[heads], order[linked]])
    owner = np.concatenate([np.arange(len(firsts)), group])
    by = np.lexsort((place, owner))
    gaps = np.diff(place[by])
    gaps[np.diff(owner[by]) != 0] = np.iinfo(np.int64).max
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    closest = np.minimum.reduceat(gaps, starts)
    longest = np.maximum.reduceat(shared[linked], firsts)
    fit = closest * (periods - 1) <= longest
    return [(order[h:h + n + 1].tolist(), shared[h + 1:h + n + 1].tolist()) for h, n in zip(heads[fit].tolist(), sizes[fit].tolist())]


def pairs(places: list[int], lengths: list[int], left: np.ndarray, words: int, periods: int) -> dict[tuple[int, int], int]:
    """{(start, length): smallest period} of the runs of one branch, bottom up."""
    found: dict[tuple[int, int], int] = {}
    nodes, links = [Places(places[0])], []

    def meet() -> None:
        b, a, shared = nodes.pop(), nodes.pop(), links.pop()
        small, large = (a, b) if a.size < b.size else (b, a)
        reach, least = shared // (periods - 1), words - shared
        for x in small:
            before, after = large.neighbours(x)
            for first, second in ((before, x), (x, after)):
                if first is None or second is None:
                    continue
                period = second - first
                if least <= period <= reach and left[first] != left[second]:
                    key = first, period + shared
                    if found.get(key, period) >= period:
                        found[key] = period
        for x in small:
            large.add(x)
        nodes.append(large)

    for place, shared in zip(places[1:], lengths):
        while links and links[-1] > shared:
            meet()
        nodes.append(Places(place))
        links.append(shared)
    while links:
        meet()
    return found


def find_runs(sequences: list[list], words: int = MIN_WORDS, periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per sequence its runs (start, length, period), by start and period.

    A run has a smallest period ``q``, at least ``max(words, periods * q)`` items and no neighbour that extends it.
    """
    if periods < 3:
        raise ValueError("periods must be 3 or more")
    letters, begin = [], [0]
    for seq in sequences:
        base, known = letters_used(letters), {}
        letters.append(np.array([known.setdefault(w, len(known)) for w in seq], np.int64) + base)
        begin.append(begin[-1] + len(seq))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    line = np.concatenate(letters) if letters else np.zeros(0, np.int64)
    if not len(line):
        return out
    order, history = sorted_suffixes(line)
    least = -(-words * (periods - 1) // periods)  # no shorter prefix can reach the length wanted
    shared = prefix_lengths(order, history, max(1, least))
    left = np.append(-1, line[:-1])
    left[[b for b in begin if b < len(line)]] = -1
    edges = np.array(begin[1:])
    for places, lengths in tight_groups(order, shared, periods):
        found = pairs(places, lengths, left, words, periods)
        if found:
            owner = int(np.searchsorted(edges, places[0], "right"))
            out[owner] += [(start - begin[owner], length, period) for (start, length), period in found.items()]
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def letters_used(letters: list[np.ndarray]) -> int:
    """First number that no earlier sequence has."""
    for part in reversed(letters):
        if len(part):
            return int(part.max()) + 1
    return 0


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that stay: each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def runs(docs: DataFrame, words: int = MIN_WORDS, periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): periodic runs of each text and the text with one period of each.

    ``runs`` has (start, length, period) in words, by start and period; ``collapsed`` joins the words that stay
    by one space.  Words are split at ASCII white space.  Null and empty texts have no words and no runs; texts of
    any length are read whole; repeated rows give repeated results; a null ``doc_id`` stays null; other columns
    are left out; an empty table gives an empty result.
    """
    @pandas_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def of(column: pd.Series) -> pd.DataFrame:
        rows, waiting, size = [], [], 0

        def work() -> None:
            for line, found in zip(waiting, find_runs(waiting, words, periods)):
                stay = line if not found else [w for w, k in zip(line, kept(len(line), found)) if k]
                rows.append((len(line), [{"start": s, "length": n, "period": p} for s, n, p in found], b" ".join(stay).decode()))
            waiting.clear()

        for text in column:
            line = text.encode().split()  # bytes: only ASCII white space splits
            if waiting and size + len(line) > BATCH_WORDS:
                work()
                size = 0
            waiting.append(line)
            size += len(line)
        work()
        return pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return texts(docs).select("doc_id", of("text").alias("r")).select("doc_id", "r.*")
