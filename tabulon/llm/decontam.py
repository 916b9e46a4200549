"""Benchmark decontamination by greedy string tiling.

Method: word five-grams of the benchmark are seeds; a document joins the items with which it shares seeds.
For each such pair the longest non-overlapping matches are marked again and again, found by running
Karp-Rabin hashes at a falling search length, down to tiles of five words.
An item counts as leaked where its tiles cover at least 0.8 of its words; their order does
not matter, so reordered passages are caught.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents
per block, so what each task holds is bounded however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import texts

TILE = 5  # words of the shortest tile
COVERAGE = 0.8
BLOCK_BYTES = 16_000_000
LONGEST = 24  # first search length
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tiles(pattern: list[int], text: list[int], shortest: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length) of the marked matches, longest first."""
    taken_p, taken_t = [False] * len(pattern), [False] * len(text)
    found, size = [], max(shortest, min(LONGEST, len(pattern)))
    while True:
        matches = _matches(pattern, text, taken_p, taken_t, size)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * size:  # much longer ones exist: look for those first
            size = longest
            continue
        for p, t, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if not any(taken_p[p:p + n]) and not any(taken_t[t:t + n]):
                taken_p[p:p + n], taken_t[t:t + n] = [True] * n, [True] * n
                found.append((p, t, n))
        if size == shortest:
            # a match cut short by a longer tile may leave a piece that is still long enough
            if not _matches(pattern, text, taken_p, taken_t, size):
                return found
        elif not _matches(pattern, text, taken_p, taken_t, size):
            size = max(shortest, size // 2)


def _hashes(values: list[int], taken: list[bool], size: int) -> list[tuple[int, int]]:
    """(position, hash) of each window of ``size`` values without a marked one; one running hash."""
    out, value, run = [], 0, 0
    base, mask = int(BASE), (1 << 64) - 1
    lead = pow(base, size, 1 << 64)
    for i, v in enumerate(values):
        if taken[i]:
            value = run = 0
            continue
        value, run = (value * base + v) & mask, run + 1
        if run > size:
            value = (value - values[i - size] * lead) & mask
        if run >= size:
            out.append((i - size + 1, value))
    return out


def _matches(pattern, text, taken_p, taken_t, size):
    """Maximal unmarked matches of at least ``size`` values, each reported from its leftmost window."""
    table: dict[int, list[int]] = {}
    for t, h in _hashes(text, taken_t, size):
        table.setdefault(h, []).append(t)
    out = []
    for p, h in _hashes(pattern, taken_p, size):
        for t in table.get(h, ()):
            if pattern[p:p + size] != text[t:t + size]:
                continue
            if p and t and pattern[p - 1] == text[t - 1] and not taken_p[p - 1] and not taken_t[t - 1]:
                continue  # part of a match that starts further left
            n = size
            while (p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n]
                   and not taken_p[p + n] and not taken_t[t + n]):
                n += 1
            out.append((p, t, n))
    return out


class Items:
    """A block of benchmark items with its seeds; built once per worker."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.numbers: dict[str, int] = {}
        self.ids, self.items = [], []
        number = self.numbers
        for item, text in rows:
            sequence = [number.setdefault(w, len(number) + 1) for w in words(text)]
            if len(sequence) >= TILE:
                self.ids.append(item)
                self.items.append(sequence)
        self.where: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(self.items):
            for at, h in enumerate(seeds(np.array(sequence, np.uint64)).tolist()):
                self.where.setdefault(h, []).append((k, at))
        self.keys = np.array(sorted(self.where), np.uint64)

    def leaks(self, text: str, coverage: float) -> list[tuple[int, int, int, int]]:
        """(item id, tiles, covered words, words) of the items covered by a whole text."""
        get = self.numbers.get
        found = words(text)
        if len(found) < TILE or not len(self.keys):
            return []
        sequence = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        known = sequence > 0
        if known.sum() < TILE:
            return []
        full = np.convolve(known, np.ones(TILE, int), "valid") == TILE
        starts = np.flatnonzero(full)
        if not len(starts):
            return []
        hashes = seeds(sequence)[starts]
        slot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[slot] == hashes
        if not hit.any():
            return []
        positions = starts[hit]
        matched: dict[int, set[int]] = {}
        for h in set(hashes[hit].tolist()):
            for k, at in self.where[h]:
                matched.setdefault(k, set()).update(range(at, at + TILE))
        near = np.zeros(len(found) + 1, bool)
        for k in range(TILE):
            near[positions + k] = True
        # the document's words under any seed, runs kept apart by numbers that no item has
        kept = np.flatnonzero(near[:-1])
        gaps = np.flatnonzero(np.diff(kept) > 1) + 1
        stretch = np.insert(sequence[kept].astype(np.int64), gaps, -np.arange(1, len(gaps) + 1)).tolist()
        out = []
        for k in sorted(matched):
            item = self.items[k]
            if len(matched[k]) < coverage * len(item):
                continue  # tiles are made of shared seeds, so they cannot cover more
            marked = tiles(item, stretch)
            covered = sum(n for _, _, n in marked)
            if covered >= coverage * len(item):
                out.append((self.ids[k], len(marked), covered, len(item)))
        return out


def seeds(sequence: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``TILE`` word numbers."""
    out = np.zeros(max(0, len(sequence) - TILE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(TILE):
            out = out * BASE + sequence[k:k + len(out)]
    return out


_items: dict[int, Items] = {}


def items_of(rows: tuple) -> Items:
    key = hash(rows)
    if key not in _items:
        _items.clear()
        _items[key] = Items(list(rows))
    return _items[key]


def blocks(benchmark: DataFrame) -> Iterator[tuple]:
    """The benchmark's (item_id, text) rows in blocks of bounded bytes; null texts are left out, repeated rows count once."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // BLOCK_BYTES)
    for k in range(n):
        yield tuple((r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy(
            "item_id", "text").collect())


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, tiles, covered, item_words, coverage): a row per document and benchmark item it leaks.

    Items of fewer than five words are too short to tell and never match; null and
    empty texts leak nothing; a repeated document row gives repeated rows.
    """
    schema = "doc_id long, item_id long, tiles int, covered int, item_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            items = items_of(block)
            for batch in batches:
                rows = [(None if pd.isna(d) else int(d), *leak) for d, t in zip(batch["doc_id"], batch["text"]) for leak in items.leaks(t, coverage)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "tiles", "covered", "item_words"]).astype(
                        {"doc_id": "Int64", "item_id": "Int64"})

        out = out.union(texts(docs).mapInPandas(run, schema))
    return out.withColumn("coverage", F.col("covered") / F.col("item_words"))


def _clean_column(block: tuple, coverage: float):
    @pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        items = items_of(block)
        return pd.Series([not items.leaks(t, coverage) for t in text], dtype=bool)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    for block in blocks(benchmark):
        docs = docs.where(_clean_column(block, coverage)(F.coalesce("text", F.lit(""))))
    return docs
