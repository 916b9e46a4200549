"""Packing documents into sequences by cutting-stock column generation.

A document is cut into full pieces of the context length and one rest, so its pieces are known
from its own length and the text is encoded once.  Rests are the orders of a
cutting-stock problem: their lengths, rounded up to a unit of a few tokens, give a histogram
of bounded size (context / unit rows), the only thing the driver sees.  A linear program over filling patterns
is solved by column generation, with knapsack dynamic programming pricing the
columns; patterns are rounded down, the few orders left over are filled best-fit, and the
pieces, ranked within their length class by Spark, take the places of the patterns in turn.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import rank_in_groups, texts
from tabulon.llm.tokens import encoder
from tabulon.session import stored

UNIT = 8  # tokens; a piece's length is rounded up to it in the plan, never in the output


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over sizes 1..capacity: best value and how often each size is taken."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        choice = best[c - 1::-1][:c] + values[:c]
        k = int(choice.argmax())
        best[c], taken[c] = choice[k], k + 1
    pattern, c = np.zeros(capacity, int), capacity
    while c > 0 and best[c] > 0:
        pattern[taken[c] - 1] += 1
        c -= taken[c]
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse with row exchanges; element-wise numpy, so no thread pool starts in the driver."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        best = k + int(np.abs(both[k:, k]).argmax())
        if best != k:
            both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        touched = np.flatnonzero(others)
        both[touched] -= others[touched, None] * both[k]
    return both[:, m:]


def plan(orders: dict[int, int], capacity: int, tolerance: float = 1e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: times}, how many sequences) that hold every order; sizes and capacity in units.

    The linear program minimises the number of sequences.  Its basis starts with one
    single-size pattern per size and takes the best-priced column until the bound that the
    prices prove is reached within ``tolerance`` (or a twentieth of a sequence), at the latest after 20 columns per size.
    """
    sizes = sorted(orders)
    if not sizes:
        return []
    m = len(sizes)
    # small unequal additions keep ratios apart: degenerate steps could cycle
    need = np.array([orders[s] for s in sizes], float) + np.linspace(0.001, 0.002, m) * np.sqrt(np.arange(2, m + 2))
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    rounds, bound = 0, 0.0
    while rounds < 20 * m:
        rounds += 1
        dual = inverse.sum(axis=0)
        values = np.full(capacity, -1.0)
        values[np.array(sizes) - 1] = dual
        worth, pattern = price(values, capacity)
        now = float(dual @ need)
        bound = max(bound, now / max(worth, 1.0))  # no plan needs fewer
        if now - bound <= max(0.05, tolerance * now):
            break
        column = pattern[np.array(sizes) - 1].astype(float)
        x, d = inverse @ need, inverse @ column
        usable = d > 1e-9
        ratio = np.where(usable, x / np.where(usable, d, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        if rounds % 100 == 0:
            inverse = inverted(basis)
        else:
            row = inverse[leave] / d[leave]
            inverse = inverse - np.outer(d, row)
            inverse[leave] = row
    counts = np.floor(np.maximum(inverted(basis) @ need, 0) + 1e-7).astype(int)
    left = Counter({s: orders[s] for s in sizes})
    out = []
    for j in np.flatnonzero(counts):
        used = {sizes[i]: int(basis[i, j]) for i in range(m) if basis[i, j] > 0.5}
        # never more than the orders still open
        times = min([int(counts[j]), *(left[s] // n for s, n in used.items())])
        if times:
            out.append((used, times))
            for s, n in used.items():
                left[s] -= n * times
    while rest := [s for s in sorted(left, reverse=True) if left[s] > 0]:
        pattern, room = {}, capacity
        for s in rest:
            n = min(left[s], room // s)
            if n:
                pattern[s] = n
                room -= n * s
        times = max(1, min(left[s] // n for s, n in pattern.items()))
        out.append((pattern, times))
        for s, n in pattern.items():
            left[s] -= n * times
    return out


def pieces(docs: DataFrame, tokenizer: str, context: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces and a rest for each document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, text in zip(batch["doc_id"], batch["text"]):
                raw = encode(text) + end
                n = len(raw) // 4
                for start in range(0, n, context):
                    part = raw[4 * start:4 * (start + context)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                        column.append(value)
            yield pd.DataFrame({
                "doc_id": pd.array([None if pd.isna(x) else int(x) for x in out[0]], "Int64"),
                **{name: np.asarray(column, "int64") for name, column in zip(
                    ("start", "length", "ids_crc32", "doc_tokens"), out[1:])}})

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def places(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Runs of ranks: (size, first rank, sequence it starts in, times per sequence, order in the sequence)."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        at = 0
        for size in sorted(pattern, reverse=True):
            n = pattern[size]
            rows.append((size, used[size], used[size] + n * times, sequence, n, at))
            used[size] += n * times
            at += n
        sequence += times
    return pd.DataFrame(rows, columns=["size", "first", "past", "sequence", "times", "at"])


def pack(docs: DataFrame, tokenizer: str, context: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Adds sequence_id and offset (gapless from 0 within a sequence) to ``pieces``.  A null
    or empty text is the end id alone; repeated rows are packed as often as they occur; an
    empty table gives an empty result.  A sequence holds at most ``context`` pieces, which
    bounds every window; patterns and histogram have at most context / UNIT sizes.
    """
    capacity = context // UNIT
    cut = stored(pieces(docs, tokenizer, context, end_id).withColumn("size", F.expr(f"int(ceil(length / {UNIT}))")))
    orders = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(orders, capacity)).sort_values(["size", "first"]).reset_index(drop=True)
    by_size = {int(s): g.to_numpy() for s, g in table.groupby("size")}
    ranked = rank_in_groups(cut, "size", F.struct("doc_id", "start", "ids_crc32"), max(orders.values(), default=0), "rank")

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            sequence, order = np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                runs = by_size[int(s)]
                run = runs[np.searchsorted(runs[:, 1], rank[mine], side="right") - 1]
                inside = rank[mine] - run[:, 1]
                sequence[mine] = run[:, 3] + inside // run[:, 4]
                order[mine] = run[:, 5] + inside % run[:, 4]
            yield batch.drop(columns=["size", "rank"]).assign(sequence_id=sequence, place=order)

    seated = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "rank").mapInPandas(
        seat, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    return seated.withColumn("offset", F.expr(
        "coalesce(sum(length) over (partition by sequence_id order by place rows between unbounded preceding and 1 preceding), 0)"
    ).cast("long")).drop("place")
