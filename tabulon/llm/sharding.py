"""K-d tree partitioning of documents into shards of equal bytes, with DataFrame functions only.

Method: every node of the tree stands for a number of shards and is split at a weighted median (weights
are bytes) along its widest dimension, until each leaf is one shard and holds the target
bytes.  Dimensions come from the text alone, so copies of a text have the same coordinates.
A position along a dimension is a 62-bit key: the coordinate, then a hash of
the text, then a hash of the document.  The median is found by descending through the key's
bits: each pass sums bytes per node and per slice of bits (at most 2048 rows per node come to the
driver) and narrows to the slice that holds the median.  The descent stops at the text hash, so
copies stay together; only where one text holds a noticeable part of a shard does it
go on into the document hash and split the copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import rank_in_groups
from tabulon.session import stored

OVERHEAD = 16  # bytes per document besides its text
COORD, TEXT, DOC = 20, 22, 20  # bits of a key
WIDTH = COORD + TEXT + DOC
SLICE = 11  # bits per pass
DIMENSIONS = ("d0", "d1", "d2", "d3")
TOLERANCE = 0.002  # of a shard's target bytes: how near a cut comes to the median
HEAVY = 0.02  # of a shard's target bytes: a text above it has its copies split


@dataclass
class Node:
    """A region of the tree: the shards it still holds, the first of them, and the cut being looked for."""

    shards: int
    first: int
    dim: int = 0
    total: int = 0
    # the part of the key found so far, its bits, bytes below it, bytes in it
    prefix: int = 0
    bits: int = 0
    below: int = 0
    inside: int = 0
    done: bool = False

    def step(self) -> int:
        """Bits of the next slice: up to the end of the text hash, then up to the end of the key."""
        return min(SLICE, (COORD + TEXT if self.bits < COORD + TEXT else WIDTH) - self.bits)


def measured(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32 and keys of four text dimensions."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.octet_length(text).alias("bytes"), F.char_length(text).alias("chars"),
        F.char_length(F.translate(text, "\n", "")).alias("joined"), F.char_length(F.translate(text, " ", "")).alias("spaceless"))
    top = (1 << COORD) - 1
    scaled = {
        "d0": "log2(1 + bytes) / 32",
        "d1": "(bytes - chars) / greatest(bytes, 1)",
        "d2": "log2(1 + chars - joined) / 32",
        "d3": "(chars - spaceless) / greatest(chars, 1)",
    }
    tail = (f"shiftleft(h & {(1 << TEXT) - 1}L, {DOC}) | (xxhash64(doc_id, h) & {(1 << DOC) - 1}L)")
    return base.select("doc_id", "size", "text_crc32", *[F.expr(
        f"shiftleft(cast(least(1.0, greatest(0.0, {e})) * {top} as long), {TEXT + DOC}) | {tail}").alias(d)
        for d, e in scaled.items()])


def _by_node(values: list[int], kind: str) -> str:
    """SQL that looks a node's value up; a constant array, so every pass runs the same compiled code."""
    return f"cast(array({', '.join(map(str, values))}) as array<{kind}>)[node]"


KEY = f"array({', '.join(DIMENSIONS)})"


def _slices(rows: DataFrame, nodes: list[Node]) -> list:
    """Bytes per node and next slice of key bits, for the open nodes; at most 2 ** SLICE rows each."""
    key = f"{KEY}[{_by_node([n.dim for n in nodes], 'int')}]"
    rest = [WIDTH - n.bits for n in nodes]
    found = rows.where(f"node >= 0 and {_by_node([int(not n.done) for n in nodes], 'int')} = 1").select(
        "size", "node", F.expr(f"shiftright({key}, {_by_node(rest, 'int')})").alias("prefix"),
        F.expr(f"shiftright({key}, {_by_node([r - n.step() for r, n in zip(rest, nodes)], 'int')}) & "
               f"{_by_node([(1 << n.step()) - 1 for n in nodes], 'bigint')}").alias("slot"))
    return found.where(f"prefix = {_by_node([n.prefix for n in nodes], 'bigint')}").groupBy("node", "slot").agg(
        F.sum("size").alias("bytes")).orderBy("node", "slot").collect()


def _narrow(rows: DataFrame, nodes: list[Node], target: float) -> None:
    """Find each node's cut: after this, keys up to ``prefix`` (at ``bits``) lie on the left side."""
    while not all(n.done for n in nodes):
        sums: dict[int, list] = {}
        for r in _slices(rows, nodes):
            sums.setdefault(r["node"], []).append(r)
        for i, n in enumerate(nodes):
            if n.done:
                continue
            goal, at = n.total * (n.shards // 2) / n.shards, n.below
            for r in sums[i]:
                if at + r["bytes"] >= goal or r is sums[i][-1]:
                    n.prefix, n.bits = n.prefix << n.step() | r["slot"], n.bits + n.step()
                    n.below, n.inside = at, r["bytes"]
                    break
                at += r["bytes"]
            last = n.bits == WIDTH or (n.bits == COORD + TEXT and n.inside <= HEAVY * target)
            if last or n.inside <= TOLERANCE * target:
                n.done = True
                if goal - n.below < n.below + n.inside - goal:  # the nearer side: leave the slice to the right
                    n.prefix -= 1


def kd_tree(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` of ``measured`` with ``shard``: the leaf of the tree that each row falls into.

    ``node`` numbers the regions of a level that are still to be split; rows in finished
    leaves carry ``-1 - shard``.
    """
    level = [Node(shards, 0)]
    rows = rows.withColumn("node", F.lit(0 if shards > 1 else -1))
    target = None
    while level and shards > 1:
        spread = rows.where("node >= 0").groupBy("node").agg(F.sum("size").alias("total"), *[F.expr(
            f"coalesce(stddev_pop(shiftright({d}, {TEXT + DOC})), 0)").alias(d) for d in DIMENSIONS]).collect()
        for r in spread:
            n = level[r["node"]]
            n.total, n.dim = r["total"], max(range(len(DIMENSIONS)), key=lambda k: r[DIMENSIONS[k]])
        for n in level:
            n.done = not n.total
        target = target or max(1.0, level[0].total / shards)
        _narrow(rows, level, target)
        left, right, nxt = [], [], []
        for n in level:
            half = n.shards // 2
            for side, count, first in ((left, half, n.first), (right, n.shards - half, n.first + half)):
                side.append(-1 - first if count == 1 else len(nxt))
                if count > 1:
                    nxt.append(Node(count, first))
        key = f"{KEY}[{_by_node([n.dim for n in level], 'int')}]"
        goes_left = (f"shiftright({key}, {_by_node([WIDTH - n.bits for n in level], 'int')}) <= "
                     f"{_by_node([n.prefix for n in level], 'bigint')}")
        rows = stored(rows.withColumn("node", F.expr(
            f"case when node < 0 then node when {goes_left} then {_by_node(left, 'int')} else {_by_node(right, 'int')} end")))
        level = nxt
    return rows.withColumn("shard", F.expr("-1 - node")).drop("node", *DIMENSIONS)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of nearly equal bytes.

    ``size`` is the UTF-8 length of the text (null: none) plus 16; ``law`` is "bytes", so
    ``grown_shard`` is null.  ``slot`` is gapless from 0 in each shard.  Equal texts share a
    shard unless they hold a noticeable part of one; repeated rows get a slot each; an
    empty table gives an empty result.
    """
    rows = stored(measured(docs))
    placed = kd_tree(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    ranked = rank_in_groups(placed, "shard", F.struct("doc_id", "text_crc32", "size"), most, "slot")
    return ranked.withColumn("grown_shard", F.lit(None).cast("int"))
