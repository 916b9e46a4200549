"""Removal of long repeated byte strings by suffix arrays.

Contract: a byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else,
in the same text or another.

1. *Anchors.*  Of the LENGTH - GRAM + 1 strings of GRAM bytes in a string of LENGTH bytes, the first one with the
   smallest hash is its anchor.  The choice depends on the string's bytes alone, so equal strings of LENGTH bytes have equal
   anchors at equal places, and only strings with equal anchors need comparing.
2. *Equal surroundings.*  The strings of LENGTH bytes that have one anchor start at successive positions; what they
   cover is its surroundings.  Each start has one anchor, so no string is compared twice.  Where two anchors have the same
   surroundings, all those strings repeat, and a single one stands for all in what follows.
3. *Suffix arrays.*  Different surroundings of equal anchors are joined to shards; each shard's suffixes
   are sorted by induction, and permuted common prefixes of LENGTH or more give the
   repeated strings.
4. *Frequent anchors.*  An anchor with more than ``MANY`` different surroundings (the edge of a passage that very many texts share)
   is not gathered in a task: its strings are split by the hash of the part that a block of starts shares, and
   only blocks that meet another are compared start by start, all by grouping on hashes.
5. The repeated intervals of a text are merged and its remaining bytes hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import texts
from tabulon.llm.suffix_array import Hashes, common_prefixes, suffix_array
from tabulon.session import stored

LENGTH, GRAM = 200, 40
MANY = 400  # different surroundings of one anchor that a shard takes
SHARD_BYTES = 2_000_000
BLOCK = 16  # starts of a block of a frequent anchor

# a fixed random 64-bit number per byte value
NUMBERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def hashed(raw: bytes) -> Hashes:
    return Hashes(NUMBERS[np.frombuffer(raw, np.uint8)])


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """Anchors of a text: positions, hashes, first and last start of the strings that have them, hashes of the surroundings."""
    n, width = len(raw), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 5
    hashes = hashed(raw)
    grams = n - GRAM + 1
    value = (hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.down[:grams]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(30)
    lowest = _slide(value, width, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    # the anchor changes where a lower value comes in and where the last start was the anchor itself
    first = np.flatnonzero(np.append(True, (lowest[1:] != lowest[:-1]) | (value[:len(lowest) - 1] == lowest[:-1])))
    last = np.append(first[1:], len(lowest)) - 1
    low = lowest[first]
    came = np.append(False, low[1:] < lowest[first[1:] - 1])
    at = np.where(came, first + width - 1, last)
    rest = np.flatnonzero(~came & (value[last] != low))
    for k in range(0, len(rest), 4096):
        some = rest[k:k + 4096]
        at[some] = first[some] + np.argmax(value[first[some][:, None] + np.arange(width)] == low[some][:, None], axis=1)
    around = hashes.of(first, last + LENGTH) + (at - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return at, low, first, last, around + (last + LENGTH - at).astype(np.uint64)


def _slide(values: np.ndarray, width: int, lower, filler) -> np.ndarray:
    """Lowest value of each window, from running values inside blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, filler, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = lower.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(lower.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return lower(behind[:n - width + 1], ahead[width - 1:n])


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = [(key, *anchors(text.encode())) for key, text in zip(batch["key"], batch["text"])]
        yield pd.DataFrame({
            "key": np.repeat(batch["key"].to_numpy(), [len(p[1]) for p in parts]),
            "pos": np.concatenate([p[1] for p in parts]).astype("int32"),
            "gram": np.concatenate([p[2] for p in parts]).astype(np.uint64).view("int64"),
            "first": np.concatenate([p[3] for p in parts]).astype("int32"),
            "starts": np.concatenate([p[4] - p[3] + 1 for p in parts]).astype("int16"),
            "around": np.concatenate([p[5] for p in parts]).astype(np.uint64).view("int64")})


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes around the listed anchors of each text."""
    for batch in batches:
        out = []
        for key, text, places in zip(batch["key"], batch["text"], batch["places"]):
            raw = text.encode()
            for place in places:
                if not place["many"]:
                    first = place["first"]
                    out.append((key, place["gram"], first, raw[first:first + place["starts"] - 1 + LENGTH]))
        yield pd.DataFrame(out, columns=["key", "gram", "first", "data"])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of starts around frequent anchors: the hash of the part that all of a block's strings
    share, with its place (``core``), and of all their bytes (``full``)."""
    for batch in batches:
        out = []
        for key, text, places in zip(batch["key"], batch["text"], batch["places"]):
            at = np.array([p["pos"] for p in places if p["many"]], np.int64)
            gram = np.array([p["gram"] for p in places if p["many"]], np.int64).view(np.uint64)
            start = np.array([p["first"] for p in places if p["many"]], np.int64)
            end = start + np.array([p["starts"] for p in places if p["many"]], np.int64) - 1
            hashes = hashed(text.encode())
            # counted from the anchor, so equal places share a block
            begin = at[:, None] + BLOCK * np.arange(-((LENGTH - GRAM) // BLOCK), 1)
            first = np.maximum(begin, start[:, None])
            last = np.minimum(begin + BLOCK - 1, end[:, None])
            fine = first <= last
            i = np.nonzero(fine)[0]
            begin, first, last = begin[fine], first[fine], last[fine]
            place = (begin - at[i]).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
            core = hashes.of(begin + BLOCK - 1, begin + LENGTH) + gram[i] + place
            full = hashes.of(first, last + LENGTH) + (first - begin).astype(np.uint64) * np.uint64(31) + (last - begin).astype(np.uint64)
            out.append((np.full(len(i), key), first, last, core, full))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pd.DataFrame({"key": columns[0].astype("int64"), "first": columns[1].astype("int32"), "last": columns[2].astype("int32"),
                            "core": columns[3].view("int64"), "full": columns[4].view("int64")})


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of all strings that start in the listed blocks of each text."""
    for batch in batches:
        keys, firsts, strings = [], [], []
        for key, text, blocks in zip(batch["key"], batch["text"], batch["blocks"]):
            at = np.unique(np.concatenate([np.arange(b["first"], b["last"] + 1) for b in blocks]))
            keys.append(np.full(len(at), key))
            firsts.append(at)
            strings.append(hashed(text.encode()).of(at, at + LENGTH))
        yield pd.DataFrame({"key": np.concatenate(keys).astype("int64"), "first": np.concatenate(firsts).astype("int32"),
                            "string": np.concatenate(strings).view("int64")})


def shard_repeats(pieces: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(key, first, past) of the intervals repeated among pieces (key, place in its text, bytes)."""
    length = np.array([len(p[2]) for p in pieces])
    joined = np.ones(int(length.sum()) + len(pieces) + 1, np.int64)
    begin = np.cumsum(length + 1) - length - 1
    for b, (_, _, raw) in zip(begin.tolist(), pieces):
        joined[b:b + len(raw)] = np.frombuffer(raw, np.uint8)
        joined[b:b + len(raw)] += 2
    joined[-1] = 0
    order = suffix_array(joined)
    piece = np.append(np.repeat(np.arange(len(pieces)), length + 1), len(pieces) - 1)
    room = np.maximum(begin[piece] + length[piece] - np.arange(len(joined)), 0)
    shared = common_prefixes(joined, order, room)
    whole = room >= LENGTH  # the string ends inside its piece
    place = np.arange(len(joined)) - begin[piece] + np.array([p[1] for p in pieces])[piece]
    _, text = np.unique(np.array([p[0] for p in pieces]), return_inverse=True)
    identity = text[piece].astype(np.int64) << 40 | place
    ordered = order[whole[order]]
    # predecessors that reach LENGTH are whole strings themselves, so runs stay unbroken here
    starts = np.flatnonzero(shared[ordered] < LENGTH)
    if not len(starts) or starts[0] != 0:
        starts = np.insert(starts, 0, 0)
    if not len(ordered):
        return []
    who = identity[ordered]
    several = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
    hit = np.sort(ordered[np.repeat(several, np.diff(np.append(starts, len(ordered))))])
    if not len(hit):
        return []
    cuts = np.flatnonzero((np.diff(hit) > 1) | (piece[hit[1:]] != piece[hit[:-1]])) + 1
    heads, tails = np.insert(hit[cuts], 0, hit[0]), np.append(hit[cuts - 1], hit[-1])
    return [(pieces[piece[a]][0], int(place[a]), int(place[b]) + LENGTH) for a, b in zip(heads.tolist(), tails.tolist())]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of whole anchors; rows come sorted by anchor."""
    pieces, size, last = [], 0, None

    def frame() -> pd.DataFrame:
        found = np.array(shard_repeats(pieces), np.int64).reshape(-1, 3)
        return pd.DataFrame({"key": found[:, 0], "first": found[:, 1].astype("int32"), "past": found[:, 2].astype("int32")})

    for batch in batches:
        for key, gram, first, data in zip(batch["key"], batch["gram"], batch["first"], batch["data"]):
            if size >= SHARD_BYTES and gram != last:
                yield frame()
                pieces, size = [], 0
            pieces.append((key, first, data))
            size, last = size + len(data), gram
    if pieces:
        yield frame()


def _frequent(touched: DataFrame) -> DataFrame:
    """(key, first, past) of repeated strings around frequent anchors, by grouping on hashes.

    A block equal to another repeats as a whole.  Of those that only share their core with a
    different one, each kind is compared start by start.
    """
    blocks = stored(touched.where("exists(places, p -> p.many)").select("key", "text", "places").mapInPandas(
        _blocks, "key long, first int, last int, core long, full long"))
    kinds = stored(blocks.groupBy("core", "full").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last")).alias("one")))
    equal = blocks.join(kinds.where("n > 1").select("core", "full"), ["core", "full"]).select("key", "first", "last")
    shared = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    unlike = kinds.join(shared.select("core"), "core").select("one.key", "one.first", "one.last")
    listed = unlike.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("blocks"))
    each = stored(touched.select("key", "text").join(listed, "key").mapInPandas(_starts, "key long, first int, string long"))
    again = each.groupBy("string").agg(F.min(F.struct("key", "first")).alias("a"), F.max(F.struct("key", "first")).alias("b")).where("a != b")
    single = each.join(again.select("string"), "string").select("key", "first", F.col("first").alias("last"))
    return equal.union(single).select("key", "first", (F.col("last") + LENGTH).alias("past"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the intervals of each text and hash what is left."""
    for batch in batches:
        out = []
        for key, text, spans in zip(batch["key"], batch["text"], batch["spans"]):
            raw = text.encode()
            kept, at, removed, runs = [], 0, 0, 0
            end = -1
            for first, past in sorted((s["first"], s["past"]) for s in spans):
                if first > end:  # a new run; one that only touches the last joins it
                    runs += 1
                    kept.append(raw[at:first])
                    removed += past - first
                    at = end = past
                elif past > end:
                    removed += past - end
                    at = end = past
            kept.append(raw[at:])
            out.append((key, removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document.

    Null texts are empty; a text under ``LENGTH`` bytes keeps everything.  A repeated row (same
    id and text) occurs as often as it is given, so its bytes repeat.
    """
    base = texts(docs).withColumn("key", F.xxhash64("doc_id", "text", F.lit(1)))
    slim = stored(base.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(
        F.col("text").cast("binary"), 256).alias("whole")))
    twice = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = stored(base.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInPandas(
        _find_anchors, "key long, pos int, gram long, first int, starts short, around long"))
    # stored (as ``many`` below), so that the join with it can split the rows of a frequent anchor over tasks
    shared = stored(found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high")).where("n > 1"))
    joined = stored(found.join(shared, "gram").select(
        "key", "pos", "gram", "first", "starts", "around", (F.col("low") == F.col("high")).alias("alike")))
    mixed = joined.where("not alike")
    kinds = mixed.groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "first", "starts")).alias("one"))
    kinds = stored(kinds)
    many = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MANY).select("gram", F.lit(True).alias("many")))
    chosen = kinds.join(many, "gram", "left").select("one.*", "gram", F.coalesce("many", F.lit(False)).alias("many"))
    alike = joined.where("alike").select("key", "first", "starts").union(mixed.join(
        kinds.where("n > 1").select("gram", "around"), ["gram", "around"]).select("key", "first", "starts"))
    # texts with any shared anchor, with the anchors to compare and those known to repeat
    places = chosen.groupBy("key").agg(F.collect_list(F.struct("pos", "gram", "first", "starts", "many")).alias("places"))
    known = alike.groupBy("key").agg(F.collect_list(F.struct("first", "starts")).alias("alike"))
    wanted = places.join(known, "key", "full")
    touched = stored(base.select("key", "text").join(wanted, "key"))
    around = touched.where("exists(places, p -> not p.many)").select("key", "text", "places").mapInPandas(
        _surroundings, "key long, gram long, first int, data binary")
    sharded = around.repartition("gram").sortWithinPartitions("gram")
    spans = sharded.mapInPandas(_shards, "key long, first int, past int").union(_frequent(touched)).union(
        touched.where("alike is not null").select("key", F.explode("alike").alias("a")).select(
            "key", "a.first", (F.col("a.first") + F.col("a.starts") + (LENGTH - 1)).alias("past")))
    by_text = spans.groupBy("key").agg(F.collect_set(F.struct("first", "past")).alias("spans"))
    cut = touched.select("key", "text").join(by_text, "key").mapInPandas(
        _cut, "key long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["key"])
    empty = hashlib.sha256(b"").hexdigest()
    gone = (F.col("n").isNotNull()) & (F.col("n_bytes") >= LENGTH)
    return slim.join(cut, "key", "left").join(twice, "key", "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
