"""Importance resampling: draw the documents whose word features look most like a target table's.

1. Features (runs of 1 to ``longest`` words, repeats counted) fall into hash buckets.  Each bucket's counts over all
   documents and all target texts give it a gain: the rounded log of the ratio of its smoothed shares.
2. *Array-scored weights.*  Gains are one array of ``buckets`` numbers; a document's weight is the sum of
   the entries of its features.  A fixed random Gumbel number per document turns "the highest" into a draw without
   replacement in proportion to exp(weight / 1000).
3. *Weighted median-of-medians selection.*  Each task sends the median of its keys that are still open (itself the
   weighted median of the medians of its batches); the median of these, weighted by the numbers of open keys, is counted against
   all open keys.  At least an eighth of them lies on either side, so each round discards that much, until the exact
   cut is met.  The driver sees one short row per task.
4. Winners are sorted by range over many tasks and numbered by the sizes of the ranges before theirs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import GROUP_ROWS, texts
from tabulon.session import stored

BUCKETS = 10_000
UNIT = 1_000  # weights are whole thousandths
LAST = (1 << 63) - 1
FEW = 4_096  # open keys that the driver sorts itself

# letters A-Z lower-cased, ASCII other than letters and digits turned into blanks, other bytes as they are
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters."""
    return text.encode().translate(PLAIN).split()


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Bucket of each run of 1 to ``longest`` words."""
    crc = zlib.crc32
    found = [crc(w) for w in words]
    for k in range(2, longest + 1):
        found += [crc(b" ".join(words[i:i + k])) for i in range(len(words) - k + 1)]
    return np.array(found, np.int64) % buckets


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Number of features per bucket over all texts: each task sends its sums, which Spark adds up."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(feature_buckets(words_of(text), longest, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype("int32"), "n": total[some]})

    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares in target and corpus, in thousandths, rounded down."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(UNIT * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per document."""
    worth = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))

    @pandas_udf("n_words long, n_features long, weight long")
    def weigh(column: pd.Series) -> pd.DataFrame:
        rows = []
        for text in column:
            words = words_of(text)
            found = feature_buckets(words, longest, buckets)
            rows.append((len(words), len(found), int(worth[found].sum())))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    found = texts(docs).select("doc_id", weigh("text").alias("w")).select("doc_id", "w.*")
    return found.withColumn("score", F.col("weight") + gumbel)


def middle(parts: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """Weighted median of (key, weight) pairs."""
    ordered = sorted(parts)
    half, so_far = sum(w for _, w in ordered) / 2, 0
    for key, weight in ordered:
        so_far += weight
        if so_far >= half:
            return key
    raise ValueError("no keys")


def _inside(keys: DataFrame, low: tuple[int, int] | None, high: tuple[int, int] | None) -> DataFrame:
    if low is not None:
        keys = keys.where(f"a > {low[0]} or (a = {low[0]} and b > {low[1]})")
    if high is not None:
        keys = keys.where(f"a < {high[0]} or (a = {high[0]} and b < {high[1]})")
    return keys


def _round(open_keys: DataFrame, pivot: tuple[int, int] | None) -> list:
    """Per task: open keys below, at and above the pivot, with the medians of those below and above."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: list[list] = [[], []]
        equal = 0
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            if pivot is None:
                masks = np.zeros(len(a), bool), np.ones(len(a), bool)
            else:
                same = (a == pivot[0]) & (b == pivot[1])
                less = (a < pivot[0]) | ((a == pivot[0]) & (b < pivot[1]))
                masks = less, ~less & ~same
                equal += int(same.sum())
            for side, mask in zip(sides, masks):
                x, y = a[mask], b[mask]
                if len(x):
                    at = np.lexsort((y, x))[(len(x) - 1) // 2]
                    side.append(((int(x[at]), int(y[at])), len(x)))
        row = [equal]
        for side in sides:
            row += [sum(n for _, n in side), *(middle(side) if side else (None, None))]
        yield pd.DataFrame([row], columns=["equal", "below", "below_a", "below_b", "above", "above_a", "above_b"]).astype("Int64")

    return open_keys.mapInPandas(
        work, "equal long, below long, below_a long, below_b long, above long, above_a long, above_b long").collect()


def cutoff(keys: DataFrame, k: int, total: int) -> tuple[int, int]:
    """The k-th smallest key (a, b) of the ``total`` stored keys, k from 1 to total."""
    low = high = pivot = None
    passed, size = 0, total  # keys up to ``low``; keys in the table that is read
    while True:
        rows = _round(_inside(keys, low, high), pivot)
        below, equal = sum(r.below for r in rows), sum(r.equal for r in rows)
        above = sum(r.above for r in rows)
        if pivot is not None and passed + below < k <= passed + below + equal:
            return pivot
        if pivot is not None and k <= passed + below:
            high, left = pivot, below
            medians = [((r.below_a, r.below_b), r.below) for r in rows if r.below]
        else:
            passed, low, left = passed + below + equal, pivot, above
            medians = [((r.above_a, r.above_b), r.above) for r in rows if r.above]
        if left <= FEW:
            last = sorted((r.a, r.b) for r in _inside(keys, low, high).collect())
            return last[k - passed - 1]
        if left * 16 <= size:  # few of the rows that are read are still open
            keys, size = stored(_inside(keys, low, high).coalesce(max(1, -(-left // GROUP_ROWS)))), left
        pivot = middle(medians)


def numbered(winners: DataFrame, n: int) -> DataFrame:
    """Add ``rank`` 1, 2, 3, ... by (a, b, salt), sorted by range; no task gets more than its range."""
    spark = winners.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_ROWS))
    ranged = stored(winners.repartitionByRange(parts, "a", "b", "salt").withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes)
    before = dict(zip(order, accumulate([0] + [sizes[p] for p in order[:-1]])))
    offsets = spark.createDataFrame(sorted(before.items()), "part int, before long")  # a row per range
    local = ranged.withColumn("place", F.expr("row_number() over (partition by part order by a, b, salt)"))
    return local.join(F.broadcast(offsets), "part").withColumn("rank", F.col("place") + F.col("before"))


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, longest: int = 1,
             buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the ``share`` percent with the highest scores get a rank.

    Only documents of ``least_words`` words or more can be drawn, and the share is of their number, rounded down.
    Ties go to the smaller ``doc_id``, a null id last; repeated rows are drawn one by one (which of two equal rows gets
    the lower rank is left open).  Null and empty texts have no features, weight 0 and no rank; texts of any length are
    read whole; an empty target gives all buckets their smoothed share; an empty table gives an empty result;
    other columns are left out.
    """
    found = stored(scored(docs, target, longest, buckets, seed).select(
        "*", (-F.col("score")).alias("a"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("b"),
        F.monotonically_increasing_id().alias("salt")))
    able = found.where(F.col("n_words") >= least_words)
    n = able.count()
    k = share * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return found.select(*columns, F.lit(None).cast("long").alias("rank"))
    a, b = cutoff(able.select("a", "b"), k, n)
    won = (F.col("n_words") >= least_words) & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b)))
    ranked = numbered(found.where(won), k)
    return ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank")).union(
        found.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))
