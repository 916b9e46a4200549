"""Positions and neighbours in sorted groups of any size.

A window over a group puts the whole group into one task.  That is fine while
the largest group is known to be small, and it is the plan used then.  A larger
group is sorted by range over many tasks instead; every task numbers its own
rows and adds the number of rows of the group in the ranges before it.  Windows
that look back a fixed number of rows work on blocks of consecutive positions,
each block carrying a copy of the last rows of the block before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import TASK_ROWS, durable


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group (0 for an empty input)."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & col(k).eqNullSafe(col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    limit: int = TASK_ROWS,
    known_largest: int | None = None,
) -> DataFrame:
    """0-based position of every row in its group, sorted by ``order`` ascending.

    Rows equal in ``order`` are put in the order of a hash of the whole row; rows
    equal in every column are interchangeable.
    """
    biggest = largest_group(df, keys) if known_largest is None else known_largest
    key_cols = [col(k) for k in keys]
    tie = F.xxhash64(*[col(c) for c in df.columns])
    if biggest <= limit:
        window = Window.partitionBy(*key_cols).orderBy(*[col(c) for c in order], tie)
        return df.withColumn(name, F.row_number().over(window).cast("long") - 1)

    # Copies of one row collapse before the shuffle and are laid out again at the end.
    merged = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    merged = merged.withColumn("__tie", tie)
    total = max(1, df.count())
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(setting, math.ceil(total / limit))
    sort_cols = [col(c) for c in order] + [F.col("__tie")]
    ranged = durable(
        merged.repartitionByRange(pieces, *key_cols, *sort_cols).withColumn("__part", F.spark_partition_id())
    )
    # One row per (group, range): at most `pieces` rows per group.
    parts = ranged.groupBy(*key_cols, "__part").agg(
        F.sum("__copies").alias("__rows"), F.max("__copies").alias("__most")
    )
    before = Window.partitionBy(*key_cols).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *key_cols, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    )
    inside = (
        Window.partitionBy(*key_cols, "__part").orderBy(*sort_cols).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.withColumn("__inside", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    placed = same(local, starts, [*keys, "__part"]).withColumn("__first", F.col("__start") + F.col("__inside"))
    if parts.agg(F.max("__most")).first()[0] > 1:
        placed = placed.withColumn(
            "__slice", F.explode(F.expr(f"sequence(0L, (__copies - 1) div {limit}L)"))
        ).repartition("__first", "__slice")
        placed = placed.withColumn(
            "__copy",
            F.explode(
                F.expr(f"sequence(__slice * {limit}L, least(__copies, (__slice + 1) * {limit}L) - 1)")
            ),
        )
    else:
        placed = placed.withColumn("__copy", F.lit(0).cast("long"))
    return placed.select(*[col(c) for c in df.columns], (F.col("__first") + F.col("__copy")).alias(name))


class Blocks:
    """Sorted groups cut into blocks that one task can hold.

    ``df`` has the input columns, ``pos``, ``__block`` and ``__halo``; ``window()``
    is the window inside a block and ``done()`` removes the helper rows and columns.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], look_back: int, split: bool, limit: int):
        self.keys = list(keys)
        self.split = split
        if split:
            if look_back > limit:
                raise ValueError("look-back is longer than a block")
            block = F.floor(F.col("pos") / limit).cast("long")
            own = df.withColumns({"__block": block, "__halo": F.lit(False)})
            # A block needs the last `look_back` rows of the block before it, nothing more.
            tail = df.where(F.col("pos") % limit >= limit - look_back).withColumns(
                {"__block": block + 1, "__halo": F.lit(True)}
            )
            self.df = own.unionByName(tail) if look_back else own
        else:
            self.df = df.withColumns({"__block": F.lit(0).cast("long"), "__halo": F.lit(False)})

    def window(self):
        group = [col(k) for k in self.keys]
        if self.split:
            group.append(F.col("__block"))
        return Window.partitionBy(*group).orderBy("pos")

    @staticmethod
    def done(df: DataFrame) -> DataFrame:
        return df.where(~F.col("__halo")).drop("__block", "__halo")


def blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], look_back: int, limit: int = TASK_ROWS
) -> Blocks:
    biggest = largest_group(df, keys)
    placed = with_position(df, keys, order, "pos", limit, biggest)
    return Blocks(placed, keys, look_back, biggest > limit, limit)


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: int = TASK_ROWS, back: bool = True
) -> DataFrame:
    """Fill nulls of ``value`` with the last value before, then (``back``) the first after."""
    biggest = largest_group(df, keys)
    placed = with_position(df, keys, order, "pos", limit, biggest)
    keep = [col(k) for k in keys]
    item = col(value)
    if biggest <= limit:
        past = Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy(*keep).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
        filled = F.last(item, ignorenulls=True).over(past)
        if back:
            filled = F.coalesce(filled, F.first(item, ignorenulls=True).over(ahead))
        return placed.withColumn(value, filled)
    # First and last known value of each block, carried over the (few) blocks of a group.
    placed = placed.withColumn("__block", F.floor(F.col("pos") / limit).cast("long"))
    known = F.when(item.isNotNull(), F.col("pos"))
    ends = placed.groupBy(*keep, "__block").agg(
        F.max_by(item, known).alias("__last"), F.min_by(item, known).alias("__first")
    )
    over_blocks = Window.partitionBy(*keep).orderBy("__block")
    ends = ends.select(
        *keep,
        "__block",
        F.last("__last", True).over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", True).over(over_blocks.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    placed = same(placed, ends, [*keys, "__block"])
    inner = Window.partitionBy(*keep, "__block").orderBy("pos")
    filled = F.coalesce(
        F.last(item, True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before")
    )
    if back:
        filled = F.coalesce(
            filled, F.first(item, True).over(inner.rowsBetween(0, Window.unboundedFollowing)), F.col("__after")
        )
    return placed.withColumn(value, filled).drop("__block", "__before", "__after")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark limits the groups before the shuffle (window group limit), so a hot
    group sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str, limit: int = TASK_ROWS) -> DataFrame:
    """Sum of ``value`` over all rows before this one in ``order`` (unique), for any table size."""
    sort_cols = [col(c) for c in order]
    rows = df.count()
    if rows <= limit:
        before = Window.orderBy(*sort_cols).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(col(value)).over(before), F.lit(0)))
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(setting, math.ceil(rows / limit))
    ranged = durable(df.repartitionByRange(pieces, *sort_cols).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(F.sum(col(value)).alias("__sum"))
    over_parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(over_parts), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*sort_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__inside", F.coalesce(F.sum(col(value)).over(inside), F.lit(0)))
    return local.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__inside")).drop(
        "__part", "__inside", "__start"
    )
