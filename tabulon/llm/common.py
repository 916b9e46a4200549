"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that one window or one task may hold of a group that has been split.
GROUP_ROWS = 100_000


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), plus named columns; all other columns of the input are left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)


def rank_in_groups(df: DataFrame, group: str, key: Column, n_rows: int, rank: str) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... within each value of ``group``, without holding a group in one task.

    Rows are dealt to cells by a hash of ``key`` (unique per row, or nearly), ranked inside
    their cell, and shifted by the number of rows in the cells before it.
    """
    cells = max(1, -(-n_rows // GROUP_ROWS))
    dealt = df.withColumn("__key", key).withColumn("__cell", F.pmod(F.xxhash64("__key"), F.lit(cells)).cast("int"))
    ranked = dealt.withColumn(rank, F.expr(
        f"row_number() over (partition by `{group}`, __cell order by __key) - 1").cast("long"))
    if cells > 1:
        counts = dealt.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
        before = counts.select(group, "__cell", F.expr(
            f"coalesce(sum(__n) over (partition by `{group}` order by __cell rows between unbounded preceding "
            "and 1 preceding), 0)").cast("long").alias("__before"))
        ranked = ranked.join(before, [group, "__cell"]).withColumn(rank, F.col(rank) + F.col("__before")).drop("__before")
    return ranked.drop("__key", "__cell")
