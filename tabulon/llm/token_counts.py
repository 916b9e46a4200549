"""Exact token counts: a histogram of encoded lengths answers totals, quantiles and truncated totals.

Method: documents are encoded whole and aggregated by their length (partial sums before the
shuffle), one row per distinct length.  Suffix sums over that histogram give, for each
context limit L, the tokens that remain after truncation (the sum over t of documents
longer than t, t below L), the documents that are cut, and the quantiles.  The histogram has one row per distinct
length, so its size follows the longest document, not the corpus; it is summed in ranges all the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import texts
from tabulon.llm.tokens import encoder
from tabulon.session import stored

LIMITS = (512, 1024, 2048, 4096, 8192, 32768, 131072)
WIDTH = 4096  # lengths per range of the suffix sums


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, tokens): encoded length of each whole text; null and empty texts have 0."""
    @pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        encode = encoder(tokenizer).encode
        return pd.Series([len(encode(t)) // 4 for t in text], dtype="int64")

    return texts(docs).select("doc_id", count("text").alias("tokens"))


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(tokens, docs): documents per encoded length."""
    return token_lengths(docs, tokenizer).groupBy("tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """Per distinct length: documents and tokens at that length, above it, and tokens kept when cut to it.

    ``lengths`` is (tokens, docs).  Columns: tokens, docs, longer_docs, longer_tokens,
    up_to_docs, kept_tokens, total_docs, total_tokens.
    """
    rows = lengths.select("tokens", "docs", F.expr(f"tokens div {WIDTH}").alias("range"))
    ranges = rows.groupBy("range").agg(F.sum("docs").alias("d"), F.sum(F.expr("docs * tokens")).alias("t"))
    later = "over (order by range desc rows between unbounded preceding and 1 preceding)"
    above = ranges.selectExpr(
        "range", f"coalesce(sum(d) {later}, 0) as d_above", f"coalesce(sum(t) {later}, 0) as t_above",
        "sum(d) over () as total_docs", "sum(t) over () as total_tokens")
    inside = "over (partition by range order by tokens desc rows between unbounded preceding and 1 preceding)"
    summed = rows.join(above, "range").select(
        "tokens", "docs", "total_docs", "total_tokens",
        F.expr(f"coalesce(sum(docs) {inside}, 0) + d_above").alias("longer_docs"),
        F.expr(f"coalesce(sum(docs * tokens) {inside}, 0) + t_above").alias("longer_tokens"))
    return summed.select(
        "tokens", "docs", "longer_docs", "longer_tokens",
        F.expr("total_docs - longer_docs").alias("up_to_docs"),
        F.expr("total_tokens - longer_tokens + tokens * longer_docs").alias("kept_tokens"),
        "total_docs", "total_tokens")


def token_report(docs: DataFrame, tokenizer: str, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """The histogram with its suffix sums, a row per length that occurs and one per context limit.

    Columns: tokens, docs (at that length; 0 at a limit that no document has), longer_docs
    (they would be cut there), longer_tokens, up_to_docs, kept_tokens (total if every document is cut to
    that length), quantile (share of documents up to that length), total_docs,
    total_tokens.  An empty table gives the limits with zero counts and a null quantile.
    """
    spark = docs.sparkSession
    found = histogram(docs, tokenizer)
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("tokens"))
    both = found.unionByName(wanted.withColumn("docs", F.lit(0).cast("long")))
    lengths = stored(both.groupBy("tokens").agg(F.sum("docs").alias("docs")))
    return suffix_sums(lengths).withColumn(
        "quantile", F.expr("up_to_docs / nullif(total_docs, 0)"))


def quantile_length(report: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed."""
    return report.where(F.col("docs") > 0).where(F.col("quantile") >= share).agg(F.min("tokens").alias("tokens"))
