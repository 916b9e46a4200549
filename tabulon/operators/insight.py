"""Numbers behind the text next to a chart."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, format_inr, is_number, is_text, number, type_of


def key_metrics(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``column, total, avg, min, max`` for every column with numeric values: one pass."""
    names = list(columns or [c for c in df.columns if is_number(type_of(df, c)) or is_text(type_of(df, c))])
    aggs = []
    for i, c in enumerate(names):
        v = number(df, c)
        aggs += [F.sum(v).alias(f"t{i}"), F.avg(v).alias(f"a{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"t{i}").alias("total"), F.col(f"a{i}").alias("avg"),
            F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("avg").isNotNull())


def insight_numbers(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row on an aggregated chart: extremes, mean, total, concentration.

    Ties go to the smaller label at the top and the larger one at the bottom.
    """
    data = df.select(col(x).cast("string").alias("label"), number(df, y).alias("v")).where(F.col("v").isNotNull())
    best = data.orderBy(F.desc("v"), F.asc("label")).limit(3)
    top3 = best.agg(F.sum("v")).first()[0]
    facts = data.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("v").alias("total"),
        F.avg("v").alias("average"),
        F.min(F.struct((-F.col("v")).alias("v"), F.col("label"))).alias("top"),
        F.min("v").alias("bottom_value"),
        F.max(F.struct((-F.col("v")).alias("v"), F.col("label"))).alias("bottom"),
    )
    top_value = -F.col("top.v")
    return facts.select(
        "records", "total", "average",
        F.col("top.label").alias("top_label"),
        top_value.alias("top_value"),
        F.col("bottom.label").alias("bottom_label"),
        "bottom_value",
        F.when(F.col("total") > 0, top_value / F.col("total") * 100).otherwise(F.lit(0.0)).alias("top_pct"),
        F.when(F.col("bottom_value") > 0, top_value / F.col("bottom_value")).otherwise(F.lit(1.0)).alias("spread"),
        F.lit(top3).cast("double").alias("top3_total"),
    )


def insight_lines(df: DataFrame, x: str, y: str, title: str = "") -> DataFrame:
    """The same facts as short sentences, one per row."""
    about = f"{title} {x} {y}"
    facts = insight_numbers(df, x, y)

    def money(name):
        return format_inr(F.col(name), about)

    lines = F.array(
        F.format_string("%d records", "records"),
        F.concat(F.lit("Highest: "), F.col("top_label"), F.lit(" with "), money("top_value"),
                 F.format_string(" (%.1f%% of the total)", "top_pct")),
        F.concat(F.lit("Lowest: "), F.col("bottom_label"), F.lit(" with "), money("bottom_value")),
        F.concat(F.lit("Mean "), money("average"), F.lit(", total "), money("total")),
        F.concat(F.lit("Top three together "), money("top3_total"), F.format_string("; spread %.1fx", "spread")),
    )
    return facts.select(F.posexplode(lines).alias("line", "text"))
