"""Derived columns: parts of dates and quantile groups of numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, number, time_of
from .profile import value_counts
from .quantiles import column_quantiles
from .types import type_map

# Names of the quantile groups, lowest first.
GROUPS = {4: ("Low", "Medium-Low", "Medium-High", "High"), 3: ("Low", "Medium", "High")}
MIN_ROWS, MANY_ROWS = 20, 50
MIN_DISTINCT = 30


def add_date_parts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Year, year-month and weekday name of each date column, as text."""
    out = {}
    for c in columns:
        moment = time_of(df, c)
        out[f"{c}_year"] = F.coalesce(F.year(moment).cast("string"), F.lit("0"))
        out[f"{c}_month"] = F.coalesce(F.date_format(moment, "yyyy-MM"), F.lit("Unknown"))
        out[f"{c}_day_of_week"] = F.coalesce(F.date_format(moment, "EEEE"), F.lit("Unknown"))
    return df.withColumns(out) if out else df


def add_quantile_group(df: DataFrame, columns: Iterable[str], distinct: dict[str, int] | None = None) -> DataFrame:
    """``<c>_group``: quartiles (terciles below 50 rows), intervals closed on the right.

    Columns with few distinct values, tables under 20 rows and columns whose
    edges collide get no group.
    """
    return apply_groups(df, group_cuts(df, columns, distinct))


def group_cuts(df: DataFrame, columns: Iterable[str], distinct: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Edges of the groups of the columns that get any."""
    names = list(columns)
    rows = df.count()
    if rows < MIN_ROWS or not names:
        return {}
    if distinct is None:
        # A sketch settles all but the close cases.
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
        distinct = {c: row[f"d{i}"] for i, c in enumerate(names)}
        close = [c for c in names if distinct[c] <= 10 * MIN_DISTINCT]
        if close:
            counts = value_counts(df, close).groupBy("column").count()
            distinct |= {r["column"]: r["count"] for r in counts.collect()}
    names = [c for c in names if distinct.get(c, 0) > MIN_DISTINCT]
    parts = 4 if rows >= MANY_ROWS else 3
    edges = column_quantiles(df, {c: number(df, c) for c in names}, [i / parts for i in range(parts + 1)])
    return {c: list(edges[c]) for c in names if edges[c][0] is not None and len(set(edges[c])) == len(edges[c])}


def apply_groups(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Adds ``<c>_group`` by known edges: no pass over the data."""
    out = {}
    for c, cut in cuts.items():
        value, words = number(df, c), GROUPS[len(cut) - 1]
        label = F.when(value.isNull(), F.lit("Missing"))
        for upper, word in zip(cut[1:-1], words):
            label = label.when(value <= upper, F.lit(word))
        out[f"{c}_group"] = label.otherwise(F.lit(words[-1]))
    return df.withColumns(out) if out else df


def derive(df: DataFrame, types: dict[str, dict] | None = None) -> tuple[DataFrame, list[dict]]:
    """All derived columns of a table and a list that says what was derived and why."""
    types = types or type_map(df)
    dates = [c for c, f in types.items() if f["data_type"] == "datetime"]
    numbers = [c for c, f in types.items() if f["data_type"] == "numerical"]
    wide = add_quantile_group(add_date_parts(df, dates), numbers)
    return wide, derived_log(df, wide)


def derived_log(df: DataFrame, wide: DataFrame) -> list[dict]:
    """What was derived from what, and why."""
    log = []
    for c in wide.columns:
        if c in df.columns:
            continue
        for suffix, what, why in (
            ("_year", "year of the date", "yearly totals and trends"),
            ("_month", "year and month of the date", "monthly seasonality"),
            ("_day_of_week", "name of the weekday", "weekly pattern"),
            ("_group", "quantile group", "comparison of value ranges"),
        ):
            source = c.removesuffix(suffix)
            if c.endswith(suffix) and source in df.columns:
                log.append(
                    {"original_column": source, "derived_column": c, "transformation": what, "reason": why}
                )
    return log
