"""Chart specifications turned into DataFrames.

Every chart is one aggregate over all rows and shows all its points.  A spec's ``limit``, or
``screen=True`` with the row caps of a dashboard screen, keeps the first points; sorting before a
cap has a tie-breaker and becomes a top-k, not a sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, half_even, is_number, is_text, is_time, number, type_of
from .predicates import apply_filters
from .quantiles import group_quantiles

# Chart types, and the row caps of each shape on a dashboard screen.
CHART_TYPES = (
    "Bar", "Horizontal Bar", "Line", "Area", "Pie", "Donut", "Scatter", "Stacked Bar", "Stacked Area",
    "Treemap", "Metric",
)
SCREEN = {"groups": 50, "counts": 30, "rows": 50, "fallback": 30, "scatter": 1000}
AGGREGATIONS = ("sum", "avg", "mean", "median", "min", "max", "count")
WIDE_PIVOT = 1000  # columns that a wide pivot may have


@dataclass(frozen=True)
class ChartSpec:
    """What to draw; ``sql`` replaces the table when it is a query."""

    chart_type: str = "Bar"
    x: str | None = None
    y: str | None = None
    group: str | None = None
    size: str | None = None
    aggregation: str = "none"
    filters: tuple = field(default_factory=tuple)
    sql: str | None = None
    title: str = ""
    category: str = ""
    limit: int | None = None
    long: bool = False  # a grouped chart as (x, group, value) rows instead of a column per group


def normalise(spec: ChartSpec) -> ChartSpec:
    """Unknown chart types become Bar, unknown aggregations none; only queries stay as SQL."""
    known = {t.lower(): t for t in (*CHART_TYPES, "KPI")}
    kind = known.get((spec.chart_type or "").replace("_", " ").lower(), "Bar")
    how = (spec.aggregation or "none").lower()
    sql = spec.sql if spec.sql and re.match(r"\s*(select|with)\b", spec.sql, re.I) else None
    return replace(spec, chart_type=kind, aggregation=how if how in AGGREGATIONS else "none", sql=sql)


def reduce_by(value: Column, how: str) -> Column:
    """Aggregate expression by name (not for median)."""
    functions = {
        "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
    }
    return functions[how](value)


def _plain(df: DataFrame, name: str, how: str) -> Column:
    """Value to aggregate; integers keep their type so that sums stay exact."""
    return number(df, name) if how != "count" else col(name)


def metric(df: DataFrame, name: str, aggregation: str = "sum") -> DataFrame:
    """One number over the values of a column that are numeric: ``metric, value``."""
    how = aggregation if aggregation in ("sum", "avg", "min", "max", "count") else "sum"
    value = reduce_by(number(df, name), how)
    if how == "sum":
        value = F.coalesce(value, F.lit(0.0))
    return df.agg(half_even(value.cast("double"), 2).alias("value")).select(F.lit(name).alias("metric"), "value")


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("Total Records").alias("metric"), "value"
    )


def scatter(df: DataFrame, columns: Iterable[str | None], limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows without nulls in the given columns by ``order`` (default: by the columns); the first ``limit`` if given."""
    names = [c for c in dict.fromkeys(columns) if c and c in df.columns]
    keys = [c for c in order if c in df.columns] or names
    rows = df.dropna(subset=names).orderBy(*[col(c) for c in keys], *[col(c) for c in names if c not in keys])
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(*[col(c) for c in names])


def _first_keys(df: DataFrame, x: str, cap: int) -> DataFrame:
    """The smallest ``cap`` keys."""
    return df.select(col(x).alias("__key")).where(col(x).isNotNull()).distinct().orderBy("__key").limit(cap)


def grouped_long(df: DataFrame, x: str, group: str, y: str | None, aggregation: str, cap: int | None = None) -> DataFrame:
    """``x, group, value``, for the first ``cap`` values of x if given: long form for any number of groups."""
    rows = df.where(col(x).isNotNull() & col(group).isNotNull())
    if cap is not None:
        rows = rows.join(_first_keys(rows, x, cap), col(x) == F.col("__key"), "left_semi")
    numeric = y is not None and y in df.columns and is_number(type_of(df, y))
    how = aggregation if aggregation in AGGREGATIONS else "sum"
    if not numeric:
        return rows.groupBy(col(x), col(group)).agg(F.count(F.lit(1)).alias("value"))
    if how == "median":
        middle = group_quantiles(rows, [x, group], number(df, y), [0.5])
        return middle.select(col(x), col(group), F.col("quantiles")[0].alias("value"))
    return rows.groupBy(col(x), col(group)).agg(reduce_by(number(df, y), how).alias("value"))


def grouped_pivot(
    df: DataFrame, x: str, group: str, y: str | None = None, aggregation: str = "sum",
    values: Sequence[Any] | None = None, cap: int | None = None,
) -> DataFrame:
    """One row per x, one column per group value, empty cells 0.

    Pass ``values`` to fix the columns.  Without them the distinct groups are read
    first; more than ``WIDE_PIVOT`` are refused, as ``grouped_long`` shows them in rows.
    """
    if values is None:
        found = df.select(col(group)).where(col(group).isNotNull()).distinct().orderBy(col(group))
        values = [r[0] for r in found.limit(WIDE_PIVOT + 1).collect()]
        if len(values) > WIDE_PIVOT:
            raise ValueError(f"{group!r} has more than {WIDE_PIVOT} values: ask for the long form or pass the values")
    # One pass for the usual aggregates; a median is only worth computing for the keys shown.
    long = grouped_long(df, x, group, y, aggregation, cap if aggregation == "median" else None)
    wide = long.groupBy(col(x)).pivot(group, list(values)).agg(F.first("value", ignorenulls=True))
    filled = wide.na.fill(0, subset=[c for c in wide.columns if c != x]).orderBy(col(x))
    return filled if cap is None else filled.limit(cap)


def value_count(df: DataFrame, x: str, cap: int | None = None) -> DataFrame:
    """``x, count``, most frequent first, ties by value."""
    counts = df.where(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("count"))
    ranked = counts.orderBy(F.desc("count"), col(x))
    return ranked if cap is None else ranked.limit(cap)


def grouped(df: DataFrame, x: str, y: str, aggregation: str, cap: int | None = None) -> DataFrame:
    """``x, y`` aggregated, largest first, ties by x."""
    rows = df.where(col(x).isNotNull())
    if aggregation == "median":
        keyed = rows.select(col(x)).distinct()
        middle = group_quantiles(rows, [x], number(df, y), [0.5]).select(col(x), F.col("quantiles")[0].alias(y))
        out = keyed.join(middle, x, "left")
    else:
        out = rows.groupBy(col(x)).agg(reduce_by(_plain(df, y, aggregation), aggregation).alias(y))
    ranked = out.orderBy(F.desc_nulls_last(col(y)), col(x))
    return ranked if cap is None else ranked.limit(cap)


def self_scalar(df: DataFrame, x: str, aggregation: str) -> DataFrame:
    how = aggregation if aggregation in ("sum", "avg", "mean", "min", "max") else "count"
    return df.agg(half_even(reduce_by(number(df, x), how).cast("double"), 2).alias("value")).select(
        F.lit(x).alias(x), "value"
    )


def chart(df: DataFrame, spec: ChartSpec, skipped: list[str] | None = None, screen: bool = False) -> DataFrame:
    """Data of one chart: all points, or the first ``spec.limit``, or (``screen``) as many as a screen shows."""
    spec = normalise(spec)

    def cap(shape: str) -> int | None:
        return spec.limit if spec.limit is not None or not screen else SCREEN[shape]

    df = apply_filters(df, spec.filters, skipped)
    has = set(df.columns)
    x, y = (c if c in has else None for c in (spec.x, spec.y))
    group = spec.group if spec.group in has else None
    kind = spec.chart_type.lower()
    how = spec.aggregation
    numeric_y = y is not None and is_number(type_of(df, y))
    if kind == "metric" and (y or x):
        return metric(df, y or x, how)
    if kind == "scatter":
        return scatter(df, [x, y, group, spec.size if spec.size in has else None], cap("scatter"))
    if group and x:
        return (grouped_long if spec.long else grouped_pivot)(df, x, group, y, how, cap=cap("groups"))
    if kind in ("metric", "kpi"):
        name = y or x or (df.columns[0] if df.columns else None)
        if name and is_number(type_of(df, name)):
            return metric(df, name, {"mean": "avg", "count": "sum"}.get(how, how))
        return record_count(df)
    if x:
        if x == y:
            if how == "count" or kind in ("pie", "donut", "bar", "horizontal bar"):
                return value_count(df, x, cap("groups"))
            if numeric_y:
                return self_scalar(df, x, how)
        if y and y != x and numeric_y and how != "none":
            return grouped(df, x, y, how, cap("groups"))
        if how == "count" or kind in ("pie", "donut"):
            return value_count(df, x, cap("counts"))
        return scatter(df, [x, y], cap("rows"))
    first = df.columns[:2]
    rows = df.select(*[col(c) for c in first]).orderBy(*[col(c) for c in first])
    return rows if cap("fallback") is None else rows.limit(cap("fallback"))


def dashboard(tables: dict[str, DataFrame], active: str, specs: Sequence[ChartSpec], run_sql=None, screen: bool = False) -> dict[str, DataFrame]:
    """Every card of a dashboard as a DataFrame, keyed by title.

    A card whose columns are not in the active table uses the first table that
    has them all; a card with SQL is run by ``run_sql``.
    """
    out = {}
    for i, spec in enumerate(specs):
        spec = normalise(spec)
        title = spec.title or f"Chart {i + 1}"
        if spec.sql and run_sql is not None:
            out[title] = run_sql(spec.sql)
            continue
        out[title] = chart(table_with(tables, active, [spec.x, spec.y]), spec, screen=screen)
    return out


def table_with(tables: dict[str, DataFrame], active: str, columns: Iterable[str | None]) -> DataFrame:
    """The active table, or the first other one that has all the columns."""
    need = {c for c in columns if c}
    if need <= set(tables[active].columns):
        return tables[active]
    return next((df for df in tables.values() if need <= set(df.columns)), tables[active])


def title_of(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def auto_charts(described: Sequence[dict[str, Any]]) -> list[ChartSpec]:
    """Charts worth drawing, by rule, from the rows of a profile.

    At most four per category; two charts with the same title or with the same
    category, columns and type count as one.
    """
    words = sorted(
        (r for r in described if r["data_type"] in ("categorical", "text", "boolean") and r["unique_count"] <= 50
         and r["unique_count"] > 1),
        key=lambda r: (r["unique_count"], r["ordinal"]),
    )
    numbers = [r["column"] for r in described if r["data_type"] == "numerical"]
    dates = [r["column"] for r in described if r["data_type"] == "datetime"]
    names = [r["column"] for r in words]
    out: list[ChartSpec] = []

    def add(category, title, kind, x=None, y=None, how="none", group=None, size=None):
        out.append(ChartSpec(kind, x, y, group, size, how, title=title, category=category))

    if names:
        add("Distribution", f"Frequency of {names[0]}", "Bar", names[0], names[0], "count")
    if numbers:
        add("Distribution", f"Average {numbers[0]}", "Metric", None, numbers[0], "avg")
    small = [r["column"] for r in words if 2 <= r["unique_count"] <= 7]
    if small:
        add("Distribution", f"Share of {small[-1]}", "Donut", small[-1], None, "count")
    if numbers:
        add("Distribution", f"Total {numbers[-1]}", "Metric", None, numbers[-1], "sum")
    if names and numbers:
        add("Comparison", f"{numbers[-1]} by {names[0]}", "Bar", names[0], numbers[-1], "sum")
    if dates and numbers:
        add("Comparison", f"{numbers[-1]} over {dates[0]}", "Line", dates[0], numbers[-1], "sum")
    if len(numbers) >= 2:
        add("Comparison", f"{numbers[0]} against {numbers[1]}", "Scatter", numbers[0], numbers[1])
    if numbers and (dates or names):
        x = dates[0] if dates else names[0]
        add("Comparison", f"Volume of {numbers[0]} by {x}", "Area", x, numbers[0], "sum")
    if len(names) >= 2 and numbers:
        add("Multivariate", f"{numbers[0]} by {names[0]} and {names[1]}", "Stacked Bar", names[0], numbers[0], "sum", names[1])
    if dates and names and numbers:
        add("Multivariate", f"{numbers[0]} over {dates[0]} by {names[0]}", "Line", dates[0], numbers[0], "sum", names[0])
    if len(numbers) >= 3:
        add("Multivariate", f"{numbers[0]}, {numbers[1]} and {numbers[2]}", "Scatter", numbers[0], numbers[1], size=numbers[2])
    if names and numbers:
        add("Multivariate", f"Treemap of {numbers[0]} by {names[-1]}", "Treemap", names[-1], numbers[0], "sum")

    seen, per, kept = set(), {}, []
    for spec in out:
        fields = tuple(sorted(c for c in (spec.x, spec.y, spec.group, spec.size) if c))
        keys = {title_of(spec.title), (spec.category, fields, spec.chart_type)}
        if keys & seen or per.get(spec.category, 0) >= 4:
            continue
        seen |= keys
        per[spec.category] = per.get(spec.category, 0) + 1
        kept.append(spec)
    return kept


# Words in a column name that hint at its role.
TIME_WORDS = ("date", "time", "month", "year", "day", "week", "quarter", "period")
SHARE_WORDS = ("percent", "pct", "share", "ratio", "proportion")


def infer_chart(df: DataFrame, rows: int | None = None) -> dict[str, Any]:
    """Chart type for a query result from its schema: type, axes and confidence."""
    names = df.columns
    numbers = [c for c in names if is_number(type_of(df, c))]
    others = [c for c in names if c not in numbers]
    times = [c for c in names if is_time(type_of(df, c)) or any(w in c.lower() for w in TIME_WORDS)]
    if numbers and (len(names) == 1 or (rows == 1 and not others)):
        return {"chart_type": "Metric", "x": None, "y": numbers[0], "confidence": "high"}
    if times and [c for c in numbers if c not in times]:
        y = next(c for c in numbers if c not in times)
        return {"chart_type": "Line", "x": times[0], "y": y, "confidence": "high"}
    texts = [c for c in others if is_text(type_of(df, c))]
    if texts and numbers:
        share = next((c for c in numbers if any(w in c.lower() for w in SHARE_WORDS)), None)
        if share:
            return {"chart_type": "Pie", "x": texts[0], "y": share, "confidence": "high"}
        return {"chart_type": "Bar", "x": texts[0], "y": numbers[0], "confidence": "high" if len(names) == 2 else "medium"}
    if len(numbers) >= 2:
        return {"chart_type": "Scatter", "x": numbers[0], "y": numbers[1], "confidence": "medium"}
    return {"chart_type": "Bar", "x": names[0], "y": numbers[0] if numbers else None, "confidence": "low"}
