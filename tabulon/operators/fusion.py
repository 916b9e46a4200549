"""All aggregated charts of one table from a single scan.

Every card that is an aggregate over some keys becomes one grouping set of a single GROUPING SETS aggregate; a card's filters become
conditions inside its own aggregates.  The result, a row per group of any card, is stored once and split into the
cards afterwards.  Cards that show rows or medians are no such aggregate and are left to ``chart``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, half_even, is_number, number, type_of
from ..session import stored
from .charts import AGGREGATIONS, SCREEN, WIDE_PIVOT, ChartSpec, chart, normalise, reduce_by, table_with
from .predicates import filter_condition


@dataclass
class Card:
    """One grouping set: its keys, its aggregates by name, and how its rows become the chart."""

    keys: tuple[str, ...]
    parts: dict[str, Column]
    finish: Callable[[DataFrame], DataFrame]


def _plan(df: DataFrame, spec: ChartSpec, at: int, screen: bool) -> Card | None:
    """The card of a spec, or None where it is not a plain aggregate; follows ``chart`` case by case."""
    spec = normalise(spec)
    has = set(df.columns)
    x, y = (c if c in has else None for c in (spec.x, spec.y))
    group = spec.group if spec.group in has else None
    kind, how = spec.chart_type.lower(), spec.aggregation
    numeric_y = y is not None and is_number(type_of(df, y))
    kept = filter_condition(df, spec.filters)
    rows, value = f"rows{at}", f"value{at}"

    def cap(shape: str) -> int | None:
        return spec.limit if spec.limit is not None or not screen else SCREEN[shape]

    def only(column: Column) -> Column:
        return column if kept is None else F.when(kept, column)

    counted = {rows: F.count(F.lit(1)) if kept is None else F.count_if(kept)}

    def metric(name: str, how: str) -> Card:
        how = how if how in ("sum", "avg", "min", "max", "count") else "sum"
        total = reduce_by(only(number(df, name)), how)
        total = F.coalesce(total, F.lit(0.0)) if how == "sum" else total
        return Card((), {value: total.cast("double")}, lambda r: r.select(F.lit(name).alias("metric"), half_even(F.col(value), 2).alias("value")))

    def ranked(by: Column, shape: str) -> Callable[[DataFrame], DataFrame]:
        def finish(r: DataFrame) -> DataFrame:
            out = r.orderBy(by, col(x))
            return out if cap(shape) is None else out.limit(cap(shape))

        return finish

    def counts(shape: str) -> Card:
        finish = ranked(F.desc("count"), shape)
        return Card((x,), counted, lambda r: finish(r.where(f"{rows} > 0").select(col(x), F.col(rows).alias("count"))))

    if kind == "metric" and (y or x):
        return metric(y or x, how)
    if kind == "scatter":
        return None
    if group and x:
        if how == "median" and numeric_y or group == x:
            return None
        how = how if how in AGGREGATIONS else "sum"
        parts = counted | ({value: reduce_by(only(number(df, y)), how)} if numeric_y else {})

        def pivot(r: DataFrame) -> DataFrame:
            long = r.where((F.col(rows) > 0) & col(group).isNotNull()).select(col(x), col(group), F.col(value if numeric_y else rows).alias("value"))
            most = cap("groups")
            if spec.long:
                if most is None:
                    return long
                first = long.select(col(x).alias("__key")).distinct().orderBy("__key").limit(most)
                return long.join(first, col(x) == F.col("__key"), "left_semi")
            names = [v[0] for v in long.select(col(group)).distinct().orderBy(col(group)).limit(WIDE_PIVOT + 1).collect()]
            if len(names) > WIDE_PIVOT:
                raise ValueError(f"{group!r} has more than {WIDE_PIVOT} values: ask for the long form")
            wide = long.groupBy(col(x)).pivot(group, names).agg(F.first("value", ignorenulls=True))
            wide = wide.na.fill(0, subset=[c for c in wide.columns if c != x]).orderBy(col(x))
            return wide if most is None else wide.limit(most)

        return Card((x, group), parts, pivot)
    if kind in ("metric", "kpi"):
        name = y or x or (df.columns[0] if df.columns else None)
        if name and is_number(type_of(df, name)):
            return metric(name, {"mean": "avg", "count": "sum"}.get(how, how))
        return Card((), counted, lambda r: r.select(F.lit("Total Records").alias("metric"), F.col(rows).cast("double").alias("value")))
    if x:
        if x == y:
            if how == "count" or kind in ("pie", "donut", "bar", "horizontal bar"):
                return counts("groups")
            if numeric_y:
                scalar = how if how in ("sum", "avg", "mean", "min", "max") else "count"
                return Card((), {value: reduce_by(only(number(df, x)), scalar).cast("double")},
                            lambda r: r.select(F.lit(x).alias(x), half_even(F.col(value), 2).alias("value")))
        if y and y != x and numeric_y and how not in ("none", "median"):
            base = number(df, y) if how != "count" else col(y)
            finish = ranked(F.desc_nulls_last(col(y)), "groups")
            return Card((x,), counted | {value: reduce_by(only(base), how)},
                        lambda r: finish(r.where(f"{rows} > 0").select(col(x), F.col(value).alias(y))))
        if how == "count" or kind in ("pie", "donut"):
            return counts("counts")
    return None


def fused_charts(df: DataFrame, specs: Sequence[ChartSpec], screen: bool = False) -> list[DataFrame]:
    """The data of each spec, all aggregates of them from one scan of ``df`` (which runs here, its few rows are stored)."""
    cards = [_plan(df, spec, i, screen) for i, spec in enumerate(specs)]
    fused = [(i, card) for i, card in enumerate(cards) if card is not None]
    out: dict[int, DataFrame] = {i: chart(df, specs[i], screen=screen) for i, card in enumerate(cards) if card is None}
    if fused:
        sets = list(dict.fromkeys(card.keys for _, card in fused))
        keys = list(dict.fromkeys(k for s in sets for k in s))
        parts = {name: column for _, card in fused for name, column in card.parts.items()}
        if keys:
            # keys are copied: an aggregate may read a column that a grouping set leaves out
            copied = df.withColumns({f"__k{i}": col(k) for i, k in enumerate(keys)})
            names = {k: f"__k{i}" for i, k in enumerate(keys)}
            grouped = copied.groupingSets([[F.col(names[k]) for k in s] for s in sets], *[F.col(n) for n in names.values()])
            whole = grouped.agg(F.grouping_id(*[F.col(n) for n in names.values()]).alias("__set"), *[c.alias(n) for n, c in parts.items()])
        else:
            names, whole = {}, df.agg(F.lit(0).cast("long").alias("__set"), *[c.alias(n) for n, c in parts.items()])
        whole = stored(whole)
        for i, card in fused:
            # bit k of the number tells that key k is left out of the set
            code = sum(1 << (len(keys) - 1 - p) for p, k in enumerate(keys) if k not in card.keys)
            mine = whole.where(F.col("__set") == code).select(*[F.col(names[k]).alias(k) for k in card.keys], *card.parts)
            if not card.keys and keys and () in sets and mine.isEmpty():
                mine = df.limit(0).agg(*[c.alias(n) for n, c in card.parts.items()])  # an empty table still has its totals
            for k in card.keys[:1]:
                mine = mine.where(col(k).isNotNull())
            out[i] = card.finish(mine)
    return [out[i] for i in range(len(specs))]


def fused_dashboard(tables: dict[str, DataFrame], active: str, specs: Sequence[ChartSpec], run_sql=None, screen: bool = False) -> dict[str, DataFrame]:
    """Like ``dashboard``, with one scan per table for all its aggregated cards."""
    by_table: dict[int, tuple[DataFrame, list[int]]] = {}
    out: dict[int, DataFrame] = {}
    clean = [normalise(s) for s in specs]
    for i, spec in enumerate(clean):
        if spec.sql and run_sql is not None:
            out[i] = run_sql(spec.sql)
            continue
        df = table_with(tables, active, [spec.x, spec.y])
        by_table.setdefault(id(df), (df, []))[1].append(i)
    for df, places in by_table.values():
        for i, found in zip(places, fused_charts(df, [clean[i] for i in places], screen)):
            out[i] = found
    return {s.title or f"Chart {i + 1}": out[i] for i, s in enumerate(clean)}
