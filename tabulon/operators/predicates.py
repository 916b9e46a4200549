"""Row filters of charts and dashboards.

A filter is ``{column, operator, value}``; a list of them is combined with AND.
Filters that cannot be applied (unknown column, empty value) are skipped and
reported.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_number, is_time, number, time_of, to_time, type_of


def _equals(df: DataFrame, name: str, value: Any) -> Column:
    """Case-blind text equality; numbers and times compare by value when both sides parse."""
    text = str(value)
    dtype = type_of(df, name)
    if is_number(dtype):
        try:
            return number(df, name) == F.lit(float(text))
        except ValueError:
            return F.when(col(name).isNotNull(), F.lit(False))
    if is_time(dtype):
        return time_of(df, name) == to_time(F.lit(text))
    return F.lower(col(name).cast("string")) == F.lit(text.lower())


def _condition(df: DataFrame, name: str, operator: str, value: Any) -> Column:
    if operator == "eq":
        return _equals(df, name, value)
    if operator == "neq":  # rows without a value are kept
        return ~F.coalesce(_equals(df, name, value), F.lit(False))
    if operator in ("gt", "gte", "lt", "lte", "between"):
        if is_time(type_of(df, name)):
            side, read = time_of(df, name), lambda v: F.lit(str(v)).cast("timestamp_ntz")
        else:
            side, read = number(df, name), lambda v: F.lit(float(v))
        if operator == "between":
            low, high = value
            return side.between(read(low), read(high))
        limit = read(value)
        return {"gt": side > limit, "gte": side >= limit, "lt": side < limit, "lte": side <= limit}[operator]
    if operator == "in":
        values = value if isinstance(value, (list, tuple, set)) else [value]
        tests = [_equals(df, name, v) for v in values]
        if not is_number(type_of(df, name)) and not is_time(type_of(df, name)):
            return F.lower(col(name).cast("string")).isin(*[str(v).lower() for v in values])
        out = F.lit(False)
        for test in tests:
            out = out | test
        return out
    if operator == "contains":
        re.compile(str(value))
        return col(name).cast("string").rlike("(?i)" + str(value))
    raise ValueError(f"unknown operator: {operator}")


def apply_filters(
    df: DataFrame, filters: Sequence[Mapping[str, Any]] | None, skipped: list[str] | None = None
) -> DataFrame:
    """Rows that pass every applicable filter; reasons for skipping go to ``skipped``."""
    condition = filter_condition(df, filters, skipped)
    return df if condition is None else df.where(condition)


def filter_condition(
    df: DataFrame, filters: Sequence[Mapping[str, Any]] | None, skipped: list[str] | None = None
) -> Column | None:
    """All applicable filters as one condition; None without any."""
    whole: Column | None = None
    notes = skipped if skipped is not None else []
    for f in filters or ():
        name, operator, value = f.get("column"), f.get("operator", "eq"), f.get("value")
        if name not in df.columns or value is None or value == "":
            notes.append(f"skipped filter on {name!r}: unknown column or empty value")
            continue
        try:
            condition = _condition(df, name, operator, value)
        except (ValueError, TypeError, re.error) as problem:
            notes.append(f"skipped filter on {name!r}: {problem}")
            continue
        whole = condition if whole is None else whole & condition
    return whole


def global_filters(
    tables: Mapping[str, DataFrame], values: Mapping[str, Any], columns: Mapping[str, Sequence[str]]
) -> dict[str, DataFrame]:
    """One filter bar over many tables.

    ``columns`` maps a filter (``date_start``, ``date_end``, ``region``...) to the
    columns it may mean; each table uses the first of them it has, and tables
    without one stay as they are.  The filters sit on the views, so every query
    over them pushes the predicates into its scan.
    """
    out = {}
    for table, df in tables.items():
        for name, value in values.items():
            if value is None or value == "":
                continue
            target = next((c for c in columns.get(name, ()) if c in df.columns), None)
            if target is None:
                continue
            if name == "date_start":
                df = df.where(time_of(df, target) >= F.lit(str(value)).cast("timestamp_ntz"))
            elif name == "date_end":  # the whole last day
                end = datetime.fromisoformat(str(value))
                whole_day = len(str(value)) == 10
                limit = F.lit(end + timedelta(days=1) if whole_day else end).cast("timestamp_ntz")
                df = df.where(time_of(df, target) < limit if whole_day else time_of(df, target) <= limit)
            else:
                operator = "in" if isinstance(value, (list, tuple)) else "eq"
                df = apply_filters(df, [{"column": target, "operator": operator, "value": value}])
        out[table] = df
    return out


def period_bounds(anchor: datetime, period: str) -> tuple[datetime, datetime | None]:
    """Start (inclusive) and end (exclusive) of a relative period seen from ``anchor``."""
    words = period.lower().strip()
    month = anchor.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    year = month.replace(month=1)
    if words == "this month":
        return month, None
    if words == "last month":
        return (month - timedelta(days=1)).replace(day=1), month
    if words == "this year":
        return year, None
    if words == "last year":
        return year.replace(year=year.year - 1), year
    days = re.fullmatch(r"last (\d+) days?", words)
    if days:
        return anchor - timedelta(days=int(days[1])), None
    raise ValueError(f"unknown period: {period}")


def relative_period(df: DataFrame, name: str, period: str) -> DataFrame:
    """Rows of a period that ends at the latest date in the data, never at the clock.

    The latest date is read first (column statistics answer it), so the filter is
    a pair of literals that prunes files and row groups.
    """
    anchor = df.agg(F.max(time_of(df, name))).first()[0]
    if anchor is None:
        return df.limit(0)
    start, end = period_bounds(anchor, period)
    moment = time_of(df, name)
    test = moment >= F.lit(start).cast("timestamp_ntz")
    return df.where(test if end is None else test & (moment < F.lit(end).cast("timestamp_ntz")))


def grid_search(
    df: DataFrame,
    query: str = "",
    column_filters: Mapping[str, str] | None = None,
    sort: str | None = None,
    ascending: bool = True,
) -> DataFrame:
    """Quick search over all columns, text filters per column, one sort."""
    if query:
        low = F.lit(query.lower())
        hit = F.lit(False)
        for c in df.columns:
            hit = hit | F.coalesce(F.contains(F.lower(col(c).cast("string")), low), F.lit(False))
        df = df.where(hit)
    for c, text in (column_filters or {}).items():
        if c in df.columns and text:
            df = df.where(F.contains(F.lower(col(c).cast("string")), F.lit(text.lower())))
    if sort in df.columns:
        rest = [col(c) for c in df.columns if c != sort]
        df = df.orderBy(col(sort).asc() if ascending else col(sort).desc(), *rest)
    return df
