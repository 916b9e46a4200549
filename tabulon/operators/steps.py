"""Cleaning steps that can be stored and replayed over any table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INVISIBLE, INVISIBLE_CHARACTERS, col, is_number, is_text, names_where, number, time_of, type_of
from .ordering import first_per_group
from .quantiles import column_quantiles


@dataclass(frozen=True)
class Step:
    """One transformation: a type and its parameters."""

    type: str
    params: dict[str, Any] = field(default_factory=dict)


class StepError(ValueError):
    """The step cannot be applied to this table."""


_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)")
_OPERAND = r"(`[^`]*`|[A-Za-z_][\w.]*\([^()]*\)|[A-Za-z_][\w.]*|\d+(?:\.\d+)?|\([^()]*\))"


def formula(text: str) -> Column:
    """Spreadsheet-like formula as a Spark expression.

    ``==``, ``&``, ``|``, ``**`` and ``//`` are read the Python way; a division by
    zero gives null.  Everything else is Spark SQL, so registered functions work.
    """
    if not text or not text.strip():
        raise StepError("a formula is required")
    parts = _LITERAL.split(text)
    for i in range(0, len(parts), 2):  # odd parts are quoted
        piece = re.sub(r"==", "=", parts[i])
        piece = re.sub(r"&+", " AND ", piece)
        piece = re.sub(r"\|+", " OR ", piece)
        parts[i] = re.sub(r"~", " NOT ", piece)
    sql = "".join(parts)
    while "**" in sql:  # powers bind from the right
        left, right = sql.rsplit("**", 1)
        base, exponent = re.search(_OPERAND + r"\s*$", left), re.match(r"\s*" + _OPERAND, right)
        if not base or not exponent:
            break
        sql = f"{left[:base.start()]}power({base[1]}, {exponent[1]}){right[exponent.end():]}"
    sql = re.sub(_OPERAND + r"\s*//\s*" + _OPERAND, r"floor(\1 / \2)", sql)
    sql = re.sub(r"/\s*" + _OPERAND, r"/ nullif(\1, 0)", sql)
    return F.expr(sql)


def _listed(df: DataFrame, value, need: bool = True) -> list[str]:
    names = [value] if isinstance(value, str) else list(value or [])
    found = [n for n in names if n in df.columns]
    if need and not found:
        raise StepError(f"no such column: {names}")
    return found


def add_column(df: DataFrame, p: dict) -> DataFrame:
    name, text = p.get("new_column") or p.get("column"), p.get("formula") or p.get("expression")
    if not name or not text:
        raise StepError("new_column and formula are required")
    return df.withColumn(name, formula(text))


def rename_column(df: DataFrame, p: dict) -> DataFrame:
    pairs = p.get("columns_map") or {p.get("old_name"): p.get("new_name")}
    known = {old: new for old, new in pairs.items() if old in df.columns and new}
    if not known:
        raise StepError(f"no such column: {list(pairs)}")
    return df.withColumnsRenamed(known)


def drop_column(df: DataFrame, p: dict) -> DataFrame:
    return df.drop(*_listed(df, p.get("columns") or p.get("column")))


def most_frequent(df: DataFrame, name: str) -> Any:
    """Most frequent value, the smallest on a tie; None for an empty column."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
    return row[0]["v"] if row else None


def fill_missing(df: DataFrame, p: dict) -> DataFrame:
    """Strategies mean, median, mode, constant, drop_na; others fall back by type."""
    (name,) = _listed(df, p.get("column"))[:1]
    strategy = (p.get("strategy") or "").lower()
    dtype = type_of(df, name)
    numeric = is_number(dtype)
    if strategy in ("drop_na", "drop"):
        return df.dropna(subset=[name])
    if strategy == "constant":
        value = p.get("value")
        value = "" if value is None else value
        if numeric:
            fill = F.lit(str(value)).try_cast("double")
            return df.withColumn(name, F.coalesce(col(name).cast("double"), fill))
        return df.withColumn(name, F.coalesce(col(name), F.lit(str(value)).try_cast(dtype)))
    if strategy == "mode":
        value = most_frequent(df, name)
        if value is None:
            return df.withColumn(name, F.coalesce(col(name).cast("string"), F.lit("Unknown")))
        return df.withColumn(name, F.coalesce(col(name), F.lit(value).cast(dtype)))
    if numeric and strategy == "mean":
        value = df.agg(F.avg(number(df, name))).first()[0]
    elif numeric:
        value = column_quantiles(df, {name: number(df, name)}, [0.5])[name][0]
    else:
        value = most_frequent(df, name)
        value = "Missing" if value is None else value
        return df.withColumn(name, F.coalesce(col(name), F.lit(value).try_cast(dtype)))
    return df.withColumn(name, F.coalesce(number(df, name), F.lit(value).cast("double")))


def removed_rows(before: DataFrame, step: Step) -> int:
    """How many rows a step takes away (``drop_na_rows``, ``drop_duplicates``, ``filter_rows``)."""
    return before.count() - apply_step(before, step).count()


def drop_na_rows(df: DataFrame, p: dict) -> DataFrame:
    names = p.get("columns") or p.get("column")
    return df.dropna(how="any", subset=_listed(df, names)) if names else df.dropna(how="any")


def drop_duplicates(df: DataFrame, p: dict) -> DataFrame:
    """Keep one row per key: the first by ``order`` (whole rows when no columns are given).

    Without ``order`` the smallest row by all columns is kept, so that the result
    does not depend on how rows are spread over tasks.
    """
    names = p.get("columns") or p.get("column")
    if not names:
        return df.distinct()
    keys = _listed(df, names)
    order = [col(c) for c in _listed(df, p.get("order"), need=False)] or [col(c) for c in df.columns]
    return first_per_group(df, keys, order)


def cast_type(df: DataFrame, p: dict) -> DataFrame:
    (name,) = _listed(df, p.get("column"))[:1]
    target = (p.get("target_type") or p.get("type") or "").lower()
    dtype = type_of(df, name)
    if target in ("int", "integer"):
        value = F.coalesce(number(df, name), F.lit(0.0)).try_cast("long")
    elif target in ("float", "numeric", "double", "number"):
        value = number(df, name)
    elif target in ("datetime", "date", "timestamp"):
        value = time_of(df, name)
    elif target in ("string", "text", "category", "categorical", "str"):
        value = col(name).cast("string")
    elif target in ("bool", "boolean"):
        if p.get("mode") == "parse":
            value = col(name).try_cast("boolean")
        elif is_text(dtype):
            value = col(name).isNull() | (col(name) != "")
        elif is_number(dtype):
            value = col(name).isNull() | (col(name) != 0)
        else:
            value = F.coalesce(col(name).try_cast("boolean"), F.lit(True))
    else:
        raise StepError(f"unknown target type: {target}")
    return df.withColumn(name, value)


def replace_values(df: DataFrame, p: dict) -> DataFrame:
    (name,) = _listed(df, p.get("column"))[:1]
    old, new = p.get("to_replace", p.get("old_value")), p.get("value", p.get("new_value"))
    dtype = type_of(df, name)
    old_c, new_c = F.lit(old).try_cast(dtype), F.lit(new).try_cast(dtype)
    if old is not None and is_number(dtype):
        old_c = F.lit(old).try_cast("double")
    hit = col(name).isNull() if old is None else F.coalesce(col(name) == old_c, F.lit(False))
    return df.withColumn(name, F.when(hit, new_c).otherwise(col(name)))


def filter_rows(df: DataFrame, p: dict) -> DataFrame:
    return df.where(formula(p.get("query") or p.get("condition") or ""))


def fix_formatting(df: DataFrame, p: dict | None = None) -> DataFrame:
    """Remove invisible characters from text columns; blanks stay."""
    names = _listed(df, (p or {}).get("columns"), need=False) or names_where(df, is_text)
    return df.withColumns({n: F.translate(col(n), INVISIBLE_CHARACTERS, "") for n in names}) if names else df


def formatting_report(df: DataFrame) -> DataFrame:
    """``column, cells_cleaned`` per text column and a ``total`` row: one pass."""
    names = names_where(df, is_text)
    counts = [F.count_if(col(n).rlike(INVISIBLE)).alias(f"n{i}") for i, n in enumerate(names)]
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("cells_cleaned")) for i, n in enumerate(names)]
    total = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(names))], F.lit(0).cast("long"))
    rows.append(F.struct(F.lit("total").alias("column"), total.alias("cells_cleaned")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "add_column": add_column,
    "rename_column": rename_column,
    "drop_column": drop_column,
    "fill_missing": fill_missing,
    "drop_na_rows": drop_na_rows,
    "drop_duplicates": drop_duplicates,
    "cast_type": cast_type,
    "replace_values": replace_values,
    "filter_rows": filter_rows,
    "fix_formatting": fix_formatting,
}


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    if step.type not in STEPS:
        raise StepError(f"unknown step: {step.type}")
    return STEPS[step.type](df, step.params)


def replay(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Apply steps in order; ``reset_raw`` goes back to the input."""
    return reduce(lambda now, step: df if step.type == "reset_raw" else apply_step(now, step), steps, df)


class History:
    """A raw table and the steps applied to it; every version can be rebuilt."""

    def __init__(self, raw: DataFrame, steps: Sequence[Step] = ()):
        self.raw = raw
        self.steps = list(steps)
        self.current = replay(raw, self.steps)

    def apply(self, step: Step) -> DataFrame:
        self.current = self.raw if step.type == "reset_raw" else apply_step(self.current, step)
        self.steps.append(step)
        return self.current

    def version(self, count: int) -> DataFrame:
        return replay(self.raw, self.steps[:count])
