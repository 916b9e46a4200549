"""Type inference over all rows of a table in one aggregate.

The single-process rule looks at the first ten values; rows have no order here,
so the share is taken over all values: a text column is a datetime when at least
80 % of its values (and at least 8) look like dates and parse.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    BLANK_WORDS, NUMBER_SHAPE, col, is_flag, is_number, is_text, is_time, names_where, number_sql, quote, text_literal,
    text_time_sql, to_number, to_time, type_of,
)

# Texts that may stand for a boolean.
FLAG_WORDS = ("true", "false", "True", "False", "0", "1", "yes", "no", "Y", "N")

DATE_SHAPE = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"


def _facts(df: DataFrame, name: str) -> dict[str, str]:
    """Aggregates that decide one column's type, as SQL text."""
    ref, dtype = quote(name), type_of(df, name)
    facts = {"values": f"count({ref})"}
    if is_text(dtype):
        words = ", ".join(f"'{w}'" for w in FLAG_WORDS)
        blanks = ", ".join(f"'{w}'" for w in BLANK_WORDS)
        value = f"case when {ref} rlike r'{NUMBER_SHAPE}' then try_cast({ref} as double) end"
        dated = f"length(trim({ref})) >= 8 and trim({ref}) rlike r'{DATE_SHAPE}'"
        known = f"case when lower(trim({ref})) not in ({blanks}) then {ref} end"
        facts |= {
            # bit 0: some other word; bits 1..10: words seen
            "words": f"bit_or(shiftleft(1, cast(array_position(array({words}), {ref}) as int)))",
            "dates": f"count(case when {dated} then {text_time_sql(ref)} end)",
            "numbers": f"count({value})",
            "digit": f"bool_or({known} rlike '[0-9]')",
            "letter": f"bool_or({known} rlike '[A-Za-z]')",
            "whole": f"bool_and(floor({value}) = {value})",
        }
    elif is_number(dtype):
        value = number_sql(df, name)
        whole = "true" if isinstance(dtype, T.IntegralType) else f"floor({ref}) = {ref}"
        facts |= {
            "values": f"count({value})", "binary": f"bool_and({ref} in (0, 1))", "whole": f"bool_and({whole})",
        }
    return facts


def _verdict(df: DataFrame, name: str, i: int) -> tuple[str, str, str]:
    """(data_type, sql_type, is_mixed) from the aggregates ``f<i>_<fact>``, as SQL text."""
    dtype = type_of(df, name)
    empty = f"f{i}_values = 0"
    mixed, whole = "false", "false"
    if is_text(dtype):
        flag = f"(getbit(cast(f{i}_words as bigint), 0) = 0 and bit_count(f{i}_words) <= 2)"
        share = f"f{i}_dates >= 0.8 * f{i}_values"
        mixed = f"coalesce(not ({empty}) and not {flag} and not ({share}) and f{i}_numbers < f{i}_values and f{i}_digit and f{i}_letter, false)"
        whole = f"f{i}_whole"
        kind = (
            f"case when {empty} then 'categorical' when {flag} then 'boolean' "
            f"when {share} and f{i}_dates >= 8 then 'datetime' when {mixed} then 'text' "
            f"when f{i}_numbers = f{i}_values then 'numerical' else 'categorical' end"
        )
    elif is_number(dtype):
        whole = f"f{i}_whole"
        kind = f"case when {empty} then 'categorical' when f{i}_binary then 'boolean' else 'numerical' end"
    else:
        fixed = "boolean" if is_flag(dtype) else "datetime" if is_time(dtype) else "categorical"
        kind = f"case when {empty} then 'categorical' else '{fixed}' end"
    sql = (
        f"case {kind} when 'boolean' then 'BOOLEAN' when 'datetime' then 'DATETIME' "
        f"when 'numerical' then if({whole}, 'INTEGER', 'REAL') else 'TEXT' end"
    )
    return kind, sql, mixed


def infer_types(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: ``column, data_type, sql_type, is_mixed``."""
    names = list(columns or df.columns)
    aggs, rows = [], []
    for i, name in enumerate(names):
        aggs += [f"{expr} as f{i}_{fact}" for fact, expr in _facts(df, name).items()]
        kind, sql, mixed = _verdict(df, name, i)
        rows.append(
            f"named_struct('ordinal', {i}, 'column', {text_literal(name)}, 'data_type', {kind}, "
            f"'sql_type', {sql}, 'is_mixed', {mixed})"
        )
    return df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")


def type_map(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, dict]:
    """``{column: {data_type, sql_type, is_mixed}}``: one small row per column."""
    rows = infer_types(df, columns).collect()
    return {r["column"]: {k: r[k] for k in ("data_type", "sql_type", "is_mixed")} for r in rows}


def mixed_columns(df: DataFrame) -> list[str]:
    """Text columns that hold digits as well as letters."""
    texts = names_where(df, is_text)
    if not texts:
        return []
    return [c for c, facts in type_map(df, texts).items() if facts["is_mixed"]]


def as_clean_text(column: Column) -> Column:
    """Text form of a value: whole floats lose ``.0``, blank words become null, blanks stay."""
    text = F.regexp_replace(column.cast("string"), r"^(-?\d+)\.0$", "$1")
    word = F.lower(F.trim(text))
    return F.when(~word.isin(*[w for w in BLANK_WORDS if w]), text)


def convert_mixed_to_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Mixed columns as clean text."""
    names = mixed_columns(df) if columns is None else list(columns)
    return df.withColumns({n: as_clean_text(col(n)) for n in names}) if names else df


def apply_types(df: DataFrame, types: dict[str, dict] | None = None) -> DataFrame:
    """Cast text columns to what their content was inferred to be."""
    types = types or type_map(df)
    out = {}
    for name, facts in types.items():
        if not is_text(type_of(df, name)):
            continue
        kind = facts["data_type"]
        if kind == "numerical":
            value = to_number(F.trim(col(name)))
            out[name] = value.try_cast("long") if facts["sql_type"] == "INTEGER" else value
        elif kind == "datetime":
            out[name] = to_time(col(name))
        elif kind == "boolean":
            out[name] = F.lower(col(name)).isin("true", "1", "yes", "y")
    return df.withColumns(out) if out else df
