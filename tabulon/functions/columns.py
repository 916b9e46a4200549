"""Scalar expressions: coercion, null handling, text cleaning, number formats.

Everything here is a built-in expression tree, so it stays inside whole-stage
codegen and is visible to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that a CSV reader of the pandas family takes as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Texts that say "nothing" inside a mixed column (compared in lower case).
BLANK_WORDS = ("", "nan", "none", "null", "<na>")

# Fixed pattern: control, soft-hyphen, zero-width and direction characters.
INVISIBLE = r"[\x00-\x1f\x7f-\x9f\u00ad\u200b-\u200f\u2028\u2029\u202a-\u202e\u2060\ufeff]"

# The same characters listed, for a character-by-character removal.
INVISIBLE_CHARACTERS = "".join(
    chr(c)
    for first, last in (
        (0x00, 0x1F), (0x7F, 0x9F), (0xAD, 0xAD), (0x200B, 0x200F), (0x2028, 0x2029), (0x202A, 0x202E), (0x2060, 0x2060),
        (0xFEFF, 0xFEFF),
    )
    for c in range(first, last + 1)
)

# Words that mark a title or column as money.
MONEY_WORDS = (
    "revenue", "sales", "price", "cost", "profit", "amount", "budget", "salary", "spend",
    "rupee", "inr",
)
MONEY_WORDS_CHART = MONEY_WORDS + ("income", "expense", "margin", "valuation")
MONEY_WORDS_KPI = MONEY_WORDS + ("dollar",)

NUMBER_TYPES = (T.NumericType,)
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quote(name: str) -> str:
    """Column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """Text as an SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col(quote(name))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMBER_TYPES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXT_TYPES)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def is_flag(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def names_where(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


# What counts as a number in text.  Testing the shape first spares a failed cast,
# which costs an exception per cell.
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def text_number(column: Column) -> Column:
    return F.when(column.rlike(NUMBER_SHAPE), column.try_cast("double"))


def to_number(column: Column, dtype: T.DataType | None = None) -> Column:
    """Number or null; NaN counts as missing."""
    if dtype is not None and is_number(dtype) and not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.cast("double")
    if dtype is not None and is_flag(dtype):
        return column.cast("int").cast("double")
    if dtype is not None and is_time(dtype):
        return F.lit(None).cast("double")
    if dtype is not None and is_number(dtype):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    return text_number(column.cast("string"))


def number_sql(df: DataFrame, name: str) -> str:
    """SQL text of a column as a number or null (NaN and infinite values count as missing).

    Wide aggregates are assembled as SQL text: one call per expression instead of
    one per operator.
    """
    ref, dtype = quote(name), type_of(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"case when abs(cast({ref} as double)) < double('Infinity') then cast({ref} as double) end"
    if is_number(dtype):
        return f"cast({ref} as double)"
    if is_flag(dtype):
        return f"cast(cast({ref} as int) as double)"
    if is_text(dtype):
        return f"case when {ref} rlike r'{NUMBER_SHAPE}' then try_cast({ref} as double) end"
    return "cast(null as double)"


def number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def clean_number(column: Column) -> Column:
    """Number from money-like text: drops ``$``, the rupee sign, commas and outer blanks."""
    return to_number(F.trim(F.regexp_replace(column.cast("string"), "[$,₹]", "")))


def parse_num(column: Column) -> Column:
    """Keep digits, dot and minus, read the rest as a number, 0 when that fails."""
    kept = F.regexp_replace(column.cast("string"), "[^0-9.-]", "")
    return F.coalesce(text_number(kept), F.lit(0.0))


# Layouts of dates in text, tried in this order.
TIME_LAYOUTS = (
    "yyyy-M-d HH:mm:ss", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d.M.yyyy",
)


def text_time_sql(ref: str) -> str:
    """SQL text that reads a date or timestamp in a common layout, else null."""
    tries = [f"try_cast(trim({ref}) as timestamp_ntz)"]
    tries += [f"cast(try_to_timestamp(trim({ref}), '{layout}') as timestamp_ntz)" for layout in TIME_LAYOUTS]
    return f"coalesce({', '.join(tries)})"


def time_sql(df: DataFrame, name: str) -> str:
    ref, dtype = quote(name), type_of(df, name)
    if is_time(dtype):
        return f"cast({ref} as timestamp_ntz)"
    return text_time_sql(f"cast({ref} as string)")


def to_time(column: Column) -> Column:
    """Timestamp without zone from text in a common layout; else null."""
    text = F.trim(column.cast("string"))
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in TIME_LAYOUTS]
    return F.coalesce(*tries)


def time_of(df: DataFrame, name: str) -> Column:
    return F.expr(time_sql(df, name))


def normalise_nulls(df: DataFrame) -> DataFrame:
    """Null tokens of text columns become null."""
    fixed = {
        name: F.when(~F.trim(col(name)).isin(*NULL_TOKENS), col(name))
        for name in names_where(df, is_text)
    }
    return df.withColumns(fixed) if fixed else df


def sanitize_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, at any depth; other values pass."""

    def has_float(dtype: T.DataType) -> bool:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return True
        if isinstance(dtype, T.ArrayType):
            return has_float(dtype.elementType)
        if isinstance(dtype, T.MapType):
            return has_float(dtype.valueType)
        if isinstance(dtype, T.StructType):
            return any(has_float(f.dataType) for f in dtype.fields)
        return False

    def clean(column: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        if isinstance(dtype, T.ArrayType):
            return F.transform(column, lambda x: clean(x, dtype.elementType))
        if isinstance(dtype, T.MapType):
            return F.transform_values(column, lambda _, v: clean(v, dtype.valueType))
        if isinstance(dtype, T.StructType):
            parts = [
                (clean(column[f.name], f.dataType) if has_float(f.dataType) else column[f.name]).alias(f.name)
                for f in dtype.fields
            ]
            return F.when(column.isNotNull(), F.struct(*parts))
        return column

    fixed = {f.name: clean(col(f.name), f.dataType) for f in df.schema.fields if has_float(f.dataType)}
    return df.withColumns(fixed) if fixed else df


def stringify(df: DataFrame) -> DataFrame:
    """Keep numbers, booleans and text; everything else becomes text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(col(f.name), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[f.name] = F.to_json(col(f.name))
        elif not (is_number(f.dataType) or is_flag(f.dataType) or is_text(f.dataType)):
            out[f.name] = col(f.name).cast("string")
    return df.withColumns(out) if out else df


def title_key(column: Column) -> Column:
    """Lower case letters and digits only: the key by which chart titles are compared."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def is_money(text: str, words=MONEY_WORDS) -> bool:
    low = text.lower()
    return any(word in low for word in words)


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"(\.\d*?)0+$", "$1")


def _shortest(value: Column, places: int) -> Column:
    """Fixed decimals without trailing zeros or a dangling dot, thousands in groups."""
    return F.regexp_replace(_trim_zeros(F.format_number(value, places)), r"\.$", "")


def _fixed(value: Column, places: int) -> Column:
    """Fixed decimals without groups, rounded as the stored number lies (1.235 is a little less than that)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def format_inr(column: Column, title: str = "", style: str = "insight") -> Column:
    """Indian number units (crore, lakh, thousand) with a rupee sign for money titles.

    ``insight`` keeps fixed decimals and says "Lakh"; ``chart`` trims zeros and says
    "L"; ``kpi`` trims too but only starts thousands at 10,000.
    """
    value = column.cast("double")
    size = F.abs(value)
    if style == "insight":
        sign = "₹" if is_money(title) else ""
        return (
            F.when(size >= 1e7, F.concat(F.lit(sign), _fixed(value / 1e7, 2), F.lit(" Cr")))
            .when(size >= 1e5, F.concat(F.lit(sign), _fixed(value / 1e5, 2), F.lit(" Lakh")))
            .when(size >= 1e3, F.concat(F.lit(sign), _fixed(value / 1e3, 1), F.lit(" K")))
            .when(value.isNotNull(), F.concat(F.lit(sign), F.format_number(value, 2)))
        )
    if style not in ("chart", "kpi"):
        raise ValueError(f"unknown number style: {style}")
    chart = style == "chart"
    sign = "₹" if is_money(title, MONEY_WORDS_CHART if chart else MONEY_WORDS_KPI) else ""
    body, front = (size, F.when(value < 0, "-").otherwise("")) if chart else (value, F.lit(""))

    def short(v: Column, places: int) -> Column:
        """A chart's axis has no groups of thousands."""
        return F.regexp_replace(_trim_zeros(_fixed(v, places)), r"\.$", "") if chart else _shortest(v, places)

    text = (
        F.when(size >= 1e7, F.concat(short(body / 1e7, 2), F.lit(" Cr")))
        .when(size >= 1e5, F.concat(short(body / 1e5, 2), F.lit(" L")))
        .when(size >= (1e3 if chart else 1e4), F.concat(short(body / 1e3, 1), F.lit(" K")))
        .otherwise(_shortest(body, 2))
    )
    shown = F.concat(front, F.lit(sign), text)
    return shown if chart else F.coalesce(shown, F.lit("0"))


def half_even(column: Column, places: int) -> Column:
    """Rounding as Python and pandas do it (ties to the even neighbour)."""
    return F.bround(column, places)


def month_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def day_text(column: Column) -> Column:
    """Year, month and day; years before 1 keep their sign (``yyyy`` would give the year of the era)."""
    year = F.year(column)
    shown = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(shown, F.date_format(column, "-MM-dd"))
