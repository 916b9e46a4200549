"""Column profiles and the data quality report.

A profile is one pass of plain aggregates, one pass of summaries per task (``frequencies``), exact quantiles
and one pass for the outliers; cells are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, half_even, is_text, number, number_sql, quote, text_literal, time_sql, type_of
from .frequencies import column_facts
from .quantiles import column_quantiles
from .types import type_map


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``column, value, n``: how often each value occurs, as text, nulls left out.

    Whole numbers, other numbers and the rest are counted in their own types and
    turned into text afterwards, one row per distinct value.
    """
    kinds: dict[str, list[str]] = {"bigint": [], "double": [], "string": []}
    for c in columns:
        dtype = type_of(df, c)
        if isinstance(dtype, T.IntegralType):
            kinds["bigint"].append(c)
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            kinds["double"].append(c)
        else:
            kinds["string"].append(c)
    parts = []
    for kind, names in kinds.items():
        if not names:
            continue
        pairs = ", ".join(f"{text_literal(c)}, cast({quote(c)} as {kind})" for c in names)
        long = df.selectExpr(f"stack({len(names)}, {pairs}) as (column, value)")
        counted = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        rank = F.col("value").cast("double") if kind != "string" else F.lit(None).cast("double")
        parts.append(counted.select("column", F.col("value").cast("string").alias("value"), rank.alias("number"), "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile(df: DataFrame, types: dict[str, dict] | None = None, exact: bool = True) -> DataFrame:
    """One row per column with every statistic that suits its type.

    ``exact=False`` replaces the frequency table by a distinct-count sketch (then
    top value and samples stay null): no shuffle of the data at all.
    """
    types = types or type_map(df)
    names = [c for c in df.columns if c in types]
    numeric = [c for c in names if types[c]["data_type"] == "numerical"]
    dated = [c for c in names if types[c]["data_type"] == "datetime"]
    edges = column_quantiles(df, {c: number(df, c) for c in numeric}, [0.25, 0.5, 0.75])

    aggs = ["count(1) as rows"]
    rows = []
    for i, c in enumerate(names):
        ref = quote(c)
        aggs.append(f"count_if({ref} is null) as nulls{i}")
        facts = {
            "ordinal": str(i), "column": text_literal(c), "data_type": text_literal(types[c]["data_type"]),
            "sql_type": text_literal(types[c]["sql_type"]), "rows": "rows", "null_count": f"nulls{i}",
            "null_pct": f"bround(100.0D * nulls{i} / greatest(rows, 1), 2)",
        }
        if not exact:
            aggs.append(f"approx_count_distinct({ref}) as distinct{i}")
        facts |= dict.fromkeys(("min", "max", "mean", "std", "q25", "median", "q75"), "cast(null as double)")
        facts["outliers"] = "cast(null as bigint)"
        facts |= dict.fromkeys(("min_date", "max_date"), "cast(null as string)")
        if c in numeric:
            value = number_sql(df, c)
            aggs += [
                f"min({value}) as min{i}", f"max({value}) as max{i}", f"avg({value}) as mean{i}",
                f"coalesce(stddev_samp({value}), 0.0D) as std{i}",
            ]
            facts |= {s: f"bround({s}{i}, 2)" for s in ("min", "max", "mean", "std")}
            if edges[c][0] is not None:
                low, high = iqr_fences(edges[c])
                aggs.append(f"count_if({value} < {low!r}D or {value} > {high!r}D) as out{i}")
                facts["outliers"] = f"out{i}"
                facts |= {s: f"bround({v!r}D, 2)" for s, v in zip(("q25", "median", "q75"), edges[c])}
        elif c in dated:
            moment = time_sql(df, c)
            aggs += [f"min({moment}) as first{i}", f"max({moment}) as last{i}"]
            iso = "\"yyyy-MM-dd'T'HH:mm:ss\""
            facts["min_date"] = f"date_format(first{i}, {iso})"
            facts["max_date"] = f"date_format(last{i}, {iso})"
        facts["sketched"] = f"distinct{i}" if not exact else "cast(null as bigint)"
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in facts.items()) + ")")
    base = df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")
    worded = [c for c in names if types[c]["data_type"] in ("categorical", "text")]
    if exact:
        extra = column_facts(df, names, [c for c in names if types[c]["data_type"] in ("categorical", "text")]).drop("rows", "nulls")
        out = base.join(extra, "column", "left").withColumn("unique_count", F.coalesce("distinct_values", F.lit(0)))
    else:
        out = base.withColumns(
            {
                "unique_count": F.col("sketched"), "top_value": none_s, "top_frequency": none_l,
                "sample_values": F.lit(None).cast("array<string>"),
            }
        )
    is_word = F.col("column").isin(*worded) if worded else F.lit(False)
    return out.select(
        "ordinal", "column", "data_type", "sql_type", "rows", "null_count", "null_pct", "unique_count",
        "sample_values", "min", "max", "mean", "std", "median", "q25", "q75", "outliers",
        F.when(is_word, F.coalesce("top_value", F.lit("N/A"))).alias("top_value"),
        F.when(is_word, F.coalesce("top_frequency", F.lit(0))).alias("top_frequency"),
        F.when(
            is_word, half_even(F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1)), 4)
        ).alias("cardinality_ratio"),
        "min_date", "max_date",
    )


def iqr_fences(quartiles) -> tuple[float | None, float | None]:
    """Tukey fences from the quartiles."""
    if not quartiles or quartiles[0] is None:
        return None, None
    spread = quartiles[2] - quartiles[0]
    return quartiles[0] - 1.5 * spread, quartiles[2] + 1.5 * spread


def outlier_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``column, low, high, outliers`` by the 1.5 x IQR rule, strict."""
    names = list(columns)
    edges = column_quantiles(df, {c: number(df, c) for c in names}, [0.25, 0.5, 0.75])
    fences = {c: iqr_fences(edges[c]) for c in names}
    aggs = [
        F.count_if((number(df, c) < fences[c][0]) | (number(df, c) > fences[c][1])).alias(f"o{i}")
        if fences[c][0] is not None else F.lit(0).cast("long").alias(f"o{i}")
        for i, c in enumerate(names)
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(fences[c][0]).cast("double").alias("low"),
            F.lit(fences[c][1]).cast("double").alias("high"), F.col(f"o{i}").alias("outliers"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows that repeat an earlier row in every column.

    Rows less distinct rows; rows are told apart by 128-bit digests, of which copies collapse before the only shuffle.
    """
    cells = [col(c) for c in df.columns]
    digests = df.select(F.xxhash64(F.lit(1), *cells).alias("a"), F.xxhash64(F.lit(2), *reversed(cells)).alias("b"))
    return digests.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame, converted: Iterable[str] = (), described: DataFrame | None = None) -> DataFrame:
    """One row: rows, duplicates, missing cells and their share, warnings."""
    described = _quality_facts(df) if described is None else described
    width = max(1, len(df.columns))
    mixed = list(converted)
    duplicates = duplicate_rows(df).first()[0]
    many_nulls = F.when(
        F.col("null_pct") > 40,
        F.struct(F.col("ordinal"), F.format_string("Column '%s' is %.1f%% empty", "column", "null_pct").alias("w")),
    )
    key_like = F.when(
        F.col("data_type").isin("categorical", "text")
        & (F.col("unique_count") > 100) & (F.col("unique_count") / F.greatest("rows", F.lit(1)) > 0.8),
        F.struct(
            F.col("ordinal"),
            F.format_string("Column '%s' has %d distinct values", "column", "unique_count").alias("w"),
        ),
    )
    # The profile has one row per column, so these lists are as short as the schema.
    report = described.agg(
        F.max("rows").alias("rows"),
        F.sum("null_count").alias("missing_cells"),
        F.array_sort(F.collect_list(many_nulls)).alias("nulls"),
        F.array_sort(F.collect_list(key_like)).alias("keys"),
    ).withColumn("dup", F.lit(duplicates).cast("long"))
    share = 100.0 * F.col("dup") / F.greatest("rows", F.lit(1))
    general = F.filter(
        F.array(
            F.when(F.col("dup") > 0, F.format_string("%d duplicate rows (%.1f%%)", "dup", share)),
            F.when(F.col("rows") < 10, F.format_string("Only %d rows", "rows")),
        ),
        lambda w: w.isNotNull(),
    )
    notes = F.array(*[F.lit(f"Column '{c}' mixes numbers and text; kept as text") for c in mixed]).cast("array<string>")
    return report.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.col("dup").alias("duplicate_rows"),
        half_even(share, 2).alias("duplicate_pct"),
        "missing_cells",
        half_even(100.0 * F.col("missing_cells") / F.greatest(F.col("rows") * width, F.lit(1)), 2).alias(
            "missing_cells_pct"
        ),
        F.concat(
            general, F.transform("nulls", lambda w: w["w"]), F.transform("keys", lambda w: w["w"]), notes
        ).alias("warnings"),
    )


def _quality_facts(df: DataFrame) -> DataFrame:
    """The part of a profile the report needs: nulls of all columns, distinct values of text columns."""
    texts = [c for c in df.columns if is_text(type_of(df, c))]
    kinds = type_map(df, texts) if texts else {}
    aggs = ["count(1) as rows"] + [f"count_if({quote(c)} is null) as n{i}" for i, c in enumerate(df.columns)]
    rows = ", ".join(
        f"named_struct('ordinal', {i}, 'column', {text_literal(c)}, 'data_type', "
        f"{text_literal(kinds.get(c, {}).get('data_type', 'other'))}, 'rows', rows, 'null_count', n{i}, "
        f"'null_pct', bround(100.0D * n{i} / greatest(rows, 1), 2))"
        for i, c in enumerate(df.columns)
    )
    base = df.selectExpr(*aggs).selectExpr(f"inline(array({rows}))")
    worded = [c for c in texts if kinds[c]["data_type"] in ("categorical", "text")]
    if not worded:
        return base.withColumn("unique_count", F.lit(0))
    distinct = column_facts(df, worded).select("column", F.col("distinct_values").alias("unique_count"))
    return base.join(distinct, "column", "left")


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-null, non-empty values as text, ascending."""
    text = col(name).cast("string")
    if is_text(type_of(df, name)):
        df = df.where(col(name) != "")
    values = df.where(col(name).isNotNull()).select(text.alias("value")).distinct()
    return values.orderBy("value")
