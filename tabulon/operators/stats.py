"""Correlations over all rows: encoding, matrix, ranking, feature choice, splits."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, half_even, is_flag, is_number, is_text, number, number_sql, quote, text_literal, type_of
from ..session import stored
from .profile import value_counts
from .quantiles import column_quantiles, group_quantiles
from .types import type_map

MAX_CODES = 30
ID_SHARE = 0.7
FEW_CLASSES = 1000
MERGES = 16  # merged partial sums that the driver gets


def encode_for_correlation(
    df: DataFrame, target: str | None = None, types: dict[str, dict] | None = None
) -> tuple[DataFrame, list[str]]:
    """Eligible columns as doubles.

    Numbers: missing = median.  Booleans: 0/1, missing = 0.  Text of 2 to 30 distinct
    values that is not key-like: codes by ascending value (rows have no order of
    appearance).  A target that is not eligible is added with missing = 0.  Constant
    columns never qualify.
    """
    types = types or type_map(df)
    numeric, flags, words = [], [], []
    for name, facts in types.items():
        dtype, kind = type_of(df, name), facts["data_type"]
        if kind == "numerical" or (is_number(dtype) and kind != "categorical"):
            numeric.append(name)
        elif is_flag(dtype) or kind == "boolean":
            flags.append(name)
        elif kind in ("categorical", "text") and is_text(dtype):
            words.append(name)
    rows = df.count()
    # Numbers vary unless min = max: no distinct count needed.
    span = [f"min({number_sql(df, c)}) < max({number_sql(df, c)}) as n{i}" for i, c in enumerate(numeric)]
    span += [f"min({quote(c)}) < max({quote(c)}) as f{i}" for i, c in enumerate(flags)]
    row = df.selectExpr(*span).first() if span else {}
    numeric = [c for i, c in enumerate(numeric) if row[f"n{i}"]]
    flags = [c for i, c in enumerate(flags) if row[f"f{i}"]]
    codes = _codes(df, words) if words else {}
    codes = {c: v for c, v in codes.items() if c == target or (1 < len(v) <= MAX_CODES and len(v) < ID_SHARE * rows)}
    medians = column_quantiles(df, {c: number(df, c) for c in numeric}, [0.5])
    out: dict[str, Column] = {}
    for name in types:
        if name in numeric:
            out[name] = F.coalesce(number(df, name), F.lit(float(medians[name][0])))
        elif name in flags:
            if is_text(type_of(df, name)):
                value = F.lower(col(name)).isin("true", "1", "yes", "y").cast("double")
            else:
                value = col(name).cast("double")
            out[name] = F.coalesce(value, F.lit(0.0))
        elif name in codes:
            pairs = ", ".join(f"{text_literal(v)}, {float(i)!r}D" for i, v in enumerate(codes[name]))
            # A missing text is a value of its own, after the others.
            out[name] = F.expr(f"coalesce(map({pairs})[{quote(name)}], {float(len(codes[name]))!r}D)")
    return df.select(*[c.alias(n) for n, c in out.items()]), list(out)


def _codes(df: DataFrame, words: Sequence[str]) -> dict[str, list[str]]:
    """Values of each text column that has few of them, ascending."""
    counts = value_counts(df, words)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where(F.col("d").between(2, MAX_CODES))
    # At most MAX_CODES rows per column are left after this join.
    few = counts.join(sizes, "column").select("column", "value").collect()
    out: dict[str, list[str]] = {}
    for r in few:
        out.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def _merged(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred product sums of several parts together."""
    n, mean, products = 0, np.zeros(0), np.zeros((0, 0))
    for m, other, more in parts:
        if not m:
            continue
        if not n:
            n, mean, products = m, other, more
            continue
        gap = other - mean
        products = products + more + np.outer(gap, gap) * (n * m / (n + m))
        mean = mean + gap * (m / (n + m))
        n += m
    return n, mean, products


def moments(df: DataFrame, *columns: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred sums of products of number columns without nulls, or of one array column.

    One scan: each task merges its batches (centred on their own means, so nothing cancels), a second step merges tasks; the driver
    gets at most ``MERGES`` rows of width squared.  The plan has one operator, however many columns there are.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                if not batch.num_rows:
                    continue
                if pa.types.is_list(batch.schema.field(0).type):
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                else:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                mean = x.mean(axis=0)
                yield len(x), mean, (x - mean).T @ (x - mean)

        n, mean, products = _merged(parts())
        yield pa.RecordBatch.from_pydict({"slot": [TaskContext.get().partitionId() % MERGES], "n": [n], "mean": [mean.tolist()],
                                          "products": [products.ravel().tolist()]}, schema=pa.schema(
            [("slot", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))]))

    def read(frame: Iterable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, mean, products in frame:
            yield n, np.array(mean), np.array(products).reshape(len(mean), len(mean))  # a part without rows has no width

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        n, mean, products = _merged(read(zip(frame["n"], frame["mean"], frame["products"])))
        return pd.DataFrame({"slot": [frame["slot"].iloc[0]], "n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})

    schema = "slot int, n long, mean array<double>, products array<double>"
    sums = df.select(*[col(c) for c in columns]).mapInArrow(work, schema).groupBy("slot").applyInPandas(merge, schema)
    return _merged(read((r["n"], r["mean"], r["products"]) for r in sorted(sums.collect(), key=lambda r: r["slot"])))


def correlation_matrix(encoded: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``feature, other, correlation``: Pearson over all rows from one sum of products."""
    names = list(columns or encoded.columns)
    if not names:
        raise ValueError("no eligible columns")
    n, _, products = moments(encoded.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]),
                             *[f"c{i}" for i in range(len(names))])
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            spread = math.sqrt(products[i, i]) * math.sqrt(products[j, j]) if n else 0.0
            r = 1.0 if i == j else products[min(i, j), max(i, j)] / spread if spread > 0 else 0.0
            rows.append((a, b, round(max(-1.0, min(1.0, float(r))), 4)))
    return encoded.sparkSession.createDataFrame(rows, "feature string, other string, correlation double")


def strength(size: Column) -> Column:
    return (
        F.when(size >= 0.7, "Very Strong").when(size >= 0.5, "Strong").when(size >= 0.3, "Moderate")
        .when(size >= 0.1, "Weak").otherwise("Very Weak")
    )


def target_correlations(matrix: DataFrame, target: str) -> DataFrame:
    """Correlation of every feature with the target, strongest first."""
    r = F.col("correlation")
    size = half_even(F.abs(r), 4)
    return (
        matrix.where((F.col("other") == target) & (F.col("feature") != target))
        .select(
            "feature", "correlation", size.alias("abs_correlation"), strength(size).alias("strength"),
            F.when(r > 0, "positive").when(r < 0, "negative").otherwise("neutral").alias("direction"),
        )
        .orderBy(F.desc("abs_correlation"), "feature")
    )


def select_features(ranked: Sequence[dict[str, Any]], columns: Sequence[str], target: str | None = None, most: int | None = None) -> list[str]:
    """Features for a model from the ranked correlations (one small row per column); the ``most`` best if given.

    Features that equal the target are left out, weak ones where three others are stronger.
    """
    fair = [r for r in ranked if r["abs_correlation"] < 0.999]
    strong = [r for r in fair if r["abs_correlation"] >= 0.05]
    chosen = strong if len(strong) >= 3 else fair
    names = [r["feature"] for r in chosen] if ranked else [c for c in columns if c != target]
    return names[:most]


def top_features(ranked: Sequence[dict[str, Any]], n: int = 5, least: float | None = None) -> list[str]:
    """The pickers of the matrix view: the top n, or everything from a threshold on."""
    if least is not None:
        return [r["feature"] for r in ranked if r["abs_correlation"] >= least]
    return [r["feature"] for r in ranked[:n]]


def features_from_charts(specs, columns: Sequence[str]) -> dict[str, Any]:
    """One chart gives date and target; several give candidate features."""
    specs = list(specs)
    have = set(columns)
    if len(specs) == 1:
        s = specs[0]
        return {"date_column": s.x if s.x in have else None, "target_column": s.y if s.y in have else None}
    names = dict.fromkeys(c for s in specs for c in (s.x, s.y, s.group, s.size) if c in have)
    return {"feature_columns": list(names)}


def split_point(key: Column, seed: int) -> Column:
    """Evenly spread number in [0, 2^32) from a key: the same row always falls on the same side."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def split(
    df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, strata: str | None = None
) -> DataFrame:
    """Adds ``is_test``.  With ``strata`` the share holds in every class with at least two rows.

    Per class the threshold is a quantile of the hash, found without bringing a
    class into one task.
    """
    point = split_point(col(key), seed)
    if strata is None:
        return df.withColumn("is_test", point < int(test_share * 2**32))
    # Read by every pass of the quantile, and by whatever follows: the point of a row is worked out once.
    marked = stored(df.withColumn("__point", point))
    edges = group_quantiles(marked.where(col(strata).isNotNull()), [strata], F.col("__point"), [test_share], "__edge")
    sizes = df.where(col(strata).isNotNull()).groupBy(col(strata)).agg(F.count(F.lit(1)).alias("__n"))
    limits = edges.join(sizes, strata).select(
        col(strata).alias("__class"), F.when(F.col("__n") >= 2, F.col("__edge")[0]).alias("__limit")
    )
    few = limits.limit(FEW_CLASSES + 1).collect()
    if len(few) <= FEW_CLASSES:  # the usual case: thresholds as literals, no join
        pairs = [F.lit(x) for r in few for x in (r["__class"], r["__limit"])]
        edge = F.try_element_at(F.create_map(*pairs), col(strata)) if pairs else F.lit(None).cast("double")
        return marked.withColumn("is_test", F.coalesce(F.col("__point") < edge, F.lit(False))).drop("__point")
    joined = marked.join(limits, col(strata) == F.col("__class"), "left")
    is_test = F.coalesce(F.col("__point") < F.col("__limit"), F.lit(False))
    return joined.withColumn("is_test", is_test).drop("__point", "__class", "__limit")
