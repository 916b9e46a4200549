"""What is in the tables: explorer, relationships, join keys, schema of a workspace."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, half_even, quote, text_literal
from ..session import stored
from .frequencies import column_facts
from .profile import profile
from .types import infer_types

# Endings that mark a key column.
KEY_ENDINGS = ("_id", "id", "_code", "_key")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def explore(tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: type, key flag, rows, null share, distinct values.

    One scan per table, a second only for columns of very many values; ``exact=False`` takes a distinct-count sketch.
    """
    parts = []
    for name, df in tables.items():
        described = df.sparkSession.createDataFrame(
            [(name, i, f.name, f.dataType.simpleString(), f.nullable, (keys or {}).get(name) == f.name) for i, f in enumerate(df.schema.fields)],
            "table_name string, ordinal int, column string, type string, nullable boolean, is_key boolean")
        if exact:
            facts = column_facts(df, df.columns)
        else:
            aggs = [F.count(F.lit(1)).alias("rows")]
            for i, c in enumerate(df.columns):
                aggs += [F.count_if(col(c).isNull()).alias(f"n{i}"), F.approx_count_distinct(col(c)).alias(f"d{i}")]
            listed = [F.struct(F.lit(c).alias("column"), "rows", F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(df.columns)]
            facts = df.agg(*aggs).select(F.explode(F.array(*listed)).alias("r")).select("r.*")
        parts.append(described.join(facts, "column").select(
            "table_name", "ordinal", "column", "type", "nullable", "is_key", "rows",
            half_even(100.0 * F.col("nulls") / F.greatest("rows", F.lit(1)), 2).alias("null_pct"), "distinct_values"))
    return _union(parts)


def sample_rows(tables: Mapping[str, DataFrame], n: int = 5) -> DataFrame:
    """``table_name, position, row``: the first rows of each table, by all its columns, as JSON (nulls kept)."""
    parts = []
    for name, df in tables.items():
        whole = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
        first = df.orderBy(*[col(c) for c in df.columns]).limit(n)
        place = F.row_number().over(Window.orderBy(*[col(c) for c in df.columns]))  # n rows
        parts.append(first.select(F.lit(name).alias("table_name"), place.alias("position"), whole.alias("row")))
    return _union(parts)


def column_defaults(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, column, default``: the columns that a table's schema gives a default, as SQL text."""
    spark = next(iter(tables.values())).sparkSession
    found = [(t, f.name, f.metadata.get("CURRENT_DEFAULT", f.metadata.get("EXISTS_DEFAULT"))) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame([r for r in found if r[2] is not None], "table_name string, column string, default string")


def preview(df: DataFrame, limit: int = 100, order: Iterable[str] = ()) -> DataFrame:
    """The first rows, by ``order`` if given (rows have no order of their own)."""
    keys = [col(c) for c in order]
    return (df.orderBy(*keys) if keys else df).limit(limit)


def preview_columns(df: DataFrame) -> DataFrame:
    """What stands above a preview: types and mixed flag per column, total rows and columns."""
    return infer_types(df).withColumns(
        {"total_rows": F.lit(df.count()).cast("long"), "total_columns": F.lit(len(df.columns))}
    )


def relationships(spark: SparkSession, declared: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Foreign keys as rows ``(from_table, from_column, to_table, to_column)``."""
    return spark.createDataFrame(list(declared), "from_table string, from_column string, to_table string, to_column string")


def orphan_counts(tables: Mapping[str, DataFrame], declared: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Rows whose foreign key has no partner, per declared relationship.

    The keys of both sides are reduced to distinct values with counts first, so a
    hot key is one row in the join.
    """
    parts = []
    for child, child_col, parent, parent_col in declared:
        have = tables[child].where(col(child_col).isNotNull()).groupBy(col(child_col).alias("k")).agg(
            F.count(F.lit(1)).alias("n")
        )
        known = tables[parent].select(col(parent_col).alias("k")).distinct()
        lost = have.join(known, "k", "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")
        )
        parts.append(
            lost.select(
                F.lit(child).alias("from_table"), F.lit(child_col).alias("from_column"),
                F.lit(parent).alias("to_table"), F.lit(parent_col).alias("to_column"), "orphan_rows", "orphan_keys",
            )
        )
    return _union(parts)


def related_tables(edges: DataFrame, matched: Iterable[str], depth: int = 2) -> DataFrame:
    """Tables within ``depth`` foreign-key steps of the matched ones, either direction."""
    both = edges.select("from_table", "to_table").union(edges.select("to_table", "from_table")).toDF("a", "b").distinct()
    spark = edges.sparkSession
    reached = spark.createDataFrame([(t, 0) for t in matched], "table_name string, hops int")
    for hop in range(1, depth + 1):
        step = reached.join(both, F.col("table_name") == F.col("a")).select(F.col("b").alias("table_name"), F.lit(hop).alias("hops"))
        reached = reached.union(step).groupBy("table_name").agg(F.min("hops").alias("hops"))
    return reached


def join_key_candidates(tables: Mapping[str, DataFrame], overlap: bool = False) -> DataFrame:
    """Columns found in more than one table or named like a key; with ``overlap`` the shared values too."""
    spark = next(iter(tables.values())).sparkSession
    listed = [(t, c) for t, df in tables.items() for c in df.columns]
    # A schema, not data: as many rows as there are columns.
    schema = spark.createDataFrame(listed, "table_name string, column string")
    found = schema.groupBy("column").agg(
        F.count(F.lit(1)).alias("tables"), F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("table_names")
    )
    many = len(tables) > 1
    lower = F.lower("column")
    named = reduce(lambda a, b: a | b, [lower.endswith(e) for e in KEY_ENDINGS])
    found = found.where((F.col("tables") > 1) | named if many else named)
    if not overlap:
        return found
    owners: dict[str, list[str]] = {}
    for t, c in listed:
        owners.setdefault(c, []).append(t)
    wanted = {t: [c for c in df.columns if len(owners[c]) > 1] for t, df in tables.items()}
    if not any(wanted.values()):
        return found.withColumn("shared_values", F.lit(None).cast("long"))
    sizes = spark.createDataFrame([(c, len(o)) for c, o in owners.items() if len(o) > 1], "column string, owners long")
    everywhere = _digests(tables, wanted).groupBy("column", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sizes), "column").where("n = owners")
    counted = everywhere.groupBy("column").agg(F.count(F.lit(1)).alias("shared"))
    counted = sizes.join(counted, "column", "left").select("column", F.coalesce("shared", F.lit(0)).alias("shared_values"))
    return found.join(counted, "column", "left")


def _digests(tables: Mapping[str, DataFrame], wanted: Mapping[str, Iterable[str]]) -> DataFrame:
    """``table_name, column, a, b``: distinct 128-bit digests of the texts of some columns; one scan per table, no text is shuffled."""
    parts = []
    for name, columns in wanted.items():
        if columns:
            pairs = ", ".join(f"{text_literal(c)}, cast({quote(c)} as string)" for c in columns)
            long = tables[name].selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)").where("value is not null")
            parts.append(long.select(F.lit(name).alias("table_name"), "column", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b")).distinct())
    return _union(parts)


def key_overlap(tables: Mapping[str, DataFrame], pairs: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Distinct values two columns share, to rank join keys of different names; one scan per table."""
    listed = list(pairs)
    spark = next(iter(tables.values())).sparkSession
    wanted: dict[str, list[str]] = {}
    for a, ca, b, cb in listed:
        for t, c in ((a, ca), (b, cb)):
            if c not in wanted.setdefault(t, []):
                wanted[t].append(c)
    sides = spark.createDataFrame([(i, t, c) for i, (a, ca, b, cb) in enumerate(listed) for t, c in ((a, ca), (b, cb))],
                                  "pair int, table_name string, column string")
    both = _digests(tables, wanted).join(F.broadcast(sides), ["table_name", "column"]).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    names = spark.createDataFrame([(i, f"{a}.{ca}", f"{b}.{cb}") for i, (a, ca, b, cb) in enumerate(listed)], "pair int, left_key string, right_key string")
    counted = both.groupBy("pair").agg(F.count(F.lit(1)).alias("shared"))
    return names.join(counted, "pair", "left").select("left_key", "right_key", F.coalesce("shared", F.lit(0)).alias("shared_values"))


def rank_join_keys(tables: Mapping[str, DataFrame], least: float = 0.5, size: int = 12) -> DataFrame:
    """``left_key, right_key, shared_values, left_values, right_values, containment``: column pairs of two tables that look like join keys.

    Theta sketches of all columns (``2 ** size`` entries each, one scan per table) are intersected pair by pair; pairs of like type whose
    estimated share of the smaller side is not below ``least`` by six standard errors are then counted exactly on digests.  The
    sketch of a large column keeps few values of a small one, so such pairs are nearly always counted.
    """
    def kind(dtype: T.DataType) -> str | None:
        return "number" if isinstance(dtype, T.IntegralType) else "text" if isinstance(dtype, T.StringType) else None

    sketched = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if kind(f.dataType)]
        if fields:
            row = df.agg(*[F.theta_sketch_agg(col(f.name).cast("string"), size).alias(f"s{i}") for i, f in enumerate(fields)])
            entries = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column"), F.lit(kind(f.dataType)).alias("kind"),
                                         F.col(f"s{i}").alias("sketch")) for i, f in enumerate(fields)])
            sketched.append(row.select(F.explode(entries).alias("e")).select("e.*"))
    if not sketched:
        raise ValueError("no column of numbers or texts")
    # a row per column, so the pairs are as few as the square of the schema
    one = stored(_union(sketched).withColumn("values", F.theta_sketch_estimate("sketch")))
    two = one.toDF("table2", "column2", "kind2", "sketch2", "values2")
    met = one.join(two, (F.col("kind") == F.col("kind2")) & (F.col("table_name") < F.col("table2"))).where("values > 0 and values2 > 0")
    share = F.theta_sketch_estimate(F.theta_intersection("sketch", "sketch2")) / F.least("values", "values2")
    # values of the smaller side that the coarser sketch keeps
    kept = F.least("values", "values2") * F.least(F.lit(1.0), 2**size / F.greatest("values", "values2"))
    room = 6 * (F.sqrt(least * (1 - least) / kept) + least / math.sqrt(2**size))
    likely = [tuple(r) for r in met.where(share >= least - room).select("table_name", "column", "table2", "column2").collect()]
    names = "left_key string, right_key string"
    if not likely:
        return next(iter(tables.values())).sparkSession.createDataFrame([], names + ", shared_values long, left_values long, right_values long, containment double")
    exact = key_overlap(tables, likely)
    wanted: dict[str, list[str]] = {}
    for a, ca, b, cb in likely:
        for t, c in ((a, ca), (b, cb)):
            if c not in wanted.setdefault(t, []):
                wanted[t].append(c)
    sizes = stored(_digests(tables, wanted).groupBy("table_name", "column").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat_ws(".", "table_name", "column").alias("key"), "n"))
    joined = exact.join(sizes.toDF("left_key", "left_values"), "left_key").join(sizes.toDF("right_key", "right_values"), "right_key")
    held = F.col("shared_values") / F.least("left_values", "right_values")
    return joined.where(held >= least).select(
        "left_key", "right_key", "shared_values", "left_values", "right_values", half_even(held, 4).alias("containment"))


def workspace_schema(tables: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """The profiles of all tables, one row per table and column."""
    return _union([profile(df, exact=exact).withColumn("table_name", F.lit(name)) for name, df in tables.items()])


def fanout(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Does joining on ``key`` multiply rows?  Duplicate keys per side and rows of the join, without joining rows."""
    a = left.groupBy(col(key)).agg(F.count(F.lit(1)).alias("nl")).where(col(key).isNotNull())
    b = right.groupBy(col(key)).agg(F.count(F.lit(1)).alias("nr")).where(col(key).isNotNull())
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("nl") > 1).alias("left_duplicate_keys"),
        F.count_if(F.col("nr") > 1).alias("right_duplicate_keys"),
        F.count_if((F.col("nl") > 1) & (F.col("nr") > 1)).alias("many_to_many_keys"),
        F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("joined_rows"),
    )
