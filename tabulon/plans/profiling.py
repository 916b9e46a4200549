"""Queries over types, profiles, quality, derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normalise_nulls, sanitize_floats
from ..operators.derive import add_date_parts, add_quantile_group
from ..operators.profile import distinct_values, outlier_counts, profile, quality_report
from ..operators.types import convert_mixed_to_text, infer_types
from .registry import query

TYPES = {
    "lineitem": {
        "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
        "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "c", "l_linestatus": "c",
        "l_shipdate": "d",
    },
    "orders": {
        "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "c", "o_totalprice": "n", "o_orderdate": "d",
        "o_orderpriority": "t",
    },
    "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "c"},
}
KIND = {"n": "numerical", "c": "categorical", "d": "datetime", "t": "text"}


def _profile_sql(table: str) -> str:
    parts = []
    for i, (c, k) in enumerate(TYPES[table].items()):
        text = f"CAST({c} AS VARCHAR)"
        num = k == "n"
        word = k in "ct"
        sql_type = (
            f"(SELECT CASE WHEN bool_and({c} % 1 = 0) THEN 'INTEGER' ELSE 'REAL' END FROM {table})" if num
            else "'DATETIME'" if k == "d" else "'TEXT'"
        )
        def q(p):
            return f"round_even(quantile_cont(CAST({c} AS DOUBLE), {p}), 2)::DOUBLE" if num else "NULL::DOUBLE"
        def stat(f):
            return f"round_even({f}, 2)::DOUBLE" if num else "NULL::DOUBLE"
        outliers = (
            f"(SELECT count(*) FROM {table}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) a, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.75) b FROM {table}) "
            f"WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))" if num else "NULL::BIGINT"
        )
        top = f"(SELECT {{}} FROM (SELECT {text} v, count(*) n FROM {table} GROUP BY 1 ORDER BY n DESC, v LIMIT 1))"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{KIND[k]}' AS data_type, {sql_type} AS sql_type, "
            f"count(*) AS \"rows\", count(*) - count({c}) AS null_count, "
            f"round_even(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, "
            f"{stat(f'min(CAST({c} AS DOUBLE))')} AS min, {stat(f'max(CAST({c} AS DOUBLE))')} AS max, "
            f"{stat(f'avg(CAST({c} AS DOUBLE))')} AS mean, {stat(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, "
            f"{q(0.5)} AS median, {q(0.25)} AS q25, {q(0.75)} AS q75, {outliers} AS outliers, "
            f"{top.format('v') if word else 'NULL::VARCHAR'} AS top_value, "
            f"{top.format('n') if word else 'NULL::BIGINT'} AS top_frequency, "
            + (f"round_even(count(DISTINCT {c}) / count(*), 4)::DOUBLE" if word else "NULL::DOUBLE")
            + " AS cardinality_ratio, "
            + (f"strftime(min({c}), '%Y-%m-%dT%H:%M:%S')" if k == "d" else "NULL::VARCHAR") + " AS min_date, "
            + (f"strftime(max({c}), '%Y-%m-%dT%H:%M:%S')" if k == "d" else "NULL::VARCHAR") + " AS max_date "
            f"FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _samples_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS sample_values FROM (SELECT DISTINCT {c} AS v FROM {table} "
        f"WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)" for c, k in TYPES[table].items() if k != "d" and "price" not in c and "bal" not in c)


@query("profile_sample_values", " UNION ALL ".join(_samples_sql(t) for t in ("lineitem", "orders", "customer")))
def profile_sample_values(t):
    """The smallest values of whole-number and text columns of three tables (prices are left out: their texts differ in form)."""
    parts = []
    for name in ("lineitem", "orders", "customer"):
        kept = [c for c, k in TYPES[name].items() if k != "d" and "price" not in c and "bal" not in c]
        parts.append(profile(getattr(t, name).select(*kept)).select("column", F.array_join("sample_values", "|").alias("sample_values")))
    return parts[0].union(parts[1]).union(parts[2])


@query("profile_lineitem", _profile_sql("lineitem"))
def profile_lineitem(t):
    return profile(t.lineitem).drop("sample_values")


@query("profile_orders", _profile_sql("orders"))
def profile_orders(t):
    return profile(t.orders).drop("sample_values")


@query("profile_customer", _profile_sql("customer"))
def profile_customer(t):
    return profile(t.customer).drop("sample_values")


@query(
    "profile_samples_part",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS sample_values FROM "
        f"(SELECT DISTINCT {c} AS v FROM part ORDER BY v LIMIT 5)"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    ),
)
def profile_samples_part(t):
    described = profile(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return described.select("column", F.array_join("sample_values", "|").alias("sample_values"))


@query(
    "quality_customer",
    """
    SELECT count(*) AS "rows", 6 AS columns, count(*) - count(DISTINCT (c_name, c_nationkey, c_acctbal, seg, small))
           AS duplicate_rows,
           CAST(sum(CASE WHEN seg IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN small IS NULL THEN 1 ELSE 0 END) AS BIGINT)
             AS missing_cells,
           round_even(100.0 * (sum(CASE WHEN seg IS NULL THEN 1 ELSE 0 END)
             + sum(CASE WHEN small IS NULL THEN 1 ELSE 0 END)) / (count(*) * 6), 2)::DOUBLE AS missing_cells_pct
    FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg,
                 CASE WHEN c_acctbal < 5000 THEN c_acctbal END AS small FROM customer)
    """,
)
def quality_customer(t):
    df = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn(
        "small", F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal"))
    )
    return quality_report(df).select("rows", "columns", "duplicate_rows", "missing_cells", "missing_cells_pct")


@query(
    "quality_duplicates_lineitem",
    """
    SELECT count(*) AS "rows", (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (
        SELECT count(*) n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax))
        AS duplicate_rows,
      (SELECT round_even(100.0 * coalesce(sum(n - 1), 0) / sum(n), 2)::DOUBLE FROM (
        SELECT count(*) n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax))
        AS duplicate_pct
    FROM lineitem
    """,
)
def quality_duplicates_lineitem(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    return quality_report(df).select("rows", "duplicate_rows", "duplicate_pct")


def _text_type_sql(i: int, table: str, c: str) -> str:
    digit, letter = f"bool_or(regexp_matches({c}, '[0-9]'))", f"bool_or(regexp_matches({c}, '[A-Za-z]'))"
    numbers = f"count(TRY_CAST(trim({c}) AS DOUBLE)) = count({c})"
    return (
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", "
        f"CASE WHEN {digit} AND {letter} THEN 'text' WHEN {numbers} THEN 'numerical' ELSE 'categorical' END "
        f"AS data_type, CASE WHEN {digit} AND {letter} THEN 'TEXT' WHEN {numbers} THEN "
        f"CASE WHEN bool_and(TRY_CAST(trim({c}) AS DOUBLE) % 1 = 0) THEN 'INTEGER' ELSE 'REAL' END ELSE 'TEXT' END "
        f"AS sql_type, {digit} AND {letter} AS is_mixed FROM {table}"
    )


@query(
    "infer_types_events",
    " UNION ALL ".join(
        [
            "SELECT 0 AS ordinal, 'event_id' AS \"column\", 'numerical' AS data_type, 'INTEGER' AS sql_type, "
            "false AS is_mixed",
            "SELECT 1, 'ts', 'datetime', 'DATETIME', false",
            _text_type_sql(2, "(SELECT CAST(user_id AS VARCHAR) AS user_text FROM events)", "user_text"),
            _text_type_sql(3, "events", "event_type"),
            _text_type_sql(4, "(SELECT CAST(value AS VARCHAR) AS value_text FROM events)", "value_text"),
            _text_type_sql(5, "events", "props"),
        ]
    ),
)
def infer_types_events(t):
    return infer_types(
        t.events.select(
            "event_id", "ts", F.col("user_id").cast("string").alias("user_text"), "event_type",
            F.col("value").cast("string").alias("value_text"), "props",
        )
    )


@query(
    "infer_types_derived_text",
    """
    SELECT 0 AS ordinal, 'day' AS "column", 'datetime' AS data_type, 'DATETIME' AS sql_type, false AS is_mixed
    UNION ALL SELECT 1, 'flag', CASE WHEN count(DISTINCT l_returnflag) > 0 THEN 'boolean' END, 'BOOLEAN', false
              FROM lineitem
    UNION ALL SELECT 2, 'binary', CASE WHEN count(*) > 0 THEN 'boolean' END, 'BOOLEAN', false FROM lineitem
    UNION ALL SELECT 3, 'nothing', 'categorical', 'TEXT', false
    """,
)
def infer_types_derived_text(t):
    return infer_types(
        t.lineitem.select(
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
            F.when(F.col("l_returnflag") == "A", "yes").otherwise("no").alias("flag"),
            (F.col("l_quantity") > 25).cast("int").alias("binary"),
            F.lit(None).cast("string").alias("nothing"),
        )
    )


@query(
    "mixed_part",
    """
    SELECT p_partkey, p_name, p_brand,
           CASE WHEN p_size < 10 THEN NULL WHEN p_size < 25 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS code
    FROM part
    """,
)
def mixed_part(t):
    size = F.col("p_size")
    raw = t.part.select(
        "p_partkey", "p_name", "p_brand",
        F.when(size < 10, "None").when(size < 25, size.cast("double").cast("string")).otherwise(F.col("p_brand"))
        .alias("code"),
    )
    return convert_mixed_to_text(raw)


@query("distinct_segments", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment <> ''")
def distinct_segments(t):
    return distinct_values(t.customer, "c_mktsegment")


@query(
    "iqr_outliers",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high, "
        f"(SELECT count(*) FROM {tab} WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers "
        f"FROM (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM {tab})"
        for tab, c in (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"))
    ),
)
def iqr_outliers(t):
    return outlier_counts(t.lineitem, ["l_extendedprice", "l_quantity", "l_discount"])


@query(
    "date_parts_orders",
    """
    SELECT o_orderkey, coalesce(CAST(year(d) AS VARCHAR), '0') AS d_year,
           coalesce(strftime(d, '%Y-%m'), 'Unknown') AS d_month, coalesce(dayname(d), 'Unknown') AS d_day_of_week
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)
    """,
)
def date_parts_orders(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    return add_date_parts(df, ["d"]).drop("d")


@query(
    "quantile_group_price",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      CASE WHEN l_extendedprice <= a THEN 'Low' WHEN l_extendedprice <= b THEN 'Medium-Low'
           WHEN l_extendedprice <= c THEN 'Medium-High' ELSE 'High' END AS l_extendedprice_group
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b,
                           quantile_cont(l_extendedprice, 0.75) c FROM lineitem)
    """,
)
def quantile_group_price(t):
    return add_quantile_group(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])


@query(
    "normalise_null_tokens",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority FROM orders
    """,
)
def normalise_null_tokens(t):
    raw = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", " N/A ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    return normalise_nulls(raw)


@query(
    "sanitize_floats",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem
    """,
)
def sanitize_lineitem(t):
    price = (
        F.when(F.col("l_discount") == 0, F.lit(float("nan")))
        .when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    )
    return sanitize_floats(t.lineitem.select("l_orderkey", "l_linenumber", price.alias("price")))


@query(
    "quality_warnings",
    """WITH d AS (SELECT c_name, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal < 2000 THEN c_acctbal END AS small FROM customer
      UNION ALL SELECT c_name, nullif(c_mktsegment, 'BUILDING'), CASE WHEN c_acctbal < 2000 THEN c_acctbal END FROM customer WHERE c_custkey % 10 = 0),
    n AS (SELECT count(*) AS r, count(*) - count(DISTINCT (c_name, seg, small)) AS dup, count(DISTINCT c_name) AS names,
      count(*) - count(small) AS gaps FROM d)
    SELECT printf('%d duplicate rows (%.1f%%)', dup, 100.0 * dup / r) AS warning FROM n WHERE dup > 0
    UNION ALL SELECT printf('Column ''small'' is %.1f%% empty', round_even(100.0 * gaps / r, 2)::DOUBLE) FROM n WHERE round_even(100.0 * gaps / r, 2) > 40
    UNION ALL SELECT printf('Column ''c_name'' has %d distinct values', names) FROM n WHERE names > 100 AND names::DOUBLE / r > 0.8""",
)
def quality_warnings(t):
    """The warnings of a report: duplicates, an emptied column, a key-like text."""
    once = t.customer.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") < 2000, F.col("c_acctbal")).alias("small"))
    df = once.union(once.where("c_custkey % 10 = 0")).drop("c_custkey")
    return quality_report(df).select(F.explode("warnings").alias("warning"))
