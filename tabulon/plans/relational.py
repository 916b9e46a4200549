"""Queries over joins, SQL shapes, catalog and workspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import (
    explore, fanout, join_key_candidates, key_overlap, orphan_counts, preview, preview_columns, rank_join_keys, related_tables, relationships, sample_rows, workspace_schema,
)
from ..operators.charts import ChartSpec
from ..sources.sqlguard import SCREEN_LIMIT
from ..sources.workspace import Workspace
from .registry import query

FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


def _workspace(t, *names, active=None):
    return Workspace(t.spark, {n: getattr(t, n) for n in names}, active)


def _sql(sql, *names, active=None):
    """A query that runs the same text as its check, through the guarded SQL path."""
    return lambda t: _workspace(t, *names, active=active).sql(sql, None)


def shared(name, sql, *names, active=None):
    query(name, sql)(_sql(sql, *names, active=active))


shared(
    "join_group",
    """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "orders", "customer",
)
shared(
    "three_way_join",
    """SELECT p_brand, s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand, s_name""",
    "lineitem", "part", "supplier",
)
shared(
    "join_distinct_subquery",
    """SELECT b.p_brand, round(avg(a.l_extendedprice), 4) AS avg_price, sum(a.l_quantity) AS quantity FROM lineitem a
    JOIN (SELECT DISTINCT p_partkey, p_brand FROM part) b ON a.l_partkey = b.p_partkey GROUP BY b.p_brand""",
    "lineitem", "part",
)
shared(
    "self_join_nation",
    """SELECT a.n_name AS nation, min(b.n_name) AS neighbour, count(b.n_nationkey) AS neighbours FROM nation a
    LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_name""",
    "nation",
)
shared(
    "left_join_customers_without_orders",
    """SELECT c_mktsegment, count(*) AS customers, count(o.o_custkey) AS with_orders FROM customer
    LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o.o_custkey GROUP BY c_mktsegment""",
    "customer", "orders",
)
shared(
    "cte_top_customer",
    """WITH spent AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey),
    big AS (SELECT * FROM spent WHERE total > (SELECT avg(total) FROM spent))
    SELECT c_name, n, total, class, place FROM (
      SELECT c_name, n, total, CASE WHEN total > 3000000 THEN 'gold' ELSE 'silver' END AS class,
        rank() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) AS place
      FROM big JOIN customer ON o_custkey = c_custkey) WHERE place <= 8 ORDER BY total DESC, c_name LIMIT 40""",
    "orders", "customer",
)
shared(
    "having_count",
    """SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > (SELECT avg(n) FROM
    (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey))""",
    "lineitem",
)
shared(
    "union_parties",
    """SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation FROM customer
    UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier""",
    "customer", "supplier",
)
shared(
    "intersect_nations",
    "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "customer", "supplier",
)
shared(
    "except_customers",
    "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "customer", "orders",
)
shared(
    "top_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "orders",
)
shared(
    "max_anchor_filter",
    """SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY GROUP BY o_orderstatus""",
    "orders",
)
query(
    "dialect_strftime",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, 7 // 2 AS half FROM orders GROUP BY 1",
)(_sql("SELECT strftime('%Y-%m', `o_orderdate`) AS month, count(*) AS n, CAST(7 DIV 2 AS INT) AS half FROM dataset GROUP BY 1", "orders"))
query("sql_reroute", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")(
    _sql("SELECT p_brand, count(*) AS n FROM dataset GROUP BY p_brand", "orders", "part")
)


@query("sql_all_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def sql_all_rows(t):
    """A query without a limit gives all its rows."""
    return _workspace(t, "orders").sql("SELECT o_orderkey, o_totalprice FROM data WHERE o_totalprice > 1000")


_NESTED = """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000),
    best AS (WITH big AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT o_custkey, m FROM big)
  SELECT best.o_custkey, best.m, count(*) AS n FROM best JOIN big USING (o_custkey) WHERE best.o_custkey IN (SELECT c_custkey FROM customer)
  GROUP BY best.o_custkey, best.m"""


@query("sql_nested_scopes", _NESTED)
def sql_nested_scopes(t):
    """One CTE name with two meanings, and a subquery over another table."""
    return _workspace(t, "orders", "customer").sql(_NESTED)


@query("sql_row_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def sql_row_cap(t):
    return _workspace(t, "orders").sql("SELECT o_orderkey FROM data ORDER BY o_orderkey", SCREEN_LIMIT)


@query(
    "margin_by_type",
    """SELECT p_type, count(DISTINCT p_partkey) AS products, round(sum(l_extendedprice), 2) AS revenue,
      round(sum(p_retailprice), 2) AS cost, round((sum(l_extendedprice) - sum(p_retailprice)) / sum(l_extendedprice) * 100, 4)
      AS margin_pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
)
def margin_by_type(t):
    """Line items are reduced to one row per part first, so no part number is hot in the join."""
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("r"), F.count("*").alias("n"))
    joined = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    revenue, cost = F.sum("r"), F.sum(F.col("p_retailprice") * F.col("n"))
    return joined.groupBy("p_type").agg(
        F.count("*").alias("products"), F.round(revenue, 2).alias("revenue"), F.round(cost, 2).alias("cost"),
        F.round(F.try_divide(revenue - cost, revenue) * 100, 4).alias("margin_pct"),
    )


@query(
    "supply_gap_fanout",
    """SELECT m.p_brand, round(sum(m.l_quantity), 2) AS made, round(sum(d.q), 2) AS wanted,
      round(sum(m.l_quantity) - sum(d.q), 2) AS gap FROM (SELECT p_brand, l_partkey, l_quantity FROM lineitem
      JOIN part ON l_partkey = p_partkey) m JOIN (SELECT l_partkey AS k, l_quantity * (1 - l_discount) AS q FROM lineitem) d
      ON m.l_partkey = d.k GROUP BY m.p_brand""",
)
def supply_gap_fanout(t):
    """Sums over a many-to-many join, without building it.

    Each left row meets every right row of its key, so both sides are reduced per
    key and each sum is multiplied by the other side's row count.
    """
    left = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("a"), F.count("*").alias("na"))
    right = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(
        F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("b"), F.count("*").alias("nb")
    )
    both = left.join(right, F.col("l_partkey") == F.col("k")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    made, wanted = F.sum(F.col("a") * F.col("nb")), F.sum(F.col("b") * F.col("na"))
    return both.groupBy("p_brand").agg(
        F.round(made, 2).alias("made"), F.round(wanted, 2).alias("wanted"), F.round(made - wanted, 2).alias("gap")
    )


@query(
    "fanout_check",
    """SELECT count(*) FILTER (a > 1) AS left_duplicate_keys, count(*) FILTER (b > 1) AS right_duplicate_keys,
      count(*) FILTER (a > 1 AND b > 1) AS many_to_many_keys, CAST(sum(coalesce(a * b, 0)) AS BIGINT) AS joined_rows FROM
      (SELECT l_partkey k, count(*) a FROM lineitem GROUP BY 1) FULL JOIN
      (SELECT l_suppkey k, count(*) b FROM lineitem GROUP BY 1) USING (k)""",
)
def fanout_check(t):
    return fanout(t.lineitem.select(F.col("l_partkey").alias("k")), t.lineitem.select(F.col("l_suppkey").alias("k")), "k")


@query(
    "price_ratio",
    """SELECT p_brand, round(avg(l_extendedprice / l_quantity), 4) AS unit_price, round(avg(p_retailprice), 4) AS list_price,
      round(avg(l_extendedprice / l_quantity / p_retailprice), 6) AS ratio, sum(l_quantity) AS units FROM lineitem
      JOIN (SELECT DISTINCT p_partkey, p_brand, p_retailprice FROM part) ON l_partkey = p_partkey GROUP BY p_brand""",
)
def price_ratio(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(
        F.sum(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).alias("u"), F.count("*").alias("n"),
        F.sum("l_quantity").alias("q"),
    )
    dim = t.part.select("p_partkey", "p_brand", "p_retailprice").distinct()
    joined = per_part.join(dim, F.col("l_partkey") == F.col("p_partkey"))
    n = F.sum("n")
    return joined.groupBy("p_brand").agg(
        F.round(F.sum("u") / n, 4).alias("unit_price"),
        F.round(F.sum(F.col("p_retailprice") * F.col("n")) / n, 4).alias("list_price"),
        F.round(F.sum(F.col("u") / F.col("p_retailprice")) / n, 6).alias("ratio"),
        F.sum("q").alias("units"),
    )


@query(
    "star_join_nation_revenue",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
)
def star_join_nation_revenue(t):
    """A walk along the foreign keys that aggregates before every join."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("n")
    )
    per_customer = (
        per_order.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    )
    per_nation = (
        per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    )
    return (
        per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", "n_name", F.round("r", 2).alias("revenue"), F.col("n").alias("n_lines"))
    )


def _explore_sql(table, types):
    n = len(types)
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS \"column\", '{k}' AS type, true AS nullable, {str(i == 0).lower()} "
        f"AS is_key, count(*) AS \"rows\", round_even(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_pct, "
        f"count(DISTINCT {c}) AS distinct_values FROM {table}"
        for i, (c, k) in enumerate(types)
    ) if n else ""


@query(
    "explorer",
    " UNION ALL ".join([
        _explore_sql("nation", [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]),
        _explore_sql("supplier", [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]),
        _explore_sql("orders", [
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
        ]),
    ]),
)
def explorer(t):
    return explore(
        {"nation": t.nation, "supplier": t.supplier, "orders": t.orders},
        {"nation": "n_nationkey", "supplier": "s_suppkey", "orders": "o_orderkey"},
    )


@query("preview_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_orders(t):
    return preview(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 100, ["o_orderkey"])


@query(
    "preview_columns_orders",
    " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{k}' AS data_type, '{q}' AS sql_type, {m} AS is_mixed, count(*) AS total_rows, "
        "6 AS total_columns FROM orders"
        for i, (c, k, q, m) in enumerate((
            ("o_orderkey", "numerical", "INTEGER", "false"), ("o_custkey", "numerical", "INTEGER", "false"),
            ("o_orderstatus", "categorical", "TEXT", "false"), ("o_totalprice", "numerical", "REAL", "false"),
            ("o_orderdate", "datetime", "DATETIME", "false"), ("o_orderpriority", "text", "TEXT", "true"),
        ))
    ),
)
def preview_columns_orders(t):
    return preview_columns(t.orders)


@query(
    "foreign_key_check",
    " UNION ALL ".join(
        f"SELECT '{a}' AS from_table, '{ca}' AS from_column, '{b}' AS to_table, '{cb}' AS to_column, "
        f"count(*) AS orphan_rows, count(DISTINCT {ca}) AS orphan_keys FROM {a} WHERE {ca} IS NOT NULL "
        f"AND {ca} NOT IN (SELECT {cb} FROM {b})"
        for a, ca, b, cb in FOREIGN_KEYS
    ),
)
def foreign_key_check(t):
    names = {n for a, _, b, _ in FOREIGN_KEYS for n in (a, b)}
    return orphan_counts({n: getattr(t, n) for n in names}, FOREIGN_KEYS)


@query(
    "related_tables",
    """SELECT 'lineitem' AS table_name, 0 AS hops, count(*) AS "rows" FROM lineitem UNION ALL SELECT 'orders', 1, count(*) FROM orders
    UNION ALL SELECT 'part', 1, count(*) FROM part UNION ALL SELECT 'supplier', 1, count(*) FROM supplier
    UNION ALL SELECT 'customer', 2, count(*) FROM customer UNION ALL SELECT 'nation', 2, count(*) FROM nation""",
)
def related(t):
    edges = relationships(t.spark, FOREIGN_KEYS)
    counts = None
    for n in sorted({n for a, _, b, _ in FOREIGN_KEYS for n in (a, b)}):
        one = getattr(t, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        counts = one if counts is None else counts.union(one)
    return related_tables(edges, ["lineitem"], 2).join(counts, "table_name")


@query(
    "join_keys_overlap",
    " UNION ALL ".join(
        f"SELECT '{a}.{ca}' AS left_key, '{b}.{cb}' AS right_key, count(*) AS shared_values FROM "
        f"(SELECT {ca} FROM {a} INTERSECT SELECT {cb} FROM {b})"
        for a, ca, b, cb in FOREIGN_KEYS
    ),
)
def join_keys_overlap(t):
    names = {n for a, _, b, _ in FOREIGN_KEYS for n in (a, b)}
    return key_overlap({n: getattr(t, n) for n in names}, FOREIGN_KEYS)


_KEYED = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
          "orders": ["o_custkey", "o_orderstatus"], "region": ["r_regionkey", "r_name"]}
_TEXTS = ("c_mktsegment", "n_name", "o_orderstatus", "r_name")


def _ranked_sql():
    parts = []
    for a, left in _KEYED.items():
        for b, right in _KEYED.items():
            for ca in left:
                for cb in right:
                    if a < b and (ca in _TEXTS) == (cb in _TEXTS):
                        parts.append(
                            f"SELECT '{a}.{ca}' AS left_key, '{b}.{cb}' AS right_key, (SELECT count(*) FROM (SELECT {ca} FROM {a} INTERSECT SELECT {cb} FROM {b})) AS shared_values, "
                            f"(SELECT count(DISTINCT {ca}) FROM {a}) AS left_values, (SELECT count(DISTINCT {cb}) FROM {b}) AS right_values")
    return f"""SELECT *, round_even(shared_values::DOUBLE / least(left_values, right_values), 4)::DOUBLE AS containment
      FROM ({' UNION ALL '.join(parts)}) WHERE shared_values::DOUBLE / least(left_values, right_values) >= 0.7"""


@query("join_key_ranking", _ranked_sql())
def join_key_ranking(t):
    """Column pairs of four tables whose values contain each other, found by sketches and counted exactly."""
    return rank_join_keys({n: getattr(t, n).select(*c) for n, c in _KEYED.items()}, 0.7)


@query(
    "explorer_sample_rows",
    """SELECT 'nation' AS table_name, place::INTEGER AS position, n_name AS name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation) WHERE place <= 5
    UNION ALL SELECT 'supplier', place::INTEGER, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier) WHERE place <= 5""",
)
def explorer_sample_rows(t):
    rows = sample_rows({"nation": t.nation, "supplier": t.supplier})
    name = F.coalesce(F.get_json_object("row", "$.n_name"), F.get_json_object("row", "$.s_name"))
    return rows.select("table_name", "position", name.alias("name"))


@query(
    "join_key_candidates",
    """SELECT 'doc_id' AS "column", CAST(2 AS BIGINT) AS tables, 'documents,labels' AS table_names,
      (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared_values
    UNION ALL SELECT 'page_id', 1, 'pages', NULL UNION ALL SELECT 'conv_id', 1, 'conversations', NULL
    UNION ALL SELECT 'text', 2, 'conversations,documents',
      (SELECT count(*) FROM (SELECT text FROM documents INTERSECT SELECT text FROM conversations))""",
)
def join_key_candidates_texts(t):
    tables = {"documents": t.documents, "labels": t.labels, "pages": t.pages, "conversations": t.conversations}
    return join_key_candidates(tables, overlap=True)


@query(
    "workspace_schema",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{k}' AS data_type, count(*) AS \"rows\", count(DISTINCT {c}) AS unique_count "
        f"FROM {t}"
        for t, c, k in (
            ("part", "p_partkey", "numerical"), ("part", "p_name", "categorical"), ("part", "p_brand", "text"),
            ("part", "p_type", "categorical"), ("part", "p_size", "numerical"), ("part", "p_retailprice", "numerical"),
            ("labels", "doc_id", "numerical"), ("labels", "quality", "boolean"), ("labels", "toxic", "boolean"),
        )
    ),
)
def schema_of_workspace(t):
    return workspace_schema({"part": t.part, "labels": t.labels}).select(
        "table_name", "column", "data_type", "rows", "unique_count"
    )


@query("workspace_chart", "SELECT p_type, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY p_type")
def workspace_chart(t):
    """The columns are not in the active table, so the next table that has them is used."""
    ws = _workspace(t, "orders", "part")
    out = ws.chart(ChartSpec("Bar", "p_type", "p_retailprice", aggregation="avg"))
    return out.withColumn("p_retailprice", F.round("p_retailprice", 4))


@query(
    "chart_source_sql",
    "SELECT o_orderpriority, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY o_orderpriority",
)
def chart_source_sql(t):
    ws = _workspace(t, "orders")
    return ws.chart_source(ChartSpec(sql="SELECT o_orderpriority, sum(o_custkey) AS s FROM data GROUP BY o_orderpriority"))


@query(
    "json_records",
    "SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_records(t):
    """JSON texts of a table read as records (schema given, no inference pass)."""
    return t.events.select("event_id", "event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))

