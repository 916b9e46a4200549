"""Queries over chart specifications and their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import ChartSpec, auto_charts, chart, dashboard, grouped_long
from ..operators.insight import insight_lines, insight_numbers, key_metrics
from ..operators.fusion import fused_charts, fused_dashboard
from ..operators.profile import profile
from .registry import query


@query("metric_total_price", "SELECT 'o_totalprice' AS metric, round(sum(o_totalprice), 2) AS value FROM orders")
def metric_total_price(t):
    return chart(t.orders, ChartSpec("Metric", y="o_totalprice", aggregation="sum"))


@query(
    "metric_each_aggregation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS how, round_even({a}(l_quantity), 2)::DOUBLE AS value FROM lineitem" for a in ("avg", "min", "max", "count")
    ),
)
def metric_each_aggregation(t):
    out = None
    for how in ("avg", "min", "max", "count"):
        one = chart(t.lineitem, ChartSpec("Metric", y="l_quantity", aggregation=how)).select(
            F.lit(how).alias("how"), F.col("value").cast("double").alias("value")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("kpi_total_records", "SELECT 'Total Records' AS metric, count(*)::DOUBLE AS value FROM customer")
def kpi_total_records(t):
    return chart(t.customer, ChartSpec("KPI", y="c_name"))


@query(
    "bar_revenue_by_segment",
    """SELECT c_mktsegment, round(sum(o_totalprice), 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 1000 GROUP BY c_mktsegment ORDER BY o_totalprice DESC LIMIT 50""",
)
def bar_revenue_by_segment(t):
    """Orders are reduced to one row per customer before the join."""
    spec = ChartSpec("Bar", "c_mktsegment", "o_totalprice", aggregation="sum")
    spent = (
        t.orders.where(F.col("o_totalprice") > 1000).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("o_totalprice"))
    )
    joined = spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return chart(joined, spec, screen=True).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "pivot_status_priority",
    "SELECT o_orderpriority, "
    + ", ".join(
        f"coalesce(round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4), 0) AS \"{s}\"" for s in "FOP"
    )
    + " FROM orders GROUP BY o_orderpriority",
)
def pivot_status_priority(t):
    out = chart(t.orders, ChartSpec("Stacked Bar", "o_orderpriority", "o_totalprice", "o_orderstatus", aggregation="avg"))
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in "FOP"])


@query(
    "pivot_counts_brand",
    "SELECT p_brand, "
    + ", ".join(f"count(*) FILTER (p_type = '{s}') AS \"{s}\"" for s in ("ECONOMY", "STANDARD"))
    + " FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 50",
)
def pivot_counts_brand(t):
    return chart(t.part, ChartSpec("Stacked Bar", "p_brand", None, "p_type"), screen=True).select("p_brand", "ECONOMY", "STANDARD")


@query(
    "pivot_median_quantity",
    "SELECT l_returnflag, "
    + ", ".join(f"median(l_extendedprice) FILTER (l_linestatus = '{s}') AS \"{s}\"" for s in "FO")
    + " FROM lineitem GROUP BY l_returnflag",
)
def pivot_median_quantity(t):
    return chart(t.lineitem, ChartSpec("Stacked Area", "l_returnflag", "l_extendedprice", "l_linestatus", aggregation="median"))


@query(
    "grouped_long_supplier",
    "SELECT l_suppkey, l_returnflag, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL",
)
def grouped_long_supplier(t):
    return grouped_long(t.lineitem, "l_suppkey", "l_returnflag", "l_extendedprice", "max", cap=None)


@query("count_by_brand", "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 50")
def count_by_brand(t):
    return chart(t.part, ChartSpec("Bar", "p_brand", "p_brand", aggregation="count"), screen=True)


@query("donut_by_type", "SELECT p_type, count(*) AS count FROM part GROUP BY p_type ORDER BY count DESC, p_type LIMIT 30")
def donut_by_type(t):
    return chart(t.part, ChartSpec("Donut", "p_type"), screen=True)


@query("self_scalar_price", "SELECT 'p_retailprice' AS p_retailprice, round_even(avg(p_retailprice), 2)::DOUBLE AS value FROM part")
def self_scalar_price(t):
    return chart(t.part, ChartSpec("Line", "p_retailprice", "p_retailprice", aggregation="avg"))


@query(
    "scatter_qty_price",
    "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem ORDER BY l_quantity, l_extendedprice, l_returnflag LIMIT 1000",
)
def scatter_qty_price(t):
    return chart(t.lineitem, ChartSpec("Scatter", "l_quantity", "l_extendedprice", "l_returnflag"), screen=True)


@query("raw_sample_orders", "SELECT o_orderpriority, o_orderdate::VARCHAR AS day FROM orders ORDER BY ALL LIMIT 50")
def raw_sample_orders(t):
    df = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return chart(df, ChartSpec("Line", "o_orderpriority", "day"), screen=True)


@query(
    "median_by_flag",
    "SELECT l_returnflag, median(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_returnflag",
)
def median_by_flag(t):
    return chart(t.lineitem, ChartSpec("Bar", "l_returnflag", "l_extendedprice", aggregation="median"))


@query(
    "bar_filtered_min",
    """SELECT l_suppkey, min(l_extendedprice) AS l_extendedprice FROM lineitem WHERE lower(l_returnflag) = 'r' AND l_quantity >= 10
    GROUP BY l_suppkey ORDER BY l_extendedprice DESC, l_suppkey LIMIT 50""",
)
def bar_filtered_min(t):
    return chart(
        t.lineitem,
        ChartSpec(
            "Horizontal Bar", "l_suppkey", "l_extendedprice", aggregation="min",
            filters=(
                {"column": "l_returnflag", "operator": "eq", "value": "r"},
                {"column": "l_quantity", "operator": "gte", "value": 10},
            ),
        ),
        screen=True,
    )


@query("line_all_days", "SELECT l_shipdate, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_shipdate")
def line_all_days(t):
    """A trend line keeps all its days."""
    return chart(t.lineitem, ChartSpec("Line", "l_shipdate", "l_quantity", aggregation="sum"))


@query(
    "pivot_long_all_keys",
    """SELECT l_partkey, l_suppkey, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_partkey, l_suppkey""",
)
def pivot_long_all_keys(t):
    """More groups than a wide pivot has columns, as rows."""
    spec = ChartSpec("Stacked Bar", "l_partkey", "l_extendedprice", "l_suppkey", aggregation="sum", long=True)
    return chart(t.lineitem, spec).withColumn("value", F.round("value", 2))


@query(
    "key_metrics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(sum({c}), 2) AS total, round(avg({c}), 6) AS avg, min({c})::DOUBLE AS min, "
        f"max({c})::DOUBLE AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    ),
)
def key_metrics_lineitem(t):
    df = t.lineitem.select(
        "l_quantity", "l_extendedprice", F.col("l_discount").cast("string").alias("l_discount"), "l_linenumber", "l_returnflag"
    )
    return key_metrics(df).select("column", F.round("total", 2).alias("total"), F.round("avg", 6).alias("avg"), "min", "max")


_BY_BRAND = "(SELECT p_brand, round(sum(p_retailprice), 2) AS v FROM part GROUP BY p_brand)"


@query(
    "chart_insight_numbers",
    f"""SELECT count(*) AS records, round(sum(v), 2) AS total, round(avg(v), 4) AS average,
      (SELECT p_brand FROM {_BY_BRAND} ORDER BY v DESC, p_brand LIMIT 1) AS top_label, max(v) AS top_value,
      (SELECT p_brand FROM {_BY_BRAND} ORDER BY v, p_brand DESC LIMIT 1) AS bottom_label, min(v) AS bottom_value,
      round(max(v) / sum(v) * 100, 6) AS top_pct, round(max(v) / min(v), 6) AS spread,
      (SELECT round(sum(v), 2) FROM (SELECT v FROM {_BY_BRAND} ORDER BY v DESC LIMIT 3)) AS top3_total FROM {_BY_BRAND}""",
)
def chart_insight_numbers(t):
    data = t.part.groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("v"))
    digits = {"total": 2, "average": 4, "top_pct": 6, "spread": 6, "top3_total": 2}
    return insight_numbers(data, "p_brand", "v").withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "insight_lines_segment",
    """WITH d AS (SELECT c_mktsegment AS s, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1), f AS (SELECT count(*) AS n, sum(v) AS t,
      avg(v) AS a, max(v) AS hi, min(v) AS lo, arg_max(s, v) AS top, arg_min(s, v) AS low FROM d),
    t3 AS (SELECT sum(v) AS b FROM (SELECT v FROM d ORDER BY v DESC LIMIT 3)),
    m AS (SELECT *, [hi, lo, a, t, b] AS vals FROM f, t3),
    w AS (SELECT *, list_transform(vals, lambda x: CASE WHEN x >= 1e7 THEN printf('₹%.2f Cr', x / 1e7) WHEN x >= 1e5 THEN
      printf('₹%.2f Lakh', x / 1e5) ELSE printf('₹%.1f K', x / 1e3) END) AS c FROM m)
    SELECT 0::INTEGER AS line, printf('%d records', n) AS text FROM w
    UNION ALL SELECT 1, 'Highest: ' || top || ' with ' || c[1] || printf(' (%.1f%% of the total)', hi / t * 100) FROM w
    UNION ALL SELECT 2, 'Lowest: ' || low || ' with ' || c[2] FROM w
    UNION ALL SELECT 3, 'Mean ' || c[3] || ', total ' || c[4] FROM w
    UNION ALL SELECT 4, 'Top three together ' || c[5] || printf('; spread %.1fx', hi / lo) FROM w""",
)
def insight_lines_segment(t):
    data = t.customer.groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("amount"))
    return insight_lines(data, "c_mktsegment", "amount", "Balance by segment")


@query(
    "orders_distinct_count",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS revenue,
      round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 4) AS per_order FROM lineitem GROUP BY l_returnflag""",
)
def orders_distinct_count(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
        F.round(F.sum("l_extendedprice") / F.count_distinct("l_orderkey"), 4).alias("per_order"),
    )


@query(
    "avg_order_value",
    "SELECT round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 4) AS avg_order_value FROM lineitem",
)
def avg_order_value(t):
    return t.lineitem.agg(
        F.round(F.sum("l_extendedprice") / F.count_distinct("l_orderkey"), 4).alias("avg_order_value")
    )


@query(
    "cond_count_late",
    """SELECT s_name, round(avg(days), 1) AS avg_days, CAST(sum(CASE WHEN days > 60 THEN 1 ELSE 0 END) AS BIGINT) AS late,
      count(*) AS shipments FROM (SELECT l_suppkey, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey) JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name""",
)
def cond_count_late(t):
    """Facts are reduced per supplier before the supplier names are joined."""
    days = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
    facts = (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate")
        .join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey")
        .agg(F.avg(days).alias("d"), F.count_if(days > 60).alias("late"), F.count("*").alias("shipments"))
    )
    return facts.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "s_name", F.round("d", 1).alias("avg_days"), "late", "shipments"
    )


@query(
    "group_mean_series",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1",
)
def group_mean_series(t):
    return (
        t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("value")).orderBy("month")
    )


@query(
    "dashboard_cards",
    """SELECT 'Revenue by priority' AS card, o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'Balance by segment', c_mktsegment, round(avg(c_acctbal), 2) FROM customer GROUP BY 2
    UNION ALL SELECT 'Parts by type', p_type, count(*)::DOUBLE FROM part GROUP BY 2""",
)
def dashboard_cards(t):
    """All cards of one dashboard in long form: ``card, label, value``."""
    tables = {"orders": t.orders, "customer": t.customer, "part": t.part}
    cards = [
        ChartSpec("Bar", "o_orderpriority", "o_totalprice", aggregation="sum", title="Revenue by priority"),
        ChartSpec("unknown", "c_mktsegment", "c_acctbal", aggregation="avg", title="Balance by segment"),
        ChartSpec("Donut", "p_type", title="Parts by type"),
    ]
    out = None
    for title, df in dashboard(tables, "orders", cards, screen=True).items():
        label, value = df.columns
        one = df.select(
            F.lit(title).alias("card"), F.col(label).cast("string").alias("label"),
            F.round(F.col(value).cast("double"), 2).alias("value"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_AUTO = [
    ("Distribution", "Frequency of o_orderstatus", "Bar", "count(DISTINCT o_orderstatus)"), ("Distribution", "Average o_orderkey", "Metric", "least(count(*), 1)"),
    ("Distribution", "Share of o_orderpriority", "Donut", "count(DISTINCT o_orderpriority)"), ("Distribution", "Total o_totalprice", "Metric", "least(count(*), 1)"),
    ("Comparison", "o_totalprice by o_orderstatus", "Bar", "count(DISTINCT o_orderstatus)"),
    ("Comparison", "o_totalprice over o_orderdate", "Line", "count(DISTINCT o_orderdate)"),
    ("Comparison", "o_orderkey against o_custkey", "Scatter", "count(o_orderkey + o_custkey)"),
    ("Comparison", "Volume of o_orderkey by o_orderdate", "Area", "count(DISTINCT o_orderdate)"),
    ("Multivariate", "o_orderkey by o_orderstatus and o_orderpriority", "Stacked Bar", "count(DISTINCT o_orderstatus)"),
    ("Multivariate", "o_orderkey over o_orderdate by o_orderstatus", "Line", "count(DISTINCT o_orderdate)"),
    ("Multivariate", "o_orderkey, o_custkey and o_totalprice", "Scatter", "count(o_orderkey + o_custkey + o_totalprice)"),
    ("Multivariate", "Treemap of o_orderkey by o_orderpriority", "Treemap", "count(DISTINCT o_orderpriority)"),
]


@query(
    "auto_charts",
    " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS category, '{t}' AS title, '{k}' AS chart_type, {n} AS points FROM orders" for i, (c, t, k, n) in enumerate(_AUTO)),
)
def auto_charts_orders(t):
    """Charts chosen from the profile, executed with one scan for all aggregates; one row per chart with its number of points."""
    specs = auto_charts([r.asDict() for r in profile(t.orders).orderBy("ordinal").collect()])
    out = None
    for i, (spec, data) in enumerate(zip(specs, fused_charts(t.orders, specs))):
        one = data.agg(F.count("*").alias("points")).select(
            F.lit(i).alias("position"), F.lit(spec.category).alias("category"), F.lit(spec.title).alias("title"),
            F.lit(spec.chart_type).alias("chart_type"), "points",
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dashboard_one_scan",
    """SELECT 'Total' AS card, 'l_quantity' AS label, '' AS part, round(sum(l_quantity), 2) AS value FROM lineitem
    UNION ALL SELECT 'Price by flag', l_returnflag, '', round(avg(l_extendedprice), 2) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'Large by flag', l_returnflag, '', round(sum(l_extendedprice), 2) FROM lineitem WHERE l_quantity >= 49 GROUP BY 2
    UNION ALL SELECT 'Lines by day', CAST(CAST(l_shipdate AS DATE) AS VARCHAR), '', count(*)::DOUBLE FROM lineitem GROUP BY 2
    UNION ALL SELECT 'Tax by flag and status', l_returnflag, l_linestatus, round(max(l_tax), 2) FROM lineitem GROUP BY 2, 3
    UNION ALL SELECT 'Rows', 'Total Records', '', count(*)::DOUBLE FROM lineitem""",
)
def dashboard_one_scan(t):
    """Six cards of a dashboard, filters included, from one scan of the table, in long form."""
    cards = [
        ChartSpec("Metric", y="l_quantity", aggregation="sum", title="Total"),
        ChartSpec("Bar", "l_returnflag", "l_extendedprice", aggregation="avg", title="Price by flag"),
        ChartSpec("Bar", "l_returnflag", "l_extendedprice", aggregation="sum", title="Large by flag",
                  filters=({"column": "l_quantity", "operator": "gte", "value": 49},)),
        ChartSpec("Line", "l_shipdate", "l_shipdate", aggregation="count", title="Lines by day"),
        ChartSpec("Stacked Bar", "l_returnflag", "l_tax", "l_linestatus", aggregation="max", title="Tax by flag and status", long=True),
        ChartSpec("KPI", "l_returnflag", title="Rows"),
    ]
    out = None
    for title, df in fused_dashboard({"lineitem": t.lineitem}, "lineitem", cards).items():
        label = F.col(df.columns[0])
        label = F.date_format(label, "yyyy-MM-dd") if title == "Lines by day" else label.cast("string")
        part = F.col(df.columns[1]) if len(df.columns) == 3 else F.lit("")
        one = df.select(F.lit(title).alias("card"), label.alias("label"), part.alias("part"), F.round(F.col(df.columns[-1]).cast("double"), 2).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
