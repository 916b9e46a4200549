from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabulon.operators.charts import ChartSpec, auto_charts, chart, dashboard, grouped_pivot, infer_chart, normalise
from tabulon.operators.fusion import fused_charts, fused_dashboard
from tabulon.operators.insight import insight_numbers, key_metrics
from tabulon.operators.profile import profile
from tabulon.operators.catalog import fanout, join_key_candidates, related_tables, relationships
from tabulon.operators.series import momentum_forecast
from tabulon.sources.sqlguard import SCREEN_LIMIT, QueryRefused, check, safe_sql
from tabulon.sources.workspace import Workspace, clean_sheet_name


def sales(spark):
    data = [("North", 100, "A"), ("South", 250, "B"), ("North", 200, "A"), ("South", 150, "A"), ("East", 300, "B")]
    return spark.createDataFrame(data, "region string, sales long, category string")


def test_sum_by_region(spark):
    out = chart(sales(spark), ChartSpec("Bar", "region", "sales", aggregation="sum"))
    assert [(r["region"], r["sales"]) for r in rows(out)] == [("South", 400.0), ("East", 300.0), ("North", 300.0)]


def test_grouped_average_is_an_average(spark):
    out = chart(sales(spark), ChartSpec("Stacked Bar", "region", "sales", "category", aggregation="avg"))
    assert {r["region"]: (r["A"], r["B"]) for r in rows(out)} == {"East": (0.0, 300.0), "North": (150.0, 0.0), "South": (150.0, 250.0)}


def test_pivot_total_equals_long_total(spark):
    wide = grouped_pivot(sales(spark), "region", "category", "sales", "sum", ["A", "B"])
    assert sum(r["A"] + r["B"] for r in rows(wide)) == 1000.0


def test_dispatch(spark):
    df = sales(spark)
    assert chart(df, ChartSpec("Pie", "region")).first().asDict() == {"region": "North", "count": 2}
    assert chart(df, ChartSpec("KPI", y="region")).first().asDict() == {"metric": "Total Records", "value": 5.0}
    assert chart(df, ChartSpec("Line", "sales", "sales", aggregation="max")).first()["value"] == 300.0
    assert chart(df, ChartSpec("Line", "region", "sales")).count() == 5
    assert chart(df, ChartSpec("Bar")).columns == ["region", "sales"]
    assert normalise(ChartSpec("Sunburst", aggregation="mode", sql="DROP TABLE x")) == ChartSpec("Bar", aggregation="none", sql=None)


def test_empty_metric(spark):
    df = sales(spark).where("sales < 0")
    assert chart(df, ChartSpec("Metric", y="sales", aggregation="sum")).first()["value"] == 0.0


def test_insight_numbers(spark):
    df = spark.createDataFrame([("Jan", 12000), ("Feb", 15000), ("Mar", 22000), ("Apr", 18000)], "month string, revenue long")
    r = insight_numbers(df, "month", "revenue").first()
    assert (r["top_label"], r["top_value"], r["bottom_label"], r["total"], r["top3_total"]) == ("Mar", 22000.0, "Jan", 67000.0, 55000.0)


def test_key_metrics_ignore_words(spark):
    got = {r["column"]: r["total"] for r in rows(key_metrics(sales(spark)))}
    assert got == {"sales": 1000.0}


def test_auto_charts_run(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    specs = auto_charts([r.asDict() for r in profile(orders).collect()])
    assert len(specs) >= 6 and len({s.category for s in specs}) == 3
    assert all(df.count() > 0 for df in dashboard({"orders": orders}, "orders", specs).values())


def test_infer_chart(spark):
    assert infer_chart(sales(spark).select("region", "sales"))["chart_type"] == "Bar"
    assert infer_chart(spark.sql("SELECT 1.5 AS total"))["chart_type"] == "Metric"
    assert infer_chart(spark.sql("SELECT 'Jan' AS month, 2 AS n"))["chart_type"] == "Line"


REFUSED = [
    "DELETE FROM dataset", "DROP TABLE dataset", "UPDATE dataset SET x = 1", "INSERT INTO dataset VALUES (1)", "SHOW TABLES", "", "   ",
    "SELECT 1; DROP TABLE dataset", "CREATE TABLE t AS SELECT 1", "SELECT reflect('java.lang.System', 'exit', 0)",
    "FROM dataset INSERT INTO x SELECT *", "SELECT TRANSFORM(region) USING 'cat' FROM dataset", "EXPLAIN SELECT 1", "SET x = 1",
]
ALLOWED = [
    "SELECT region FROM dataset", "WITH t AS (SELECT region FROM data) SELECT * FROM t", "SELECT replace(region, 'N', 'x') FROM df",
    "SELECT sales AS update FROM dataset", "(SELECT 1) UNION (SELECT 2)", "SELECT * FROM dataset WHERE sales > (SELECT avg(sales) FROM sales_data)",
]


def test_guard(spark):
    ws = Workspace(spark, {"Sales Data": sales(spark)})
    for sql in REFUSED:
        assert not check(spark, sql, ws.views).ok, sql
    for sql in ALLOWED:
        assert check(spark, sql, ws.views).ok, (sql, check(spark, sql, ws.views))
    for sql in ("SELECT * FROM secrets", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
                "SELECT (SELECT max(x) FROM secrets) FROM dataset", "WITH t AS (SELECT * FROM secrets) SELECT * FROM t"):
        assert not check(spark, sql, ws.views).ok, sql
    with pytest.raises(QueryRefused):
        ws.sql("SELECT sales_data.nothing FROM sales_data")


def test_limit_and_reroute(spark):
    users = spark.createDataFrame([(i, f"u{i}") for i in range(150)], "user_id int, name string")
    ws = Workspace(spark, {"tx": spark.createDataFrame([(1, 2.0)], "user_id int, amount double"), "Users": users})
    assert ws.sql("SELECT * FROM users").count() == 150
    assert ws.sql("SELECT * FROM users", SCREEN_LIMIT).count() == 100
    assert ws.sql("SELECT * FROM users LIMIT 120", SCREEN_LIMIT).count() == 120
    assert ws.sql("SELECT name FROM dataset", None).count() == 150
    assert safe_sql(spark, "SELECT 1 AS one").first()["one"] == 1


def test_workspace_join_and_switch(spark):
    users = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "Dan")], "user_id int, name string")
    tx = spark.createDataFrame([(1, 1, 150.0), (2, 1, 145.0), (3, 2, 430.5), (4, 3, 500.0), (5, 3, 390.0)], "tx_id int, user_id int, amount double")
    ws = Workspace(spark, {"Users": users, "Transactions": tx})
    got = {r[0]: r[1] for r in ws.sql("SELECT u.name, SUM(t.amount) s FROM users u JOIN transactions t ON u.user_id = t.user_id GROUP BY u.name").collect()}
    assert got == {"Alice": 295.0, "Bob": 430.5, "Charlie": 890.0}
    assert ws.sql("SELECT * FROM dataset").columns == ["user_id", "name"]
    ws.switch("Transactions")
    assert "amount" in ws.sql("SELECT * FROM df").columns
    assert ws.chart(ChartSpec("Bar", "name", "name", aggregation="count")).count() == 4
    with pytest.raises(KeyError):
        ws.switch("nothing")


def test_sheet_names():
    assert clean_sheet_name("a/b:c") == "a_b_c"
    assert clean_sheet_name("Data", ["data", "DATA_2"]) == "Data_3"
    assert len(clean_sheet_name("x" * 40)) == 31


def test_catalog(spark):
    edges = relationships(spark, [("b", "a_id", "a", "id"), ("c", "b_id", "b", "id"), ("d", "c_id", "c", "id")])
    assert {r["table_name"]: r["hops"] for r in rows(related_tables(edges, ["a"]))} == {"a": 0, "b": 1, "c": 2}
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (1,), (3,)], "k int")
    r = fanout(left, right, "k").first()
    assert (r["many_to_many_keys"], r["joined_rows"]) == (1, 6) and r["joined_rows"] == left.join(right, "k").count()
    found = {r["column"] for r in rows(join_key_candidates({"l": left, "r": right}))}
    assert found == {"k"}


def test_charts_show_all_points_unless_asked(spark):
    """No shape is cut or changes its form with the number of rows; limits come from the spec or the screen."""
    df = spark.range(1200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.col("id").alias("h"), (F.col("id") * 1.0).alias("v"), F.col("id").cast("string").alias("s"))
    for spec, shown in ((ChartSpec("Line", "k", "v", aggregation="sum"), 50), (ChartSpec("Donut", "s"), 30), (ChartSpec("Bar", "s", "s", aggregation="count"), 50),
                        (ChartSpec("Scatter", "k", "v"), 1000), (ChartSpec("Line", "k", "s"), 50), (ChartSpec("Bar"), 30),
                        (ChartSpec("Bar", "k", "v", "g", aggregation="sum"), 50)):
        assert chart(df, spec).count() == 1200
        assert chart(df, spec, screen=True).count() == shown
        assert chart(df, replace(spec, limit=7)).count() == 7 == chart(df, replace(spec, limit=7), screen=True).count()
    wide = ChartSpec("Stacked Bar", "g", "v", "h", aggregation="sum")
    with pytest.raises(ValueError, match="long form"):
        chart(df, wide)
    assert chart(df, replace(wide, long=True)).count() == 1200
    assert momentum_forecast(df, "k", "v", horizon=30).count() == 30 and momentum_forecast(df, "k", "v", horizon=30, most=24).count() == 24


def test_cte_names_hold_in_their_scope_only(spark):
    spark.range(3).createOrReplaceTempView("hidden_view")
    spark.range(3).createOrReplaceTempView("orders_view")
    allowed = ["orders_view"]
    fine = (
        "WITH a AS (SELECT id FROM orders_view), b AS (SELECT id FROM a) SELECT * FROM b",
        "SELECT * FROM (WITH hidden_view AS (SELECT 1 AS id) SELECT * FROM hidden_view)",
        "WITH hidden_view AS (SELECT id FROM orders_view) SELECT * FROM orders_view WHERE id IN (SELECT id FROM hidden_view)",
        "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
        "WITH x AS (WITH y AS (SELECT id FROM orders_view) SELECT * FROM y) SELECT * FROM x",
    )
    for sql in fine:
        assert check(spark, sql, allowed).ok, sql
        safe_sql(spark, sql, {"orders_view": spark.table("orders_view")}).count()
    for sql in (
        "WITH x AS (WITH hidden_view AS (SELECT 1 AS id) SELECT * FROM hidden_view) SELECT * FROM hidden_view",
        "SELECT (WITH hidden_view AS (SELECT 1 AS id) SELECT max(id) FROM hidden_view) AS m, id FROM hidden_view",
        "WITH b AS (SELECT * FROM hidden_view), hidden_view AS (SELECT 1 AS id) SELECT * FROM b",
        "WITH hidden_view AS (SELECT * FROM hidden_view) SELECT * FROM hidden_view",
        "SELECT * FROM orders_view WHERE id IN (SELECT id FROM hidden_view)",
        "SELECT 'x AS (SELECT 1)' AS t, hidden_view.id FROM hidden_view",
        "SELECT * FROM parquet.`/tmp/x`",
    ):
        assert not check(spark, sql, allowed).ok, sql


def test_fused_cards_equal_single_charts(spark):
    """Every kind of card from one scan, filters and screen caps included, like the charts one by one; an empty table too."""
    data = [(f"k{i % 9}" if i % 11 else None, "ab"[i % 2] if i % 7 else None, float(i % 13), i % 60) for i in range(300)]
    df = spark.createDataFrame(data, "k string, g string, v double, n int")
    some = ({"column": "n", "operator": "gte", "value": 30},)
    specs = [
        ChartSpec("Metric", y="v", aggregation="avg"), ChartSpec("Metric", y="v", aggregation="sum", filters=some), ChartSpec("KPI", "k"), ChartSpec("KPI", y="n"),
        ChartSpec("Bar", "k", "v", aggregation="sum"), ChartSpec("Bar", "k", "v", aggregation="sum", filters=some), ChartSpec("Pie", "n"),
        ChartSpec("Bar", "k", "k"), ChartSpec("Line", "n", "n", aggregation="max"), ChartSpec("Line", "n", "v", aggregation="mean", limit=5),
        ChartSpec("Bar", "n", "k", aggregation="count"), ChartSpec("Stacked Bar", "k", "v", "g", aggregation="min"), ChartSpec("Stacked Bar", "n", None, "g", filters=some),
        ChartSpec("Area", "k", "v", "g", aggregation="sum", long=True), ChartSpec("Area", "k", "v", aggregation="median"), ChartSpec("Scatter", "n", "v"),
        ChartSpec("Line", "k", "g"), ChartSpec("Bar", "k", "v", aggregation="count"),
    ]

    def content(frame):
        return frame.columns, sorted((tuple(r) for r in frame.collect()), key=str)

    for screen in (False, True):
        for spec, fused in zip(specs, fused_charts(df, specs, screen)):
            assert content(fused) == content(chart(df, spec, screen=screen)), spec
    for spec, fused in zip(specs[:6], fused_charts(df.limit(0), specs[:6])):
        assert content(fused) == content(chart(df.limit(0), spec)), spec
    cards = fused_dashboard({"a": df, "b": df.withColumnRenamed("k", "other")}, "a", [ChartSpec("Bar", "other", "v", aggregation="sum", title="B"), ChartSpec("Pie", "k", title="A")])
    assert list(cards) == ["B", "A"] and cards["B"].columns == ["other", "v"]
