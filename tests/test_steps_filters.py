from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabulon.operators.predicates import apply_filters, global_filters, grid_search, period_bounds, relative_period
from tabulon.operators.steps import History, Step, StepError, apply_step, formatting_report, formula, replay


def orders(spark):
    data = [(10.0, 2, "A"), (20.0, 3, "B"), (30.0, 1, "A"), (None, 4, "C"), (50.0, 2, "B")]
    return spark.createDataFrame(data, "price double, quantity int, category string")


def test_fill_mean_then_formula(spark):
    out = replay(
        orders(spark),
        [Step("fill_missing", {"column": "price", "strategy": "mean"}), Step("add_column", {"new_column": "total", "formula": "price * quantity"})],
    )
    assert sorted(r["total"] for r in rows(out)) == [20.0, 30.0, 60.0, 100.0, 110.0]


def test_rename_drop_replace_cast(spark):
    df = apply_step(orders(spark), Step("rename_column", {"old_name": "category", "new_name": "group"}))
    df = apply_step(df, Step("replace_values", {"column": "group", "to_replace": "A", "value": "Alpha"}))
    df = apply_step(df, Step("cast_type", {"column": "price", "target_type": "integer"}))
    assert dict(df.dtypes)["price"] == "bigint"
    assert sorted((r["price"], r["group"]) for r in rows(df)) == [(0, "C"), (10, "Alpha"), (20, "B"), (30, "Alpha"), (50, "B")]
    assert apply_step(df, Step("drop_column", {"columns": ["group", "nothing"]})).columns == ["price", "quantity"]
    for bad in (Step("drop_column", {"columns": ["x"]}), Step("rename_column", {"old_name": "x", "new_name": "y"}),
                Step("add_column", {"new_column": "x"}), Step("drop_na_rows", {"columns": ["x"]}), Step("strange", {})):
        with pytest.raises(StepError):
            apply_step(df, bad)


def test_formula_operators(spark):
    df = spark.createDataFrame([(7, 2, "a&b"), (1, 0, "x==y")], "`my col` int, b int, s string")
    got = df.select(
        formula("`my col` ** 2").alias("sq"), formula("`my col` / b").alias("q"), formula("`my col` // b").alias("fl"),
        formula("s == 'a&b' & b > 1").alias("t"), formula("s == 'x==y' | b > 5").alias("u"),
    ).collect()
    assert [tuple(r) for r in got] == [(49.0, 3.5, 3, True, False), (1.0, None, None, False, True)]


def test_duplicates_keep_first_by_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "z"), (1, 2, "b")], "k int, o int, s string")
    out = apply_step(df, Step("drop_duplicates", {"columns": ["k"], "order": ["o"]}))
    assert sorted((r["k"], r["s"]) for r in rows(out)) == [(1, "a"), (2, "z")]


def test_casts(spark):
    df = spark.createDataFrame([("1.9", "2024-02-03", ""), ("-1.9", "no", "x"), ("abc", "3/15/2024", None)], "n string, d string, t string")
    out = replay(df, [Step("cast_type", {"column": "n", "target_type": "integer"}), Step("cast_type", {"column": "d", "target_type": "datetime"}),
                      Step("cast_type", {"column": "t", "target_type": "boolean"})])
    assert [tuple(r) for r in out.collect()] == [
        (1, datetime(2024, 2, 3), False), (-1, None, True), (0, datetime(2024, 3, 15), True)
    ]


def test_history_versions(spark):
    h = History(orders(spark))
    h.apply(Step("drop_na_rows", {}))
    h.apply(Step("filter_rows", {"query": "price > 15 & quantity >= 2"}))
    assert h.current.count() == 2 and h.version(1).count() == 4
    h.apply(Step("reset_raw"))
    assert h.current.count() == 5 and replay(h.raw, h.steps).count() == 5


def test_fix_formatting(spark):
    df = spark.createDataFrame([(1, "Bob\t"), (2, "Charlie\r\n"), (3, "No rth​"), (4, "fine")], "id int, customer string")
    report = {r["column"]: r["cells_cleaned"] for r in rows(formatting_report(df))}
    assert report == {"customer": 3, "total": 3}
    assert [r["customer"] for r in rows(apply_step(df, Step("fix_formatting")).orderBy("id"))] == ["Bob", "Charlie", "No rth", "fine"]


def test_filters_and_skips(spark):
    notes = []
    df = spark.createDataFrame([("F", 1.0), ("o", 2.0), (None, 3.0)], "s string, v double")
    assert apply_filters(df, [{"column": "s", "operator": "neq", "value": "f"}]).count() == 2
    assert apply_filters(df, [{"column": "v", "operator": "eq", "value": "2"}]).count() == 1
    same = apply_filters(df, [{"column": "x", "operator": "eq", "value": 1}, {"column": "s", "value": ""},
                              {"column": "v", "operator": "gt", "value": "abc"}, {"column": "s", "operator": "contains", "value": "("}], notes)
    assert same.count() == 3 and len(notes) == 4


def test_periods(spark):
    end = datetime(2024, 3, 15, 10)
    assert period_bounds(end, "last month") == (datetime(2024, 2, 1), datetime(2024, 3, 1))
    assert period_bounds(end, "last year") == (datetime(2023, 1, 1), datetime(2024, 1, 1))
    df = spark.createDataFrame([(datetime(2024, 1, 31),), (datetime(2024, 2, 1),), (datetime(2024, 3, 1),)], "d timestamp_ntz")
    assert relative_period(df, "d", "last month").count() == 1


def test_relative_period_reaches_the_scan(spark, small):
    out = relative_period(spark.read.parquet(f"{small}/orders.parquet"), "o_orderdate", "last month")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan


def test_global_filters_leave_other_tables(spark):
    a = spark.createDataFrame([("East", datetime(2024, 1, 5)), ("West", datetime(2024, 2, 5))], "region string, d timestamp_ntz")
    b = spark.createDataFrame([(1,)], "x int")
    out = global_filters({"a": a, "b": b}, {"region": "east", "date_end": "2024-01-05", "segment": None}, {"region": ["region"], "date_end": ["d"]})
    assert out["a"].count() == 1 and out["b"].count() == 1


def test_grid_search(spark):
    df = spark.createDataFrame([(1, "Alpha"), (12, "beta"), (3, None)], "id int, s string")
    assert [r["id"] for r in rows(grid_search(df, "1", sort="id", ascending=False))] == [12, 1]
    assert grid_search(df, "", {"s": "ALP"}).count() == 1
    assert df.where(F.col("s").isNull()).count() == 1
