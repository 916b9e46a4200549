"""Edits of steps and switches of tables compute again only what depends on them, and the result is that of a full run."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabulon.operators.derive import derive
from tabulon.operators.lineage import StepGraph, stale_columns
from tabulon.operators.profile import profile
from tabulon.operators.steps import Step, removed_rows, replay
from tabulon.sources.workspace import Workspace


def sales(spark, n=120):
    df = spark.range(n).select(
        F.col("id").alias("n"), (F.col("id") * 1.5).alias("price"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("shop "), F.col("id") % 5)).alias("shop"),
        F.expr("date_add(DATE'2024-01-01', cast(id as int))").alias("day"), F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("units"))
    return df


def full(df):
    return {r["column"]: r for r in rows(profile(df))}


FILL = Step("fill_missing", {"column": "units", "method": "constant", "value": 0})
TWICE = Step("add_column", {"new_column": "total", "formula": "price * units"})
CHEAP = Step("filter_rows", {"query": "price < 100"})


@pytest.mark.parametrize("old,new,stale", [
    ([], [FILL], {"units"}),
    ([FILL, TWICE], [Step("fill_missing", {"column": "units", "method": "constant", "value": 1}), TWICE], {"units", "total"}),
    ([FILL, TWICE], [FILL, Step("add_column", {"new_column": "total", "formula": "price + 1"})], {"total"}),
    ([FILL, CHEAP], [FILL], None),
    ([FILL, Step("filter_rows", {"query": "units > 1"})], [Step("filter_rows", {"query": "units > 1"})], None),
    ([TWICE], [Step("rename_column", {"old_name": "shop", "new_name": "store"}), TWICE], {"shop", "store"}),
    ([CHEAP], [CHEAP, Step("drop_column", {"columns": ["shop"]})], {"shop"}),
])
def test_stale_columns(old, new, stale):
    assert stale_columns(old, new, ["n", "price", "shop", "day", "units", "total", "store"]) == stale


def test_edited_steps_profile_only_what_changed(spark):
    raw = sales(spark)
    graph = StepGraph(raw)
    assert graph.profiled == raw.columns
    for steps, computed in (
        ([FILL], ["units"]), ([FILL, TWICE], ["total"]), ([Step("fill_missing", {"column": "units", "method": "constant", "value": 5}), TWICE], ["units", "total"]),
        ([FILL, TWICE, CHEAP], ["n", "price", "shop", "day", "units", "total"]), ([FILL, TWICE, CHEAP, Step("drop_column", {"columns": ["shop"]})], []),
        ([], raw.columns),
    ):
        graph.edit(steps)
        assert graph.profiled == computed
        now = replay(raw, steps)
        assert {r["column"]: r for r in rows(graph.profile())} == full(now)
        wide, log = derive(now)
        assert sorted(graph.wide().columns) == sorted(wide.columns)
        assert sorted(map(str, graph.derived())) == sorted(map(str, log))
        names = sorted(wide.columns)
        assert sorted(map(str, graph.wide().select(*names).collect())) == sorted(map(str, wide.select(*names).collect()))


def test_switching_keeps_what_is_known(spark):
    ws = Workspace(spark, {"Sales": sales(spark), "Shops": spark.createDataFrame([("shop 1", 10), ("shop 2", 12)], "shop string, size int")})
    first = ws.graph()
    ws.switch("Shops")
    assert ws.graph().profiled == ["shop", "size"]
    ws.switch("Sales")
    assert ws.graph() is first
    ws.edit([CHEAP])
    assert ws.sql("SELECT count(*) AS n FROM dataset").first()["n"] == 67
    assert removed_rows(sales(spark), Step("drop_na_rows", {"columns": ["shop"]})) == 30
