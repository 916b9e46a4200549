"""The split paths for large groups must agree with the simple ones."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators.ordering import blocks, Blocks, carry_forward, running_total, with_position
from tabulon.operators.quantiles import column_quantiles, group_quantiles


def skewed(spark, n=900):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(60), rng.random()) for _ in range(n)]
    data += [("hot", 5, 0.5)] * 200  # copies of one row
    data += [(None, 1, 0.25), (None, 2, 0.75)]
    return spark.createDataFrame(data, "k string, t int, v double")


@pytest.mark.parametrize("limit", [50, 10_000])
def test_positions_are_a_permutation_in_order(spark, limit):
    got = with_position(skewed(spark), ["k"], ["t"], limit=limit).toPandas()
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values("pos")
        assert part["pos"].tolist() == list(range(len(part)))
        assert part["t"].is_monotonic_increasing


def test_positions_without_keys(spark):
    got = with_position(skewed(spark), [], ["t", "v"], limit=100).toPandas().sort_values("pos")
    assert got["pos"].tolist() == list(range(len(got)))
    assert got["t"].is_monotonic_increasing


def test_blocks_see_rows_of_the_block_before(spark):
    df = skewed(spark).select("k", "t", "v").where(F.col("k").isNotNull()).distinct()
    cut = blocks(df, ["k"], ["t", "v"], 3, 40)
    assert cut.split
    got = Blocks.done(cut.df.withColumn("lag3", F.lag("v", 3).over(cut.window()))).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values("pos")
        expected = part["v"].shift(3)
        assert np.allclose(part["lag3"].fillna(-1), expected.fillna(-1))


@pytest.mark.parametrize("limit", [7, 1000])
def test_carry_forward(spark, limit):
    data = [("a", i, float(i) if i % 11 == 5 else None) for i in range(60)] + [("b", i, None) for i in range(9)]
    got = carry_forward(spark.createDataFrame(data, "k string, t int, v double"), ["k"], ["t"], "v", limit).toPandas()
    a = got[got["k"] == "a"].sort_values("t")["v"].tolist()
    expected = pd.Series([float(i) if i % 11 == 5 else None for i in range(60)]).ffill().bfill().tolist()
    assert a == expected
    assert got[got["k"] == "b"]["v"].isna().all()


@pytest.mark.parametrize("limit", [13, 1000])
def test_running_total(spark, limit):
    df = spark.range(100).select(F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    got = running_total(df, ["t"], "v", "before", limit).toPandas().sort_values("t")
    assert got["before"].tolist() == got["v"].cumsum().shift(fill_value=0).tolist()


@pytest.mark.parametrize("limit", [40, 10_000])
def test_column_quantiles_match_numpy(spark, limit):
    df = skewed(spark)
    values = df.toPandas()
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = column_quantiles(df, {"t": F.col("t"), "v": F.col("v"), "none": F.lit(None).cast("double")}, probs, limit)
    assert np.allclose(got["t"], np.quantile(values["t"], probs))
    assert np.allclose(got["v"], np.quantile(values["v"], probs))
    assert got["none"] == [None] * len(probs)


@pytest.mark.parametrize("limit", [60, 10_000])
def test_group_quantiles_match_numpy(spark, limit):
    df = skewed(spark)
    got = {r["k"]: r["quantiles"] for r in group_quantiles(df, ["k"], F.col("v"), [0.25, 0.5, 0.9], limit=limit).collect()}
    for k, part in df.toPandas().groupby("k", dropna=False):
        k = None if k is None or k != k else k
        assert np.allclose(got[k], np.quantile(part["v"], [0.25, 0.5, 0.9]))


def test_group_quantiles_of_large_groups_sort_no_rows(spark, monkeypatch):
    from tabulon.operators import quantiles

    monkeypatch.setattr(quantiles, "with_position", lambda *a: pytest.fail("sorted"), raising=False)
    df = spark.range(9000).selectExpr(
        "if(id < 200, null, id % 3) as g", "cast(if(id % 7 = 0, 5, pmod(xxhash64(id), 4000)) as double) / 7 as v")
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    got = group_quantiles(df, ["g"], F.col("v"), probs, "q", 1000).collect()
    assert {r["g"]: r["q"] for r in got} == want and len(got) == 4
    # brackets without room miss ranks and are widened
    sizes = df.groupBy("g").agg(F.count("v").alias("__n"))
    wider = quantiles._bracketed(df.withColumnRenamed("v", "__v"), sizes, ["g"], probs, "q", 0.0)
    assert {r["g"]: r["q"] for r in wider.collect()} == want
