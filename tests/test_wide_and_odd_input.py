from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tabulon.functions.columns import day_text, format_inr
from tabulon.operators.anomaly import isolation_scores
from tabulon.operators.catalog import rank_join_keys
from tabulon.operators.metrics import cluster_profile
from tabulon.operators.profile import profile
from tabulon.operators.steps import formatting_report, formula
from tabulon.sources.readers import read_csv


def test_header_longer_than_the_first_read(spark, tmp_path):
    names = [f"a_rather_long_column_name_{i}" for i in range(300)]
    path = tmp_path / "wide.csv"
    path.write_text("\n".join([",".join(names)] + [",".join(str(i + r) for i in range(300)) for r in range(5)]) + "\n")
    df = read_csv(spark, str(path))
    assert df.columns == names and df.count() == 5


def test_powers_bind_from_the_right(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert df.select(formula("a ** b ** 2")).first()[0] == 512.0
    assert df.select(formula("(a + 1) ** b")).first()[0] == 27.0


def test_report_without_text_columns(spark):
    assert [tuple(r) for r in formatting_report(spark.range(3)).collect()] == [("total", 0)]


def test_profile_with_infinity(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(math.inf,), (-math.inf,), (math.nan,)], "v double")
    found = profile(df).first().asDict()
    assert found["min"] == 0.0 and found["max"] == 8.0 and found["median"] == 4.0


def test_cluster_profile_keeps_all_columns(spark):
    df = spark.range(6).selectExpr("id % 2 as c", *[f"id + {i} as v{i}" for i in range(12)])
    assert cluster_profile(df, "c", [f"v{i}" for i in range(12)]).select("column").distinct().count() == 12


def test_rupees_round_like_the_stored_number(spark):
    values = [1e5 * (2 * i + 1) / 2 + 1e7 for i in range(200)] + [45_000_000_000.0, 123_456_780_000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", format_inr(F.col("v"), "n"), format_inr(F.col("v"), "n", "chart")).collect()
    assert [r[1] for r in got] == [f"{r[0] / 1e7:.2f} Cr" for r in got]
    assert [r[2] for r in got][-2:] == ["4500 Cr", "12345.68 Cr"]


def test_days_before_the_first_year(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-12-31', timestamp_ntz'0001-09-08')) AS d").select(
        F.explode(F.array("d", F.col("d") - F.expr("make_dt_interval(900000)"))).alias("d"))
    assert [r[0] for r in df.select(day_text(F.col("d"))).collect()] == ["2024-12-31", "-440-11-19", "0001-09-08", "-2463-07-28"]


def test_small_keys_of_a_large_column(spark):
    large = spark.range(200_000).select(F.col("id").alias("big"))
    small = spark.range(25).select(F.col("id").alias("few"), (F.col("id") - 9).alias("off"))
    got = {(r["left_key"], r["right_key"]): r["containment"] for r in rank_join_keys({"a": large, "b": small}, 0.7).collect()}
    assert got == {("a.big", "b.few"): 1.0}


def test_isolation_scores_walk_every_tree(spark):
    nodes = (np.array([0, 1, -1, -1, -1]), np.array([2.0, 5.0, 0, 0, 0]), np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]),
             np.array([0, 1, 2.5, 3.0, 1.0]))
    df = spark.createDataFrame([([1.0, 4.0],), ([2.0, 6.0],), ([3.0, 0.0],), ([math.nan, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(isolation_scores([nodes], 2.0)(F.col("v"))).collect()]
    assert np.allclose(got, [2 ** -1.25, 2 ** -1.5, 2 ** -0.5, 2 ** -0.5])
