from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabulon.operators.forecast import forecast, pick_forecaster
from tabulon.operators.series import (
    connected_series, detect_time_series, fill_dates, future_labels, lag_names, momentum_forecast, next_label, series_step,
    ts_features,
)


def series_b(spark, name=None):
    start = datetime(2023, 1, 1)
    data = [(start + timedelta(days=i), 50 + 0.8 * i + 5 * math.sin(i / 3)) for i in range(60)]
    return spark.createDataFrame(data, "timestamp timestamp_ntz, value double")


def test_detection(spark):
    df = spark.createDataFrame([(f"2024-01-{i + 1:02d}", 100.0 + i, "x") for i in range(30)], "order_date string, revenue double, category string")
    found = detect_time_series(df, "category", "category")
    assert (found["date_column"], found["target_column"], found["suitable"]) == ("order_date", "revenue", True)
    money = spark.createDataFrame([("a", "$1,200"), ("b", "₹300"), ("c", "n/a"), ("d", "5")], "k string, amount string")
    assert detect_time_series(money, "k", "amount")["target_column"] == "amount"
    assert not detect_time_series(money.select("k"), "k", None)["suitable"]


@pytest.mark.parametrize("limit", [20, 10_000])
def test_features_match_pandas(spark, limit):
    got = ts_features(series_b(spark), "timestamp", "value", lag_window=7, limit=limit).toPandas().sort_values("pos")
    v = got["value"]
    s = (v - v.min()) / (v.max() - v.min())
    assert np.allclose(got["scaled"], s)
    for i in range(1, 8):
        assert np.allclose(got[f"lag_{i}"].fillna(-9), s.shift(i).fillna(-9))
    assert np.allclose(got["rolling_mean_3"].fillna(-9), s.rolling(3).mean().shift(1).fillna(-9))
    assert np.allclose(got["rolling_std_3"].fillna(-9), s.rolling(3).std().shift(1).fillna(-9))
    assert np.allclose(got["rolling_mean_7"].fillna(-9), s.rolling(7).mean().shift(1).fillna(-9))
    assert np.allclose(got["time_index"], np.arange(60) / 59)
    assert got["split"].value_counts().to_dict() == {"train": 42, "test": 11}


def test_short_series_shrinks_window_and_constant_is_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, i), 5.0) for i in range(1, 10)], "d timestamp_ntz, v double")
    got = ts_features(df, "d", "v", lag_window=7).toPandas()
    assert set(got["lag_used"]) == {3} and set(got["scaled"]) == {0.0} and set(got["lag_5"]) == {0.0}


def test_dates_filled_or_laid_out(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-02"), (3, "x"), (4, "2024-01-04"), (5, "2024-01-05")], "i int, d string")
    got = [r["d"].day for r in rows(fill_dates(df, "d", ["i"]).orderBy("i"))]
    assert got == [2, 2, 2, 4, 5]
    none = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, d string")
    with pytest.raises(ValueError):
        fill_dates(none, "d", ["i"])
    laid = fill_dates(none, "d", ["i"], anchor=datetime(2024, 3, 1))
    assert [str(r["d"])[:10] for r in rows(laid.orderBy("i"))] == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_step(spark):
    data = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 8)), ("a", datetime(2024, 1, 15)), ("b", datetime(2024, 1, 1)),
            ("c", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 1))]
    got = {r["k"]: r["step_seconds"] for r in rows(series_step(spark.createDataFrame(data, "k string, d timestamp_ntz"), "d", ["k"]))}
    assert got == {"a": 7 * 86400.0, "b": 30 * 86400.0, "c": 86400.0}


def test_labels(spark):
    cases = {"August": ["September", "October", "November"], "Dec": ["Jan", "Feb", "Mar"], "2024-11": ["2024-12", "2025-01", "2025-02"],
             "2024-01-31": ["2024-03-01", "2024-03-31", "2024-04-30"], "7": ["8", "9", "10"], "Q4": ["Q4 (+1)", "Q4 (+2)", "Q4 (+3)"]}
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    got = df.select("label", F.array(*[next_label(F.col("label"), F.lit(i)) for i in (1, 2, 3)]).alias("next"))
    assert {r["label"]: r["next"] for r in rows(got)} == cases


def test_momentum(spark):
    values = [10.0, 14.0, 13.0, 19.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    delta, now, expected = (19 - 14) / 3, 19.0, []
    for i in range(4):
        now += delta + math.sin((i + 1) * 0.8) * 19 * 0.02
        expected.append(round(now, 2))
    got = [r["predicted"] for r in rows(momentum_forecast(df, "i", "v", horizon=4).orderBy("step"))]
    assert np.allclose(got, expected)
    one = [r["predicted"] for r in rows(momentum_forecast(df.limit(1), "i", "v", horizon=1))]
    assert one == [round(10 + 0.5 + math.sin(0.8) * 0.2, 2)]
    assert [r["predicted"] for r in rows(momentum_forecast(df.limit(0), "i", "v").orderBy("step"))] == [100.0, 115.0, 130.0]


def test_lines_meet(spark):
    history = spark.createDataFrame([(1, "Jul", 5.0), (2, "Aug", 7.0)], "i int, m string, v double")
    ahead = momentum_forecast(history, "i", "v").join(future_labels(history, "i", "m"), "step")
    got = rows(connected_series(history, ahead, "i", "m", "v").orderBy("step", "position"))
    assert [r["label"] for r in got] == ["Jul", "Aug", "Sep", "Oct", "Nov"]
    assert [r["predicted"] is None for r in got] == [True, False, False, False, False] and got[1]["predicted"] == 7.0


def expected_linear(df: pd.DataFrame, lag: int, horizon: int, alpha: float = 0.0):
    """Plain single-series version of the linear forecast."""
    v = df["value"].to_numpy()
    low, high = v.min(), v.max()
    s = pd.Series((v - low) / (high - low))
    cols = [s.shift(i) for i in range(1, lag + 1)]
    cols += [s.rolling(3).mean().shift(1), s.rolling(3).std().shift(1)]
    d = pd.DatetimeIndex(df["timestamp"])
    cols += [pd.Series(d.month / 12.0), pd.Series(d.dayofweek / 6.0), pd.Series(d.dayofyear / 365.0), pd.Series(np.arange(len(s)) / (len(s) - 1))]
    x = np.column_stack(cols)[lag:]
    y = s.to_numpy()[lag:]
    cut = max(3, int(len(y) * 0.8))
    mx, my = x[:cut].mean(axis=0), y[:cut].mean()
    a, b = x[:cut] - mx, y[:cut] - my
    w = np.linalg.pinv(a.T @ a + alpha * np.eye(a.shape[1]), rcond=1e-10) @ a.T @ b
    recent, out = list(s.to_numpy()[-lag:]), []
    for step in range(1, horizon + 1):
        when = d[-1] + timedelta(days=step)
        last = np.array(recent[-3:])
        f = [recent[-i] for i in range(1, lag + 1)] + [last.mean(), last.std(ddof=1), when.month / 12, when.dayofweek / 6, when.dayofyear / 365, 1 + 0.01 * step]
        p = my + (np.array(f) - mx) @ w
        recent.append(p)
        out.append(p * (high - low) + low)
    return out


@pytest.mark.parametrize("technique,alpha", [("linear_trend", 0.0), ("ridge_trend", 1.0)])
def test_linear_forecast_matches_plain_version(spark, technique, alpha):
    df = series_b(spark)
    got = forecast(df, "timestamp", "value", technique=technique, horizon=4, lag_window=3)
    future = [r["predicted"] for r in rows(got.future.orderBy("step"))]
    assert np.allclose(future, expected_linear(df.toPandas(), 3, 4, alpha), atol=0.02)
    assert [r["date"] for r in rows(got.future.orderBy("step"))] == ["2023-03-02", "2023-03-03", "2023-03-04", "2023-03-05"]
    metrics = got.metrics().first()
    assert metrics["samples"] == 12 and metrics["mape"] is not None
    assert got.actual_vs_predicted().count() == 57


def test_many_series_equal_single_runs(spark):
    df = series_b(spark)
    both = df.withColumn("k", F.lit("a")).unionByName(df.withColumn("value", F.col("value") * 3 + 1).withColumn("k", F.lit("b")))
    got = forecast(both, "timestamp", "value", ["k"], horizon=3, lag_window=3).future
    single = [r["predicted"] for r in rows(forecast(df, "timestamp", "value", horizon=3, lag_window=3).future.orderBy("step"))]
    a = [r["predicted"] for r in rows(got.where("k = 'a'").orderBy("step"))]
    b = [r["predicted"] for r in rows(got.where("k = 'b'").orderBy("step"))]
    assert a == single and np.allclose(b, np.array(a) * 3 + 1, atol=0.05)


@pytest.mark.parametrize("technique", ["gradient_boosting_forecast", "random_forest_forecast", "knn_forecast"])
def test_other_techniques_give_horizon_points(spark, technique):
    got = forecast(series_b(spark), "timestamp", "value", technique=technique, horizon=2, lag_window=3, trees=3)
    out = rows(got.future.orderBy("step"))
    assert [r["step"] for r in out] == [1, 2] and all(40 < r["predicted"] < 120 for r in out)
    assert got.metrics().first()["samples"] == 12


def test_knn_forecast_matches_plain_version(spark):
    df = series_b(spark)
    got = forecast(df, "timestamp", "value", technique="knn_forecast", horizon=1, lag_window=3)
    ready = ts_features(df, "timestamp", "value", lag_window=3).toPandas().sort_values("pos")
    x = ready[lag_names(3)].to_numpy()
    train = ready["split"].to_numpy() == "train"
    test = ready[ready["split"] == "test"].iloc[0]
    d = np.sqrt(((x[train] - test[lag_names(3)].to_numpy(dtype=float)) ** 2).sum(axis=1))
    p = ready["scaled"].to_numpy()[train][np.argsort(d, kind="stable")[:5]].mean()
    expected = p * (test["high"] - test["low"]) + test["low"]
    row = got.fitted.where(F.col("pos") == int(test["pos"])).first()
    assert math.isclose(row["predicted"], expected, rel_tol=1e-9)


def test_technique_by_rows(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 20 + [("c",)] * 19, "k string")
    got = {r["k"]: (r["technique"], r["lag_window"]) for r in rows(pick_forecaster(df, ["k"]))}
    assert got == {"a": ("gradient_boosting_forecast", 7), "b": ("random_forest_forecast", 5), "c": ("linear_trend", 3)}


def test_every_series_is_routed_and_forecast(spark):
    """Series of 1 to 60 days: each has a route, a status and all its future steps."""
    from datetime import date, timedelta

    from tabulon.operators.forecast import forecast_auto, route_series

    sizes = {"a": 1, "b": 3, "c": 6, "d": 8, "e": 12, "f": 25, "g": 35, "h": 60}
    data = [(k, date(2024, 1, 1) + timedelta(days=i), float(10 + i + i % 3)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "k string, d date, v double")
    routes = {r["k"]: (r["technique"], r["status"]) for r in rows(route_series(df, ["k"]))}
    assert routes == {
        "a": ("momentum", "too_few_rows"), "b": ("momentum", "too_few_rows"), "c": ("momentum", "too_few_rows"), "d": ("moving_average", "stepped_down"),
        "e": ("linear_trend", "fitted"), "f": ("ridge_trend", "stepped_down"), "g": ("random_forest_forecast", "fitted"),
        "h": ("gradient_boosting_forecast", "fitted")}
    future, told = forecast_auto(df, "d", "v", ["k"], 3, trees=3)
    got = rows(future)
    assert {(r["k"], r["step"]) for r in got} == {(k, s) for k in sizes for s in (1, 2, 3)} and all(r["predicted"] is not None for r in got)
    assert {r["k"]: r["date"] for r in got if r["step"] == 1}["e"] == "2024-01-13"
    assert told.count() == 8
    plain, _ = forecast_auto(df.where("k = 'e'").drop("k"), "d", "v", horizon=2)
    assert plain.columns[0] == "step" and plain.count() == 2
    status = {r["k"]: r["status"] for r in rows(forecast(df, "d", "v", ["k"], "ridge_trend", 2, 3).status)}
    assert status["a"] == "too_few_rows" and status["e"] == "below_minimum" and status["h"] == "fitted" and len(status) == 8
    assert forecast_auto(df.limit(0), "d", "v", ["k"])[0].count() == 0
