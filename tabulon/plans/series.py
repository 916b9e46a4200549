"""Queries over time series features and simple extrapolation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.columns import day_text
from ..operators.series import (
    connected_series, detect_time_series, fill_dates, future_labels, lag_names, momentum_forecast, prepare, series_step,
    target_summary, ts_features,
)
from .registry import query

# Sum of value per day and event type: what the feature queries start from.
DAILY = """(SELECT event_type, d, v, n, lo, hi, pos, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS s FROM (
  SELECT *, count(*) OVER (PARTITION BY event_type) n, min(v) OVER (PARTITION BY event_type) lo,
         max(v) OVER (PARTITION BY event_type) hi, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS pos
  FROM (SELECT event_type, CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY ALL)))"""
OVER = "OVER (PARTITION BY event_type ORDER BY d)"
PAST3 = "OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
PAST7 = "OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


def _daily(t):
    return t.events.select(F.to_date("ts").alias("day"), "event_type", "value")


def _features(t):
    out = ts_features(_daily(t), "day", "value", ["event_type"], 7, "sum")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "lags_daily",
    f"SELECT event_type, strftime(d, '%Y-%m-%d') AS day, "
    + ", ".join(f"round(lag(s, {i}) {OVER}, 8) AS lag_{i}" for i in range(1, 8))
    + f" FROM {DAILY}",
)
def lags_daily(t):
    return _features(t).select("event_type", "day", *[F.round(f"lag_{i}", 8).alias(f"lag_{i}") for i in range(1, 8)])


@query(
    "lags_raw_events",
    """SELECT event_id, event_type, round(lag((value - lo) / (hi - lo), 1) OVER w, 8) AS lag_1,
      round(lag((value - lo) / (hi - lo), 3) OVER w, 8) AS lag_3, round(pos / (n - 1), 8) AS time_index FROM (
        SELECT *, min(value) OVER (PARTITION BY event_type) lo, max(value) OVER (PARTITION BY event_type) hi,
          count(*) OVER (PARTITION BY event_type) n,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS pos FROM events)
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)""",
)
def lags_raw_events(t):
    """Every event is a point of its series: the block path, with a small block to exercise it."""
    out = ts_features(t.events, "ts", "value", ["event_type"], 3, None, limit=1000)
    keyed = out.join(
        t.events.select("event_id", F.col("ts").alias("ts2"), F.col("value").alias("v2"), F.col("event_type").alias("e2")),
        (F.col("ts") == F.col("ts2")) & (F.col("value") == F.col("v2")) & (F.col("event_type") == F.col("e2")),
    )
    return keyed.select(
        "event_id", "event_type", *[F.round(c, 8).alias(c) for c in ("lag_1", "lag_3", "time_index")]
    )


@query(
    "rolling_daily",
    f"""SELECT event_type, strftime(d, '%Y-%m-%d') AS day,
      CASE WHEN pos >= 3 THEN round(avg(s) {PAST3}, 8) END AS rolling_mean_3,
      CASE WHEN pos >= 3 THEN round(stddev_samp(s) {PAST3}, 8) END AS rolling_std_3,
      CASE WHEN pos >= 7 THEN round(avg(s) {PAST7}, 8) END AS rolling_mean_7 FROM {DAILY}""",
)
def rolling_daily(t):
    names = ("rolling_mean_3", "rolling_std_3", "rolling_mean_7")
    return _features(t).select("event_type", "day", *[F.round(c, 8).alias(c) for c in names])


@query(
    "time_features",
    f"""SELECT event_type, strftime(d, '%Y-%m-%d') AS day, round(month(d) / 12, 8) AS month_part,
      round((isodow(d) - 1) / 6, 8) AS weekday_part, round(dayofyear(d) / 365, 8) AS yearday_part,
      round(pos / (n - 1), 8) AS time_index FROM {DAILY}""",
)
def time_features(t):
    names = ("month_part", "weekday_part", "yearday_part", "time_index")
    return _features(t).select("event_type", "day", *[F.round(c, 8).alias(c) for c in names])


@query(
    "minmax_series",
    f"SELECT event_type, strftime(d, '%Y-%m-%d') AS day, round(v, 4) AS value, round(s, 8) AS scaled, "
    f"round(s * (hi - lo) + lo, 4) AS restored FROM {DAILY}",
)
def minmax_series(t):
    return _features(t).select(
        "event_type", "day", F.round("value", 4).alias("value"), F.round("scaled", 8).alias("scaled"),
        F.round(F.col("scaled") * (F.col("high") - F.col("low")) + F.col("low"), 4).alias("restored"),
    )


@query(
    "chrono_split",
    f"""SELECT event_type, split, count(*) AS n, strftime(min(d), '%Y-%m-%d') AS first_day FROM (
      SELECT *, CASE WHEN pos < 7 THEN 'warm-up' WHEN pos - 7 < greatest(3, floor((n - 7) * 0.8)) THEN 'train' ELSE 'test'
      END AS split FROM {DAILY}) GROUP BY ALL""",
)
def chrono_split(t):
    return (
        _features(t).withColumn("split", F.coalesce("split", F.lit("warm-up"))).groupBy("event_type", "split")
        .agg(F.count("*").alias("n"), F.min("day").alias("first_day"))
    )


@query(
    "series_step",
    """SELECT event_type, median(g) AS step_seconds FROM (SELECT event_type,
      (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6 AS g FROM events)
      WHERE g IS NOT NULL GROUP BY event_type""",
)
def series_step_events(t):
    return series_step(t.events, "ts", ["event_type"])


@query(
    "time_aggregate",
    "SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, max(value) AS value FROM events GROUP BY ALL",
)
def time_aggregate(t):
    return prepare(_daily(t), "day", "value", ["event_type"], "max").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "target_summary",
    """SELECT event_type, count(*) AS "rows", round_even(avg(value), 2)::DOUBLE AS mean, round_even(stddev_samp(value), 2)::DOUBLE AS std,
      round_even(min(value), 2)::DOUBLE AS min, round_even(max(value), 2)::DOUBLE AS max, strftime(min(ts), '%Y-%m-%d') AS first_date,
      strftime(max(ts), '%Y-%m-%d') AS last_date FROM events GROUP BY event_type""",
)
def target_summary_events(t):
    return target_summary(t.events, "ts", "value", ["event_type"])


@query(
    "fill_dates",
    """SELECT o_orderkey, strftime(coalesce(last_value(d IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING
      AND CURRENT ROW), first_value(d IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      '%Y-%m-%d') AS d FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS d FROM orders)""",
)
def fill_dates_orders(t):
    """Text dates with gaps; a small block so that values are carried over block borders."""
    df = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown").alias("d"),
    )
    return fill_dates(df, "d", ["o_orderkey"], limit=2000).withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query(
    "fill_dates_synthetic",
    """SELECT o_orderkey, strftime(TIMESTAMP '2024-12-31' - to_days(CAST(n - row_number() OVER (ORDER BY o_orderkey) AS INTEGER)),
      '%Y-%m-%d') AS d FROM (SELECT o_orderkey, count(*) OVER () AS n FROM orders)""",
)
def fill_dates_synthetic(t):
    df = t.orders.select("o_orderkey", F.lit("soon").alias("d"))
    return fill_dates(df, "d", ["o_orderkey"], anchor=datetime(2024, 12, 31)).withColumn(
        "d", day_text(F.col("d"))
    )


def _momentum_sql(source: str, key: str, value: str, by: str) -> str:
    return f"""SELECT {by}, CAST(i AS INTEGER) AS step, round_even(last + i * delta + abs(last) * 0.02 *
      list_sum(list_transform(range(1, i + 1), lambda j: sin(0.8 * j))), 2)::DOUBLE AS predicted FROM (
        SELECT {by}, max_by({value}, {key}) AS last,
          (max_by({value}, {key}) - list_extract(list({value} ORDER BY {key} DESC), 3)) / 3 AS delta
        FROM {source} GROUP BY {by}), range(1, 7) r(i)"""


_MONTHLY = """(SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY ALL)"""


def _monthly(t):
    return t.orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("v")
    )


@query("momentum_forecast", _momentum_sql(_MONTHLY, "month", "v", "o_orderpriority"))
def momentum_forecast_orders(t):
    return momentum_forecast(_monthly(t), "month", "v", ["o_orderpriority"], 6)


_LABELS = f"""(SELECT o_orderpriority, CAST(i AS INTEGER) AS step, strftime(strptime(m || '-01', '%Y-%m-%d')
  + to_months(CAST(i AS INTEGER)), '%Y-%m') AS label FROM (SELECT o_orderpriority, max(month) AS m FROM {_MONTHLY} GROUP BY 1),
  range(1, 7) r(i))"""


@query("future_months", f"SELECT * FROM {_LABELS}")
def future_months(t):
    return future_labels(_monthly(t), "month", "month", ["o_orderpriority"], 6)


@query(
    "connected_series",
    f"""SELECT o_orderpriority, CAST(0 AS INTEGER) AS step, month AS label, v AS actual,
      CASE WHEN month = max(month) OVER (PARTITION BY o_orderpriority) THEN v END AS predicted FROM {_MONTHLY}
    UNION ALL SELECT o_orderpriority, step, label, NULL, predicted FROM
      ({_momentum_sql(_MONTHLY, "month", "v", "o_orderpriority")}) JOIN {_LABELS} USING (o_orderpriority, step)""",
)
def connected_series_orders(t):
    history = _monthly(t)
    ahead = momentum_forecast(history, "month", "v", ["o_orderpriority"], 6).join(
        future_labels(history, "month", "month", ["o_orderpriority"], 6), ["o_orderpriority", "step"]
    )
    return connected_series(history, ahead, "month", "month", "v", ["o_orderpriority"]).drop("position")


@query(
    "detect_time_series",
    "SELECT 'ts' AS date_column, 'value' AS target_column, count(*) AS \"rows\", count(*) >= 3 AS suitable FROM events",
)
def detect_time_series_events(t):
    found = detect_time_series(t.events, "event_type", "value")
    return t.events.agg(F.count("*").alias("rows")).select(
        F.lit(found["date_column"]).alias("date_column"), F.lit(found["target_column"]).alias("target_column"), "rows",
        F.lit(found["suitable"]).alias("suitable"),
    )


@query(
    "feature_columns_complete",
    f"SELECT event_type, count(*) AS n FROM {DAILY} WHERE pos >= 7 GROUP BY event_type",
)
def feature_columns_complete(t):
    return _features(t).dropna(subset=lag_names(7)).groupBy("event_type").agg(F.count("*").alias("n"))
