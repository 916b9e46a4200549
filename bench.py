"""Seconds per headline query: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  Each query
runs once to warm up and three times for the median; the rows are counted on the
executors, nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tabulon.plans import load
from tabulon.plans.registry import QUERIES
from tabulon.session import build_session

HEADLINE = (
    "bar_revenue_by_segment", "profile_lineitem", "quality_duplicates_lineitem", "infer_types_events", "iqr_outliers",
    "quantile_group_price", "replay_steps", "fix_formatting_docs", "filter_range", "relative_last_month", "global_filter",
    "pivot_status_priority", "median_by_flag", "key_metrics", "cond_count_late", "margin_by_type", "supply_gap_fanout",
    "price_ratio", "star_join_nation_revenue", "cte_top_customer", "lags_daily", "momentum_forecast", "corr_matrix",
    "split_hash", "class_report", "roc_auc", "knn_label", "forecast_linear_trend",
)
RUNS = 3


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load()
    spark = build_session("bench", cores)
    times = {}
    for name in HEADLINE:
        seconds(spark, name, folder)
        times[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
