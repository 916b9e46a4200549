"""Choice of target, problem type, algorithm and parameters by rule."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_flag, is_number, is_time, number, type_of
from .stats import correlation_matrix, encode_for_correlation, select_features, target_correlations
from .types import type_map

# Words that mark an outcome column, most telling first.
TARGET_WORDS = (
    "churn", "target", "label", "class", "status", "fraud", "default", "price", "sales", "revenue", "salary",
    "outcome", "total", "profit", "cost", "rating", "score", "loss", "converted", "attrition", "delay", "is_",
)

# Other names of the problem types.
ALIASES = {
    "clustering": "clustering", "segmentation": "clustering", "cohorts": "clustering",
    "time_series": "forecasting", "forecasting": "forecasting", "forecast": "forecasting",
    "anomaly_detection": "anomaly_detection", "anomaly": "anomaly_detection", "outlier": "anomaly_detection",
    "outliers": "anomaly_detection", "regression": "regression", "regressor": "regression",
    "classification": "classification", "classifier": "classification",
}
DEFAULTS = {
    "classification": ("random_forest", {"n_estimators": 100}),
    "regression": ("random_forest", {"n_estimators": 100}),
    "forecasting": ("random_forest_forecast", {"n_estimators": 100}),
    "anomaly_detection": ("isolation_forest", {"n_estimators": 100, "contamination": 0.05}),
    "clustering": ("kmeans", {"n_clusters": 3}),
}
MIN_ROWS = 5


class DataError(ValueError):
    """Too little data for a model."""


def problem_alias(name: str | None) -> str:
    return ALIASES.get((name or "classification").lower().replace("-", "_").replace(" ", "_"), "classification")


def require_rows(df: DataFrame, least: int = MIN_ROWS) -> None:
    if df.limit(least).count() < least:
        raise DataError(f"at least {least} rows are needed")


def usable_features(df: DataFrame, features, target: str | None, supervised: bool = True) -> list[str]:
    """Features that exist; unsupervised models fall back to all columns."""
    found = [c for c in features or () if c in df.columns and c != target]
    if found:
        return found
    if supervised:
        raise DataError("none of the features exists")
    return [c for c in df.columns if c != target]


def pick_target(df: DataFrame, types: dict[str, dict] | None = None) -> str:
    """Outcome-like name, else the last text column of 2 to 10 values, else the last number, else the last column."""
    for word in TARGET_WORDS:
        for name in df.columns:
            if word in name.lower():
                return name
    types = types or type_map(df)
    words = [c for c in df.columns if types[c]["data_type"] in ("categorical", "boolean", "text")]
    if words:
        row = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(words)]).first()
        fitting = [c for i, c in enumerate(words) if 2 <= row[f"d{i}"] <= 10]
        if fitting:
            return fitting[-1]
    numbers = [c for c in df.columns if types[c]["data_type"] == "numerical"]
    return numbers[-1] if numbers else df.columns[-1]


def detect_problem(df: DataFrame, target: str | None, types: dict[str, dict] | None = None) -> dict[str, Any]:
    """Problem type of a target over all rows."""
    if not target or target not in df.columns:
        return {"problem_type": "clustering", "sub_type": None, "target_column": None, "classes": None}
    dtype = type_of(df, target)
    kind = types[target]["data_type"] if types and target in types else None
    if kind is None:
        kind = (
            "boolean" if is_flag(dtype) else "numerical" if is_number(dtype) else "datetime" if is_time(dtype) else "categorical"
        )
    if kind == "datetime":
        return {"problem_type": "time_series", "sub_type": None, "target_column": target, "classes": None}
    value = number(df, target)
    row = df.agg(
        F.count_distinct(col(target)).alias("d"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.bool_and(value.isin(0.0, 1.0)).alias("binary"),
    ).first()
    out = {"target_column": target, "classes": row["d"]}
    if kind in ("categorical", "boolean", "text"):
        return out | {"problem_type": "classification", "sub_type": "binary" if row["d"] == 2 else "multiclass"}
    if row["d"] == 2 and row["binary"]:
        return out | {"problem_type": "classification", "sub_type": "binary"}
    return out | {"problem_type": "regression", "sub_type": None, "low": row["low"], "high": row["high"]}


@dataclass
class Plan:
    """What would be trained, and on what."""

    problem_type: str
    target: str | None
    features: list[str]
    algorithm: str
    parameters: dict[str, Any] = field(default_factory=dict)
    correlations: DataFrame | None = None


def plan(
    df: DataFrame, target: str | None = None, features=None, problem: str | None = None, algorithm: str | None = None,
    parameters: dict[str, Any] | None = None, types: dict[str, dict] | None = None,
) -> Plan:
    """Fill in whatever the caller leaves open: target, features, problem type, algorithm."""
    types = types or type_map(df)
    wanted = problem_alias(problem) if problem else None
    unsupervised = wanted in ("clustering", "anomaly_detection")
    if target not in df.columns:
        target = None if unsupervised else pick_target(df, types)
    correlations, ranked = None, []
    if target is not None:
        encoded, names = encode_for_correlation(df, target, types)
        if target in names and len(names) >= 2:
            correlations = target_correlations(correlation_matrix(encoded), target)
            ranked = [r.asDict() for r in correlations.collect()]
    chosen = [c for c in features or () if c in df.columns and c != target] or select_features(ranked, df.columns, target)
    kind = wanted or problem_alias(detect_problem(df, target, types)["problem_type"])
    name, defaults = DEFAULTS[kind]
    return Plan(kind, target, chosen, algorithm or name, {**defaults, **(parameters or {})} if not algorithm else dict(parameters or {}), correlations)
