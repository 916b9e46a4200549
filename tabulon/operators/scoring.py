"""Applying a trained model to new rows, and judging the result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, half_even
from .metrics import ANOMALY_WORDS, anomaly_report, class_distribution, class_metrics, confidence_buckets, prediction_quantiles, reg_metrics
from .models import CONFIDENCE, FLAG, PREDICTION, Model, decoded, shape_input

SEVERITY = "__ml_severity"


def score(df: DataFrame, model: Model, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """All rows with ``__ml_prediction`` (and ``__ml_confidence`` in percent where there are probabilities,
    ``__ml_severity`` for anomalies).

    ``mapping`` renames columns of the input to the model's names first.  The plan is
    row by row, so it works on a stream as well.
    """
    if mapping:
        df = df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
    about = model.about
    raw = model.pipeline.transform(shape_input(df, about))
    if about.problem == "classification":
        raw = decoded(raw, about.labels, "prediction", "__decoded")
        out = {PREDICTION: F.col("__decoded")}
        if "probability" in raw.columns:
            out[CONFIDENCE] = half_even(F.array_max(vector_to_array(F.col("probability"))) * 100, 1)
    elif about.problem == "anomaly_detection":
        out = {PREDICTION: F.when(F.col(FLAG) == 1, "Anomaly").otherwise("Normal"), SEVERITY: F.col("severity")}
    elif about.problem == "clustering":
        out = {PREDICTION: F.concat(F.lit("Cluster "), F.col("__cluster").cast("string"))}
    else:
        out = {PREDICTION: F.col("prediction")}
    return raw.withColumns(out).select(*[col(c) for c in df.columns], *[F.col(c) for c in out])


def evaluate(scored: DataFrame, model: Model) -> DataFrame | None:
    """Metrics if the truth is among the columns and not all null; else None (prediction only)."""
    target = model.about.target
    if target is None or target not in scored.columns:
        return None
    if scored.where(col(target).isNotNull()).isEmpty():
        return None
    if model.about.problem == "classification":
        return class_metrics(scored, target, PREDICTION)
    if model.about.problem == "anomaly_detection":
        return anomaly_report(scored.withColumn("__flag", F.col(PREDICTION) == "Anomaly"), "__flag", target, ANOMALY_WORDS)
    return reg_metrics(scored, target, PREDICTION)


def prediction_distribution(scored: DataFrame, model: Model) -> dict[str, DataFrame]:
    """Counts per class and confidence bucket, or per quantile range of the prediction."""
    if model.about.problem == "regression":
        return {"ranges": prediction_quantiles(scored, PREDICTION)}
    out = {"classes": class_distribution(scored, PREDICTION)}
    if CONFIDENCE in scored.columns:
        out["confidence"] = confidence_buckets(scored, CONFIDENCE)
    return out
