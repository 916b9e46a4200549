"""Model metrics as aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, half_even, number
from ..session import TASK_ROWS
from .ordering import running_total
from .quantiles import column_quantiles

# Labels that mean "this is an anomaly", in scored rows and, one more, in training rows.
ANOMALY_WORDS = ("true", "yes", "1", "fraud", "anomaly", "outlier")
TRAINING_WORDS = (*ANOMALY_WORDS, "churn")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``truth, predicted, n`` over rows that have both, labels as text."""
    pairs = df.select(col(truth).cast("string").alias("truth"), col(predicted).cast("string").alias("predicted"))
    return pairs.dropna().groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where a denominator is 0.

    Works on the confusion counts, which are as few as the label pairs.
    """
    pairs = confusion(df, truth, predicted)
    rows = pairs.select(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                        F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"))
    called = pairs.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                          F.lit(0).cast("long").alias("hits"))
    sums = rows.unionByName(called).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("called")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    scored = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    return scored.select("label", "support", "called", "hits", "precision", "recall", f1.alias("f1"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1 (4 places)."""
    report = class_report(df, truth, predicted)
    total = F.sum("support")

    def weighted(name):
        return half_even(F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), total), F.lit(0.0)), 4).alias(name)

    return report.agg(
        total.alias("samples"),
        half_even(F.coalesce(F.try_divide(F.sum("hits"), total), F.lit(0.0)), 4).alias("accuracy"),
        weighted("precision"), weighted("recall"), weighted("f1"),
    )


def roc_auc(df: DataFrame, truth: str, score: str, positive: str, limit: int = TASK_ROWS) -> DataFrame:
    """Area under the ROC curve from the counts per distinct score (equal scores are one point)."""
    is_positive = (col(truth).cast("string") == positive).cast("long")
    points = df.where(col(truth).isNotNull() & col(score).isNotNull()).groupBy(number(df, score).alias("s")).agg(
        F.sum(is_positive).alias("p"), F.sum(1 - is_positive).alias("n")
    )
    ranked = running_total(points, ["s"], "n", "below", limit)
    # Pairs in which the positive scores higher, and half of the ties.
    won = F.col("p") * (F.col("below") + F.col("n") / 2)
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return ranked.agg(half_even(F.try_divide(F.sum(won), pairs), 4).alias("roc_auc"))


def reg_metrics(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = (), with_mape: bool = False) -> DataFrame:
    """MAE, MSE, RMSE, R2 (4 places) over rows with a truth; MAPE (2 places) on request.

    The total sum of squares comes from the variance, so it is one pass.
    """
    y, p = number(df, truth), number(df, predicted)
    rows = df.select(*[col(k) for k in keys], y.alias("__y"), p.alias("__p")).dropna(subset=["__y", "__p"])
    error = F.col("__y") - F.col("__p")
    mse = F.avg(error * error)
    n = F.count(F.lit(1))
    spread = F.var_pop("__y")
    r2 = F.when(n <= 1, F.lit(0.0)).when(spread > 0, 1 - mse / spread).otherwise(F.when(mse == 0, 1.0).otherwise(0.0))
    aggs = [
        n.alias("samples"), half_even(F.avg(F.abs(error)), 4).alias("mae"), half_even(mse, 4).alias("mse"),
        half_even(F.sqrt(mse), 4).alias("rmse"), half_even(r2, 4).alias("r2"),
    ]
    if with_mape:
        share = F.when(F.abs("__y") > 1e-8, F.abs(error / F.nullif("__y", F.lit(0.0))))
        aggs.append(half_even(F.avg(share) * 100, 2).alias("mape"))
    return rows.groupBy(*[col(k) for k in keys]).agg(*aggs)


def residual_sample(df: DataFrame, truth: str, predicted: str, key: str, n: int = 50) -> DataFrame:
    """Actual, predicted and residual of the first ``n`` rows by key."""
    y, p = number(df, truth), number(df, predicted)
    rows = df.select(col(key), half_even(y, 4).alias("actual"), half_even(p, 4).alias("predicted"), half_even(y - p, 4).alias("residual"))
    return rows.dropna().orderBy(col(key)).limit(n)


def cluster_profile(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """``cluster, size, pct, column, mean, overall, diff_pct`` for all given columns; two aggregates."""
    names = list(columns)
    values = [number(df, c) for c in names]
    overall = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    per = df.groupBy(col(cluster)).agg(F.count(F.lit(1)).alias("size"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)])
    rows = []
    for i, c in enumerate(names):
        base = overall[f"m{i}"]
        diff = F.when(F.lit(base) != 0, (F.col(f"m{i}") - base) / F.abs(F.lit(base)) * 100).otherwise(F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(c).alias("column"), half_even(F.col(f"m{i}"), 2).alias("mean"),
                half_even(F.lit(base).cast("double"), 2).alias("overall"), half_even(diff, 1).alias("diff_pct"),
            )
        )
    return per.select(
        col(cluster), "size", half_even(100.0 * F.col("size") / F.lit(overall["n"]), 1).alias("pct"),
        F.explode(F.array(*rows)).alias("r"),
    ).select(col(cluster), "size", "pct", "r.*")


def severity(df: DataFrame, score: str, over: DataFrame | None = None) -> DataFrame:
    """Adds ``severity``: 1 minus the min-max scaled raw score (low raw score = unusual); ``over`` holds the same scores, stored."""
    row = (df if over is None else over).agg(F.min(col(score)).alias("low"), F.max(col(score)).alias("high")).first()
    spread = (row["high"] or 0.0) - (row["low"] or 0.0)
    value = 1 - (col(score) - F.lit(row["low"])) / F.lit(spread) if spread > 0 else F.lit(0.0)
    return df.withColumn("severity", half_even(value, 4))


def anomaly_report(df: DataFrame, flag: str, truth: str | None = None, words: Sequence[str] = TRAINING_WORDS) -> DataFrame:
    """One row: counts, share, and precision/recall/F1 against a truth column if given."""
    hit = F.coalesce(col(flag).cast("boolean"), F.lit(False))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("anomalies")]
    if truth is not None:
        real = F.coalesce(F.lower(F.trim(col(truth).cast("string"))).isin(*words), F.lit(False))
        aggs += [
            F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"),
            F.count_if(~hit & ~real).alias("tn"),
        ]
    out = df.agg(*aggs).withColumn("anomaly_pct", half_even(100.0 * F.col("anomalies") / F.greatest("rows", F.lit(1)), 2))
    if truth is None:
        return out
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return out.withColumns({"precision": half_even(precision, 4), "recall": half_even(recall, 4), "f1": half_even(f1, 4)})


def top_anomalies(df: DataFrame, flag: str, score: str, key: str, n: int = 20, fallback: int = 10) -> DataFrame:
    """The worst anomalies by severity; without any, the highest scores as "Borderline"."""
    found = df.where(col(flag)).withColumn("status", F.lit("Anomaly"))
    if found.isEmpty():
        found, n = df.withColumn("status", F.lit("Borderline")), fallback
    return found.orderBy(col(score).desc(), col(key)).limit(n)


def confidence_buckets(df: DataFrame, confidence: str) -> DataFrame:
    """``bucket, n`` of a confidence in percent; intervals closed on the right, (0, 50] first."""
    c = col(confidence)
    label = (
        F.when((c > 0) & (c <= 50), "<50%").when((c > 50) & (c <= 70), "50-70%").when((c > 70) & (c <= 85), "70-85%")
        .when((c > 85) & (c <= 95), "85-95%").when((c > 95) & (c <= 100), "95-100%")
    )
    return df.select(label.alias("bucket")).dropna().groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def prediction_quantiles(df: DataFrame, name: str, parts: int = 5) -> DataFrame:
    """``low, high, n`` of at most five quantile ranges, closed on the right; equal edges merge."""
    edges = column_quantiles(df, {name: number(df, name)}, [i / parts for i in range(parts + 1)])[name]
    cuts = sorted({e for e in edges if e is not None})
    if len(cuts) < 2:
        cuts = cuts * 2 if cuts else [0.0, 0.0]
    value = number(df, name)
    place = F.when(value.isNotNull(), F.lit(len(cuts) - 2))
    for i in range(len(cuts) - 3, -1, -1):
        place = F.when(value <= cuts[i + 1], F.lit(i)).otherwise(place)
    rows = df.select(F.when(value.isNotNull(), place).alias("i")).dropna().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.lit(float(c)) for c in cuts])
    return rows.select(F.get(listed, F.col("i")).alias("low"), F.get(listed, F.col("i") + 1).alias("high"), "n")


def class_distribution(df: DataFrame, predicted: str) -> DataFrame:
    return df.groupBy(col(predicted).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("count"))
