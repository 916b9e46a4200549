"""Queries that train, score and forecast (rows checked in tests, not by SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.forecast import forecast, forecast_auto, pick_forecaster
from ..operators.models import cluster_report, feature_importances, pca_2d, train
from ..operators.scoring import evaluate, prediction_distribution, score
from .registry import query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _metrics(spark, model):
    rows = [(k, float(v)) for k, v in sorted(model.about.metrics.items()) if v is not None]
    return spark.createDataFrame(rows, "metric string, value double")


def _classify(t, algorithm, parameters=None, **kwargs):
    df = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    model, _ = train(
        df, [*FEATURES, "l_linestatus"], "l_returnflag", "classification", algorithm, parameters, key="key", **kwargs
    )
    return df, model


for _name, _params in {
    "random_forest": {"n_estimators": 10, "max_depth": 5}, "decision_tree": {"max_depth": 5}, "logistic_regression": {"max_iter": 50},
    "naive_bayes": {}, "mlp": {"max_iter": 10, "hidden_layer_sizes": (8,)}, "gradient_boosting": {"n_estimators": 3},
}.items():

    @query(f"train_{_name}_classifier")
    def _train_class(t, name=_name, params=_params):
        return _metrics(t.spark, _classify(t, name, params)[1])


@query("train_svm_classifier")
def train_svm(t):
    """Two classes, so one margin instead of one per class."""
    df = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    model, _ = train(df, ["l_quantity", "l_discount", "l_tax"], "l_linestatus", "classification", "svm", {"max_iter": 5}, key="key")
    return _metrics(t.spark, model)


for _name, _params in {
    "linear_regression": {}, "ridge": {}, "lasso": {}, "random_forest": {"n_estimators": 10, "max_depth": 5},
    "decision_tree": {"max_depth": 5}, "gradient_boosting": {"n_estimators": 5},
}.items():

    @query(f"train_{_name}_regressor")
    def _train_reg(t, name=_name, params=_params):
        df = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
        model, _ = train(
            df, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice", "regression", name, params, key="key"
        )
        return _metrics(t.spark, model)


for _name in ("kmeans", "gaussian_mixture"):

    @query(f"train_{_name}")
    def _train_cluster(t, name=_name):
        model, scored = train(t.customer, ["c_acctbal", "c_mktsegment"], None, "clustering", name, {"n_clusters": 3})
        return cluster_report(model, scored)


@query("feature_importances")
def importances(t):
    df, model = _classify(t, "random_forest", {"n_estimators": 10, "max_depth": 5})
    return feature_importances(model, model.pipeline.transform(_shaped(df, model)))


def _shaped(df, model):
    from ..operators.models import shape_input

    return shape_input(df, model.about)


@query("pca_2d")
def pca(t):
    _, scored = train(t.customer, ["c_acctbal", "c_nationkey"], None, "clustering", "kmeans", {"n_clusters": 3})
    return pca_2d(scored).select("c_custkey", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("score_batch")
def score_batch(t):
    """Rows with other column names, mapped to the model's."""
    df, model = _classify(t, "logistic_regression", {"max_iter": 50})
    renamed = df.withColumnRenamed("l_quantity", "qty")
    return score(renamed, model, {"qty": "l_quantity"}).select("l_orderkey", "l_linenumber", "__ml_prediction", "__ml_confidence")


@query("score_distribution")
def score_distribution(t):
    df, model = _classify(t, "logistic_regression", {"max_iter": 50})
    scored = score(df, model)
    parts = prediction_distribution(scored, model)
    classes = parts["classes"].select(F.lit("class").alias("kind"), F.col("category").alias("bucket"), F.col("count").alias("n"))
    return classes.unionByName(parts["confidence"].select(F.lit("confidence").alias("kind"), "bucket", "n"))


@query("evaluate_scored")
def evaluate_scored(t):
    df, model = _classify(t, "decision_tree", {"max_depth": 5})
    return evaluate(score(df, model), model)


@query(
    "pick_forecaster",
    """SELECT event_type, count(*) AS "rows", CASE WHEN count(*) >= 50 THEN 'gradient_boosting_forecast' WHEN count(*) >= 20
      THEN 'random_forest_forecast' ELSE 'linear_trend' END AS technique, CASE WHEN count(*) >= 50 THEN 7 WHEN count(*) >= 20 THEN 5
      ELSE 3 END AS lag_window FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) FROM events) GROUP BY event_type""",
)
def pick(t):
    days = t.events.select("event_type", F.to_date("ts").alias("d")).distinct()
    return pick_forecaster(days, ["event_type"])


_SERIES = """(SELECT user_id % 97 AS bucket, count(DISTINCT CAST(ts AS DATE)) AS n FROM events
    WHERE day(ts) <= 2 + user_id % 97 % 29 GROUP BY 1)"""


def _buckets(t):
    """Daily sums of many series of very different length."""
    rows = t.events.where("day(ts) <= 2 + user_id % 97 % 29")
    return rows.select((F.col("user_id") % 97).alias("bucket"), F.to_date("ts").alias("day"), "value")


@query(
    "forecast_status",
    f"""SELECT bucket, n AS "rows", CASE WHEN n - greatest(1, least(3, n // 3)) < 5 THEN 'too_few_rows' WHEN n < 20 THEN 'below_minimum'
      ELSE 'fitted' END AS status FROM {_SERIES}""",
)
def forecast_status(t):
    """Every series has a status, the short ones too."""
    return forecast(_buckets(t), "day", "value", ["bucket"], "ridge_trend", 2, 3, "sum").status


@query(
    "forecast_auto",
    f"""WITH p AS (SELECT *, CASE WHEN n >= 50 THEN 'gradient_boosting_forecast' WHEN n >= 20 THEN 'random_forest_forecast' ELSE 'linear_trend' END AS t,
      n - greatest(1, least(CASE WHEN n >= 50 THEN 7 WHEN n >= 20 THEN 5 ELSE 3 END, n // 3)) >= 5 AS enough FROM {_SERIES}),
    r AS (SELECT *, enough AND n >= CASE t WHEN 'linear_trend' THEN 10 ELSE 30 END AS fits FROM p),
    c AS (SELECT *, CASE WHEN fits THEN t WHEN NOT enough OR n < 5 THEN 'momentum' WHEN n >= 20 THEN 'ridge_trend' WHEN n >= 10 THEN 'linear_trend'
      ELSE 'moving_average' END AS technique FROM r)
    SELECT bucket, technique, CASE WHEN fits THEN 'fitted' WHEN technique = 'momentum' THEN 'too_few_rows' ELSE 'stepped_down' END AS status,
      4::BIGINT AS steps FROM c""",
)
def forecast_routes(t):
    """Every series gets all its steps, from the forecaster that its rows allow."""
    future, _ = forecast_auto(_buckets(t), "day", "value", ["bucket"], 4, "sum")
    return future.where("predicted is not null").groupBy("bucket", "technique", "status").agg(F.count(F.lit(1)).alias("steps"))


def _daily(t):
    return t.events.select(F.to_date("ts").alias("day"), "event_type", "value")


for _name in ("linear_trend", "ridge_trend", "moving_average", "random_forest_forecast", "gradient_boosting_forecast", "knn_forecast"):

    @query(f"forecast_{_name}")
    def _forecast(t, name=_name):
        return forecast(_daily(t), "day", "value", ["event_type"], name, 6, 3, "sum", trees=5).future


@query("forecast_actual_vs_predicted")
def forecast_rows(t):
    return forecast(_daily(t), "day", "value", ["event_type"], "linear_trend", 1, 3, "sum").actual_vs_predicted()


@query("forecast_metrics")
def forecast_metrics(t):
    return forecast(_daily(t), "day", "value", ["event_type"], "ridge_trend", 1, 3, "sum").metrics()
