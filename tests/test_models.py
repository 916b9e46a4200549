from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabulon.operators.automl import DataError, detect_problem, pick_target, plan, problem_alias, usable_features
from tabulon.operators.charts import ChartSpec
from tabulon.operators.metrics import class_metrics, confidence_buckets, reg_metrics, roc_auc
from tabulon.operators.models import Model, cluster_report, feature_importances, pca_2d, run_plan, silhouette, train
from tabulon.operators.scoring import evaluate, prediction_distribution, score
from tabulon.operators.stats import correlation_matrix, encode_for_correlation, features_from_charts, select_features, split, target_correlations, top_features
from tabulon.streaming.scoring import read_scored, score_stream


def telemetry(spark, n=200):
    rng = random.Random(42)
    data = []
    for i in range(n):
        age, tenure = rng.randint(18, 70), rng.randint(1, 72)
        income = 20000 + age * 500 + rng.gauss(0, 3000)
        churn = "Yes" if tenure < 24 + rng.gauss(0, 4) else "No"
        data.append((f"id{i}", age, income, tenure, "Monthly" if tenure < 30 else "Yearly", "same", churn))
    return spark.createDataFrame(data, "code string, age int, income double, tenure int, contract string, constant string, churn string")


def houses(spark, n=80):
    rng = random.Random(1)
    data = []
    for i in range(n):
        sqft, beds, place = rng.randint(800, 3000), rng.randint(1, 5), rng.choice(["A", "B"])
        data.append((i, sqft, beds, place, 100.0 * sqft + 5000 * beds + (20000 if place == "A" else 0)))
    return spark.createDataFrame(data, "id int, sqft int, bedrooms int, location string, price double")


def test_correlations(spark):
    encoded, names = encode_for_correlation(telemetry(spark), "churn")
    assert "constant" not in names and "code" not in names and "churn" in names
    matrix = {(r["feature"], r["other"]): r["correlation"] for r in rows(correlation_matrix(encoded))}
    assert all(matrix[a, a] == 1.0 for a in names)
    assert all(matrix[a, b] == matrix[b, a] and abs(matrix[a, b]) <= 1 for a in names for b in names)
    pdf = encoded.toPandas()
    assert matrix["age", "income"] == pytest.approx(round(float(np.corrcoef(pdf["age"], pdf["income"])[0, 1]), 4))
    ranked = rows(target_correlations(correlation_matrix(encoded), "churn"))
    sizes = [r["abs_correlation"] for r in ranked]
    assert sizes == sorted(sizes, reverse=True) and ranked[0]["feature"] in ("tenure", "contract")


def test_feature_choice():
    ranked = [{"feature": f"f{i}", "abs_correlation": v} for i, v in enumerate([0.9995, 0.8, 0.3, 0.06, 0.04])]
    assert select_features(ranked, []) == ["f1", "f2", "f3"]
    assert select_features(ranked[:3] + ranked[4:], []) == ["f1", "f2", "f4"]
    assert select_features([], ["a", "b", "t"], "t") == ["a", "b"]
    assert top_features(ranked, 2) == ["f0", "f1"] and top_features(ranked, least=0.1) == ["f0", "f1", "f2"]
    assert features_from_charts([ChartSpec(x="d", y="v")], ["d", "v"]) == {"date_column": "d", "target_column": "v"}
    assert features_from_charts([ChartSpec(x="a", y="b"), ChartSpec(x="a", group="c")], ["a", "c"]) == {"feature_columns": ["a", "c"]}


def test_plan_and_problem(spark):
    df = telemetry(spark)
    p = plan(df)
    assert (p.target, p.problem_type, p.algorithm) == ("churn", "classification", "random_forest") and "tenure" in p.features
    assert plan(df, problem="segmentation").target is None
    assert detect_problem(df, "income")["problem_type"] == "regression"
    assert detect_problem(df, "churn")["sub_type"] == "binary"
    assert detect_problem(df, None)["problem_type"] == "clustering"
    assert pick_target(df.select("code", "age", "contract")) == "contract"
    assert problem_alias("Time-Series") == "forecasting" and problem_alias("outliers") == "anomaly_detection"
    with pytest.raises(DataError):
        usable_features(df, ["nothing"], "churn")


def test_split_is_stable_and_stratified(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 300, "a").otherwise("b").alias("k"))
    a = {r["id"]: r["is_test"] for r in rows(split(df, "id"))}
    assert a == {r["id"]: r["is_test"] for r in rows(split(df.repartition(7), "id"))}
    shares = {r["k"]: r["n"] for r in rows(split(df, "id", strata="k").where("is_test").groupBy("k").agg(F.count("*").alias("n")))}
    assert shares == {"a": 60, "b": 140}


def test_classifier_score_save_load(spark, tmp_path):
    df = telemetry(spark)
    model, scored = train(df, ["age", "income", "tenure", "contract"], "churn", "classification", "logistic_regression", {"max_iter": 50}, key="code")
    assert model.about.metrics["accuracy"] > 0.7 and model.about.labels == ["No", "Yes"]
    model.save(spark, str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    out = score(df.withColumnRenamed("tenure", "months"), again, {"months": "tenure"})
    assert out.count() == 200 and out.columns[-2:] == ["__ml_prediction", "__ml_confidence"]
    assert {r[0] for r in out.select("__ml_prediction").distinct().collect()} == {"No", "Yes"}
    assert evaluate(out, again).first()["accuracy"] > 0.7
    assert evaluate(score(df.drop("churn"), again), again) is None
    parts = prediction_distribution(out, again)
    assert sum(r["count"] for r in rows(parts["classes"])) == 200 == sum(r["n"] for r in rows(parts["confidence"]))
    with pytest.raises(DataError, match="tenure"):
        score(df.drop("tenure"), again)
    best = rows(feature_importances(again, scored))
    assert best[0]["feature"] in ("tenure", "contract_Monthly", "contract_Yearly")


def test_any_number_of_categories_and_classes(spark, tmp_path):
    """1,500 categories and 1,200 classes: coded by tables, stored with the model, unseen values allowed."""
    n = 3600
    df = spark.range(n).select("id", F.concat(F.lit("k"), F.col("id") % 1500).alias("word"), (F.col("id") % 1200).cast("double").alias("x"),
                               F.concat(F.lit("c"), F.col("id") % 1200).alias("y"))
    model, scored = train(df, ["x"], "y", "classification", "knn", {"n_neighbors": 1}, key="id")
    assert len(model.about.labels) == 1200 and model.about.metrics["samples"] == scored.count() > 500
    assert model.report.count() >= 1200 and model.confusion.agg(F.sum("n")).first()[0] == scored.count()
    model.save(spark, f"{tmp_path}/m")
    again = Model.load(spark, f"{tmp_path}/m")
    got = {r["id"]: r["__ml_prediction"] for r in rows(score(df.where("id < 50"), again))}
    assert set(got.values()) <= set(model.about.labels) and len(got) == 50
    tree, shown = train(df.withColumn("v", F.col("id") % 1500 * 1.0), ["word"], "v", "regression", "ridge", {"alpha": 0.001}, key="id")
    assert tree.about.metrics["samples"] > 500
    tree.save(spark, f"{tmp_path}/t")
    assert score(spark.createDataFrame([(1, "never met", 5.0), (2, None, 6.0)], "id long, word string, x double"), Model.load(spark, f"{tmp_path}/t")).count() == 2
    best = rows(feature_importances(tree, shown, 5))
    assert len(best) == 5 and all(r["feature"].startswith("word_k") for r in best)


def test_training_learns_from_training_rows_only(spark):
    """Fill values come from training rows; a binary classifier reports its ROC area, report and confusion matrix."""
    df = telemetry(spark)
    marked = split(df.withColumn("__l", (F.col("churn") == "Yes").cast("double")), "code", strata="__l")
    odd = df.join(marked.select("code", "is_test"), "code").withColumn("contract", F.when(F.col("is_test"), "TestOnly").otherwise(F.col("contract"))).drop("is_test")
    model, scored = train(odd, ["tenure", "contract"], "churn", "classification", "logistic_regression", {"max_iter": 50}, key="code")
    assert {r["contract"] for r in rows(scored.select("contract").distinct())} == {"TestOnly"}
    assert model.about.fills["contract"] in ("Monthly", "Yearly")
    assert 0.9 < model.about.metrics["roc_auc"] <= 1.0
    report = {r["label"]: r["support"] for r in rows(model.report)}
    assert sum(report.values()) == scored.count() == sum(r["n"] for r in rows(model.confusion))


def test_plans_run(spark):
    from datetime import date, timedelta

    days = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), 10.0 + i) for i in range(40)], "day date, amount double")
    found = run_plan(days, plan(days, "amount", problem="forecasting", algorithm="linear_trend"))
    assert found.future.count() == 12
    df = telemetry(spark)
    model = run_plan(df, plan(df, "churn", ["tenure", "contract"], "classification", "decision_tree", {"max_depth": 3}), key="code")
    assert model.about.metrics["accuracy"] > 0.6
    odd = run_plan(df, plan(df, problem="outliers", features=["age", "income"]))
    assert odd.about.problem == "anomaly_detection" and odd.about.metrics["rows"] == 200


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "naive_bayes", "mlp", "gradient_boosting", "nonsense"])
def test_more_classifiers(spark, name):
    model, _ = train(telemetry(spark), ["tenure", "contract"], "churn", "classification", name,
                     {"n_estimators": 5, "max_depth": 3, "max_iter": 20, "hidden_layer_sizes": (4,)}, key="code")
    assert model.about.metrics["accuracy"] > 0.6
    assert bool(model.about.warnings) == (name == "nonsense")


def test_ridge_and_lasso_match_closed_forms(spark):
    df = houses(spark)
    model, _ = train(df, ["sqft", "bedrooms"], "price", "regression", "ridge", {"alpha": 5.0}, key="id")
    last = model.pipeline.stages[-1]
    marked = split(df, "id").where("not is_test").toPandas()
    x = marked[["sqft", "bedrooms"]].to_numpy(dtype=float)
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    y = marked["price"].to_numpy()
    w = np.linalg.solve(x.T @ x + 5.0 * np.eye(2), x.T @ (y - y.mean()))
    assert np.allclose(last.coefficients.toArray(), w, rtol=1e-4)
    linear, _ = train(df, ["sqft", "bedrooms", "location"], "price", "regression", "linear_regression", key="id")
    assert linear.about.metrics["r2"] > 0.999


@pytest.mark.parametrize("name", ["lasso", "random_forest", "decision_tree", "gradient_boosting"])
def test_more_regressors(spark, name):
    model, _ = train(houses(spark), ["sqft", "bedrooms", "location"], "price", "regression", name, {"n_estimators": 5, "max_depth": 5}, key="id")
    assert model.about.metrics["r2"] > 0.5
    out = score(houses(spark), model)
    assert sum(r["n"] for r in rows(prediction_distribution(out, model)["ranges"])) == 80


def test_clusters(spark):
    data = [(100 + i, 1) for i in range(5)] + [(5000 + i, 20) for i in range(5)] + [(20000 + i, 60) for i in range(5)]
    df = spark.createDataFrame(data, "annual_spend int, visit_frequency int")
    model, scored = train(df, df.columns, None, "segmentation", "kmeans", {"n_clusters": 3})
    report = rows(cluster_report(model, scored))
    assert {r["size"] for r in report} == {5} and len(report) == 6
    assert silhouette(scored) > 0.9
    assert pca_2d(scored).select("pc1", "pc2").count() == 15
    assert score(df, model).first()["__ml_prediction"].startswith("Cluster ")
    train(df, df.columns, None, "clustering", "gaussian_mixture", {"n_components": 2})


def test_metrics_on_small_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), (None, "a")], "y string, p string")
    r = class_metrics(df, "y", "p").first()
    assert (r["samples"], r["accuracy"]) == (4, 0.5) and r["recall"] == 0.5 and r["precision"] == round((1 * 2 + 1 / 3) / 4, 4)
    reg = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0)], "y double, p double")
    r = reg_metrics(reg, "y", "p", with_mape=True).first()
    assert (r["samples"], r["mae"], r["mse"], r["r2"], r["mape"]) == (2, 0.5, 0.5, 0.5, 50.0)
    auc = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "y int, s double")
    assert roc_auc(auc, "y", "s", "1").first()[0] == 0.875 == roc_auc(auc, "y", "s", "1", limit=1).first()[0]
    c = spark.createDataFrame([(50.0,), (50.1,), (70.0,), (95.0,), (100.0,)], "c double")
    assert {r["bucket"]: r["n"] for r in rows(confidence_buckets(c, "c"))} == {"<50%": 1, "50-70%": 2, "85-95%": 1, "95-100%": 1}


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    df = telemetry(spark)
    model, _ = train(df, ["age", "tenure"], "churn", "classification", "decision_tree", {"max_depth": 3}, key="code")
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "cp"), "m").awaitTermination()
    got = {(r["code"], r["__ml_prediction"]) for r in rows(read_scored(spark, str(tmp_path / "out")))}
    assert got == {(r["code"], r["__ml_prediction"]) for r in rows(score(df, model))}
    log = rows(spark.read.parquet(str(tmp_path / "log")))
    assert sum(r["rows"] for r in log) == 200 and len(log) == 3


def test_split_works_out_a_row_once(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 3 as string) as k", "null as nothing")
    marked = split(df, "id", strata="k")
    assert "md5" not in marked._jdf.queryExecution().executedPlan().toString()
    assert marked.columns == ["id", "k", "nothing", "is_test"] and marked.where("nothing is null").count() == 400


def test_training_reads_stored_rows(spark):
    df = spark.range(300).selectExpr("id", "cast(id as double) as a", "cast(id % 7 as double) + id as y")
    _, scored = train(df, ["a"], "y", "regression", "linear_regression", key="id")
    assert "md5" not in scored._jdf.queryExecution().executedPlan().toString()
