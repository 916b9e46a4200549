"""Model pipelines on Spark ML: preparation, estimators, training, storage.

A trained model is a ``PipelineModel`` plus a small description (features,
types, fill values, labels).  Training data never leaves the executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    PCA, Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, is_flag, is_number, is_text, is_time, number, type_of
from ..session import stored
from .automl import DataError, Plan, problem_alias, require_rows, usable_features
from .detectors import Dbscan, Dictionary, DictionaryModel, EllipticEnvelope, IsolationForest, LocalOutlierFactor, Neighbors
from .forecast import Forecast, forecast
from .metrics import anomaly_report, class_metrics, class_report, cluster_profile, confusion, reg_metrics, roc_auc
from .ordering import with_position
from .stats import split
from .steps import most_frequent

SEED = 42
DEFAULT_DEPTH = 10  # when none is given; Spark trees go to 30 at most
FEATURES, LABEL, PREDICTION, CONFIDENCE = "__features", "__label", "__ml_prediction", "__ml_confidence"
FLAG = "__anomaly"  # 1 for an anomaly
NEIGHBOR_NAMES = ("knn", "k_nearest_neighbors", "k_nearest")


@dataclass
class Description:
    """Everything needed to feed rows to a stored pipeline."""

    problem: str
    algorithm: str
    features: list[str]
    numeric: list[str]
    text: list[str]
    fills: dict[str, str] = field(default_factory=dict)
    target: str | None = None
    labels: list[str] = field(default_factory=list)
    metrics: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Model:
    """A fitted pipeline and its description; ``report`` and ``confusion`` judge the test rows of a classifier."""

    pipeline: PipelineModel
    about: Description
    report: DataFrame | None = None
    confusion: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark.createDataFrame([(json.dumps(asdict(self.about)),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/about"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        text = spark.read.text(f"{path}/about").first()[0]
        return cls(PipelineModel.load(f"{path}/pipeline"), Description(**json.loads(text)))


def shape_input(df: DataFrame, about: Description) -> DataFrame:
    """Adds the model's input columns: numbers as doubles, text with its fill value."""
    missing = [c for c in about.features if c not in df.columns]
    if missing:
        raise DataError(f"missing features: {', '.join(missing)}")
    out = {f"__in_{c}": number(df, c) for c in about.numeric}
    out |= {f"__in_{c}": F.coalesce(col(c).cast("string"), F.lit(about.fills.get(c, ""))) for c in about.text}
    return df.withColumns(out)


def describe(df: DataFrame, features: Sequence[str], problem: str, algorithm: str, target: str | None) -> Description:
    """Which features are numbers, which are text; the rest is left out."""
    numeric = [c for c in features if is_number(type_of(df, c)) or is_flag(type_of(df, c))]
    text = [c for c in features if is_text(type_of(df, c))]
    if not numeric and not text:
        raise DataError("no numeric or text feature")
    fills = {c: str(most_frequent(df, c) or "") for c in text}
    return Description(problem, algorithm, [*numeric, *text], numeric, text, fills, target)


def preparation(df: DataFrame, about: Description, scaling: str = "standard") -> list:
    """Stages: median imputation and scaling for numbers, one-hot for text (any number of values)."""
    stages, parts = [], []
    if about.numeric:
        inputs = [f"__in_{c}" for c in about.numeric]
        filled = [f"__fill_{c}" for c in about.numeric]
        stages += [
            Imputer(strategy="median", inputCols=inputs, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="__numbers"),
        ]
        scalers = {
            "standard": lambda: StandardScaler(withMean=True, withStd=True, inputCol="__numbers", outputCol="__scaled"),
            "robust": lambda: RobustScaler(withCentering=True, withScaling=True, inputCol="__numbers", outputCol="__scaled"),
            "minmax": lambda: MinMaxScaler(inputCol="__numbers", outputCol="__scaled"),
        }
        kind = scaling.lower().replace("_", "").replace("scaler", "")
        if kind in scalers:
            stages.append(scalers[kind]())
        parts.append("__scaled" if kind in scalers else "__numbers")
    if about.text:
        codes, hot = [f"__code_{c}" for c in about.text], [f"__hot_{c}" for c in about.text]
        indexer = Dictionary()
        indexer._set(inputCols=[f"__in_{c}" for c in about.text], outputCols=codes)
        stages += [indexer, OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False, handleInvalid="keep")]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return stages


def _depth(p: dict) -> int:
    return min(30, int(p.get("max_depth") or DEFAULT_DEPTH))


def classifier(name: str, p: dict, rows: int, classes: int, width: int) -> tuple[Estimator, str | None]:
    """Estimator and a warning if the name is unknown."""
    cols = {"featuresCol": FEATURES, "labelCol": LABEL}
    trees = int(p.get("n_estimators", 100))
    warning = None
    many = classes > 2

    def wrap(e):
        return OneVsRest(classifier=e, featuresCol=FEATURES, labelCol=LABEL) if many else e

    if name == "decision_tree":
        est = DecisionTreeClassifier(maxDepth=_depth(p), seed=SEED, **cols)
    elif name == "gradient_boosting":
        est = wrap(GBTClassifier(maxIter=trees, stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth") or 3), seed=SEED, **cols))
    elif name == "logistic_regression":
        c = float(p.get("C", 1.0))
        est = LogisticRegression(
            regParam=1.0 / (c * max(1, rows)), elasticNetParam=0.0, standardization=False, maxIter=int(p.get("max_iter", 1000)), **cols
        )
    elif name == "naive_bayes":
        est = NaiveBayes(modelType="gaussian", **cols)
    elif name == "mlp":
        hidden = [int(h) for h in p.get("hidden_layer_sizes", (64, 32))]
        est = MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=int(p.get("max_iter", 500)), seed=SEED, **cols)
    elif name == "svm":
        est = wrap(
            LinearSVC(regParam=1.0 / (float(p.get("C", 1.0)) * max(1, rows)), maxIter=int(p.get("max_iter", 100)), **cols)
        )
    elif name in NEIGHBOR_NAMES:
        est = Neighbors(neighbors=int(p.get("n_neighbors", 5)), classes=classes, **cols)
    else:
        if name != "random_forest":
            warning = f"unknown algorithm {name!r}: random forest is used"
        est = RandomForestClassifier(numTrees=trees, maxDepth=_depth(p), seed=SEED, **cols)
    return est, warning


def regressor(name: str, p: dict, rows: int, spread: float) -> tuple[Estimator, str | None]:
    """``spread`` is the population standard deviation of the label (Spark rescales the label by it)."""
    cols = {"featuresCol": FEATURES, "labelCol": LABEL}
    trees = int(p.get("n_estimators", 100))
    warning = None
    if name == "linear_regression":
        est = LinearRegression(solver="auto", **cols)  # normal equations up to 4,096 features, else iterations
    elif name == "ridge":
        alpha = float(p.get("alpha", 1.0))
        est = LinearRegression(
            regParam=alpha * spread / max(1, rows), elasticNetParam=0.0, standardization=False, solver="auto", **cols
        )
    elif name == "lasso":
        est = LinearRegression(regParam=float(p.get("alpha", 0.1)), elasticNetParam=1.0, standardization=False, maxIter=1000, **cols)
    elif name == "decision_tree":
        est = DecisionTreeRegressor(maxDepth=_depth(p), seed=SEED, **cols)
    elif name == "gradient_boosting":
        est = GBTRegressor(maxIter=trees, stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth") or 3), seed=SEED, **cols)
    elif name in NEIGHBOR_NAMES:
        est = Neighbors(neighbors=int(p.get("n_neighbors", 5)), **cols)
    else:
        if name != "random_forest":
            warning = f"unknown algorithm {name!r}: random forest is used"
        est = RandomForestRegressor(numTrees=trees, maxDepth=_depth(p), seed=SEED, **cols)
    return est, warning


def clusterer(name: str, p: dict) -> tuple[Estimator, str | None]:
    k = int(p.get("n_clusters") or p.get("n_components") or 3)
    if name in ("gaussian_mixture", "gmm"):
        return GaussianMixture(k=k, seed=SEED, featuresCol=FEATURES), None
    if name == "dbscan":
        return Dbscan(eps=float(p.get("eps", 0.5)), minPoints=int(p.get("min_samples", 5)), featuresCol=FEATURES), None
    warning = None if name in ("kmeans", "k_means") else f"unknown algorithm {name!r}: k-means is used"
    return KMeans(k=k, seed=SEED, featuresCol=FEATURES), warning


def detector(name: str, p: dict) -> tuple[Estimator, str | None]:
    """Estimator of an anomaly model and a warning if the name is unknown."""
    given = {"featuresCol": FEATURES, "predictionCol": FLAG, "contamination": float(p.get("contamination", 0.05))}
    if name in ("lof", "local_outlier_factor"):
        return LocalOutlierFactor(neighbors=int(p.get("n_neighbors", 20)), **given), None
    if name in ("elliptic_envelope", "covariance"):
        return EllipticEnvelope(rounds=int(p.get("rounds", 4)), **given), None
    warning = None if name in ("isolation_forest", "forest") else f"unknown algorithm {name!r}: isolation forest is used"
    return IsolationForest(trees=int(p.get("n_estimators", 100)), sample=int(p.get("max_samples", 256)), **given), warning


def label_table(df: DataFrame, target: str) -> DataFrame:
    """``__value, __index``: the classes as text in ascending order, with their numbers; at least two."""
    values = df.select(col(target).cast("string").alias("__value")).dropna().distinct()
    found = stored(with_position(values, [], ["__value"], "__index").withColumn("__index", F.col("__index").cast("double")))
    if found.limit(2).count() < 2:
        raise DataError("the target needs at least two classes")
    return found


def decoded(df: DataFrame, labels: Sequence[str], index: str, name: str) -> DataFrame:
    """Adds the class with the number in ``index``.

    A classifier keeps weights per class on the driver, so the list of its classes is no longer than that; it may be broadcast.
    """
    table = df.sparkSession.createDataFrame(list(enumerate(labels)), f"__index int, `{name}` string")
    return df.join(F.broadcast(table), col(index).cast("int") == F.col("__index"), "left").drop("__index")


def train(
    df: DataFrame, features: Sequence[str], target: str | None = None, problem: str = "classification",
    algorithm: str = "random_forest", parameters: dict[str, Any] | None = None, scaling: str = "standard",
    key: str | None = None, test_share: float = 0.2,
) -> tuple[Model, DataFrame | None]:
    """Fit one model; returns it with the scored test rows (all rows for clusters and anomalies).

    Fill values, scales and categories are learned from the training rows only.
    """
    kind, p = problem_alias(problem), dict(parameters or {})
    require_rows(df)
    names = usable_features(df, features, target, kind in ("classification", "regression"))
    if kind == "anomaly_detection":
        about = describe(df, names, kind, algorithm, target)
        rows = shape_input(df, about)
        est, warning = detector(algorithm, p)
        pipeline = Pipeline(stages=[*preparation(df, about, scaling), est]).fit(rows)
        about.warnings = [warning] if warning else []
        scored = pipeline.transform(rows)
        about.metrics = anomaly_report(scored, FLAG, target).first().asDict() | {"contamination": est.value("contamination")}
        return Model(pipeline, about), scored
    if target is not None:
        df = df.where(col(target).isNotNull())
    if kind == "clustering":
        about = describe(df, names, kind, algorithm, target)
        rows = shape_input(df, about)
        est, warning = clusterer(algorithm, p)
        est._set(predictionCol="__cluster")
        pipeline = Pipeline(stages=[*preparation(df, about, scaling), est]).fit(rows)
        about.warnings = [warning] if warning else []
        return Model(pipeline, about), pipeline.transform(rows)
    if kind == "forecasting":
        raise DataError("a series is forecast by forecast() or run_plan(), not trained on rows")

    if key is None:
        df = df.withColumn("__key", F.xxhash64(*[col(c) for c in (*names, target)]))
        key = "__key"
    labels: list[str] = []
    if kind == "classification":
        table = label_table(df, target)
        df = df.join(table, col(target).cast("string") == F.col("__value")).withColumnRenamed("__index", LABEL).drop("__value")
        labels = [r["__value"] for r in table.orderBy("__index").collect()]
        marked = split(df, key, test_share, SEED, LABEL)
    else:
        df = df.withColumn(LABEL, number(df, target)).where(F.col(LABEL).isNotNull())
        marked = stored(split(df, key, test_share, SEED))  # as with classes, so that no pass repeats the work before it
    fit_raw, test_raw = marked.where(~F.col("is_test")), marked.where(F.col("is_test"))
    about = describe(fit_raw, names, kind, algorithm, target)
    about.labels = labels
    fit_rows, test_rows = shape_input(fit_raw, about), shape_input(test_raw, about)
    facts = fit_rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("s")).first()
    prepared = Pipeline(stages=preparation(fit_raw, about, scaling)).fit(fit_rows)
    ready = prepared.transform(fit_rows)
    if kind == "classification":
        width = ready.select(F.size(vector_to_array(F.col(FEATURES))).alias("w")).limit(1).collect()[0]["w"]
        est, warning = classifier(algorithm, p, facts["n"], len(about.labels), width)
    else:
        est, warning = regressor(algorithm, p, facts["n"], facts["s"] or 0.0)
    # Iterative fits read their input many times.
    kept = ready.select(FEATURES, LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = est.fit(kept)
    finally:
        kept.unpersist()
    about.warnings = [warning] if warning else []
    model = Model(PipelineModel(stages=[*prepared.stages, fitted]), about)
    scored = model.pipeline.transform(test_rows)
    if kind == "classification":
        scored = decoded(scored, about.labels, "prediction", "__decoded")
        metrics = class_metrics(scored, target, "__decoded").first().asDict()
        if len(about.labels) == 2 and "probability" in scored.columns:
            # the second label in order is the positive one
            ranked = scored.withColumn("__p", vector_to_array(F.col("probability"))[1])
            metrics |= roc_auc(ranked, target, "__p", about.labels[1]).first().asDict()
        model.report, model.confusion = class_report(scored, target, "__decoded"), confusion(scored, target, "__decoded")
    else:
        metrics = reg_metrics(scored, LABEL, "prediction").first().asDict()
    about.metrics = metrics | {"train_samples": facts["n"]}
    return model, scored


def run_plan(df: DataFrame, plan: Plan, date: str | None = None, series: Sequence[str] = (), key: str | None = None) -> Model | Forecast:
    """Do what an automatic plan says: train its model, or forecast its target over ``date`` (default: the first time column)."""
    if plan.problem_type != "forecasting":
        return train(df, plan.features, plan.target, plan.problem_type, plan.algorithm, plan.parameters, key=key)[0]
    dates = [date] if date else [c for c in df.columns if is_time(type_of(df, c)) and c != plan.target]
    values = [plan.target, *plan.features, *df.columns]
    target = next((c for c in values if c and c in df.columns and is_number(type_of(df, c)) and c not in series), None)
    if not dates or target is None:
        raise DataError("a forecast needs a time column and a number")
    return forecast(df, dates[0], target, series, plan.algorithm, trees=int(plan.parameters.get("n_estimators", 100)), aggregation="sum")


def feature_names(model: Model, places: Sequence[int]) -> dict[int, str]:
    """Names of positions of the feature vector: a number's column, or a text column with its value."""
    about = model.about
    coder = next((s for s in model.pipeline.stages if isinstance(s, DictionaryModel)), None)
    begin, owner = len(about.numeric), {}
    for i, size in enumerate(coder.facts["sizes"] if coder else []):
        # the values, the place of unseen ones, and the encoder's own place for invalid codes
        owner |= {p: (i, p - begin) for p in places if begin <= p < begin + size + 2}
        begin += size + 2
    values = coder.names_of(list(owner.values())) if coder else {}
    names = {p: about.numeric[p] for p in places if p < len(about.numeric)}
    return names | {p: f"{about.text[c]}_{values.get((c, code), '__unknown')}" for p, (c, code) in owner.items()}


def feature_importances(model: Model, scored: DataFrame, n: int | None = 20) -> DataFrame:
    """``feature, importance``: tree importances or mean absolute coefficients, largest first; the first ``n``, or all."""
    last = model.pipeline.stages[-1]
    if hasattr(last, "models"):  # one versus rest: the mean over the classes
        weights = [_weights(m) for m in last.models]
        values = [sum(w[i] for w in weights) / len(weights) for i in range(len(weights[0]))] if all(weights) else []
    else:
        values = _weights(last)
    best = sorted(range(len(values)), key=lambda i: (-values[i], i))[:n]
    names = feature_names(model, best)
    rows = sorted(((names.get(i, str(i)), round(float(values[i]), 4)) for i in best), key=lambda r: (-r[1], r[0]))
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double")


def _weights(stage) -> list[float]:
    if hasattr(stage, "featureImportances"):
        return [float(v) for v in stage.featureImportances.toArray()]
    if hasattr(stage, "coefficientMatrix"):
        return [float(v) for v in abs(stage.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(stage, "coefficients"):
        return [abs(float(v)) for v in stage.coefficients.toArray()]
    return []


def silhouette(scored: DataFrame, cluster: str = "__cluster") -> float | None:
    """Mean silhouette with squared Euclidean distance; None for a single cluster."""
    if scored.select(cluster).distinct().limit(2).count() < 2:
        return None
    score = ClusteringEvaluator(predictionCol=cluster, featuresCol=FEATURES, distanceMeasure="squaredEuclidean").evaluate(scored)
    return round(score, 4)


def cluster_report(model: Model, scored: DataFrame) -> DataFrame:
    return cluster_profile(scored, "__cluster", model.about.numeric)


def pca_2d(scored: DataFrame, shown: int | None = None) -> DataFrame:
    """Two principal components of the features; fitted on all rows."""
    model = PCA(k=2, inputCol=FEATURES, outputCol="__pca").fit(scored)
    parts = vector_to_array(F.col("__pca"))
    out = model.transform(scored).withColumns({"pc1": parts[0], "pc2": parts[1]}).drop("__pca")
    return out.limit(shown) if shown else out
