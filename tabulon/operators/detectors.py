"""Spark ML estimators for neighbours, density clusters and anomalies.

They take the feature vector that the preparation stages make (medians filled in, numbers scaled, categories
encoded), so they train, score, save and load like every other stage of a pipeline.  What a model learned from all
rows is a table next to its parameters; what is small whatever the data (a forest of sampled rows, a
covariance matrix, a cut) is kept with the metadata or read to the driver.

Rows with equal vectors get equal results, so distinct vectors are looked up and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml import Model as Fitted
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .anomaly import SAMPLE, forest_base, grow_forest, isolation_scores
from .density import dbscan_vectors
from .neighbors import MetricIndex, distinct_vectors, local_densities, nearest
from .ordering import with_position
from .quantiles import column_quantiles
from .stats import moments

SCORE = "anomaly_score"
VECTOR = "__vector"


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Parameters of all stages here; each uses some of them."""

    contamination = Param(Params._dummy(), "contamination", "share of the training rows beyond the cut", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "trees of the forest", TypeConverters.toInt)
    sample = Param(Params._dummy(), "sample", "rows per tree", TypeConverters.toInt)
    neighbors = Param(Params._dummy(), "neighbors", "neighbours per row", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "refits of the trimmed covariance", TypeConverters.toInt)
    eps = Param(Params._dummy(), "eps", "radius of a neighbourhood", TypeConverters.toFloat)
    minPoints = Param(Params._dummy(), "minPoints", "points of a dense neighbourhood", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes; 0 for a number as target", TypeConverters.toInt)

    def __init__(self, **values: Any):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", contamination=0.05, trees=100,
                         sample=SAMPLE, neighbors=5, rounds=4, eps=0.5, minPoints=5, classes=0)
        self._set(**{k: v for k, v in values.items() if v is not None})

    def value(self, name: str) -> Any:
        return self.getOrDefault(name)

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn(VECTOR, vector_to_array(F.col(self.value("featuresCol"))))


class _Writer(MLWriter):
    def __init__(self, instance: TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"facts": self.instance.facts, "tables": list(self.instance.tables)})
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(metadata["facts"], {n: self.sparkSession.read.parquet(f"{path}/{n}") for n in metadata["tables"]})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Fitted, _Shared, MLWritable, MLReadable):
    """A fitted stage: parameters, small facts and tables."""

    def __init__(self, facts: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.facts, self.tables, self._held = facts or {}, tables or {}, None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def like(self, other: _Shared) -> TableModel:
        return other._copyValues(self)

    def looked_up(self, df: DataFrame, find) -> DataFrame:
        """``df`` with the columns that ``find`` gives for its distinct vectors (``vector`` and the columns)."""
        rows = self.vectors(df)
        asked = rows.select(F.col(VECTOR).alias("vector")).distinct()
        found = find(asked).withColumnRenamed("vector", "__found")
        return rows.join(found, F.col(VECTOR) == F.col("__found"), "left").drop(VECTOR, "__found")


class _Stage(Estimator, _Shared, DefaultParamsWritable):
    """An estimator of this module; parameters are given by name."""


def index_tables(index: MetricIndex) -> dict[str, DataFrame]:
    """The index as tables: placed rows, and a row per pivot."""
    spark = index.placed.sparkSession
    pivots = [(i, c.tolist(), float(r), [float(g) for g in gaps], int(n))
              for i, (c, r, gaps, n) in enumerate(zip(index.centres, index.reach, index.inner, index.rows))]
    return {"placed": index.placed, "pivots": spark.createDataFrame(pivots, "cell int, centre array<double>, reach double, inner array<double>, rows long")}


def index_of(tables: dict[str, DataFrame]) -> MetricIndex:
    """The index back from its tables; its pivots are about the square root of the rows, at most ``PIVOT_NUMBERS`` numbers."""
    pivots = tables["pivots"].orderBy("cell").collect()
    return MetricIndex(tables["placed"], np.array([r["centre"] for r in pivots]), np.array([r["reach"] for r in pivots]),
                       np.array([r["inner"] for r in pivots]), np.array([r["rows"] for r in pivots], int))


# --- categories ---

class Dictionary(_Stage, HasInputCols, HasOutputCols):
    """Codes of text values: each column's distinct values in ascending order, as a table of any size."""

    def _fit(self, dataset: DataFrame) -> DictionaryModel:
        names = self.getInputCols()
        listed = dataset.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(names)])).alias("v"))
        values = listed.select("v.*").where("value is not null").distinct()
        coded = stored(with_position(values, ["column"], ["value"], "code"))
        sizes = {r["column"]: r["n"] for r in coded.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return DictionaryModel({"sizes": [sizes.get(i, 0) for i in range(len(names))]}, {"codes": coded}).like(self)


class DictionaryModel(TableModel, HasInputCols, HasOutputCols):
    """Adds the code of each value as a number; values that fitting has not met, and nulls, get the code after the last."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for i, (name, out) in enumerate(zip(self.getInputCols(), self.getOutputCols())):
            mine = self.tables["codes"].where(F.col("column") == i).select(F.col("value").alias("__value"), F.col("code").cast("double").alias("__code"))
            joined = dataset.join(mine, F.col(f"`{name}`") == F.col("__value"), "left")
            code = F.coalesce("__code", F.lit(float(self.facts["sizes"][i])))
            # the encoder after this stage reads the number of codes here, so that it does not depend on the rows it meets
            about = {"ml_attr": {"type": "nominal", "num_vals": self.facts["sizes"][i] + 1}}
            dataset = joined.withColumn(out, code).drop("__value", "__code").withMetadata(out, about)
        return dataset

    def names_of(self, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], str]:
        """Values of some (column, code) pairs."""
        if not wanted:
            return {}
        pairs = self.tables["codes"].sparkSession.createDataFrame(list(wanted), "column int, code long")
        return {(r["column"], r["code"]): r["value"] for r in self.tables["codes"].join(F.broadcast(pairs), ["column", "code"]).collect()}


# --- nearest neighbours ---

class Neighbors(_Stage):
    """k nearest neighbours: the majority class (``classes`` > 0), or the mean target."""

    def _fit(self, dataset: DataFrame) -> NeighborsModel:
        k = self.value("neighbors")
        rows = self.vectors(dataset).select(F.col(VECTOR).alias("vector"), F.col(self.value("labelCol")).cast("double").alias("label"))
        rows = stored(rows.withColumn("id", F.monotonically_increasing_id()))
        index = MetricIndex.build(distinct_vectors(rows, k), k)
        return NeighborsModel({"rows": rows.count()}, index_tables(index) | {"labels": rows.select("id", "label")}).like(self)


class NeighborsModel(TableModel):
    """Adds ``prediction`` and, for classes, ``probability`` (shares of the votes; the smallest class wins a tie)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k, classes = self.value("neighbors"), self.value("classes")
        self._held = self._held or index_of(self.tables)

        def find(asked: DataFrame) -> DataFrame:
            near = nearest(self.tables["placed"], asked.select("vector", F.col("vector").alias("qid")), k, index=self._held)
            voted = near.join(self.tables["labels"], "id").groupBy(F.col("qid").alias("vector"))
            if not classes:
                return voted.agg(F.avg("label").alias(self.value("predictionCol")))
            counted = voted.agg(F.collect_list(F.col("label").cast("int")).alias("votes"))  # k of them
            share = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.size(F.filter("votes", lambda v: v == c)) / F.size("votes"))
            return counted.withColumn("shares", share).select(
                "vector", (F.array_position("shares", F.array_max("shares")) - 1).cast("double").alias(self.value("predictionCol")),
                array_to_vector("shares").alias("probability"))

        return self.looked_up(dataset, find)


# --- density clusters ---

class Dbscan(_Stage):
    """Density clusters of the vectors, numbered by their smallest point; -1 is noise."""

    def _fit(self, dataset: DataFrame) -> DbscanModel:
        rows = self.vectors(dataset).select(F.col(VECTOR).alias("vector"))
        found = dbscan_vectors(rows, self.value("eps"), self.value("minPoints"))
        cores = stored(found.where("is_core").select("vector", "cluster").withColumn("id", F.monotonically_increasing_id()))
        index = MetricIndex.build(cores.select("id", "vector"), 1)
        return DbscanModel({}, index_tables(index) | {"labels": cores.select("id", "cluster")}).like(self)


class DbscanModel(TableModel):
    """The cluster of the nearest core point within ``eps``, else -1: for training rows the clusters found in fitting."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._held = self._held or index_of(self.tables)

        def find(asked: DataFrame) -> DataFrame:
            near = nearest(self.tables["placed"], asked.select("vector", F.col("vector").alias("qid")), 1, index=self._held)
            close = near.where(F.col("distance") <= self.value("eps")).join(self.tables["labels"], "id")
            return close.select(F.col("qid").alias("vector"), F.col("cluster").alias(self.value("predictionCol")))

        name = self.value("predictionCol")
        return self.looked_up(dataset, find).withColumn(name, F.coalesce(name, F.lit(-1)))


# --- anomalies ---

class _Detector(_Stage):
    """Fits scores (high: unusual) and the cut that ``contamination`` of the training rows exceed."""

    def _fit(self, dataset: DataFrame) -> AnomalyModel:
        model = self.learn(self.vectors(dataset)).like(self)
        scores = stored(model.scored(self.vectors(dataset)).select(SCORE))
        share = self.value("contamination")
        model.facts["cut"] = column_quantiles(scores, {SCORE: F.col(SCORE)}, [1 - share])[SCORE][0]
        low, high = scores.agg(F.min(SCORE), F.max(SCORE)).first()
        model.facts |= {"low": low, "high": high}
        return model

    def learn(self, rows: DataFrame) -> AnomalyModel:
        raise NotImplementedError


class AnomalyModel(TableModel):
    """Adds ``anomaly_score``, ``severity`` (0 to 1 between the lowest and the highest training score) and ``prediction``,
    1 beyond the cut of the training rows."""

    def scored(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.scored(self.vectors(dataset)).drop(VECTOR)
        low, high = self.facts["low"], self.facts["high"]
        spread = high - low if high is not None and high > low else None
        severity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(SCORE) - low) / spread)) if spread else F.lit(0.0)
        return out.withColumns({"severity": F.round(severity, 4), self.value("predictionCol"): F.coalesce(
            (F.col(SCORE) > F.lit(self.facts["cut"])).cast("double"), F.lit(0.0))})


class IsolationForest(_Detector):
    """Random trees over samples of ``sample`` rows; isolated rows have short paths."""

    def learn(self, rows: DataFrame) -> AnomalyModel:
        nodes = grow_forest(rows.select(F.col(VECTOR).alias("values")), self.value("trees"), self.value("sample"))
        return IsolationForestModel({"base": forest_base(rows, self.value("sample"))}, {"nodes": stored(nodes)})


class IsolationForestModel(AnomalyModel):
    def scored(self, rows: DataFrame) -> DataFrame:
        if self._held is None:  # trees x 2 x sample nodes at most
            self._held = [tuple(np.array(t[n]) for n in ("feature", "cut", "left", "right", "depth"))
                          for t in self.tables["nodes"].orderBy("tree").collect()]
        return rows.withColumn(SCORE, isolation_scores(self._held, self.facts["base"])(F.col(VECTOR)))


class EllipticEnvelope(_Detector):
    """Squared Mahalanobis distance from mean and covariance, refitted on the rows inside the cut."""

    def learn(self, rows: DataFrame) -> AnomalyModel:
        model = None
        rows = stored(rows.select(VECTOR))
        for _ in range(self.value("rounds")):
            inside = rows
            if model is not None:
                scores = model.scored(rows)
                cut = column_quantiles(scores, {SCORE: F.col(SCORE)}, [1 - self.value("contamination")])[SCORE][0]
                inside = scores.where(F.col(SCORE) <= F.lit(cut))
            n, mean, products = moments(inside, VECTOR)
            inverse = np.linalg.pinv(products / max(1, n))
            model = EllipticEnvelopeModel({"mean": mean.tolist(), "inverse": inverse.tolist()})
        return model


class EllipticEnvelopeModel(AnomalyModel):
    def scored(self, rows: DataFrame) -> DataFrame:
        mean, inverse = np.array(self.facts["mean"]), np.array(self.facts["inverse"])

        @F.pandas_udf("double")
        def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                x = np.array([np.asarray(v, float) for v in values]).reshape(len(values), len(mean)) - mean
                yield pd.Series(np.einsum("ij,jk,ik->i", x, inverse, x, optimize=True))

        return rows.withColumn(SCORE, distance(F.col(VECTOR)))


class LocalOutlierFactor(_Detector):
    """Density of the neighbours relative to the own density, over the table of training densities."""

    def learn(self, rows: DataFrame) -> AnomalyModel:
        k = self.value("neighbors")
        given = stored(rows.select(F.col(VECTOR).alias("vector"), F.monotonically_increasing_id().alias("id")))
        kept = stored(distinct_vectors(given, k + 1))
        index = MetricIndex.build(kept, k + 1)
        density = local_densities(kept, k, index=index)[1].select("id", "kdist", "lrd")
        return LocalOutlierFactorModel({}, index_tables(index) | {"density": density})


class LocalOutlierFactorModel(AnomalyModel):
    def scored(self, rows: DataFrame) -> DataFrame:
        k = self.value("neighbors")
        self._held = self._held or index_of(self.tables)
        asked = rows.select(F.col(VECTOR).alias("vector"), F.col(VECTOR).alias("qid")).distinct()
        near = nearest(self.tables["placed"], asked, k, index=self._held).join(self.tables["density"], "id")
        mine = 1 / (F.avg(F.greatest("distance", "kdist")) + 1e-10)
        found = near.groupBy(F.col("qid").alias("__found")).agg((F.avg("lrd") / mine).alias(SCORE))
        return rows.join(found, F.col(VECTOR) == F.col("__found"), "left").drop("__found")


