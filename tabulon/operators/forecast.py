"""Forecasts of many series at once from lag features.

Linear models are fitted per series from sums of products, which Spark adds up
before the shuffle; only a small matrix per series is solved in Python.  Tree
models are fitted over all series together.  The recursion into the future is
serial per series and needs one row per series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, half_even
from ..session import durable
from .metrics import reg_metrics
from .ordering import same, with_position
from .series import lag_names, last_values, momentum_forecast, prepare, series_step, ts_features

SEED = 42
# Rows a technique needs.
MIN_ROWS = {
    "linear_trend": 10, "ridge_trend": 20, "random_forest_forecast": 30, "gradient_boosting_forecast": 30,
    "knn_forecast": 20, "moving_average": 5,
}
STEP_DOWN = ("ridge_trend", "linear_trend", "moving_average")  # what a series gets that is too short for its technique
LINEAR = ("linear_trend", "ridge_trend", "moving_average")
TREES = ("random_forest_forecast", "gradient_boosting_forecast")
MIN_PREPARED = 5


def pick_forecaster(df: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """``series, rows, technique, lag_window`` by the number of rows."""
    n = F.col("rows")
    return df.groupBy(*[col(k) for k in series]).agg(F.count(F.lit(1)).alias("rows")).select(
        *[col(k) for k in series], "rows",
        F.when(n >= 50, "gradient_boosting_forecast").when(n >= 20, "random_forest_forecast").otherwise("linear_trend").alias("technique"),
        F.when(n >= 50, 7).when(n >= 20, 5).otherwise(3).alias("lag_window"),
    )


def route_series(df: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """``series, rows, technique, lag_window, status``: the forecaster that each series' rows allow.

    ``fitted``: the one that ``pick_forecaster`` names; ``stepped_down``: the best of a few simpler ones, as
    the series has fewer rows than the named one needs; ``too_few_rows``: none, so recent momentum is extrapolated.
    """
    picked = pick_forecaster(df, series)
    least = F.create_map(*[F.lit(x) for pair in MIN_ROWS.items() for x in pair])
    lower = F.lit("momentum")
    for name in reversed(STEP_DOWN):
        lower = F.when(F.col("rows") >= MIN_ROWS[name], name).otherwise(lower)
    # the linear models read lags as well: with fewer than MIN_PREPARED rows behind the lags nothing is fitted
    used = F.greatest(F.lit(1), F.least(F.col("lag_window"), F.floor(F.col("rows") / 3).cast("int")))
    lower = F.when(F.col("rows") - used >= MIN_PREPARED, lower).otherwise("momentum")
    fits = (F.col("rows") >= F.element_at(least, F.col("technique"))) & (F.col("rows") - used >= MIN_PREPARED)
    routed = picked.withColumn("__fits", fits).withColumn("technique", F.when(F.col("__fits"), F.col("technique")).otherwise(lower))
    status = F.when(F.col("__fits"), "fitted").when(F.col("technique") == "momentum", "too_few_rows").otherwise("stepped_down")
    return routed.withColumn("status", status).drop("__fits")


def forecast_auto(
    df: DataFrame, date: str, target: str, series: Sequence[str] = (), horizon: int = 12, aggregation: str | None = None,
    trees: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """``(future, routes)``: every series forecast by the technique its row count allows, none left out.

    ``future`` is ``series, step, date, predicted, technique, status``; ``routes`` is what ``route_series`` says.
    One pass per technique that occurs (seven at most), over its series only.
    """
    key = list(series)
    if not key:
        df, key = df.withColumn("__series", F.lit("all")), ["__series"]
    ready = durable(prepare(df, date, target, key, aggregation))
    routes = durable(route_series(ready, key))
    kinds = sorted((r[0], r[1]) for r in routes.select("technique", "lag_window").distinct().collect())
    parts = []
    for technique, lag_window in kinds:
        mine = routes.where((F.col("technique") == technique) & (F.col("lag_window") == lag_window)).select(*[col(k) for k in key])
        rows = same(ready, mine, key)
        if technique == "momentum":
            ahead = momentum_forecast(rows, date, target, key, horizon)
            last = rows.groupBy(*[col(k) for k in key]).agg(F.max(col(date)).alias("last_date"))
            dated = same(same(ahead, last, key), series_step(rows, date, key), key)
            when = F.timestamp_micros((F.unix_micros(F.col("last_date").cast("timestamp")) + F.col("step_seconds") * 1e6 * F.col("step")).cast("long"))
            future = dated.withColumn("date", F.date_format(when, "yyyy-MM-dd"))
        else:
            future = forecast(rows, date, target, key, technique, horizon, lag_window, None, trees=trees).future
        parts.append(future.select(*[col(k) for k in key], "step", "date", F.col("predicted").cast("double").alias("predicted")))
    if not parts:
        parts = [ready.limit(0).select(*[col(k) for k in key], F.lit(0).alias("step"), F.lit("").alias("date"), F.lit(0.0).alias("predicted"))]
    future = parts[0]
    for more in parts[1:]:
        future = future.unionByName(more)
    future = same(future, routes.drop("rows", "lag_window"), key)
    return (future, routes) if series else (future.drop("__series"), routes.drop("__series"))


class Forecast:
    """Fitted rows, metrics and future of a set of series; ``status`` has a row for every series."""

    def __init__(self, fitted: DataFrame, future: DataFrame, date: str, target: str, series: Sequence[str], status: DataFrame | None = None):
        self.fitted, self.future, self.status = fitted, future, status
        self.date, self.target, self.series = date, target, list(series)

    def actual_vs_predicted(self) -> DataFrame:
        """``series, date, actual, predicted, split`` for every prepared row (2 places)."""
        return self.fitted.select(
            *[col(k) for k in self.series], F.date_format(col(self.date), "yyyy-MM-dd").alias("date"),
            half_even(col(self.target), 2).alias("actual"), half_even(F.col("predicted"), 2).alias("predicted"), "split",
        )

    def metrics(self) -> DataFrame:
        """Test metrics per series, MAPE included."""
        test = self.fitted.where(F.col("split") == "test")
        return reg_metrics(test, self.target, "predicted", self.series, with_mape=True)


def forecast(
    df: DataFrame, date: str, target: str, series: Sequence[str] = (), technique: str = "linear_trend", horizon: int = 12,
    lag_window: int = 7, aggregation: str | None = None, alpha: float = 1.0, trees: int = 100,
    population_std: bool = False,
) -> Forecast:
    """Fit and extrapolate every series.

    Series with fewer than five prepared rows cannot be fitted: ``status`` says ``too_few_rows`` for them, and
    ``below_minimum`` for those that are fitted with fewer rows than the technique should have.  The rolling deviation of
    the future steps is the sample one, as in training, unless ``population_std``.
    """
    key = list(series)
    if not key:
        df, key = df.withColumn("__series", F.lit("all")), ["__series"]
    # Features are used by the fit, the predictions and the tails: keep one durable copy.
    ready = durable(ts_features(df, date, target, key, lag_window, aggregation))
    enough = F.col("n") - F.col("lag_used") >= MIN_PREPARED
    minimum = MIN_ROWS.get(technique, 0)
    status = ready.groupBy(*[col(k) for k in key]).agg(F.first("n").alias("rows"), F.first(enough).alias("__enough")).withColumn(
        "status", F.when(~F.col("__enough"), "too_few_rows").when(F.col("rows") < minimum, "below_minimum").otherwise("fitted")).drop("__enough")
    ready = ready.where(enough)
    names = lag_names(lag_window)
    tails = last_values(ready, "pos", "scaled", key, lag_window)
    facts = ready.groupBy(*[col(k) for k in key]).agg(
        F.max(col(date)).alias("last_date"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("n").alias("n"),
        F.first("lag_used").alias("lag_used"),
    )
    steps = series_step(ready.select(*[col(k) for k in key], col(date)), date, key)
    state = same(same(facts, tails, key), steps, key)
    prepared = ready.where(F.col("split").isNotNull())
    if technique in LINEAR:
        weights = _fit_linear(prepared, names, key, alpha if technique == "ridge_trend" else 0.0)
        fitted = _predict_linear(prepared, weights, names, key)
        future = _roll_linear(same(state, weights, key), key, lag_window, horizon, population_std)
    elif technique in TREES:
        fitted, future = _trees(prepared, state, names, key, technique, trees, lag_window, horizon)
    elif technique == "knn_forecast":
        fitted, future = _neighbours(prepared, state, names, key, lag_window, horizon)
    else:
        raise ValueError(f"unknown technique: {technique}")
    if not series:
        fitted, future, status = fitted.drop("__series"), future.drop("__series"), status.drop("__series")
    return Forecast(fitted, future, date, target, series, status)


def _restore(df: DataFrame, scaled: str = "p") -> DataFrame:
    return df.withColumn("predicted", F.col(scaled) * (F.col("high") - F.col("low")) + F.col("low"))


def _fit_linear(prepared: DataFrame, names: list[str], key: list[str], alpha: float) -> DataFrame:
    """``key, weights``: intercept first.  One aggregate of products, then a small solve per series."""
    wide = ["1.0D", *[f"`{n}`" for n in names], "scaled"]
    size = len(names) + 1
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    products = ", ".join([f"sum({wide[i]} * {wide[j]})" for i, j in cells] + [f"sum({w} * scaled)" for w in wide[:-1]])
    sums = prepared.where(F.col("split") == "train").groupBy(*[col(k) for k in key]).agg(F.expr(f"array({products})").alias("sums"))
    kept = len(cells)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sums in batch["sums"]:
                v = np.asarray(sums, dtype=float)
                a = np.zeros((size, size))
                for (i, j), x in zip(cells, v[:kept]):
                    a[i, j] = a[j, i] = x
                b = v[kept:]
                # Centre, so that the penalty leaves the intercept alone; least norm where columns depend.
                n, mean = a[0, 0], a[0, 1:] / a[0, 0]
                cov = a[1:, 1:] - n * np.outer(mean, mean)
                rhs = b[1:] - mean * b[0]
                w = np.linalg.pinv(cov + alpha * np.eye(size - 1), rcond=1e-10, hermitian=True) @ rhs
                out.append([b[0] / n - float(mean @ w), *w])
            yield batch.drop(columns="sums").assign(weights=out)

    schema = T.StructType([*[f for f in sums.schema.fields if f.name in key], T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return sums.mapInPandas(solve, schema)


def _predict_linear(prepared: DataFrame, weights: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    joined = same(prepared, weights, key)
    terms = " + ".join(["weights[0]"] + [f"weights[{i + 1}] * `{n}`" for i, n in enumerate(names)])
    return _restore(joined.withColumn("p", F.expr(terms))).drop("weights", "p")


def _future_features(recent: np.ndarray, used: np.ndarray, when: pd.DatetimeIndex, step: int, lag_window: int, ddof: int) -> np.ndarray:
    """Feature rows of one step for many series: the same columns as in training."""
    rows, length = recent.shape
    parts = [np.where(used >= i, recent[:, length - i], 0.0) for i in range(1, lag_window + 1)]
    if lag_window >= 3:
        last3 = recent[:, -3:]
        parts += [np.where(used >= 3, last3.mean(axis=1), 0.0), np.where(used >= 3, last3.std(axis=1, ddof=ddof), 0.0)]
    if lag_window >= 7:
        parts.append(np.where(used >= 7, recent[:, -7:].mean(axis=1), 0.0))
    parts += [when.month / 12.0, when.dayofweek / 6.0, when.dayofyear / 365.0, np.full(rows, 1.0 + 0.01 * step)]
    return np.column_stack([np.asarray(x, dtype=float) for x in parts])


def _roll_linear(state: DataFrame, key: list[str], lag_window: int, horizon: int, population_std: bool) -> DataFrame:
    """Recursive steps for all series of a batch at once."""
    key_fields = [f for f in state.schema.fields if f.name in key]
    names = [f.name for f in key_fields]
    ddof = 0 if population_std else 1

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            recent = np.array([([0.0] * lag_window + list(r))[-lag_window:] for r in batch["recent"]], dtype=float)
            weights = np.array([list(w) for w in batch["weights"]], dtype=float)
            used = batch["lag_used"].to_numpy()
            start = pd.DatetimeIndex(pd.to_datetime(batch["last_date"]))
            gap = pd.to_timedelta(batch["step_seconds"].to_numpy(), unit="s")
            low, high = batch["low"].to_numpy(), batch["high"].to_numpy()
            for step in range(1, horizon + 1):
                when = start + gap * step
                x = _future_features(recent, used, when, step, lag_window, ddof)
                p = weights[:, 0] + (weights[:, 1:] * x).sum(axis=1)
                recent = np.column_stack([recent[:, 1:], p])
                out = batch[names].copy()
                out["step"] = step
                out["date"] = when.strftime("%Y-%m-%d")
                out["predicted"] = p * (high - low) + low
                yield out

    schema = T.StructType(
        [*key_fields, T.StructField("step", T.IntegerType()), T.StructField("date", T.StringType()), T.StructField("predicted", T.DoubleType())]
    )
    return state.mapInPandas(roll, schema).withColumn("predicted", half_even(F.col("predicted"), 2))


def _step_columns(state: DataFrame, step: int, lag_window: int) -> DataFrame:
    """Feature columns of one future step from the recent values."""
    r = F.col("recent")
    wide = {}
    for i in range(1, lag_window + 1):
        wide[f"lag_{i}"] = F.when(F.col("lag_used") >= i, F.coalesce(F.try_element_at(r, F.lit(-i)), F.lit(0.0))).otherwise(0.0)

    def over(k, how):
        past = F.array(*[F.coalesce(F.try_element_at(r, F.lit(-i)), F.lit(0.0)) for i in range(1, k + 1)])
        mean = F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / k
        if how == "mean":
            return F.when(F.col("lag_used") >= k, mean).otherwise(0.0)
        squares = F.aggregate(past, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.when(F.col("lag_used") >= k, F.sqrt(squares / (k - 1))).otherwise(0.0)

    if lag_window >= 3:
        wide |= {"rolling_mean_3": over(3, "mean"), "rolling_std_3": over(3, "std")}
    if lag_window >= 7:
        wide["rolling_mean_7"] = over(7, "mean")
    when = F.timestamp_micros(
        (F.unix_micros(F.col("last_date").cast("timestamp")) + F.col("step_seconds") * 1e6 * step).cast("long")
    )
    wide |= {
        "month_part": F.month(when) / 12.0, "weekday_part": F.weekday(when) / 6.0, "yearday_part": F.dayofyear(when) / 365.0,
        "time_index": F.lit(1.0 + 0.01 * step), "__when": F.date_format(when, "yyyy-MM-dd"), "__step": F.lit(step),
    }
    return state.withColumns(wide)


def _unroll(state: DataFrame, key: list[str], horizon: int, lag_window: int, predict) -> DataFrame:
    """Step by step for all series; each step appends its prediction to the recent values."""
    now = durable(state.withColumn("made", F.array().cast("array<struct<step:int,date:string,p:double>>")))
    base = now.columns
    for step in range(1, horizon + 1):
        scored = predict(_step_columns(now, step, lag_window))
        made = F.concat("made", F.array(F.struct(F.col("__step").alias("step"), F.col("__when").alias("date"), F.col("p").alias("p"))))
        scored = scored.withColumn("made", made).withColumn("recent", F.concat("recent", F.array("p"))).select(*[col(c) for c in base])
        now = durable(scored)  # one small row per series
    out = now.select(*[col(k) for k in key], "low", "high", F.explode("made").alias("m"))
    return _restore(out.select(*[col(k) for k in key], "low", "high", "m.*")).select(
        *[col(k) for k in key], "step", "date", half_even(F.col("predicted"), 2).alias("predicted")
    )


def _trees(prepared, state, names, key, technique, trees, lag_window, horizon):
    """One model over all series with the series number, its place in the order of names, as a feature.

    The numbers are a table that is joined, so no list of names reaches the driver.
    """
    label = F.concat_ws("|", *[col(k).cast("string") for k in key])
    names_of = prepared.select(*[col(k) for k in key]).distinct().withColumn("__label", label)
    numbers = durable(with_position(names_of, [], ["__label"], "__code").drop("__label").withColumn("__code", F.col("__code").cast("double")))

    def coded(df):
        return same(df, numbers, key)

    assembler = VectorAssembler(inputCols=[*names, "__code"], outputCol="__x")
    train = assembler.transform(coded(prepared.where(F.col("split") == "train")))
    common = {"featuresCol": "__x", "labelCol": "scaled", "predictionCol": "p", "seed": SEED}
    if technique == "random_forest_forecast":
        model = RandomForestRegressor(numTrees=trees, maxDepth=10, **common).fit(train)
    else:
        model = GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, **common).fit(train)

    def predict(df):
        return model.transform(assembler.transform(coded(df))).drop("__x", "__code")

    return _restore(predict(prepared)).drop("p"), _unroll(state, key, horizon, lag_window, predict)


def _neighbours(prepared, state, names, key, lag_window, horizon, k: int = 5):
    """Mean of the five nearest training rows of the same series."""
    from .neighbors import nearest

    vector = F.array(*[col(n).cast("double") for n in names])
    train = prepared.where(F.col("split") == "train").select(
        *[col(c) for c in key], F.col("pos").alias("id"), vector.alias("vector"), "scaled"
    )

    def predict(df, ident):
        queries = df.select(*[col(c) for c in key], ident.alias("qid"), vector.alias("vector"))
        near = nearest(train.drop("scaled"), queries, k, "id", "qid", by=key)
        found = same(near.withColumnRenamed("id", "nid"), train.select(*[col(c) for c in key], F.col("id").alias("nid"), F.col("scaled")), [*key, "nid"])
        means = found.groupBy(*[col(c) for c in key], "qid").agg(F.avg("scaled").alias("p"))
        return same(df.withColumn("qid", ident), means, [*key, "qid"]).drop("qid")

    fitted = _restore(predict(prepared, F.col("pos"))).drop("p")
    return fitted, _unroll(state, key, horizon, lag_window, lambda df: predict(df, F.lit(0).cast("long")))
