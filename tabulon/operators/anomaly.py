"""Anomaly scores: isolation forest, elliptic envelope, local outlier factor."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, number, number_sql
from ..session import stored
from .metrics import severity
from .neighbors import local_outlier_factor
from .ordering import first_per_group
from .quantiles import column_quantiles

SAMPLE = 256
EULER = 0.5772156649015329
NODES = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _tree_samples(df: DataFrame, key: str, columns: Sequence[str], trees: int, sample: int) -> DataFrame:
    """``tree, values``: about ``sample`` rows per tree, drawn by a hash of the key.

    A row is copied only to the trees whose hash it wins, so little more than the
    samples themselves is shuffled.
    """
    rows = df.count()
    share = min(1.0, 2.0 * sample / max(1, rows) + 0.0)
    limit = int(share * 2**31)
    picks = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(col(key), t), F.lit(2**31)) < limit
    )
    drawn = df.select(col(key), F.array(*[F.coalesce(number(df, c), F.lit(0.0)) for c in columns]).alias("values"), picks.alias("trees"))
    drawn = drawn.select(col(key), "values", F.explode("trees").alias("tree"))
    return first_per_group(drawn, ["tree"], [F.xxhash64(col(key), F.col("tree"))], sample).select("tree", "values")


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    """One tree from at most ``SAMPLE`` rows, as parallel node lists."""
    x = np.array([np.asarray(v, dtype=float) for v in frame["values"]])
    tree = int(frame["tree"].iloc[0])
    rng = np.random.default_rng(42 + tree)
    deepest = math.ceil(math.log2(max(2, len(x))))
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        for store, value in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (depth, level + _mean_path(len(rows)))):
            store.append(value)
        spans = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.nonzero(spans > 0)[0]
        if level >= deepest or len(rows) <= 1 or not len(usable):
            return at
        f = int(rng.choice(usable))
        low, high = x[rows, f].min(), x[rows, f].max()
        value = float(rng.uniform(low, high))
        below = x[rows, f] <= value
        feature[at], cut[at] = f, value
        left[at] = node(rows[below], level + 1)
        right[at] = node(rows[~below], level + 1)
        return at

    node(np.arange(len(x)), 0)
    return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut], "left": [left], "right": [right], "depth": [depth]})


def isolation_forest(
    df: DataFrame, columns: Sequence[str], key: str, trees: int = 100, contamination: float = 0.05, sample: int = SAMPLE
) -> DataFrame:
    """Adds ``score`` (near 1 = isolated), ``is_anomaly`` and ``severity``.

    ``key`` is unique per row.  The forest has ``trees`` x 2 x ``sample`` nodes at most,
    whatever the size of the data, so it travels with the task.
    """
    grown = _tree_samples(df, key, columns, trees, sample).groupBy("tree").applyInPandas(_grow, NODES).orderBy("tree").collect()
    forest = [tuple(np.array(t[n]) for n in ("feature", "cut", "left", "right", "depth")) for t in grown]
    values = F.array(*[F.coalesce(number(df, c), F.lit(0.0)) for c in columns])
    return flag_by_share(df.withColumn("score", isolation_scores(forest, forest_base(df, sample))(values)), "score", contamination)


def grow_forest(rows: DataFrame, trees: int, sample: int) -> DataFrame:
    """A row of node lists per tree, from the arrays in ``values``; rows are drawn one by one, copies included."""
    keyed = rows.withColumn("__key", F.xxhash64("values", F.monotonically_increasing_id()))
    share = min(1.0, 2.0 * sample / max(1, rows.count()))
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("__key", t), F.lit(2**31)) < int(share * 2**31))
    drawn = keyed.select("__key", "values", F.explode(picks).alias("tree"))
    samples = first_per_group(drawn, ["tree"], [F.xxhash64("__key", "tree")], sample).select("tree", "values")
    return samples.groupBy("tree").applyInPandas(_grow, NODES)


def forest_base(rows: DataFrame, sample: int) -> float:
    """Path length that a score of one half stands for."""
    return _mean_path(min(sample, max(2, rows.limit(sample).count())))


def isolation_scores(forest: list[tuple[np.ndarray, ...]], base: float):
    """A column function: isolation score (near 1: isolated) of an array of numbers."""

    # A leaf leads to itself, so all rows take the same number of steps: as many as the tree has levels.
    trees = []
    for feature, cut, left, right, depth in forest:
        leaf, own = feature < 0, np.arange(len(feature))
        next_node = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel()
        levels, at = 0, np.zeros(1, dtype=np.int64)
        while not leaf[at].all():
            levels, at = levels + 1, np.unique(np.concatenate([next_node[2 * at], next_node[2 * at + 1]]))
        trees.append((np.where(leaf, 0, feature), np.where(leaf, np.inf, cut), next_node, depth, levels))

    @F.pandas_udf("double")
    def isolate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            x = np.array([np.asarray(v, dtype=float) for v in values])
            total, row, flat = np.zeros(len(x)), np.arange(len(x)), x.T.ravel()
            for feature, cut, next_node, depth, levels in trees:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(levels):
                    down = flat.take(feature.take(at) * len(x) + row) <= cut.take(at)
                    at = next_node.take(2 * at + down)
                total += depth[at]
            yield pd.Series(np.power(2.0, -total / (len(forest) * base)) if len(x) else np.array([]))

    return isolate


def flag_by_share(scored: DataFrame, score: str, contamination: float) -> DataFrame:
    """Adds ``is_anomaly`` for the given share of the highest scores, and ``severity``."""
    kept = stored(scored.select(col(score), (-col(score)).alias("__raw")))  # read by every pass of the quantile
    cut = column_quantiles(kept, {score: col(score)}, [1 - contamination])[score][0]
    flagged = scored.withColumn("is_anomaly", F.coalesce(col(score) > F.lit(cut), F.lit(False)))
    return severity(flagged.withColumn("__raw", -col(score)), "__raw", kept).drop("__raw")


def elliptic_envelope(df: DataFrame, columns: Sequence[str], contamination: float = 0.05, rounds: int = 4) -> DataFrame:
    """Adds ``score`` (squared Mahalanobis distance from a trimmed fit), ``is_anomaly`` and ``severity``.

    Each round refits mean and covariance on the rows inside the (1 - contamination)
    quantile; only sums leave the executors.
    """
    names = list(columns)
    value = [f"coalesce({number_sql(df, c)}, 0.0D)" for c in names]
    inside, distance = None, None
    for _ in range(rounds):
        rows = df if inside is None else df.where(F.expr(inside))
        aggs = [f"avg({v})" for v in value]
        aggs += [f"covar_pop({value[i]}, {value[j]})" for i in range(len(names)) for j in range(i, len(names))]
        got = list(rows.selectExpr(*aggs).first())
        mean, flat = got[: len(names)], got[len(names) :]
        cov = np.zeros((len(names), len(names)))
        for (i, j), c in zip([(i, j) for i in range(len(names)) for j in range(i, len(names))], flat):
            cov[i, j] = cov[j, i] = c
        inverse = np.linalg.pinv(cov)
        centred = [f"({v} - {float(m)!r}D)" for v, m in zip(value, mean)]
        distance = " + ".join(
            f"{float(inverse[i, j])!r}D * {centred[i]} * {centred[j]}" for i in range(len(names)) for j in range(len(names))
        )
        cut = column_quantiles(df, {"d": F.expr(distance)}, [1 - contamination])["d"][0]
        inside = f"({distance}) <= {float(cut)!r}D"
    return flag_by_share(df.withColumn("score", F.expr(distance)), "score", contamination)


def lof_anomalies(df: DataFrame, columns: Sequence[str], key: str, k: int = 20, contamination: float = 0.05) -> DataFrame:
    """Adds ``score`` (local outlier factor), ``is_anomaly`` and ``severity``."""
    vector = F.array(*[F.coalesce(number(df, c), F.lit(0.0)) for c in columns])
    lof = stored(local_outlier_factor(df.select(col(key).alias("id"), vector.alias("vector")), k))
    # a row per key: merged, so that the driver never holds it for a broadcast
    found = lof.select(F.col("id").alias(key), F.col("lof").alias("score")).hint("merge")
    return flag_by_share(df.join(found, key, "left"), "score", contamination)
