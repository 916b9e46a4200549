"""Neighbours, density clusters and anomaly models through train, score and evaluate."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_neighbors_density import brute_dbscan

from tabulon.operators.density import dbscan_vectors
from tabulon.operators.models import FLAG, Model, train
from tabulon.operators.neighbors import MetricIndex, distinct_vectors, nearest
from tabulon.operators.scoring import evaluate, score
from tabulon.operators.stats import moments, split


def readings(spark, n=240):
    rng = np.random.default_rng(7)
    data = [(i, float(a), float(b), "x" if i % 2 else "y", "ok") for i, (a, b) in enumerate(np.round(rng.normal((50, 5), (4, 0.5), (n, 2)), 4))]
    data += [(n + i, 50.0 + 40 * (-1) ** i, 5.0 + 4 * (-1) ** (i // 2), "x", "fraud") for i in range(8)]
    data.append((n + 8, None, 5.0, "y", "churn"))
    return spark.createDataFrame(data, "id long, heat double, load double, kind string, truth string")


@pytest.mark.parametrize("name", ["isolation_forest", "lof", "elliptic_envelope", "nonsense"])
def test_anomaly_models_end_to_end(spark, tmp_path, name):
    df = readings(spark)
    model, scored = train(df, ["heat", "load"], "truth", "anomaly_detection", name, {"contamination": 0.05, "n_estimators": 30})
    assert bool(model.about.warnings) == (name == "nonsense")
    facts = model.about.metrics
    assert facts["rows"] == 249 and 8 <= facts["anomalies"] <= 13 and facts["tp"] == 8
    model.save(spark, f"{tmp_path}/m")
    again = Model.load(spark, f"{tmp_path}/m")
    fresh = spark.createDataFrame([(1, 51.0, 5.1, "x", "no"), (2, 500.0, 40.0, "y", "outlier"), (3, None, None, "x", "churn"), (3, None, None, "x", "churn")],
                                  "id long, heat double, load double, kind string, truth string")
    for use in (model, again):
        out = score(fresh, use)
        assert out.columns[-2:] == ["__ml_prediction", "__ml_severity"]
        assert sorted((r["id"], r["__ml_prediction"]) for r in rows(out)) == [(1, "Normal"), (2, "Anomaly"), (3, "Normal"), (3, "Normal")]
        assert max(r["__ml_severity"] for r in rows(out)) > 0.9  # isolation has no order far outside
    judged = evaluate(score(df, again), again).first()
    assert (judged["tp"], judged["fn"]) == (8, 0) and judged["recall"] == 1.0  # "churn" counts in training only
    assert score(fresh.limit(0), again).count() == 0


def scaled(x, fit=None):
    fit = x if fit is None else fit
    return (x - fit.mean(axis=0)) / fit.std(axis=0, ddof=1)


def test_outlier_factor_of_new_rows_equals_brute_force(spark):
    df = readings(spark).where("heat is not null")
    model, _ = train(df, ["heat", "load"], None, "anomaly", "lof", {"n_neighbors": 10})
    seen = np.array([(r["heat"], r["load"]) for r in rows(df.orderBy("id"))])
    new = np.array([[50.0, 5.0], [70.0, 5.5], [44.0, 4.2], seen[3]])
    fit, ask = scaled(seen), scaled(new, seen)
    d = np.sqrt(((fit[:, None] - fit[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :10]
    gaps = np.take_along_axis(d, order, axis=1)
    far = gaps.max(axis=1)
    lrd = 1 / (np.maximum(gaps, far[order]).mean(axis=1) + 1e-10)
    want = []
    for point in ask:
        e = np.sqrt(((fit - point) ** 2).sum(axis=1))
        o = np.argsort(e, kind="stable")[:10]
        want.append(lrd[o].mean() * (np.maximum(e[o], far[o]).mean() + 1e-10))
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(new)], "id long, heat double, load double")
    from tabulon.operators.models import shape_input
    got = rows(model.pipeline.transform(shape_input(asked, model.about)).orderBy("id"))
    assert np.allclose([r["anomaly_score"] for r in got], want)


def test_neighbour_models_equal_brute_force(spark, tmp_path):
    df = readings(spark).where("heat is not null").withColumn("size", F.col("heat") * 2 + F.col("load"))
    model, _ = train(df, ["heat", "load"], "size", "regression", "knn", {"n_neighbors": 3}, key="id")
    fit = np.array([(r["heat"], r["load"], r["size"]) for r in rows(split(df, "id").where("not is_test").orderBy("id"))])
    every = np.array([(r["heat"], r["load"]) for r in rows(df.orderBy("id"))])
    near = np.argsort(((scaled(every, fit[:, :2])[:, None] - scaled(fit[:, :2])[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :3]
    model.save(spark, f"{tmp_path}/m")
    got = rows(score(df, Model.load(spark, f"{tmp_path}/m")).orderBy("id"))
    assert np.allclose([r["__ml_prediction"] for r in got], fit[near, 2].mean(axis=1))
    voted, scored = train(df, ["heat", "load"], "kind", "classification", "knn", {"n_neighbors": 5}, key="id")
    assert not voted.about.warnings and scored.count() == voted.about.metrics["samples"]
    shares = {r["__ml_confidence"] for r in rows(score(df, voted))}
    assert shares <= {60.0, 80.0, 100.0}


def test_dbscan_model_scales_and_assigns_new_rows(spark, tmp_path):
    df = readings(spark)
    model, scored = train(df, ["heat", "load"], None, "clustering", "dbscan", {"eps": 0.4, "min_samples": 5})
    assert not model.about.warnings
    filled = np.array([(r["heat"] if r["heat"] is not None else np.nan, r["load"]) for r in rows(df.orderBy("id"))])
    filled[np.isnan(filled[:, 0]), 0] = np.nanpercentile(filled[:, 0], 50, method="lower")
    core, label, d = brute_dbscan(scaled(filled), 0.4, 5)
    mine = np.array([r["__cluster"] for r in rows(scored.orderBy("id"))])
    pairs = set(zip(mine[core], label[core]))
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    assert ((mine >= 0) == ((d <= 0.4) & core[None, :]).any(axis=1)).all()
    model.save(spark, f"{tmp_path}/m")
    out = rows(score(spark.createDataFrame([(50.0, 5.0), (900.0, 5.0)], "heat double, load double"), Model.load(spark, f"{tmp_path}/m")))
    assert [r["__ml_prediction"] for r in out] == ["Cluster 0", "Cluster -1"]


@pytest.mark.parametrize("dims,eps", [(1, 0.02), (2, 0.12), (3, 0.3), (5, 0.9)])
def test_dbscan_in_any_dimensions(spark, dims, eps):
    rng = np.random.default_rng(dims)
    x = np.round(np.concatenate([rng.normal(c, 0.25, (120, dims)) for c in (0, 1.5)] + [rng.uniform(-1, 3, (60, dims))]), 3)
    frame = spark.createDataFrame([([float(v) for v in p],) for p in x], "vector array<double>")
    got = {tuple(r["vector"]): (r["cluster"], r["is_core"]) for r in rows(dbscan_vectors(frame, eps, 5))}
    core, label, d = brute_dbscan(x, eps, 5)
    mine = [got.get(tuple(p), (-1, False)) for p in x]
    assert [m[1] for m in mine] == core.tolist()
    pairs = {(m[0], b) for m, b, c in zip(mine, label, core) if c}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


@pytest.mark.parametrize("gap,clusters", [(0.3, 2), (0.19, 1)])
def test_two_full_cells_are_refined(spark, gap, clusters):
    """Two dense stripes in neighbouring cells: apart by more than eps, or touching at one far point only."""
    rng = np.random.default_rng(1)
    left = np.column_stack([rng.uniform(0, 0.01, 600), rng.uniform(0, 0.13, 600)])
    right = left + (gap, 0)
    x = np.concatenate([left, right])
    if clusters == 1:
        x = np.concatenate([x, [[0.1, 0.05]]])
        x[600:, 0] += np.where(np.arange(601) == 600, 0, 0.02)
    frame = spark.createDataFrame([([float(v) for v in p],) for p in x], "vector array<double>")
    core, label, _ = brute_dbscan(x, 0.2, 4)
    found = rows(dbscan_vectors(frame, 0.2, 4))
    assert len({r["cluster"] for r in found}) == len(set(label[core]))


def compared(index, queries, k):
    """Row pairs that a search looks at."""
    sizes = index.placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))
    return index.visits(queries.withColumnRenamed("vector", "asked"), k).join(sizes, "__cell").agg(F.sum("n")).first()[0]


def test_index_keeps_the_work_below_quadratic(spark):
    def frame(n):
        rng = np.random.default_rng(n)
        return spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(0, 1, (n, 2)))], "id long, vector array<double>")

    work = {n: compared(MetricIndex.build(frame(n), 5), frame(n), 5) for n in (1_000, 4_000)}
    assert work[4_000] < 10 * work[1_000] and work[4_000] < 4_000 * 4_000 / 8
    few = frame(60)
    index = MetricIndex.build(distinct_vectors(few, 3), 3)
    got = {(r["qid"], r["id"]) for r in rows(nearest(few, few.withColumnRenamed("id", "qid"), 3, index=index))}
    plain = {(r["qid"], r["id"]) for r in rows(nearest(few, few.withColumnRenamed("id", "qid"), 3))}
    assert got == plain


def test_moments_with_parts_that_have_no_rows(spark):
    frame = spark.range(0, 8, 1, 4).selectExpr("cast(id as double) as a", "cast(id * id as double) as b").where("a >= 6")
    for n, mean, products in (moments(frame, "a", "b"), moments(frame.select(F.array("a", "b").alias("v")), "v")):
        assert n == 2 and mean.tolist() == [6.5, 42.5] and products.tolist() == [[0.5, 6.5], [6.5, 84.5]]


def test_moments_of_columns_and_arrays(spark):
    x = np.random.default_rng(4).normal(1e6, 3, (500, 4))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(5)
    for n, mean, products in (moments(frame, "a", "b", "c", "d"), moments(frame.select(F.array("a", "b", "c", "d").alias("v")), "v")):
        assert n == 500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(products, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    assert moments(frame.limit(0), "a")[0] == 0


def test_flag_column_of_training_rows(spark):
    _, scored = train(readings(spark), ["heat", "load"], None, "outliers", "elliptic_envelope", {"contamination": 0.0})
    assert scored.where(F.col(FLAG) == 1).count() == 0
