"""Neighbour operators against brute force on small fixtures, split paths included."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabulon.operators import neighbors
from tabulon.operators.anomaly import elliptic_envelope, isolation_forest
from tabulon.operators.density import dbscan
from tabulon.operators.metrics import top_anomalies
from tabulon.operators.neighbors import knn_classify, local_outlier_factor, nearest


def cloud(seed=3, n=220, dims=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n, dims)), rng.normal(6, 0.5, (n // 2, dims)), np.zeros((60, dims)) + 2.5])
    return np.round(x, 3)


def frame(spark, x, label=None):
    data = [(int(i), [float(v) for v in row], int(i % 3)) for i, row in enumerate(x)]
    return spark.createDataFrame(data, "id long, vector array<double>, label int")


def brute(x, q, k, exclude):
    out = {}
    for i, point in enumerate(q):
        d = np.sqrt(((x - point) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if not (exclude and j == i)][:k]
        out[i] = [(int(j), round(float(d[j]), 9)) for j in order]
    return out


@pytest.mark.parametrize("block,pivots", [(10_000, 8), (40, 8), (40, 1)])
@pytest.mark.parametrize("exclude", [True, False])
def test_nearest_equals_brute_force(spark, block, pivots, exclude):
    x = cloud()
    df = frame(spark, x)
    got = {}
    near = nearest(df, df.select(F.col("id").alias("qid"), "vector"), 4, exclude_self=exclude, block=block, pivots=pivots)
    for r in near.orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["distance"], 9)))
    assert got == brute(x, x, 4, exclude)


@pytest.mark.parametrize("share", [0.0, 2.0])
@pytest.mark.parametrize("exclude", [True, False])
def test_cells_and_large_blocks_give_the_same(spark, monkeypatch, share, exclude):
    monkeypatch.setattr(neighbors, "FLAT_SHARE", share)
    x = np.hstack([cloud(), cloud(4), cloud(5), cloud(6)]) + 1000.0
    df = frame(spark, x)
    got = {}
    for r in nearest(df, df.select(F.col("id").alias("qid"), "vector"), 4, exclude_self=exclude, block=40, pivots=8).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["distance"], 9)))
    assert got == brute(x, x, 4, exclude)


def test_many_dimensions_copy_no_query_per_cell(spark, monkeypatch):
    met = []
    monkeypatch.setattr(neighbors, "paired_blocks", lambda train, queries, *rest, f=neighbors.paired_blocks: (
        met.append((queries.count(), rest[-1])), f(train, queries, *rest))[1])
    df = frame(spark, np.random.default_rng(1).normal(0, 1, (400, 32)))
    near = nearest(df, df.select(F.col("id").alias("qid"), "vector"), 3, block=16, pivots=16)
    assert met == [(400, 50)] and near.count() == 1200


def test_copies_are_looked_up_once_and_no_side_is_broadcast(spark, monkeypatch):
    asked, plans = [], []

    def watched(train, queries, *rest, f=neighbors.paired_blocks):
        asked.append(queries.select("qid").distinct().count())
        found = f(train, queries, *rest)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(neighbors, "paired_blocks", watched)
    x = np.round(np.random.default_rng(2).normal(0, 1, (60, 2)), 3)
    df = frame(spark, np.concatenate([x] * 12))
    few = {r["id"]: r["lof"] for r in rows(local_outlier_factor(df, 15, block=40, pivots=8))}
    assert asked == [60] and len(few) == 720 and all(abs(few[i] - few[i % 60]) < 1e-12 for i in few)
    joins = [line for line in plans[0].splitlines() if "HashJoin" in line or "NestedLoop" in line]
    assert all("LeftSemi" in j or "LeftOuter" in j for j in joins) and "REPARTITION_BY_NUM" in plans[0]
    d = np.sqrt(((np.concatenate([x] * 12)[:, None] - np.concatenate([x] * 12)[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(720), d.shape), d), axis=1)[:, :15]
    gaps = np.take_along_axis(d, order, axis=1)
    lrd = 1 / (np.maximum(gaps, gaps[:, -1][order]).mean(axis=1) + 1e-10)
    assert np.allclose([few[i] for i in range(720)], lrd[order].mean(axis=1) / lrd)


def test_nearest_within_groups(spark):
    x = cloud(n=60)
    df = frame(spark, x).withColumn("g", F.col("label").cast("string"))
    near = nearest(df, df.select("g", F.col("id").alias("qid"), "vector"), 2, by=["g"], block=16)
    groups = {r["id"]: r["g"] for r in rows(df)}
    assert all(groups[r["qid"]] == groups[r["id"]] for r in rows(near)) and near.count() == 2 * len(x)


def test_fewer_rows_than_k(spark):
    df = frame(spark, cloud()[:3])
    assert nearest(df, df.select(F.col("id").alias("qid"), "vector"), 9).count() == 9


def test_majority_label(spark):
    df = spark.createDataFrame([(0, [0.0], 1), (1, [0.1], 2), (2, [0.2], 2), (3, [5.0], 7)], "id long, vector array<double>, label int")
    q = spark.createDataFrame([(9, [0.0])], "qid long, vector array<double>")
    assert knn_classify(df, q, "label", 3).first()["predicted"] == 2
    assert knn_classify(df, q, "label", 2).first()["predicted"] == 1


def test_lof_marks_the_lonely_point(spark):
    x = np.vstack([np.random.default_rng(0).normal(0, 1, (60, 2)), [[9.0, 9.0]]])
    got = {r["id"]: r["lof"] for r in rows(local_outlier_factor(frame(spark, x).drop("label"), 10))}
    assert len(got) == 61 and max(got, key=got.get) == 60 and got[60] > 2


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (d <= eps).sum(axis=1) >= least
    label = np.full(len(x), -1)
    n = 0
    for i in np.lexsort(x.T[::-1]):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = n
        while todo:
            j = todo.pop()
            for m in np.nonzero((d[j] <= eps) & core & (label < 0))[0]:
                label[m] = n
                todo.append(m)
        n += 1
    return core, label, d


@pytest.mark.parametrize("block", [10_000, 15])
def test_dbscan_equals_brute_force(spark, block):
    x = np.vstack([cloud(5, 120, 2), [[2.5, 2.5]] * 30])
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = dbscan(df, ["a", "b"], 0.45, 5, block).toPandas().sort_values("id")
    core, label, d = brute_dbscan(x, 0.45, 5)
    assert (got["is_core"].to_numpy() == core).all()
    mine = got["cluster"].to_numpy()
    # Same partition of the core points, whatever the numbers.
    pairs = set(zip(mine[core], label[core]))
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    reachable = ((d <= 0.45) & core[None, :]).any(axis=1)
    assert ((mine >= 0) == reachable).all()


def test_dbscan_long_chain_and_missing_values(spark):
    data = [(i, i * 0.4, 0.0) for i in range(150)] + [(900, None, 0.0)]
    got = rows(dbscan(spark.createDataFrame(data, "id long, a double, b double"), ["a", "b"], 0.5, 2))
    assert {r["cluster"] for r in got if r["id"] < 900} == {0}
    assert [r["cluster"] for r in got if r["id"] == 900] == [-1]
    with pytest.raises(ValueError):
        dbscan(spark.createDataFrame(data, "id long, a double, b double"), ["a"] * 5)


def test_isolation_forest_and_envelope(spark):
    data = [(i, 100.0 + i % 7, 10.0 + i % 3) for i in range(99)] + [(99, 5000.0, 120.0)]
    df = spark.createDataFrame(data, "id long, amount double, duration double")
    for scored in (isolation_forest(df, ["amount", "duration"], "id", 30, 0.02), elliptic_envelope(df, ["amount", "duration"], 0.02)):
        flagged = [r["id"] for r in rows(scored.where("is_anomaly"))]
        assert 99 in flagged and len(flagged) <= 3
        assert top_anomalies(scored, "is_anomaly", "severity", "id").first()["id"] == 99
    none = isolation_forest(df.where("id < 99"), ["duration"], "id", 10, 0.0)
    assert {r["status"] for r in rows(top_anomalies(none, "is_anomaly", "score", "id"))} == {"Borderline"}
