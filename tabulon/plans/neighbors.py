"""Queries over neighbours, density clusters and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.anomaly import elliptic_envelope, isolation_forest, lof_anomalies
from ..operators.density import dbscan, noise_share
from ..operators.metrics import anomaly_report
from ..operators.neighbors import knn_classify, knn_regress, local_outlier_factor, nearest
from .registry import query

_VEC = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
_NEAR = f"""(SELECT a.vec_id AS qid, b.vec_id AS id, b.label, list_distance(a.v, b.v) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS place
  FROM ({_VEC}) a JOIN ({_VEC}) b ON a.vec_id <> b.vec_id)"""


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _queries(df):
    return df.select(F.col("id").alias("qid"), "vector")


@query("nearest_vectors", f"SELECT qid, id, round(d, 6) AS distance, CAST(place AS INTEGER) AS place FROM {_NEAR} WHERE place <= 3")
def nearest_vectors(t):
    df = _vectors(t)
    return nearest(df, _queries(df), 3, exclude_self=True, block=256, pivots=16).withColumn("distance", F.round("distance", 6))


@query(
    "knn_label",
    f"""SELECT qid, label AS predicted FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS r
      FROM {_NEAR} WHERE place <= 5 GROUP BY qid, label) WHERE r = 1""",
)
def knn_label(t):
    df = _vectors(t)
    return knn_classify(df, _queries(df), "label", 5, exclude_self=True)


@query("knn_mean", f"SELECT qid, round(avg(label), 6) AS predicted FROM {_NEAR} WHERE place <= 5 GROUP BY qid")
def knn_mean(t):
    df = _vectors(t)
    return knn_regress(df, _queries(df), "label", 5, exclude_self=True).withColumn("predicted", F.round("predicted", 6))


@query(
    "local_outlier_factor",
    f"""WITH near AS MATERIALIZED (SELECT * FROM {_NEAR} WHERE place <= 20), far AS (SELECT qid AS id, max(d) AS kd FROM near GROUP BY qid),
    dens AS (SELECT near.qid, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN far USING (id) GROUP BY near.qid)
    SELECT near.qid AS id, round(avg(o.lrd) / any_value(me.lrd), 6) AS lof FROM near JOIN dens o ON near.id = o.qid
    JOIN dens me ON near.qid = me.qid GROUP BY near.qid""",
)
def lof(t):
    return local_outlier_factor(_vectors(t).drop("label"), 20).withColumn("lof", F.round("lof", 6))


@query("lof_report")
def lof_report(t):
    return anomaly_report(lof_anomalies(t.customer, ["c_acctbal", "c_nationkey"], "c_custkey", 20), "is_anomaly")


@query(
    "dbscan_2d",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey AS id, p_retailprice / 10 AS a, p_size::DOUBLE AS b FROM part),
    near AS MATERIALIZED (SELECT x.id AS i, y.id AS j, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d, y.a AS ya, y.b AS yb
      FROM p x JOIN p y ON abs(x.a - y.a) <= 0.6 AND abs(x.b - y.b) <= 0.6 WHERE sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) <= 0.6),
    core AS MATERIALIZED (SELECT i FROM near GROUP BY i HAVING count(*) >= 4),
    reach AS (SELECT i AS a, i AS b FROM core UNION SELECT reach.a, near.j FROM reach JOIN near ON reach.b = near.i
      WHERE near.j IN (SELECT i FROM core)),
    label AS MATERIALIZED (SELECT a AS id, min(b) AS l FROM reach GROUP BY a),
    member AS MATERIALIZED (SELECT id, l, true AS is_core FROM label UNION ALL SELECT i, l, false FROM (SELECT near.i, label.l,
      row_number() OVER (PARTITION BY near.i ORDER BY near.d, near.ya, near.yb) AS r FROM near JOIN label ON near.j = label.id
      WHERE near.i NOT IN (SELECT i FROM core)) WHERE r = 1),
    firsts AS (SELECT l, row_number() OVER (ORDER BY min((a, b))) - 1 AS n FROM member JOIN p USING (id) GROUP BY l)
    SELECT CAST(coalesce(n, -1) AS INTEGER) AS cluster, count(*) AS size, count(*) FILTER (coalesce(is_core, false)) AS cores
    FROM p LEFT JOIN member USING (id) LEFT JOIN firsts USING (l) GROUP BY 1""",
)
def dbscan_2d(t):
    df = t.part.select("p_partkey", (F.col("p_retailprice") / 10).alias("a"), F.col("p_size").alias("b"))
    return noise_share(dbscan(df, ["a", "b"], 0.6, 4))


@query("isolation_forest")
def forest(t):
    df = t.lineitem.withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    scored = isolation_forest(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "key", 50, 0.05)
    return anomaly_report(scored, "is_anomaly")


@query(
    "elliptic_envelope",
    """SELECT count(*) AS "rows", count(*) FILTER (d > cut) AS anomalies, round_even(100.0 * count(*) FILTER (d > cut) / count(*), 2)::DOUBLE
      AS anomaly_pct FROM (SELECT pow(c_acctbal - m, 2) / s AS d, quantile_cont(pow(c_acctbal - m, 2) / s, 0.9) OVER () AS cut
      FROM customer, (SELECT avg(c_acctbal) m, var_pop(c_acctbal) s FROM customer))""",
)
def envelope(t):
    """One round in one dimension is the plain standardised distance, which SQL can check."""
    return anomaly_report(elliptic_envelope(t.customer, ["c_acctbal"], 0.1, rounds=1), "is_anomaly")


@query("elliptic_envelope_refit")
def envelope_refit(t):
    return anomaly_report(elliptic_envelope(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], 0.05), "is_anomaly")
