"""Queries over anomaly, neighbour and density models that go through train, score and evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.models import train
from ..operators.scoring import evaluate, score
from .registry import query

# Standardised distances do not change under scaling, so the SQL works on the raw columns.
_ENVELOPE = """stats AS (SELECT avg(c_acctbal) AS ma, avg(c_nationkey) AS mb, var_pop(c_acctbal) AS saa, var_pop(c_nationkey) AS sbb,
    covar_pop(c_acctbal, c_nationkey) AS sab FROM customer),
  scored AS (SELECT c_custkey, c_acctbal, (sbb * pow(c_acctbal - ma, 2) - 2 * sab * (c_acctbal - ma) * (c_nationkey - mb) + saa * pow(c_nationkey - mb, 2))
    / (saa * sbb - sab * sab) AS d FROM customer, stats),
  called AS (SELECT *, d > quantile_cont(d, 0.95) OVER () AS hit FROM scored)"""
_SIGNS = ["c_acctbal", "c_nationkey"]


def _envelope(df, target=None):
    """One round: the plain covariance, which SQL can check."""
    return train(df, _SIGNS, target, "anomaly_detection", "elliptic_envelope", {"contamination": 0.05, "rounds": 1})[0]


@query("score_anomaly", f"WITH {_ENVELOPE} SELECT c_custkey, CASE WHEN hit THEN 'Anomaly' ELSE 'Normal' END AS label FROM called")
def score_anomaly(t):
    return score(t.customer, _envelope(t.customer)).select("c_custkey", F.col("__ml_prediction").alias("label"))


@query(
    "anomaly_evaluate",
    f"""WITH {_ENVELOPE}, judged AS (SELECT hit, c_acctbal > 9500 OR c_acctbal < -800 AS bad FROM called),
    n AS (SELECT count(*) AS "rows", count(*) FILTER (hit) AS anomalies, count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp,
      count(*) FILTER (NOT hit AND bad) AS fn, count(*) FILTER (NOT hit AND NOT bad) AS tn FROM judged)
    SELECT *, round_even(100.0 * anomalies / "rows", 2)::DOUBLE AS anomaly_pct, coalesce(round_even(tp::DOUBLE / nullif(tp + fp, 0), 4), 0)::DOUBLE AS precision,
      coalesce(round_even(tp::DOUBLE / nullif(tp + fn, 0), 4), 0)::DOUBLE AS recall,
      coalesce(round_even(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 4), 0)::DOUBLE AS f1 FROM n""",
)
def anomaly_evaluate(t):
    """Precision and recall against a column that says which rows are bad."""
    bad = (F.col("c_acctbal") > 9500) | (F.col("c_acctbal") < -800)
    df = t.customer.withColumn("state", F.when(bad, "fraud").otherwise("fine"))
    model = _envelope(df, "state")
    return evaluate(score(df, model), model)


_SCALED = """z AS MATERIALIZED (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS a,
    (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS b FROM customer),
  gaps AS MATERIALIZED (SELECT x.c_custkey AS q, y.c_custkey AS o, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d,
    row_number() OVER (PARTITION BY x.c_custkey ORDER BY pow(x.a - y.a, 2) + pow(x.b - y.b, 2), y.c_custkey) AS place FROM z x, z y)"""


@query(
    "score_outlier_factor",
    f"""WITH {_SCALED}, near AS (SELECT * FROM gaps WHERE place BETWEEN 2 AND 21), far AS (SELECT q AS o, max(d) AS kd FROM near GROUP BY q),
    dens AS (SELECT near.q AS o, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN far USING (o) GROUP BY near.q),
    asked AS (SELECT q, avg(lrd) * (avg(greatest(d, kd)) + 1e-10) AS lof FROM gaps JOIN far USING (o) JOIN dens USING (o) WHERE place <= 20 GROUP BY q)
    SELECT q AS c_custkey, CASE WHEN lof > quantile_cont(lof, 0.95) OVER () THEN 'Anomaly' ELSE 'Normal' END AS label FROM asked""",
)
def score_outlier_factor(t):
    """Densities of the training rows without themselves; a scored row is compared with them as a new row, as its own nearest."""
    model, _ = train(t.customer, _SIGNS, None, "anomaly_detection", "lof", {"contamination": 0.05, "n_neighbors": 20})
    return score(t.customer, model).select("c_custkey", F.col("__ml_prediction").alias("label"))


@query("score_isolation_forest")
def score_isolation_forest(t):
    """A forest of random trees: rows only, no SQL."""
    model, _ = train(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipmode"], None, "anomaly_detection", "isolation_forest",
                     {"contamination": 0.05})
    return score(t.lineitem, model).select("l_orderkey", "l_linenumber", F.col("__ml_prediction").alias("label"), "__ml_severity")


@query(
    "knn_scaled",
    """WITH fit AS (SELECT * FROM customer WHERE ('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|42'), 1, 8))::BIGINT >= 858993459),
    s AS (SELECT stddev_samp(c_acctbal) AS sa, stddev_samp(c_nationkey) AS sb FROM fit),
    gaps AS (SELECT x.c_custkey, y.c_custkey AS o, row_number() OVER (PARTITION BY x.c_custkey
      ORDER BY pow((x.c_acctbal - y.c_acctbal) / sa, 2) + pow((x.c_nationkey - y.c_nationkey) / sb, 2)) AS place FROM customer x, fit y, s)
    SELECT c_custkey, round_even(avg(o), 4)::DOUBLE AS predicted FROM gaps WHERE place <= 5 GROUP BY c_custkey""",
)
def knn_scaled(t):
    """The mean of the five nearest training rows in scaled columns."""
    df = t.customer.withColumn("number", F.col("c_custkey").cast("double"))
    model, _ = train(df, _SIGNS, "number", "regression", "knn", {"n_neighbors": 5}, key="c_custkey")
    return score(df, model).select("c_custkey", F.bround("__ml_prediction", 4).alias("predicted"))


@query(
    "dbscan_scaled",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey AS id, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS a,
      (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS b FROM part),
    near AS MATERIALIZED (SELECT x.id AS i, y.id AS j, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d, y.a AS ya, y.b AS yb
      FROM p x JOIN p y ON abs(x.a - y.a) <= 0.05 AND abs(x.b - y.b) <= 0.05 WHERE sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) <= 0.05),
    core AS MATERIALIZED (SELECT i FROM near GROUP BY i HAVING count(*) >= 4),
    reach AS (SELECT i AS a, i AS b FROM core UNION SELECT reach.a, near.j FROM reach JOIN near ON reach.b = near.i
      WHERE near.j IN (SELECT i FROM core)),
    label AS MATERIALIZED (SELECT a AS id, min(b) AS l FROM reach GROUP BY a),
    member AS MATERIALIZED (SELECT id, l FROM label UNION ALL SELECT i, l FROM (SELECT near.i, label.l,
      row_number() OVER (PARTITION BY near.i ORDER BY near.d, near.ya, near.yb) AS r FROM near JOIN label ON near.j = label.id
      WHERE near.i NOT IN (SELECT i FROM core)) WHERE r = 1)
    SELECT CASE WHEN l IS NULL THEN 'Noise' ELSE 'Cluster' END AS kind, size, count(*) AS clusters FROM (SELECT l, count(*) AS size FROM p LEFT JOIN member USING (id)
      GROUP BY l) GROUP BY 1, 2""",
)
def dbscan_scaled(t):
    """Sizes of the density clusters of scaled columns, and of the noise."""
    _, scored = train(t.part, ["p_retailprice", "p_size"], None, "clustering", "dbscan", {"eps": 0.05, "min_samples": 4})
    sizes = scored.groupBy("__cluster").agg(F.count(F.lit(1)).alias("size"))
    kind = F.when(F.col("__cluster") < 0, "Noise").otherwise("Cluster")
    return sizes.groupBy(kind.alias("kind"), "size").agg(F.count(F.lit(1)).alias("clusters"))
