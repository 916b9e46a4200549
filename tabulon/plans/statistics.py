"""Queries over correlations, splits, metrics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.automl import detect_problem, pick_target, plan
from ..operators.metrics import (
    anomaly_report, class_metrics, class_report, cluster_profile, confidence_buckets, confusion, prediction_quantiles,
    reg_metrics, roc_auc, top_anomalies,
)
from ..operators.profile import iqr_fences
from ..operators.quantiles import column_quantiles
from ..operators.stats import correlation_matrix, encode_for_correlation, select_features, split, target_correlations
from .registry import query

_NUM = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
# The coded form of the columns: flag codes ascending, price gaps filled with the median.
CODED = """(SELECT l_linenumber::DOUBLE AS l_linenumber, l_quantity, coalesce(p, (SELECT median(p) FROM (SELECT CASE WHEN l_tax <> 0
  THEN l_extendedprice END AS p FROM lineitem))) AS l_extendedprice, l_discount, l_tax, CASE l_returnflag WHEN 'A' THEN 0.0 WHEN
  'N' THEN 1.0 ELSE 2.0 END AS l_returnflag FROM (SELECT *, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS p FROM lineitem))"""
_ALL = (*_NUM, "l_returnflag")


def _coded(t):
    df = t.lineitem.select(*_NUM, "l_returnflag", F.lit("same").alias("constant"), F.col("l_shipdate"))
    df = df.withColumn("l_extendedprice", F.when(F.col("l_tax") != 0, F.col("l_extendedprice")))
    return encode_for_correlation(df, "l_extendedprice")[0]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, round_even(corr({a}, {b}), 4)::DOUBLE AS correlation FROM {CODED}"
        for a in _ALL for b in _ALL
    ),
)
def corr_matrix(t):
    return correlation_matrix(_coded(t))


_TARGET = " UNION ALL ".join(
    f"SELECT '{a}' AS feature, round_even(corr({a}, l_extendedprice), 4)::DOUBLE AS correlation FROM {CODED}"
    for a in _ALL if a != "l_extendedprice"
)


@query(
    "target_corr",
    f"""SELECT feature, correlation, abs(correlation) AS abs_correlation, CASE WHEN abs(correlation) >= 0.7 THEN 'Very Strong' WHEN
      abs(correlation) >= 0.5 THEN 'Strong' WHEN abs(correlation) >= 0.3 THEN 'Moderate' WHEN abs(correlation) >= 0.1 THEN 'Weak'
      ELSE 'Very Weak' END AS strength, CASE WHEN correlation > 0 THEN 'positive' WHEN correlation < 0 THEN 'negative' ELSE 'neutral'
      END AS direction FROM ({_TARGET})""",
)
def target_corr(t):
    return target_correlations(correlation_matrix(_coded(t)), "l_extendedprice")


@query(
    "selected_features",
    f"""WITH r AS (SELECT feature, abs(correlation) AS a FROM ({_TARGET}) WHERE abs(correlation) < 0.999)
    SELECT feature FROM r WHERE CASE WHEN (SELECT count(*) FROM r WHERE a >= 0.05) >= 3 THEN a >= 0.05 ELSE true END
    ORDER BY a DESC, feature LIMIT 10""",
)
def selected_features(t):
    ranked = target_correlations(correlation_matrix(_coded(t)), "l_extendedprice")
    chosen = select_features([r.asDict() for r in ranked.collect()], list(_ALL), "l_extendedprice", most=10)
    return ranked.where(F.col("feature").isin(*chosen)).select("feature")


_POINT = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8))::BIGINT"


@query("split_hash", f"SELECT o_orderkey, {_POINT} < 858993459 AS is_test FROM orders")
def split_hash(t):
    return split(t.orders, "o_orderkey").select("o_orderkey", "is_test")


@query(
    "split_stratified",
    f"""SELECT o_orderkey, o_orderstatus, {_POINT} < quantile_cont({_POINT}::DOUBLE, 0.2) OVER (PARTITION BY o_orderstatus)
      AS is_test FROM orders""",
)
def split_stratified(t):
    return split(t.orders, "o_orderkey", strata="o_orderstatus").select("o_orderkey", "o_orderstatus", "is_test")


@query("confusion_quality_toxic", "SELECT quality::VARCHAR AS truth, toxic::VARCHAR AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion_quality_toxic(t):
    return confusion(t.labels, "quality", "toxic")


def _report_sql(truth, predicted, table):
    return f"""SELECT label, support, called, hits, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END
      AS f1 FROM (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits / called END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END
      AS r FROM (SELECT l::VARCHAR AS label, (SELECT count(*) FROM {table} WHERE {truth} = l) AS support,
      (SELECT count(*) FROM {table} WHERE {predicted} = l) AS called,
      (SELECT count(*) FROM {table} WHERE {predicted} = l AND {truth} = l) AS hits
      FROM (SELECT {truth} AS l FROM {table} UNION SELECT {predicted} FROM {table})))"""


@query("class_report", _report_sql("l_linenumber", "n", "(SELECT l_linenumber, CAST(floor(l_quantity / 7) AS INTEGER) AS n FROM lineitem)"))
def class_report_lines(t):
    return class_report(t.lineitem.withColumn("n", F.floor(F.col("l_quantity") / 7).cast("int")), "l_linenumber", "n")


@query(
    "weighted_prf",
    f"""SELECT CAST(sum(support) AS BIGINT) AS samples, round_even(sum(hits) / sum(support), 4)::DOUBLE AS accuracy,
      round_even(sum(precision * support) / sum(support), 4)::DOUBLE AS precision,
      round_even(sum(recall * support) / sum(support), 4)::DOUBLE AS recall,
      round_even(sum(f1 * support) / sum(support), 4)::DOUBLE AS f1 FROM ({_report_sql("quality", "toxic", "labels")})""",
)
def weighted_prf(t):
    return class_metrics(t.labels, "quality", "toxic")


@query(
    "roc_auc",
    """WITH s AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS pos FROM lineitem), k AS (SELECT v, count(*) FILTER (pos) AS p,
      count(*) FILTER (NOT pos) AS n FROM s GROUP BY v), c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED
      PRECEDING AND 1 PRECEDING), 0) AS below FROM k)
    SELECT round_even(sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 4)::DOUBLE AS roc_auc FROM c""",
)
def roc_auc_price(t):
    return roc_auc(t.lineitem, "l_returnflag", "l_extendedprice", "R")


_PAIR = "(SELECT l_returnflag, l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)"
_METRICS = """count(*) AS samples, round_even(avg(abs(y - p)), 4)::DOUBLE AS mae, round_even(avg((y - p) * (y - p)), 4)::DOUBLE AS mse,
  round_even(sqrt(avg((y - p) * (y - p))), 4)::DOUBLE AS rmse, round_even(1 - avg((y - p) * (y - p)) / var_pop(y), 4)::DOUBLE AS r2"""


def _pair(t):
    return t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("p"))


@query("reg_metrics", f"SELECT {_METRICS} FROM {_PAIR}")
def reg_metrics_price(t):
    return reg_metrics(_pair(t), "y", "p")


@query("mape", f"SELECT l_returnflag, {_METRICS}, round_even(avg(abs((y - p) / y)) * 100, 2)::DOUBLE AS mape FROM {_PAIR} GROUP BY 1")
def mape_by_flag(t):
    return reg_metrics(_pair(t), "y", "p", ["l_returnflag"], with_mape=True)


@query(
    "cluster_profile_flag",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, count(*) AS size, round_even(100.0 * count(*) / (SELECT count(*) FROM lineitem), 1)::DOUBLE AS pct,
        '{c}' AS "column", round_even(avg({c}), 2)::DOUBLE AS mean, round_even((SELECT avg({c}) FROM lineitem), 2)::DOUBLE AS overall,
        round_even((avg({c}) - (SELECT avg({c}) FROM lineitem)) / (SELECT avg({c}) FROM lineitem) * 100, 1)::DOUBLE AS diff_pct
        FROM lineitem GROUP BY l_returnflag"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def cluster_profile_flag(t):
    out = cluster_profile(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("diff_pct", F.col("diff_pct") + 0.0)


_FENCE = """(SELECT *, l_extendedprice > q3 + 0.4 * (q3 - q1) OR l_extendedprice < q1 - 0.4 * (q3 - q1) AS odd, CASE WHEN l_quantity >= 49
  THEN 'Yes' ELSE 'no' END AS truth FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3
  FROM lineitem))"""


def _fenced(t):
    edges = column_quantiles(t.lineitem, {"p": F.col("l_extendedprice")}, [0.25, 0.5, 0.75])["p"]
    assert iqr_fences(edges)[0] is not None
    spread = edges[2] - edges[0]
    price = F.col("l_extendedprice")
    return t.lineitem.withColumns(
        {
            "odd": (price > edges[2] + 0.4 * spread) | (price < edges[0] - 0.4 * spread),
            "truth": F.when(F.col("l_quantity") >= 49, "Yes").otherwise("no"),
        }
    )


@query(
    "anomaly_report_iqr",
    f"""SELECT *, round_even(100.0 * anomalies / "rows", 2)::DOUBLE AS anomaly_pct, round_even(tp / (tp + fp), 4)::DOUBLE AS precision,
      round_even(tp / (tp + fn), 4)::DOUBLE AS recall, round_even(2 * tp / (2 * tp + fp + fn), 4)::DOUBLE AS f1 FROM (
      SELECT count(*) AS "rows", count(*) FILTER (odd) AS anomalies, count(*) FILTER (odd AND truth = 'Yes') AS tp,
        count(*) FILTER (odd AND truth = 'no') AS fp, count(*) FILTER (NOT odd AND truth = 'Yes') AS fn,
        count(*) FILTER (NOT odd AND truth = 'no') AS tn FROM {_FENCE})""",
)
def anomaly_report_iqr(t):
    return anomaly_report(_fenced(t), "odd", "truth")


@query(
    "top_anomalies",
    f"SELECT l_orderkey, l_linenumber, l_extendedprice, 'Anomaly' AS status FROM {_FENCE} WHERE odd "
    "ORDER BY l_extendedprice DESC, l_orderkey LIMIT 20",
)
def top_anomalies_price(t):
    out = top_anomalies(_fenced(t), "odd", "l_extendedprice", "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "status")


@query(
    "confidence_buckets",
    """SELECT CASE WHEN c <= 50 THEN '<50%' WHEN c <= 70 THEN '50-70%' WHEN c <= 85 THEN '70-85%' WHEN c <= 95 THEN '85-95%'
      ELSE '95-100%' END AS bucket, count(*) AS n FROM (SELECT l_quantity * 2 AS c FROM lineitem) WHERE c > 0 AND c <= 100 GROUP BY 1""",
)
def confidence_buckets_quantity(t):
    return confidence_buckets(t.lineitem.select((F.col("l_quantity") * 2).alias("c")), "c")


@query(
    "prediction_quantiles",
    """WITH e AS (SELECT quantile_cont(l_extendedprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM lineitem)
    SELECT q[i] AS low, q[i + 1] AS high, (SELECT count(*) FROM lineitem WHERE l_extendedprice <= q[i + 1]
      AND (l_extendedprice > q[i] OR i = 1)) AS n FROM e, range(1, 6) r(i)""",
)
def prediction_quantiles_price(t):
    return prediction_quantiles(t.lineitem, "l_extendedprice")


@query(
    "automl_decisions",
    """SELECT 'orders' AS table_name, 'o_orderstatus' AS target, 'classification' AS problem, 'multiclass' AS sub_type,
      count(DISTINCT o_orderstatus) AS classes FROM orders
    UNION ALL SELECT 'customer', 'c_mktsegment', 'classification', 'multiclass', count(DISTINCT c_mktsegment) FROM customer
    UNION ALL SELECT 'part', 'p_retailprice', 'regression', NULL, count(DISTINCT p_retailprice) FROM part
    UNION ALL SELECT 'labels', 'toxic', 'classification', 'binary', count(DISTINCT toxic) FROM labels""",
)
def automl_decisions(t):
    out = None
    for name, df in (("orders", t.orders), ("customer", t.customer), ("part", t.part), ("labels", t.labels)):
        target = pick_target(df)
        found = detect_problem(df, target)
        if name == "labels":
            target = "toxic"
            found = detect_problem(df, target)
        one = df.agg(F.count_distinct(target).alias("classes")).select(
            F.lit(name).alias("table_name"), F.lit(target).alias("target"), F.lit(found["problem_type"]).alias("problem"),
            F.lit(found["sub_type"]).cast("string").alias("sub_type"), "classes",
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("automl_plan")
def automl_plan(t):
    """The plan of a model for line item prices: its ranked features."""
    df = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    p = plan(df, "l_extendedprice")
    return p.correlations.select(
        "feature", "correlation", F.col("feature").isin(*p.features).alias("selected"), F.lit(p.problem_type).alias("problem"),
        F.lit(p.algorithm).alias("algorithm"),
    )
