"""Queries over cleaning steps and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean_number, format_inr, half_even, parse_num, title_key
from ..operators.predicates import apply_filters, global_filters, grid_search, relative_period
from ..operators.steps import Step, apply_step, formatting_report, replay
from ..sources.workspace import Workspace
from .registry import query

ITEM = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def _gaps(t):
    """Line items with nulls where the discount is 0 (price), 1 % (quantity) or the flag is R."""
    return t.lineitem.select(*ITEM).withColumns(
        {
            "l_extendedprice": F.when(F.col("l_discount") != 0, F.col("l_extendedprice")),
            "l_quantity": F.when(F.col("l_discount") != 0.01, F.col("l_quantity")),
            "l_returnflag": F.nullif("l_returnflag", F.lit("R")),
        }
    )


GAPS = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0.01 THEN l_quantity END AS l_quantity,
  CASE WHEN l_discount <> 0 THEN l_extendedprice END AS l_extendedprice, l_discount,
  nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem)"""


@query(
    "step_add_column",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, "
    "l_extendedprice / nullif(l_quantity - 1, 0) AS unit, l_quantity > 10 AND l_returnflag = 'A' AS big_a, "
    "pow(l_quantity, 2) AS squared FROM lineitem",
)
def step_add_column(t):
    steps = [
        Step("add_column", {"new_column": "net", "formula": "l_extendedprice * (1 - l_discount)"}),
        Step("add_column", {"new_column": "unit", "formula": "`l_extendedprice` / (l_quantity - 1)"}),
        Step("add_column", {"new_column": "big_a", "formula": "(l_quantity > 10) & (l_returnflag == 'A')"}),
        Step("add_column", {"new_column": "squared", "formula": "l_quantity ** 2"}),
    ]
    return replay(t.lineitem, steps).select("l_orderkey", "l_linenumber", "net", "unit", "big_a", "squared")


@query("step_rename_drop", "SELECT r_regionkey AS region_id FROM region")
def step_rename_drop(t):
    return replay(
        t.region,
        [
            Step("rename_column", {"columns_map": {"r_regionkey": "region_id", "missing": "x"}}),
            Step("drop_column", {"columns": ["r_name"]}),
        ],
    )


@query(
    "step_fill_mean",
    f"SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, (SELECT avg(l_extendedprice) FROM {GAPS})), 4) "
    f"AS l_extendedprice FROM {GAPS}",
)
def step_fill_mean(t):
    out = apply_step(_gaps(t), Step("fill_missing", {"column": "l_extendedprice", "strategy": "mean"}))
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query(
    "step_fill_median",
    f"SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM {GAPS})) AS l_quantity FROM {GAPS}",
)
def step_fill_median(t):
    out = apply_step(_gaps(t), Step("fill_missing", {"column": "l_quantity", "strategy": "median"}))
    return out.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "step_fill_mode",
    f"SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT l_returnflag FROM {GAPS} WHERE l_returnflag IS NOT "
    f"NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM {GAPS}",
)
def step_fill_mode(t):
    out = apply_step(_gaps(t), Step("fill_missing", {"column": "l_returnflag", "strategy": "mode"}))
    return out.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("step_fill_constant", f"SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, 'none') AS l_returnflag FROM {GAPS}")
def step_fill_constant(t):
    out = apply_step(_gaps(t), Step("fill_missing", {"column": "l_returnflag", "strategy": "constant", "value": "none"}))
    return out.select("l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "step_fill_fallback",
    f"SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM {GAPS})) AS l_quantity, "
    f"coalesce(l_returnflag, (SELECT l_returnflag FROM {GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1 "
    f"ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM {GAPS}",
)
def step_fill_fallback(t):
    out = replay(
        _gaps(t),
        [
            Step("fill_missing", {"column": "l_quantity", "strategy": "something"}),
            Step("fill_missing", {"column": "l_returnflag", "strategy": "mean"}),
        ],
    )
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query(
    "step_dropna",
    f"SELECT * FROM {GAPS} WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
)
def step_dropna(t):
    return apply_step(_gaps(t), Step("drop_na_rows", {"columns": ["l_quantity", "l_extendedprice"]}))


@query(
    "step_dedupe",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn FROM lineitem) WHERE rn = 1",
)
def step_dedupe(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return apply_step(
        df,
        Step("drop_duplicates", {"columns": ["l_orderkey"], "order": ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]}),
    )


@query("step_dedupe_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def step_dedupe_rows(t):
    return apply_step(t.lineitem.select("l_returnflag", "l_linestatus", "l_discount"), Step("drop_duplicates", {}))


@query(
    "step_cast",
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
      coalesce(TRY_CAST(o_orderstatus AS BIGINT), 0) AS status_number,
      TRY_CAST(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS cust_number, strftime(o_orderdate, '%Y-%m-%d') AS day,
      CAST(o_custkey AS VARCHAR) AS cust_text, o_custkey <> 0 AS cust_flag FROM orders""",
)
def step_cast(t):
    df = t.orders.select(
        "o_orderkey", F.col("o_totalprice").alias("whole"), F.col("o_orderstatus").alias("status_number"),
        F.col("o_custkey").cast("string").alias("cust_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_custkey").alias("cust_text"),
        F.col("o_custkey").alias("cust_flag"),
    )
    kinds = {
        "whole": "integer", "status_number": "integer", "cust_number": "float", "day": "datetime",
        "cust_text": "string", "cust_flag": "boolean",
    }
    out = replay(df, [Step("cast_type", {"column": c, "target_type": k}) for c, k in kinds.items()])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "step_replace",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def step_replace(t):
    df = t.orders.select("o_orderkey", "o_orderstatus")
    return apply_step(df, Step("replace_values", {"column": "o_orderstatus", "to_replace": "O", "value": "Open"}))


@query(
    "step_filter",
    f"SELECT * FROM {GAPS} WHERE l_quantity > 30 AND (l_returnflag = 'A' OR l_discount >= 0.05)",
)
def step_filter(t):
    return apply_step(
        _gaps(t), Step("filter_rows", {"query": "(l_quantity > 30) & ((l_returnflag == 'A') | (l_discount >= 0.05))"})
    )


@query(
    "replay_steps",
    f"""SELECT flag, count(*) AS n, round(sum(net), 2) AS net FROM (
      SELECT coalesce(l_returnflag, 'none') AS flag, l_extendedprice * (1 - l_discount) AS net FROM {GAPS}
      WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity >= 5) GROUP BY flag""",
)
def replay_steps(t):
    out = replay(
        _gaps(t),
        [
            Step("drop_na_rows", {"columns": ["l_quantity", "l_extendedprice"]}),
            Step("fill_missing", {"column": "l_returnflag", "strategy": "constant", "value": "none"}),
            Step("rename_column", {"old_name": "l_returnflag", "new_name": "flag"}),
            Step("filter_rows", {"query": "l_quantity >= 5"}),
            Step("add_column", {"new_column": "net", "formula": "l_extendedprice * (1 - l_discount)"}),
        ],
    )
    return out.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("net"), 2).alias("net"))


DIRT = r"[\x00-\x1f\x7f-\x9f\x{ad}\x{200b}-\x{200f}\x{2028}\x{2029}\x{202a}-\x{202e}\x{2060}\x{feff}]"


@query(
    "fix_formatting_docs",
    f"SELECT doc_id, regexp_replace(text, '{DIRT}', '', 'g') AS text, lang FROM documents",
)
def fix_formatting_docs(t):
    return apply_step(t.documents.select("doc_id", "text", "lang"), Step("fix_formatting", {}))


@query(
    "formatting_report_docs",
    f"""SELECT 'text' AS "column", count(*) FILTER (regexp_matches(text, '{DIRT}')) AS cells_cleaned FROM documents
    UNION ALL SELECT 'lang', count(*) FILTER (regexp_matches(lang, '{DIRT}')) FROM documents
    UNION ALL SELECT 'total', count(*) FILTER (regexp_matches(text, '{DIRT}'))
      + count(*) FILTER (regexp_matches(lang, '{DIRT}')) FROM documents""",
)
def formatting_report_docs(t):
    return formatting_report(t.documents.select("text", "lang"))


STATUS = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders)"


def _status(t):
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice")


@query("filter_eq_ci", f"SELECT * FROM {STATUS} WHERE lower(status) = 'f'")
def filter_eq_ci(t):
    return apply_filters(_status(t), [{"column": "status", "operator": "eq", "value": "f"}])


@query("filter_neq_keeps_null", f"SELECT * FROM {STATUS} WHERE lower(status) IS DISTINCT FROM 'f'")
def filter_neq_keeps_null(t):
    return apply_filters(_status(t), [{"column": "status", "operator": "neq", "value": "F"}])


@query("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def filter_in(t):
    return apply_filters(
        t.customer.select("c_custkey", "c_mktsegment"),
        [{"column": "c_mktsegment", "operator": "in", "value": ["Building", "MACHINERY"]}],
    )


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'R[IE]', 'i')")
def filter_contains(t):
    return apply_filters(t.part.select("p_partkey", "p_name"), [{"column": "p_name", "operator": "contains", "value": "R[IE]"}])


@query(
    "filter_range",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.5 AND o_totalprice <= 250000 AND o_orderkey >= 10 "
    "AND o_orderkey < 14000",
)
def filter_range(t):
    return apply_filters(
        t.orders.select("o_orderkey", "o_totalprice"),
        [
            {"column": "o_totalprice", "operator": "gt", "value": "1000.5"},
            {"column": "o_totalprice", "operator": "lte", "value": 250000},
            {"column": "o_orderkey", "operator": "gte", "value": 10},
            {"column": "o_orderkey", "operator": "lt", "value": "14000"},
            {"column": "nowhere", "operator": "eq", "value": 1},
            {"column": "o_orderkey", "operator": "gt", "value": "abc"},
            {"column": "o_orderkey", "operator": "eq", "value": ""},
        ],
    )


@query("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t):
    return apply_filters(t.part.select("p_partkey", "p_size"), [{"column": "p_size", "operator": "between", "value": [10, 20]}])


_PERIODS = {
    "last_month": ("last month", "date_trunc('month', m) - INTERVAL 1 MONTH", "date_trunc('month', m)"),
    "this_year": ("this year", "date_trunc('year', m)", "m + INTERVAL 1 DAY"),
    "last_year": ("last year", "date_trunc('year', m) - INTERVAL 1 YEAR", "date_trunc('year', m)"),
    "this_month": ("this month", "date_trunc('month', m)", "m + INTERVAL 1 DAY"),
    "last_30_days": ("last 30 days", "m - INTERVAL 30 DAY", "m + INTERVAL 1 DAY"),
}
for _key, (_words, _start, _end) in _PERIODS.items():

    @query(
        f"relative_{_key}",
        f"SELECT o_orderkey, o_totalprice FROM orders, (SELECT max(o_orderdate) m FROM orders) "
        f"WHERE o_orderdate >= {_start} AND o_orderdate < {_end}",
    )
    def _relative(t, words=_words):
        return relative_period(t.orders, "o_orderdate", words).select("o_orderkey", "o_totalprice")


@query(
    "global_filter",
    """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
      AND lower(c_mktsegment) = 'building' GROUP BY n_name""",
)
def global_filter(t):
    tables = global_filters(
        {"orders": t.orders, "customer": t.customer, "nation": t.nation},
        {"date_start": "1996-01-01", "date_end": "1996-12-31", "segment": "Building", "warehouse": "W1", "supplier": ""},
        {
            "date_start": ["o_orderdate", "l_shipdate"], "date_end": ["o_orderdate", "l_shipdate"],
            "segment": ["c_mktsegment"], "warehouse": ["w_name"],
        },
    )
    per_customer = tables["orders"].groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("s")
    )
    return (
        per_customer.join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", F.col("n").alias("n_orders"), F.round("s", 2).alias("total"))
    )


@query(
    "grid_search",
    """SELECT * FROM part WHERE (contains(CAST(p_partkey AS VARCHAR), '12') OR contains(lower(p_name), '12')
      OR contains(lower(p_brand), '12') OR contains(lower(p_type), '12') OR contains(CAST(p_size AS VARCHAR), '12')
      OR contains(CAST(p_retailprice AS VARCHAR), '12')) AND contains(lower(p_type), 'econ')""",
)
def grid(t):
    return grid_search(t.part, "12", {"p_type": "ECON"}, sort="p_retailprice", ascending=False)


@query(
    "clean_numeric_text",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price, "
    "CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice END AS parsed FROM orders",
)
def clean_numeric_text(t):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    )
    return t.orders.select("o_orderkey", clean_number(text).alias("price"), parse_num(text).alias("parsed"))


@query(
    "format_inr_price",
    """SELECT o_orderkey,
      CASE WHEN v >= 1e7 THEN printf('₹%.2f Cr', v / 1e7) WHEN v >= 1e5 THEN printf('₹%.2f Lakh', v / 1e5)
           WHEN v >= 1e3 THEN printf('₹%.1f K', v / 1e3) ELSE '₹' || printf('%.2f', v) END AS insight,
      CASE WHEN v >= 1e7 THEN regexp_replace(printf('%.2f', v / 1e7), '\\.?0+$', '') || ' Cr'
           WHEN v >= 1e5 THEN regexp_replace(printf('%.2f', v / 1e5), '\\.?0+$', '') || ' L'
           WHEN v >= 1e3 THEN regexp_replace(printf('%.1f', v / 1e3), '\\.0+$', '') || ' K'
           ELSE regexp_replace(printf('%.2f', v), '\\.?0+$', '') END AS chart
    FROM (SELECT o_orderkey, floor(o_totalprice * o_custkey / 8) * 8 + 8 AS v FROM orders)""",
)
def format_inr_price(t):
    v = F.floor(F.col("o_totalprice") * F.col("o_custkey") / 8) * 8 + 8
    return t.orders.select(
        "o_orderkey", format_inr(v, "Total price").alias("insight"), format_inr(v, "count", "chart").alias("chart")
    )


@query(
    "text_functions",
    """SELECT p_partkey, regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]', '', 'g') AS key,
      substr(p_name, 1, 3) AS head, trim('  ' || p_type || ' ') AS kind, regexp_matches(p_brand, '#1') AS first_line,
      abs(p_size - 25) AS gap, sqrt(p_size) AS root, round_even(p_retailprice / 7, 1)::DOUBLE AS seventh,
      round(sin(p_size), 9) AS wave, least(greatest(p_size, 10), 40) AS clipped,
      CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS class, coalesce(nullif(p_type, 'ECONOMY'), 'other') AS label
    FROM part""",
)
def text_functions(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        title_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("key"),
        F.substring("p_name", 1, 3).alias("head"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("kind"),
        F.col("p_brand").rlike("#1").alias("first_line"),
        F.abs(size - 25).alias("gap"), F.sqrt(size).alias("root"),
        half_even(F.col("p_retailprice") / 7, 1).alias("seventh"), F.round(F.sin(size), 9).alias("wave"),
        F.least(F.greatest(size, F.lit(10)), F.lit(40)).alias("clipped"),
        F.when(size > 25, "large").otherwise("small").alias("class"),
        F.coalesce(F.nullif("p_type", F.lit("ECONOMY")), F.lit("other")).alias("label"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey, strftime(d, '%Y-%m') AS month, CAST(year(d) AS INTEGER) AS year, CAST(isodow(d) - 1 AS INTEGER) AS weekday,
      dayname(d) AS day_name, CAST(dayofyear(d) AS INTEGER) AS day_of_year FROM (SELECT o_orderkey, o_orderdate d FROM orders)""",
)
def date_functions(t):
    from ..functions.columns import month_text, to_time

    d = to_time(F.date_format("o_orderdate", "yyyy/M/d"))
    return t.orders.select(
        "o_orderkey", month_text(d).alias("month"), F.year(d).alias("year"), F.weekday(d).alias("weekday"),
        F.date_format(d, "EEEE").alias("day_name"), F.dayofyear(d).alias("day_of_year"),
    )


@query(
    "switch_rederive",
    """WITH c AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment,
      CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END * 2 AS twice FROM customer)
    SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS unique_count, false AS computed FROM c
    UNION ALL SELECT 'c_name', count(DISTINCT c_name), false FROM c UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), false FROM c
    UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), true FROM c UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), false FROM c
    UNION ALL SELECT 'twice', count(DISTINCT twice), true FROM c""",
)
def switch_rederive(t):
    """Switch away and back, then change the first of two steps: only its column and the one made from it are profiled again."""
    ws = Workspace(t.spark, {"customer": t.customer, "nation": t.nation})
    double = Step("add_column", {"new_column": "twice", "formula": "c_acctbal * 2"})
    ws.edit([double])
    ws.switch("nation")
    ws.switch("customer")
    graph = ws.edit([Step("add_column", {"new_column": "c_acctbal", "formula": "CASE WHEN c_acctbal < 0 THEN 0.0D ELSE c_acctbal END"}), double])
    return graph.profile().select("column", "unique_count", F.col("column").isin(*graph.profiled).alias("computed"))
