"""Read-only SQL over the tables of a workspace.

Spark's own parser decides what a statement is; nothing that writes, lists files
or calls into the JVM gets as far as ``spark.sql`` (which runs commands at once).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

# Names under which the active table is always known.
ACTIVE_NAMES = ("dataset", "data", "df")
SCREEN_LIMIT = 100  # rows of a query on a screen

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_JVM_CALLS = {"reflect", "java_method", "try_reflect"}

# Date tokens of strftime and the matching Spark letters.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy",
    "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE",
}


class QueryRefused(ValueError):
    """The statement is not a read-only query over known tables."""


@dataclass(frozen=True)
class Verdict:
    ok: bool
    message: str = ""


def add_dialect(spark: SparkSession) -> None:
    """``strftime(format, moment)`` as an SQL function; its body is inlined by the analyzer."""
    body = "f"
    for token, letters in STRFTIME.items():
        body = f"replace({body}, '{token}', '{letters}')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strftime(f STRING, moment TIMESTAMP_NTZ) RETURNS STRING "
        f"RETURN date_format(moment, {body})"
    )


def _parse(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def check(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> Verdict:
    """Is this one read-only query, over known tables if ``tables`` is given?"""
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        return Verdict(False, "empty query")
    try:
        plan = _parse(spark, text)
    except ParseException as problem:
        return Verdict(False, f"not a valid query: {str(problem).splitlines()[0]}")
    if not re.match(r"[\s(]*(select|with)\b", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S), re.I):
        return Verdict(False, "only SELECT and WITH queries are allowed")
    tree = plan.treeString()
    gateway = spark.sparkContext._gateway
    for kind in ("Command", "ParsedStatement"):
        if is_instance_of(gateway, plan, _LOGICAL + kind):
            return Verdict(False, "only SELECT and WITH queries are allowed")
    if "ScriptTransform" in tree or "InsertInto" in tree:
        return Verdict(False, "only SELECT and WITH queries are allowed")
    calls = {c.lower() for c in re.findall(r"'([a-zA-Z_]\w*)\(", tree)}
    if calls & _JVM_CALLS:
        return Verdict(False, "this function is not allowed")
    if tables is not None:
        known = {t.lower() for t in tables} | set(ACTIVE_NAMES)
        for name in _tables_read(gateway, plan, frozenset()):
            if name.lower() not in known:
                return Verdict(False, f"unknown table: {name}")
    return Verdict(True)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _tables_read(gateway, plan, scope: frozenset[str]) -> Iterator[str]:
    """Names of the tables that a parsed plan reads, without the CTE names that are in scope where they stand.

    A CTE is known to the ones after it and to the body of its own WITH (a recursive one to itself as well), not
    outside; subqueries see the scope of the place they stand in.
    """
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        inner = scope
        for entry in _items(plan.cteRelations()):
            name = entry._1().lower()
            yield from _tables_read(gateway, entry._2(), inner | {name} if plan.allowRecursion() else inner)
            inner |= {name}
        yield from _tables_read(gateway, plan.child(), inner)
        return
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in scope:
            yield ".".join(parts)
    for expression in _items(plan.expressions()):
        yield from _tables_in(gateway, expression, scope)
    for child in _items(plan.children()):
        yield from _tables_read(gateway, child, scope)


def _tables_in(gateway, expression, scope: frozenset[str]) -> Iterator[str]:
    """The same for the subqueries inside an expression."""
    if is_instance_of(gateway, expression, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        yield from _tables_read(gateway, expression.plan(), scope)
    for child in _items(expression.children()):
        yield from _tables_in(gateway, child, scope)


def safe_sql(
    spark: SparkSession,
    sql: str,
    tables: Mapping[str, DataFrame] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Run one read-only query; a ``limit``, if given, applies when the query has none of its own.

    A column missing from the active table sends the query once to the first other
    table that has it.
    """
    verdict = check(spark, sql, tables)
    if not verdict.ok:
        raise QueryRefused(verdict.message)
    text = sql.strip().rstrip(";").strip()
    try:
        df = spark.sql(text)
    except AnalysisException as problem:
        other = _reroute(text, problem, tables or {})
        if other is None:
            raise QueryRefused(str(problem).splitlines()[0]) from problem
        df = spark.sql(other)
    capped = re.search(r"\blimit\s+\d+\s*(offset\s+\d+\s*)?$", text, re.I)
    return df if limit is None or capped else df.limit(limit)


def _reroute(sql: str, problem: AnalysisException, tables: Mapping[str, DataFrame]) -> str | None:
    if not (problem.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
        return None
    missing = problem.getMessageParameters()["objectName"].replace("`", "").split(".")[-1].lower()
    for name, df in tables.items():
        if name.lower() in ACTIVE_NAMES:
            continue
        if missing in (c.lower() for c in df.columns):
            moved = re.sub(
                r"\b(from|join)\s+(dataset|data|df)\b", lambda m: f"{m[1]} {name}", sql, flags=re.I
            )
            return moved if moved != sql else None
    return None
