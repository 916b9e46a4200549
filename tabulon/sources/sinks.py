"""Writers and append-only logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, sanitize_floats, stringify
from ..operators.ordering import first_per_group
from .readers import safe_table_name

LOGGED_ROWS = 50  # scored rows that a log entry shows


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; quotes inside values are doubled, non-finite numbers are empty."""
    flat = stringify(sanitize_floats(df))
    flat.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"').option("emptyValue", "").csv(path)


def write_workspace(tables: Mapping[str, DataFrame], path: str, partitions: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """One Parquet folder per table, partitioned by the given columns."""
    written = []
    for name, df in tables.items():
        target = f"{path}/{safe_table_name(name)}"
        writer = df.write.mode("overwrite")
        by = (partitions or {}).get(name)
        (writer.partitionBy(*by) if by else writer).parquet(target)
        written.append(target)
    return written


def prediction_log_entry(scored: DataFrame, model_id: str, batch_id: int | None = None, shown: int = LOGGED_ROWS) -> DataFrame:
    """One row on a scoring call: rows, columns, the first ``shown`` scored rows as JSON (one value holds them, so not all)."""
    first = scored.limit(shown).agg(F.collect_list(F.to_json(F.struct(*[col(c) for c in scored.columns]))).alias("sample"))
    rows = scored.agg(F.count(F.lit(1)).alias("rows")).first()[0]
    return first.select(
        F.lit(model_id).alias("model_id"), F.lit(batch_id).cast("long").alias("batch_id"), F.current_timestamp().alias("at"),
        F.lit(rows).cast("long").alias("rows"), F.array(*[F.lit(c) for c in scored.columns]).alias("columns"), "sample",
    )


def append_log(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").parquet(path)


def query_history(log: DataFrame, pinned: str = "is_pinned", at: str = "ts") -> DataFrame:
    """Pinned entries first, newest first."""
    return log.orderBy(col(pinned).desc(), col(at).desc())


def saved_queries(log: DataFrame, text: str = "sql", at: str = "ts", keep: int | None = None) -> DataFrame:
    """The distinct queries, newest first; the last ``keep`` if given."""
    latest: Column = F.max(col(at)).alias(at)
    found = log.groupBy(col(text)).agg(latest).orderBy(col(at).desc(), col(text))
    return found if keep is None else found.limit(keep)


def active_models(registry: DataFrame, chart: str = "chart_id", at: str = "trained_at") -> DataFrame:
    """The newest model of each chart: the only active one."""
    return first_per_group(registry, [chart], [col(at).desc(), col("model_id")])


def registry_view(registry: DataFrame, at: str = "trained_at") -> DataFrame:
    """All models, newest first, with a flag for the active one of each chart."""
    live = active_models(registry, at=at).select("model_id", F.lit(True).alias("is_active"))
    flagged = registry.join(live, "model_id", "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))
    return flagged.orderBy(col(at).desc(), "model_id")


def deploy(registry: DataFrame, deployments: DataFrame | None, model_id: str) -> DataFrame:
    """Upsert: the deployment of a model replaces its earlier one."""
    new = registry.where(col("model_id") == model_id).select("model_id", F.current_timestamp().alias("deployed_at"))
    if deployments is None:
        return new
    return deployments.where(col("model_id") != model_id).unionByName(new)
