"""Several tables opened together, queried by name."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..operators.charts import ChartSpec, chart, normalise, table_with
from ..operators.derive import derive
from ..operators.lineage import StepGraph
from ..operators.steps import Step
from ..operators.types import apply_types, convert_mixed_to_text, mixed_columns
from .readers import read_table, safe_table_name
from .sqlguard import ACTIVE_NAMES, add_dialect, safe_sql

NAME_LENGTH = 31


def clean_sheet_name(name: str, taken: Iterable[str] = ()) -> str:
    """Table title without reserved characters, at most 31 long, unique without regard to case."""
    clean = re.sub(r"[\\/*?:\[\]]", "_", name or "Sheet").strip()[:NAME_LENGTH] or "Sheet"
    used = {t.lower() for t in taken}
    out, count = clean, 2
    while out.lower() in used:
        end = f"_{count}"
        out, count = clean[: NAME_LENGTH - len(end)] + end, count + 1
    return out


class Workspace:
    """Ordered tables, one of them active; each is a temp view."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], active: str | None = None):
        if not tables:
            raise ValueError("a workspace needs a table")
        self.spark = spark
        self.tables = dict(tables)
        self.active = active or next(iter(self.tables))
        self.graphs: dict[str, StepGraph] = {}
        self.register()

    @classmethod
    def open(cls, spark: SparkSession, paths: Iterable[str], typed: bool = True) -> Workspace:
        """One table per path; empty tables are left out, mixed columns become text."""
        tables: dict[str, DataFrame] = {}
        for path in paths:
            df = read_table(spark, path)
            if not df.columns or df.isEmpty():
                continue
            title = clean_sheet_name(PurePosixPath(path).stem.replace("_", " ").title().replace(" ", "_"), tables)
            mixed = mixed_columns(df)
            df = convert_mixed_to_text(df, mixed) if mixed else df
            tables[title] = apply_types(df) if typed else df
        return cls(spark, tables)

    @property
    def views(self) -> dict[str, DataFrame]:
        return {safe_table_name(n): df for n, df in self.tables.items()}

    def register(self) -> list[str]:
        """(Re)create the views; the active table also answers to dataset, data and df."""
        for name, df in self.views.items():
            df.createOrReplaceTempView(name)
        for alias in ACTIVE_NAMES:
            self.tables[self.active].createOrReplaceTempView(alias)
        add_dialect(self.spark)
        return [*self.views, *ACTIVE_NAMES]

    def graph(self, name: str | None = None) -> StepGraph:
        """Steps, profile and derived columns of a table (default: the active one), kept from one switch to the next."""
        name = name or self.active
        if name not in self.graphs:
            self.graphs[name] = StepGraph(self.tables[name])
        return self.graphs[name]

    def edit(self, steps: Sequence[Step]) -> StepGraph:
        """Give the active table these steps: only columns that depend on a changed step are profiled and derived again."""
        graph = self.graph()
        graph.edit(steps)
        self.tables[self.active] = graph.current
        self.register()
        return graph

    def switch(self, name: str) -> DataFrame:
        """Make another table active; its profile and derived columns are those of ``graph()``, made once per table."""
        if name not in self.tables:
            raise KeyError(f"no such table: {name}")
        if not self.tables[name].columns or self.tables[name].isEmpty():
            raise ValueError(f"table is empty: {name}")
        self.active = name
        self.register()
        return self.tables[name]

    def replace_active(self, df: DataFrame) -> None:
        self.tables[self.active] = df
        self.graphs.pop(self.active, None)
        self.register()

    def with_derived(self) -> list[dict]:
        """Add the derived columns to the active table; returns what was added."""
        wide, log = derive(self.tables[self.active])
        self.replace_active(wide)
        return log

    def table_for(self, columns: Iterable[str | None]) -> DataFrame:
        return table_with(self.tables, self.active, columns)

    def sql(self, query: str, limit: int | None = None) -> DataFrame:
        return safe_sql(self.spark, query, self.views, limit)

    def chart(self, spec: ChartSpec, screen: bool = False) -> DataFrame:
        spec = normalise(spec)
        return self.chart_source(spec) if spec.sql else chart(self.table_for([spec.x, spec.y]), spec, screen=screen)

    def chart_source(self, spec: ChartSpec) -> DataFrame:
        """The rows behind a chart: its query, uncapped, or the table with its columns."""
        spec = normalise(spec)
        return self.sql(spec.sql, None) if spec.sql else self.table_for([spec.x, spec.y])
