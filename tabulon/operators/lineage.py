"""Steps with their inputs and outputs: after an edit only what depends on it is computed again.

A step reads columns and writes columns, or changes the set of rows.  From the first step that an edit touches on, a
column is stale if a touched step writes it, or a later step writes it from a stale column; a step that
keeps rows by a stale column makes all columns stale.  The profile and the derived columns of the others stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import stored
from .derive import add_date_parts, apply_groups, derived_log, group_cuts
from .profile import profile
from .steps import Step, replay
from .types import type_map

ROW_STEPS = ("drop_na_rows", "drop_duplicates", "filter_rows", "reset_raw")


@dataclass(frozen=True)
class Effect:
    """Columns that a step reads and writes, and whether it changes the set of rows."""

    reads: frozenset[str]
    writes: frozenset[str]
    rows: bool


def _names(params: dict, *keys: str) -> list[str]:
    for key in keys:
        value = params.get(key)
        if value:
            return [value] if isinstance(value, str) else list(value)
    return []


def effect(step: Step, columns: Sequence[str]) -> Effect:
    """What a step does to a table with these columns."""
    p, every = step.params, frozenset(columns)

    def used(text: str | None) -> frozenset[str]:
        return frozenset(c for c in columns if re.search(rf"(?<![\w`]){re.escape(c)}(?!\w)|`{re.escape(c)}`", text or ""))

    if step.type == "add_column":
        return Effect(used(p.get("formula") or p.get("expression")), frozenset(_names(p, "new_column", "column")), False)
    if step.type == "rename_column":
        pairs = p.get("columns_map") or {p.get("old_name"): p.get("new_name")}
        return Effect(frozenset(pairs), frozenset([*pairs, *pairs.values()]), False)
    if step.type == "drop_column":
        return Effect(frozenset(), frozenset(_names(p, "columns", "column")), False)
    if step.type == "filter_rows":
        return Effect(used(p.get("query") or p.get("condition")), frozenset(), True)
    if step.type in ROW_STEPS:
        return Effect(frozenset(_names(p, "columns", "column")) or every, frozenset(), True)
    named = frozenset(_names(p, "columns", "column")) or every
    return Effect(named, named, False)


def stale_columns(old: Sequence[Step], new: Sequence[Step], columns: Sequence[str]) -> set[str] | None:
    """Columns that may differ after ``new`` instead of ``old`` steps; None stands for all of them.

    ``columns`` are those of any version of the table.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    touched = [*old[head:len(old) - tail], *new[head:len(new) - tail]]
    changed: set[str] = set()
    for step in touched:
        done = effect(step, columns)
        if done.rows:
            return None
        changed |= done.writes
    for step in new[len(new) - tail:]:
        done = effect(step, columns)
        if done.reads & changed:
            if done.rows:
                return None
            changed |= done.writes
    return changed


class StepGraph:
    """A raw table, its steps, and the profile and derived columns of the result.

    ``profiled`` and ``derived_again`` name the columns that the last call had to compute.
    """

    def __init__(self, raw: DataFrame, steps: Sequence[Step] = ()):
        self.raw, self.steps = raw, list(steps)
        self.current = replay(raw, self.steps)
        self.profiled: list[str] = []
        self.derived_again: list[str] = []
        self._profile: DataFrame | None = None
        self._cuts: dict[str, list[float]] | None = None
        self._dates: list[str] = []
        self._refresh(None)

    def edit(self, steps: Sequence[Step]) -> DataFrame:
        """Replace the steps; returns the new table."""
        before = list(self.current.columns)
        now = replay(self.raw, steps)
        every = list(dict.fromkeys([*self.raw.columns, *before, *now.columns]))
        stale = stale_columns(self.steps, list(steps), every)
        self.steps, self.current = list(steps), now
        self._refresh(stale)
        return now

    def _refresh(self, stale: set[str] | None) -> None:
        names = self.current.columns
        kept = [] if self._profile is None or stale is None else [c for c in names if c not in stale and c in self._known]
        fresh = [c for c in names if c not in kept]
        old = self._profile
        parts = []
        types: dict = {}
        if fresh:
            types = type_map(self.current, fresh)
            parts.append(profile(self.current.select(*[col(c) for c in fresh]), types))
        if kept:
            parts.append(old.where(F.col("column").isin(*kept)))
        order = self.current.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string")
        joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self._profile = stored(joined.join(F.broadcast(order), F.col("column") == F.col("name")).withColumn("ordinal", F.col("place")).drop("place", "name"))
        self._known = set(names)
        self.profiled = fresh
        # derived columns: dates by type, groups by their edges
        numbers = [c for c in fresh if types[c]["data_type"] == "numerical"]
        self._dates = [c for c in names if c in kept and c in self._dates or c in fresh and types[c]["data_type"] == "datetime"]
        cuts = {c: v for c, v in (self._cuts or {}).items() if c in kept}
        if numbers:
            cuts |= group_cuts(self.current, numbers)
        self._cuts = {c: cuts[c] for c in names if c in cuts}
        self.derived_again = [c for c in names if c in numbers or c in fresh and c in self._dates]

    def profile(self) -> DataFrame:
        """A row per column of the current table."""
        return self._profile

    def wide(self) -> DataFrame:
        """The current table with its derived columns."""
        return apply_groups(add_date_parts(self.current, self._dates), self._cuts or {})

    def derived(self) -> list[dict]:
        """What is derived from what, and why."""
        return derived_log(self.current, self.wide())
