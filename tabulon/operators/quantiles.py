"""Exact quantiles (linear interpolation) that do not need a group in one task.

``percentile`` keeps all distinct values of a group in one buffer.  It is used
where a count shows the group is small.  Larger columns are narrowed down: a
sketch brackets the wanted rank, one counting pass locates the rank inside the
bracket, and the few values left are read exactly.  Larger groups of a grouped
quantile go the same way, with a bracket per group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import TASK_ROWS, stored
from .ordering import same

SKETCH = 10_000
DIRECT = 20_000  # rows up to which the exact aggregate is the fastest way


def _ranks(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    out = []
    for p in probs:
        at = (n - 1) * p
        low = math.floor(at)
        out.append((low, min(low + 1, n - 1), at - low))
    return out


def column_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], limit: int = TASK_ROWS, direct: int = DIRECT
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, ``{name: [value per prob]}``; nulls are ignored.

    The result is a handful of numbers, so it lives on the driver and goes back
    into plans as literals.
    """
    names = list(columns)
    if not names:
        return {}
    data = df.select(*[columns[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    counts = data.selectExpr(*[f"count(c{i}) as c{i}" for i in range(len(names))]).first()
    result: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    small = [i for i in range(len(names)) if 0 < counts[i] <= direct]
    if small:
        plist = "array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")"
        row = data.selectExpr(*[f"percentile(c{i}, {plist}) as c{i}" for i in small]).first()
        for i in small:
            result[names[i]] = list(row[f"c{i}"])
    large = [i for i in range(len(names)) if counts[i] > direct]
    if large:
        wanted = {
            f"c{i}": sorted({r for low, high, _ in _ranks(counts[i], probs) for r in (low, high)}) for i in large
        }
        values = _order_statistics(data, wanted, {f"c{i}": counts[i] for i in large}, limit)
        for i in large:
            got = values[f"c{i}"]
            result[names[i]] = [
                got[low] + (got[high] - got[low]) * part for low, high, part in _ranks(counts[i], probs)
            ]
    return result


def _between(c: str, low, high) -> str:
    """SQL text: ``c`` inside the open interval (None = unbounded)."""
    tests = [f"{c} is not null"]
    if low is not None:
        tests.append(f"{c} > {low!r}D")
    if high is not None:
        tests.append(f"{c} < {high!r}D")
    return " and ".join(tests)


def _order_statistics(
    data: DataFrame, wanted: dict[str, list[int]], totals: dict[str, int], limit: int
) -> dict[str, dict[int, float]]:
    """Values at the given 0-based ranks of large columns, all columns together.

    Every pass is one aggregate over the data without a shuffle of rows.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    # Where each rank can lie: (column, low, high, rows below, rows inside) -> ranks; bounds are exclusive.
    spans: dict[tuple, list[int]] = {(c, None, None, 0, totals[c]): list(ranks) for c, ranks in wanted.items()}
    while spans:
        # One sketch per open interval brackets all its ranks.
        order = list(spans)
        aggs = []
        for j, (c, low, high, below, n) in enumerate(order):
            ends = sorted({min(1.0, max(0.0, (r - below) / n + side)) for r in spans[order[j]] for side in (-2 / SKETCH, 2 / SKETCH)})
            listed = ", ".join(f"{e!r}D" for e in ends)
            aggs.append(f"percentile_approx(case when {_between(c, low, high)} then {c} end, array({listed}), {SKETCH}) as s{j}")
        sketch = data.selectExpr(*aggs).first()
        # Rows below and at every cut.
        cuts = {c: sorted({v for j, span in enumerate(order) if span[0] == c for v in sketch[f"s{j}"]}) for c in wanted}
        counts = [f"count_if({c} < {v!r}D) as lt_{c}_{m}" for c in cuts for m, v in enumerate(cuts[c])]
        counts += [f"count_if({c} = {v!r}D) as eq_{c}_{m}" for c in cuts for m, v in enumerate(cuts[c])]
        row = data.selectExpr(*counts).first()
        narrowed: dict[tuple, list[int]] = {}
        for (c, low, high, below, n), ranks in spans.items():
            for r in ranks:
                span = (low, high, below, below + n)
                for m, v in enumerate(cuts[c]):
                    lt, eq = row[f"lt_{c}_{m}"], row[f"eq_{c}_{m}"]
                    if lt <= r < lt + eq:
                        found[c][r] = v
                        break
                    if r >= lt + eq and (span[0] is None or v > span[0]):
                        span = (v, span[1], lt + eq, span[3])
                    if r < lt and (span[1] is None or v < span[1]):
                        span = (span[0], v, span[2], lt)
                if r not in found[c]:
                    narrowed.setdefault((c, span[0], span[1], span[2], span[3] - span[2]), []).append(r)
        # Few values left: read the ranks off.
        ready = [(span, r) for span, ranks in narrowed.items() if span[4] <= limit for r in ranks]
        if ready:
            shaped = data.selectExpr(
                *[f"case when {_between(c, low, high)} then {c} end as s{j}" for j, ((c, low, high, _, _), _) in enumerate(ready)]
            )
            row = shaped.selectExpr(
                *[
                    f"percentile_disc({(r - below + 0.5) / n!r}D) within group (order by s{j}) as s{j}"
                    for j, ((_, _, _, below, n), r) in enumerate(ready)
                ]
            ).first()
            for j, (span, r) in enumerate(ready):
                found[span[0]][r] = row[f"s{j}"]
        spans = {span: ranks for span, ranks in narrowed.items() if span[4] > limit}
    return found


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Sequence[float],
    name: str = "quantiles",
    limit: int = TASK_ROWS,
) -> DataFrame:
    """``keys`` plus an array of quantiles of ``value`` per group (nulls ignored)."""
    plist = F.array(*[F.lit(float(p)) for p in probs])
    key_cols = [col(k) for k in keys]
    base = df.select(*key_cols, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    limit = min(limit, DIRECT)  # a task holds the values of many groups at once
    sizes = stored(base.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("__n")))
    biggest, smallest = sizes.agg(F.max("__n"), F.min("__n")).first()
    if (biggest or 0) <= limit:
        return base.groupBy(*key_cols).agg(F.percentile("__v", plist).alias(name))
    large_keys = sizes.where(F.col("__n") > limit)
    wide = base if smallest > limit else same(base, large_keys, keys).drop("__n")
    large = _bracketed(wide, large_keys, keys, probs, name, max(2 / SKETCH, 2 / (limit + 1)))
    if smallest > limit:
        return large
    small_keys = sizes.where(F.col("__n") <= limit)
    small = same(base, small_keys, keys).drop("__n").groupBy(*key_cols).agg(F.percentile("__v", plist).alias(name))
    return small.unionByName(large)


def _bracketed(base: DataFrame, sizes: DataFrame, keys: Sequence[str], probs: Sequence[float], name: str, room: float) -> DataFrame:
    """Quantiles of few large groups: a sketch brackets each rank with ``room`` (a share) on both sides, one pass counts
    what is below and the values inside, and the window over these finds the ranks.

    A rank that the sketch missed shows in the counts; the brackets are widened then.
    """
    key_cols = [col(k) for k in keys]
    ends = F.array(*[F.lit(min(1.0, max(0.0, float(p) + side))) for p in probs for side in (-room, room)])
    cuts = stored(base.groupBy(*key_cols).agg(F.percentile_approx("__v", ends, SKETCH).alias("__cuts"), F.count(F.lit(1)).alias("__n")))
    met = [F.when(F.col("__v") <= F.col("__cuts")[2 * i + 1], F.struct(
        F.lit(i).alias("i"), F.when(F.col("__v") >= F.col("__cuts")[2 * i], F.col("__v")).alias("v"))) for i in range(len(probs))]
    listed = same(base, cuts, keys).select(*key_cols, "__n", F.explode(F.array_compact(F.array(*met))).alias("__m"))
    # A row for everything below a bracket (no value), and one per value inside.
    counted = listed.groupBy(*key_cols, "__n", F.col("__m.i").alias("__i"), F.col("__m.v").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*key_cols, "__i").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1)
    placed = counted.withColumn("__b", F.coalesce(F.sum("__c").over(before), F.lit(0))).where("__v is not null").withColumns(
        {"__low": F.floor(at), "__high": F.ceil(at), "__at": at})
    low = F.col("__low").between(F.col("__b"), F.col("__b") + F.col("__c") - 1)
    high = F.col("__high").between(F.col("__b"), F.col("__b") + F.col("__c") - 1)
    part = F.when(low & high, F.col("__v")).when(low, (F.col("__low") + 1 - F.col("__at")) * F.col("__v")).when(
        high, (F.col("__at") - F.col("__low")) * F.col("__v"))
    found = stored(placed.groupBy(*key_cols).agg(
        F.array(*[F.sum(F.when(F.col("__i") == i, part)) for i in range(len(probs))]).alias(name),
        (F.count_if(low) + F.count_if(high)).alias("__hits")))
    hits = found.agg(F.count(F.lit(1)), F.coalesce(F.min("__hits"), F.lit(0))).first()
    if tuple(hits) != (sizes.count(), 2 * len(probs)) and room < 1:
        return _bracketed(base, sizes, keys, probs, name, room * 8 + 1 / SKETCH)
    return found.drop("__hits")
