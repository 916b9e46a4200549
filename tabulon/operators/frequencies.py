"""Distinct counts, most frequent and smallest values of all columns without moving their cells.

One pass keeps, per task and column, the counts of all values while there are few, and for wider columns a
heavy-hitter sketch with a known error, and the smallest values.  Only these summaries are shuffled.  For the wide columns a
second pass counts distinct digests and, exactly, the candidates that the sketch names; a candidate whose exact count is above
the sketch's error is the most frequent value for certain.  Only where none is (no value stands out, yet some repeat) the values of that column
are grouped in full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quote, type_of
from ..session import stored
from .ordering import first_per_group

NARROW = 4_096  # values of a column that a task counts one by one; beyond, size of its sketch
SAMPLES = 5


def kind_of(df: DataFrame, name: str) -> str:
    """How values are compared and counted: ``bigint``, ``double`` or ``string``."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if isinstance(dtype, (T.DoubleType, T.FloatType)) else "string"


NAN = float("nan")


def _order(value):
    """Sort key: NaN comes last."""
    return value != value, value


class Counter:
    """Counts of one column in one task: exact while narrow, then a Misra-Gries sketch and the smallest values."""

    def __init__(self, size: int, sketched: bool):
        self.size, self.sketched, self.wide, self.error = size, sketched, False, 0
        self.counts: dict = {}
        self.low: list = []

    def open(self, values: pa.Array) -> pa.Array:
        """The values that can still change something: once a column is wide and has no sketch, those below its largest sample."""
        if not self.wide or self.sketched or len(self.low) < SAMPLES or self.low[-1] != self.low[-1]:
            return values
        return values.filter(pc.less(values, pa.scalar(self.low[-1], values.type)))

    def add(self, values: list, counts: list[int]) -> None:
        known = self.counts
        values = [v if v == v else NAN for v in values]  # one NaN object, so that NaNs are one key
        if not self.wide:
            for v, n in zip(values, counts):
                known[v] = known.get(v, 0) + n
            if len(known) <= self.size:
                return
            self.wide, self.low = True, heapq.nsmallest(SAMPLES, known, _order)
        else:
            fresh = [v for v in values if len(self.low) < SAMPLES or _order(v) < _order(self.low[-1])]
            if fresh:
                self.low = heapq.nsmallest(SAMPLES, {*self.low, *fresh}, _order)
            if self.sketched:
                for v, n in zip(values, counts):
                    known[v] = known.get(v, 0) + n
        if not self.sketched:
            known.clear()
        elif len(known) > self.size:
            cut = heapq.nlargest(self.size + 1, known.values())[-1]
            self.error += cut
            self.counts = {v: n - cut for v, n in known.items() if n > cut}


def summaries(df: DataFrame, columns: list[str], sketched: set[str], size: int = NARROW) -> DataFrame:
    """``ordinal, kind, whole, number, text, n`` per task: ``z`` nulls (and ``whole``: rows), ``c`` counts, or ``w`` error, ``k``
    candidates and ``l`` smallest values."""
    kinds = [kind_of(df, c) for c in columns]
    schema = pa.schema([("ordinal", pa.int32()), ("kind", pa.string()), ("whole", pa.int64()), ("number", pa.float64()), ("text", pa.string()), ("n", pa.int64())])
    place = {"bigint": "whole", "double": "number", "string": "text"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter(size, c in sketched) for c in columns]
        rows_seen, nulls = 0, [0] * len(columns)
        for batch in batches:
            rows_seen += batch.num_rows
            for i, (counter, values) in enumerate(zip(counters, batch.columns)):
                nulls[i] += values.null_count
                left = counter.open(values.drop_null())
                if not len(left):
                    continue
                found = pc.value_counts(left)
                counter.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        out: dict[str, list] = {f.name: [] for f in schema}
        for i, (counter, kind) in enumerate(zip(counters, kinds)):
            rows = [("c" if not counter.wide else "k", v, n) for v, n in counter.counts.items()]
            if counter.wide:
                rows += [("w", None, counter.error)] + [("l", v, 0) for v in counter.low]
            out["ordinal"].append(i)
            for name, v in (("kind", "z"), ("whole", rows_seen), ("number", None), ("text", None), ("n", nulls[i])):
                out[name].append(v)
            for tag, v, n in rows:
                out["ordinal"].append(i)
                out["kind"].append(tag)
                for name in ("whole", "number", "text"):
                    out[name].append(v if name == place[kind] else None)
                out["n"].append(n)
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    typed = df.selectExpr(*[f"cast({quote(c)} as {k}) as c{i}" for i, (c, k) in enumerate(zip(columns, kinds))])
    return typed.mapInArrow(work, "ordinal int, kind string, whole long, number double, text string, n long")


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """``ordinal, value`` of the given columns (of one kind), nulls left out."""
    pairs = ", ".join(f"{i}, cast({quote(c)} as {kind})" for i, c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (ordinal, value)").where("value is not null")


def column_facts(df: DataFrame, columns: Iterable[str], worded: Iterable[str] = (), size: int = NARROW) -> DataFrame:
    """``column, rows, nulls, distinct_values, sample_values, top_value, top_frequency`` per column.

    Nulls are left out; ties of the most frequent value go to the smallest text.  ``top_value`` is given for the columns in
    ``worded``.  Distinct texts of a wide column are told apart by 64-bit digests.
    """
    names = list(columns)
    want = set(worded)
    kinds = [kind_of(df, c) for c in names]
    found = stored(summaries(df, names, want, size))
    wide = {r["ordinal"]: r["error"] for r in found.where("kind = 'w'").groupBy("ordinal").agg(F.sum("n").alias("error")).collect()}
    values = found.where("kind not in ('w', 'z')").withColumn("value", F.coalesce(F.col("whole").cast("string"), F.col("number").cast("string"), "text"))
    rank = F.coalesce(F.col("whole").cast("double"), F.col("number"))
    # counts of narrow columns are whole; of wide ones they are lower bounds
    counted = values.groupBy("ordinal", "value").agg(F.max(rank).alias("number"), F.sum("n").alias("n"))
    few = first_per_group(counted, ["ordinal"], [F.col("number"), F.col("value")], SAMPLES)
    listed = F.sort_array(F.collect_list(F.struct("number", "value")))
    samples = few.groupBy("ordinal").agg(F.transform(listed, lambda s: s["value"]).alias("sample_values"))
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    narrow = counted.where(~F.col("ordinal").isin(*wide)) if wide else counted
    facts = narrow.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_values"), top.alias("top"))
    if wide:
        facts = facts.unionByName(_wide_facts(df, names, kinds, wide, counted, want))
    table = df.sparkSession.createDataFrame(list(enumerate(names)), "ordinal int, column string")
    sizes = found.where("kind = 'z'").groupBy("ordinal").agg(F.sum("whole").alias("rows"), F.sum("n").alias("nulls"))
    worded_place = [i for i, c in enumerate(names) if c in want]
    is_worded = F.col("ordinal").isin(*worded_place) if worded_place else F.lit(False)
    every = table.join(sizes, "ordinal", "left").join(facts.join(samples, "ordinal"), "ordinal", "left")
    return every.select(
        "column", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("nulls", F.lit(0)).alias("nulls"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "sample_values", F.when(is_worded, F.col("top.value")).alias("top_value"),
        F.when(is_worded, -F.col("top.n")).alias("top_frequency"))


def _wide_facts(df: DataFrame, names: list[str], kinds: list[str], wide: dict[int, int], counted: DataFrame, want: set[str]) -> DataFrame:
    """``ordinal, distinct_values, top`` of the columns whose values were too many to count in a task."""
    parts = []
    for kind in ("bigint", "double", "string"):
        mine = [(i, names[i]) for i in wide if kinds[i] == kind]
        if mine:
            digest = F.xxhash64("value") if kind == "string" else F.col("value")
            parts.append(_long(df, mine, kind).select("ordinal", digest.alias("d")).groupBy("ordinal", "d").agg(F.count(F.lit(1)).alias("n")).groupBy("ordinal").agg(
                F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("cells")))
    sizes = {r["ordinal"]: r for r in reduce(lambda a, b: a.unionByName(b), parts).collect()}  # a row per column
    tops: dict[int, tuple[int, str] | None] = dict.fromkeys(wide)
    open_ = [i for i in wide if names[i] in want]
    for i in [i for i in open_ if sizes[i]["distinct_values"] == sizes[i]["cells"]]:
        tops[i] = (1, counted.where(F.col("ordinal") == i).agg(F.min("value")).first()[0])
        open_.remove(i)
    if open_:
        # candidates that can still be the first: their lower bound plus the error reaches the best lower bound
        best = {r["ordinal"]: r["n"] for r in counted.where(F.col("ordinal").isin(*open_)).groupBy("ordinal").agg(F.max("n").alias("n")).collect()}
        reach = reduce(lambda a, b: a | b, [(F.col("ordinal") == i) & (F.col("n") + wide[i] >= best[i]) for i in open_])
        chosen = counted.where(reach).select("ordinal", F.col("value").alias("candidate"))
        cells = _long(df, [(i, names[i]) for i in open_], "string").withColumnRenamed("ordinal", "place")
        exact = cells.join(chosen, (F.col("place") == F.col("ordinal")) & (F.col("value") == F.col("candidate"))).groupBy("ordinal", "value").agg(
            F.count(F.lit(1)).alias("n")).groupBy("ordinal").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("top"))
        for r in exact.collect():
            if -r["top"]["n"] > wide[r["ordinal"]]:
                tops[r["ordinal"]] = (-r["top"]["n"], r["top"]["value"])
    for i in open_:
        if tops[i] is None:
            groups = _long(df, [(i, names[i])], "string").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            first = groups.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("top")).first()["top"]
            tops[i] = (-first["n"], first["value"])
    rows = [(i, sizes[i]["distinct_values"], None if tops[i] is None else (-tops[i][0], tops[i][1])) for i in wide]
    return df.sparkSession.createDataFrame(rows, "ordinal int, distinct_values long, top struct<n:long,value:string>")
