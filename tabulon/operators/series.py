"""Time series: detection, preparation, lag features, splits, simple extrapolation.

All functions take ``series`` key columns, so one call handles one series or
millions.  Look-back windows run on blocks (see ``ordering``), hence a single
long series does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    clean_number, col, half_even, is_number, is_time, quote, text_time_sql, time_sql, type_of,
)
from ..session import TASK_ROWS
from .ordering import Blocks, blocks, carry_forward, first_per_group, same, with_position
from .quantiles import group_quantiles

# Words in a column name that suggest a date.
DATE_WORDS = ("date", "time", "timestamp", "datetime", "year", "month", "period", "day")
CALENDAR = ("month_part", "weekday_part", "yearday_part", "time_index")
DAY = 86_400.0


def date_sql(df: DataFrame, name: str) -> str:
    """Date of a column; a whole number is read as text, so 2024 is a year."""
    if is_number(type_of(df, name)):
        text = f"cast({quote(name)} as string)"
        return f"coalesce({text_time_sql(text)}, cast(try_to_timestamp({text}, 'yyyy') as timestamp_ntz))"
    return time_sql(df, name)


def detect_time_series(df: DataFrame, x: str | None = None, y: str | None = None) -> dict[str, Any]:
    """Date column, target column and whether a forecast makes sense; one aggregate."""
    names = df.columns
    named = [c for c in names if any(w in c.lower() for w in DATE_WORDS)]
    tested = {c for c in named if not is_time(type_of(df, c))} | ({x} if x in names else set())
    aggs = [F.count(F.lit(1)).alias("rows")]
    order = sorted(tested)
    aggs += [F.expr(f"count({date_sql(df, c)})").alias(f"d{i}") for i, c in enumerate(order)]
    if y in names:
        aggs.append(F.count(clean_number(col(y))).alias("numbers"))
    row = df.agg(*aggs).first()
    rows = row["rows"]
    parsed = {c: row[f"d{i}"] > rows * 0.5 for i, c in enumerate(order)}

    def dated(c: str) -> bool:
        return is_time(type_of(df, c)) or (c in named and parsed[c])

    candidates = ([x] if x in names else []) + list(names)
    date = next((c for c in candidates if dated(c)), None)
    if date is None:
        date = x if x in names else None  # an axis that does not parse becomes a plain sequence
    target = None
    if y in names:
        if is_number(type_of(df, y)) or row["numbers"] >= max(3, int(rows * 0.3)):
            target = y
    if target is None:
        target = next((c for c in names if is_number(type_of(df, c)) and c != date), None)
    return {
        "date_column": date, "target_column": target, "rows": rows, "suitable": target is not None and rows >= 3,
    }


def fill_dates(
    df: DataFrame, date: str, order: Sequence[str], series: Sequence[str] = (),
    anchor: datetime | None = None, limit: int = TASK_ROWS,
) -> DataFrame:
    """Missing dates take the last known one before, else the next one after (in ``order``).

    When under 3 dates or under 30 % parse, daily dates ending at ``anchor`` are laid
    out instead.
    """
    df = df.withColumn(date, F.expr(date_sql(df, date)))
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count(col(date)).alias("d")).first()
    if counts["d"] >= max(3, int(counts["n"] * 0.3)):
        if counts["d"] == counts["n"]:
            return df
        return carry_forward(df, series, order, date, limit).drop("pos")
    if anchor is None:
        raise ValueError("the dates do not parse: give an anchor for the last one")
    placed = with_position(df, series, order, "pos", limit)
    sizes = placed.groupBy(*[col(k) for k in series]).agg(F.count(F.lit(1)).alias("__n"))
    placed = same(placed, sizes, series) if series else placed.withColumn("__n", F.lit(counts["n"]))
    back = F.make_dt_interval(days=(F.col("pos") - F.col("__n") + 1).cast("int"))
    return placed.withColumn(date, F.lit(anchor).cast("timestamp_ntz") + back).drop("pos", "__n")


def prepare(
    df: DataFrame, date: str, target: str, series: Sequence[str] = (), aggregation: str | None = None,
) -> DataFrame:
    """``series, date, target`` with a numeric target, rows without target or date left out."""
    value = F.expr(f"nanvl(cast({quote(target)} as double), cast(null as double))") if is_number(
        type_of(df, target)
    ) else clean_number(col(target))
    keys = [col(k) for k in series]
    out = df.select(*keys, F.expr(date_sql(df, date)).alias(date), value.alias(target)).dropna(subset=[date, target])
    how = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min}
    if aggregation and aggregation != "none":
        out = out.groupBy(*keys, col(date)).agg(how.get(aggregation, F.avg)(col(target)).alias(target))
    return out


def target_summary(df: DataFrame, date: str, target: str, series: Sequence[str] = ()) -> DataFrame:
    ready = prepare(df, date, target, series)
    return ready.groupBy(*[col(k) for k in series]).agg(
        F.count(F.lit(1)).alias("rows"), half_even(F.avg(col(target)), 2).alias("mean"),
        half_even(F.stddev_samp(col(target)), 2).alias("std"), half_even(F.min(col(target)), 2).alias("min"),
        half_even(F.max(col(target)), 2).alias("max"), F.date_format(F.min(col(date)), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max(col(date)), "yyyy-MM-dd").alias("last_date"),
    )


def lag_names(lag_window: int) -> list[str]:
    """Feature columns for a lag window."""
    out = [f"lag_{i}" for i in range(1, lag_window + 1)]
    if lag_window >= 3:
        out += ["rolling_mean_3", "rolling_std_3"]
    if lag_window >= 7:
        out.append("rolling_mean_7")
    return out + list(CALENDAR)


def ts_features(
    df: DataFrame, date: str, target: str, series: Sequence[str] = (), lag_window: int = 7,
    aggregation: str | None = None, limit: int = TASK_ROWS,
) -> DataFrame:
    """Scaled target, lags, shifted rolling statistics, calendar features, train/test split.

    Per series of n rows the lag window is at most n // 3; features beyond it are 0.
    Rows before the window is full have null lags; ``split`` is null there.
    """
    ready = prepare(df, date, target, series, aggregation)
    keys = [col(k) for k in series]
    facts = ready.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(target)).alias("low"), F.max(col(target)).alias("high")
    )
    cut = blocks(ready, series, [date, target], lag_window, limit)
    placed = same(cut.df, facts, series) if series else _with_constants(cut.df, facts)
    window = cut.window()
    used = F.greatest(F.lit(1), F.least(F.lit(lag_window), F.floor(F.col("n") / 3).cast("int")))
    spread = F.col("high") - F.col("low")
    scaled = F.when(spread > 0, (col(target) - F.col("low")) / spread).otherwise(F.lit(0.0))
    out = placed.withColumn("scaled", scaled).withColumn("lag_used", used)
    wide = {}
    for i in range(1, lag_window + 1):
        wide[f"lag_{i}"] = F.when(F.col("lag_used") < i, F.lit(0.0)).otherwise(F.lag("scaled", i).over(window))

    def rolling(function, size):
        past = window.rowsBetween(-size, -1)
        full = F.when(F.count("scaled").over(past) == size, function("scaled").over(past))
        return F.when(F.col("lag_used") < size, F.lit(0.0)).otherwise(full)

    if lag_window >= 3:
        wide["rolling_mean_3"] = rolling(F.avg, 3)
        wide["rolling_std_3"] = rolling(F.stddev_samp, 3)
    if lag_window >= 7:
        wide["rolling_mean_7"] = rolling(F.avg, 7)
    wide["month_part"] = F.month(col(date)) / 12.0
    wide["weekday_part"] = F.weekday(col(date)) / 6.0
    wide["yearday_part"] = F.dayofyear(col(date)) / 365.0
    wide["time_index"] = F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)
    usable = F.col("n") - F.col("lag_used")
    at = F.col("pos") - F.col("lag_used")
    wide["split"] = F.when(
        at >= 0, F.when(at < F.greatest(F.lit(3), F.floor(usable * 0.8)), F.lit("train")).otherwise(F.lit("test"))
    )
    return Blocks.done(out.withColumns(wide))


def _with_constants(df: DataFrame, facts: DataFrame) -> DataFrame:
    row = facts.first()
    return df.withColumns({c: F.lit(row[c]) for c in facts.columns})


def series_step(df: DataFrame, date: str, series: Sequence[str] = (), limit: int = TASK_ROWS) -> DataFrame:
    """Median gap between consecutive dates in seconds: 1 day if not positive, 30 days for a single row."""
    keys = [col(k) for k in series]
    ready = df.select(*keys, F.expr(date_sql(df, date)).alias("d")).where(F.col("d").isNotNull())
    cut = blocks(ready, series, ["d"], 1, limit)
    gap = F.unix_micros(F.col("d").cast("timestamp")) - F.unix_micros(F.lag("d").over(cut.window()).cast("timestamp"))
    gaps = Blocks.done(cut.df.withColumn("gap", gap / 1e6))
    middle = group_quantiles(gaps, series, F.col("gap"), [0.5], limit=limit)
    sizes = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = same(sizes, middle, series, "left") if series else _with_constants(
        sizes, middle.select(F.element_at("quantiles", 1).alias("m"))
    ).withColumn("quantiles", F.array("m"))
    m = F.element_at("quantiles", 1)
    return joined.select(
        *keys, F.when(m > 0, m).when(F.col("n") <= 1, F.lit(30 * DAY)).otherwise(F.lit(DAY)).alias("step_seconds")
    )


def last_values(df: DataFrame, order: str, value: str, series: Sequence[str], n: int) -> DataFrame:
    """``series, recent``: the last ``n`` values of each series, oldest first (n is small)."""
    keys = [col(k) for k in series]
    few = first_per_group(df.select(*keys, col(order), col(value)), series, [col(order).desc(), col(value).desc()], n)
    pairs = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(value).alias("v"))))
    return few.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("recent"))


def momentum_forecast(df: DataFrame, order: str, value: str, series: Sequence[str] = (), horizon: int = 3, most: int | None = None) -> DataFrame:
    """Recent trend plus a gentle wave, in closed form: ``series, step, predicted``; at most ``most`` steps if given.

    The wave's partial sums sin(0.8) + ... + sin(0.8 i) equal
    sin(0.4 i) sin(0.4 (i + 1)) / sin(0.4), so no step depends on the one before.
    """
    steps = max(1, horizon if most is None else min(most, horizon))
    keys = [col(k) for k in series]
    ready = df.select(*keys, col(order), col(value).cast("double").alias(value)).dropna(subset=[value])
    recent = last_values(ready, order, value, series, 3)
    if not series:  # an empty table still gets the default line
        recent = recent.unionByName(df.sparkSession.range(1).select(F.array().cast("array<double>").alias("recent")))
        recent = recent.orderBy(F.desc(F.size("recent"))).limit(1)
    last = F.element_at("recent", -1)
    size = F.size("recent")
    # Three values are kept, but the divisor is min(3, n - 1), so n is needed too.
    counts = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = same(recent, counts, series) if series else _with_constants(recent, counts)
    delta = F.when(size >= 2, (last - F.element_at("recent", 1)) / F.least(F.lit(3), F.col("n") - 1)).otherwise(last * 0.05)
    i = F.col("step")
    wave = F.sin(0.4 * i) * F.sin(0.4 * (i + 1)) / F.sin(F.lit(0.4))
    line = last + i * delta + F.abs(last) * 0.02 * wave
    return joined.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *keys, "step",
        F.when(size == 0, 100.0 + (i - 1) * 15.0).otherwise(half_even(line, 2)).alias("predicted"),
    )


# Month names.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
)


def next_label(label: Column, step: Column) -> Column:
    """The label ``step`` places after ``label``: month names, dates, integers, else ``label (+i)``."""
    text = F.trim(label.cast("string"))

    def month(names):
        listed = F.array(*[F.lit(m) for m in names])
        at = F.array_position(listed, text)
        return at > 0, F.element_at(listed, (F.pmod(at - 1 + step, F.lit(12)) + 1).cast("int"))

    is_full, full = month(MONTHS)
    is_short, short = month([m[:3] for m in MONTHS])
    year_month = F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(text.isNull(), F.concat(F.lit("Period +"), step.cast("string")))
        .when(is_full, full).when(is_short, short)
        .when(text.rlike(r"^\d{4}-\d{2}$") & year_month.isNotNull(), F.date_format(F.add_months(year_month, step.cast("int")), "yyyy-MM"))
        .when(day.isNotNull(), F.date_format(F.date_add(day, (step * 30).cast("int")), "yyyy-MM-dd"))
        .when(text.rlike(r"^[+-]?\d+$"), (text.try_cast("long") + step).cast("string"))
        .otherwise(F.concat(text, F.lit(" (+"), step.cast("string"), F.lit(")")))
    )


def future_labels(df: DataFrame, order: str, label: str, series: Sequence[str] = (), horizon: int = 3) -> DataFrame:
    """``series, step, label`` that continue the labels of each series."""
    keys = [col(k) for k in series]
    last = df.groupBy(*keys).agg(F.max_by(col(label).cast("string"), col(order)).alias("last"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, "step", next_label(F.col("last"), F.col("step")).alias("label")
    )


def connected_series(
    history: DataFrame, forecast: DataFrame, order: str, label: str, value: str, series: Sequence[str] = (),
) -> DataFrame:
    """History and forecast as one line chart.

    ``forecast`` has ``series, step, label, predicted``.  The prediction line is null
    over the history except at the last point, so both lines meet there.
    """
    keys = [col(k) for k in series]
    ends = history.groupBy(*keys).agg(F.max(col(order)).alias("__end"))
    past = same(history, ends, series) if series else _with_constants(history, ends)
    past = past.select(
        *keys, F.lit(0).alias("step"), col(order).cast("string").alias("position"), col(label).cast("string").alias("label"),
        col(value).cast("double").alias("actual"),
        F.when(col(order) == F.col("__end"), col(value).cast("double")).alias("predicted"),
    )
    ahead = forecast.select(
        *keys, "step", F.lit(None).cast("string").alias("position"), "label", F.lit(None).cast("double").alias("actual"),
        "predicted",
    )
    return past.unionByName(ahead)


def top_by(df: DataFrame, score: str, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the highest score, ties by key."""
    return df.orderBy(col(score).desc_nulls_last(), col(key)).limit(n)
