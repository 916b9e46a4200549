"""Compare registered queries with their SQL on DuckDB: ``python check.py [pattern] [sf]``."""

from __future__ import annotations

import fnmatch
import math
import sys
import time
import traceback

import duckdb
import pandas as pd

from tabulon.plans import load
from tabulon.plans.registry import ORACLES, QUERIES, TABLES
from tabulon.session import build_session


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return str(value) if not isinstance(value, (int, float, bool, str)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=lambda r: tuple(str(v) for v in r))


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and not isinstance(a, str) and not isinstance(b, str) and (
            math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
        )
    return a == b


def compare(spark, con, name, folder):
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got[1])} rows {took:.1f}s"
    result = con.execute(ORACLES[name])
    types = [str(d[1]) for d in result.description]
    want = rows_of([d[0] for d in result.description], result.fetchall())
    odd = [x for x in types if "DECIMAL" in x or "HUGEINT" in x]
    note = f" ODD TYPES {odd}" if odd else ""
    if got[0] != want[0]:
        return f"FAIL columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"FAIL rows {len(got[1])} != {len(want[1])}"
    if got[1] == want[1]:
        return f"ok {len(got[1])} rows {took:.1f}s{note}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    far = [(a, b) for a, b in bad if not all(close(x, y) for x, y in zip(a, b))]
    label = "FAIL values" if far else "CLOSE"
    return f"{label} {len(far or bad)} of {len(got[1])}: {got[0]} {(far or bad)[:3]}{note}"


def main():
    pattern = sys.argv[1] if len(sys.argv) > 1 else "*"
    folder = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = build_session("check", 8)
    bad = 0
    for name in QUERIES:
        if not any(fnmatch.fnmatch(name, p) for p in pattern.split(",")):
            continue
        try:
            verdict = compare(spark, con, name, folder)
        except Exception as problem:  # report and go on with the next query
            if len(pattern.split(",")) <= 3:
                traceback.print_exc()
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name}: {verdict}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
