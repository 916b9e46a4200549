from __future__ import annotations

from datetime import date, timedelta

from conftest import rows

from tabulon.operators.derive import derive
from tabulon.operators.profile import distinct_values, duplicate_rows, profile, quality_report
from tabulon.operators.types import apply_types, convert_mixed_to_text, infer_types, mixed_columns, type_map


def customers(spark):
    data = [
        (i, 20 + i, "Retail" if i % 2 else "Corporate", f"2023-01-{i + 1:02d}", i % 3 == 0) for i in range(10)
    ]
    return spark.createDataFrame(data, "customer_id long, age long, segment string, signup_date string, churned boolean")


def test_types_of_customers(spark):
    kinds = {r["column"]: r["data_type"] for r in rows(infer_types(customers(spark)))}
    assert kinds == {
        "customer_id": "numerical", "age": "numerical", "segment": "categorical", "signup_date": "datetime", "churned": "boolean",
    }
    assert duplicate_rows(customers(spark)).first()[0] == 0


def test_zero_one_integers_are_boolean_and_nulls_categorical(spark):
    df = spark.createDataFrame([(0, None), (1, None), (1, None)], "flag int, empty string")
    facts = type_map(df)
    assert facts["flag"] == {"data_type": "boolean", "sql_type": "BOOLEAN", "is_mixed": False}
    assert facts["empty"]["data_type"] == "categorical"


def test_short_date_columns_are_not_datetime(spark):
    df = spark.createDataFrame([(f"2023-01-0{i}",) for i in range(1, 8)], "d string")
    assert type_map(df)["d"]["data_type"] == "categorical"


def test_number_texts(spark):
    df = spark.createDataFrame([("1", "1.5", "1d"), ("2", "-3e2", "2"), ("7", ".5", "3")], "a string, b string, c string")
    facts = type_map(df)
    assert (facts["a"]["data_type"], facts["a"]["sql_type"]) == ("numerical", "INTEGER")
    assert (facts["b"]["data_type"], facts["b"]["sql_type"]) == ("numerical", "REAL")
    assert facts["c"]["data_type"] == "text"  # a type suffix is no number
    typed = apply_types(df, facts)
    assert dict(typed.dtypes)["a"] == "bigint" and dict(typed.dtypes)["b"] == "double"


def test_mixed_columns_and_conversion(spark):
    data = [("100", "A102", "10", "red", "2024-01-01"), ("Pending", "A103", "20", "blue", "2024-01-02"), ("250.0", "B1", "30", "red", "2024-01-03"),
            ("N/A", "C9", "40", "red", "2024-01-04"), ("nan", "C9", "40", "red", "2024-01-05")]
    df = spark.createDataFrame(data, "status string, code string, plain string, word string, day string")
    assert mixed_columns(df) == ["status", "code"]
    out = [r["status"] for r in convert_mixed_to_text(df).select("status").collect()]
    assert out == ["100", "Pending", "250", "N/A", None]


def test_conversion_keeps_blanks(spark):
    df = spark.createDataFrame([("  Alice  ",), ("   100   ",), ("  ORD 99  ",)], "s string")
    assert [r[0] for r in convert_mixed_to_text(df).collect()] == ["  Alice  ", "   100   ", "  ORD 99  "]


def test_profile_numbers(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (4.0, None), (100.0, "b")], "v double, w string")
    got = {r["column"]: r for r in rows(profile(df))}
    v, w = got["v"], got["w"]
    assert (v["min"], v["max"], v["mean"], v["median"], v["q25"], v["q75"], v["outliers"]) == (1.0, 100.0, 22.0, 3.0, 2.0, 4.0, 1)
    assert (w["null_count"], w["null_pct"], w["unique_count"], w["top_value"], w["top_frequency"]) == (1, 20.0, 2, "a", 2)
    assert w["cardinality_ratio"] == 0.4 and w["sample_values"] == ["a", "b"]


def test_profile_sketch_mode_and_odd_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "`a b.c` int, `it's` string")
    got = {r["column"]: r for r in rows(profile(df, exact=False))}
    assert got["a b.c"]["unique_count"] == 3 and got["it's"]["unique_count"] == 2
    assert {r["column"] for r in rows(profile(df))} == {"a b.c", "it's"}


def test_profile_counts_add_up(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    n = orders.count()
    assert all(r["rows"] == n for r in rows(profile(orders)))


def test_quality_report(spark):
    data = [("a", None), ("a", None), ("b", 1.0), ("c", None)]
    r = quality_report(spark.createDataFrame(data, "k string, v double"), converted=["k"]).first()
    assert (r["rows"], r["duplicate_rows"], r["missing_cells"], r["missing_cells_pct"]) == (4, 1, 3, 37.5)
    text = " | ".join(r["warnings"])
    assert "duplicate" in text and "Only 4 rows" in text and "75.0% empty" in text and "mixes" in text


def test_distinct_values_skip_empty(spark):
    df = spark.createDataFrame([("b",), ("",), ("a",), (None,), ("a",)], "s string")
    assert [r[0] for r in distinct_values(df, "s").collect()] == ["a", "b"]


def test_derived_columns(spark):
    start = date(2023, 1, 1)
    data = [((start + timedelta(days=i)).isoformat(), 100 + 25 * i) for i in range(60)]
    df = spark.createDataFrame(data, "order_date string, revenue long")
    wide, log = derive(df)
    assert {"order_date_year", "order_date_month", "order_date_day_of_week", "revenue_group"} <= set(wide.columns)
    assert len(log) == 4
    first = wide.orderBy("order_date").first()
    assert (first["order_date_year"], first["order_date_month"], first["order_date_day_of_week"]) == ("2023", "2023-01", "Sunday")
    sizes = {r["revenue_group"]: r["count"] for r in wide.groupBy("revenue_group").count().collect()}
    assert sizes == {"Low": 15, "Medium-Low": 15, "Medium-High": 15, "High": 15}


def test_frequencies_of_narrow_and_wide_columns(spark):
    """Sketched columns give exact results: a value that stands out, unique values, ties, NaN, nulls, an empty column and table."""
    import math

    from tabulon.operators.frequencies import column_facts

    n = 900
    data = [("hot" if i % 3 == 0 else f"w{i}", f"id{i:04d}", f"p{i // 2:03d}", None, i % 400, math.nan if i % 5 == 0 else i * 0.5, "ab"[i % 2]) for i in range(n)]
    df = spark.createDataFrame(data, "a string, b string, c string, d string, e int, f double, g string").repartition(5)
    got = {r["column"]: r for r in rows(column_facts(df, df.columns, ["a", "b", "c", "d", "g"], size=20))}
    assert (got["a"]["top_value"], got["a"]["top_frequency"], got["a"]["distinct_values"]) == ("hot", 300, 601)
    assert (got["b"]["top_value"], got["b"]["top_frequency"], got["b"]["distinct_values"]) == ("id0000", 1, 900)
    assert (got["c"]["top_value"], got["c"]["top_frequency"], got["c"]["distinct_values"]) == ("p000", 2, 450)
    assert (got["d"]["distinct_values"], got["d"]["nulls"], got["d"]["rows"], got["d"]["top_value"]) == (0, n, n, None)
    assert (got["e"]["distinct_values"], got["e"]["sample_values"], got["e"]["top_value"]) == (400, ["0", "1", "2", "3", "4"], None)
    assert got["f"]["distinct_values"] == 721 and got["f"]["sample_values"][0] == "0.5"
    assert (got["g"]["top_value"], got["g"]["top_frequency"], got["g"]["sample_values"]) == ("a", 450, ["a", "b"])
    plain = {r["column"]: r for r in rows(column_facts(df, df.columns, ["a", "b", "c", "d", "g"]))}
    assert plain == got
    assert {r["distinct_values"] for r in rows(column_facts(df.limit(0), df.columns))} == {0}


def test_wide_column_without_sketch_takes_smaller_values_only():
    import pyarrow as pa

    from tabulon.operators.frequencies import Counter

    for values, later, left in ((list(range(10, 40)), [50, 3, 12, 14, 99], [3, 12]), ([f"m{i:02}" for i in range(30)], ["z", "a", "m03"], ["a", "m03"]),
                                ([float(i) for i in range(30)], [float("nan"), -1.0, 7.0], [-1.0])):
        counter = Counter(8, False)
        assert counter.open(pa.array(later)).to_pylist()[1:] == later[1:]
        counter.add(values, [1] * len(values))
        assert counter.wide and counter.open(pa.array(later)).to_pylist() == left
