from __future__ import annotations

from datetime import datetime

from conftest import rows

from tabulon.functions.columns import format_inr, sanitize_floats
from tabulon.sources.readers import detect_format, read_csv, read_table, records_to_df, refused_lines, sniff_csv
from tabulon.sources.sinks import active_models, append_log, deploy, prediction_log_entry, query_history, registry_view, saved_queries, write_csv, write_workspace
from tabulon.sources.workspace import Workspace


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_layouts(spark, tmp_path):
    for sep in ",;\t|":
        path = write(tmp_path / f"t{ord(sep)}.csv", f" id {sep}name{sep}age\n1{sep}Ann{sep}30\n2{sep}Bob{sep}\n3{sep}Cid{sep}41\n")
        df = read_csv(spark, path)
        assert df.columns == ["id", "name", "age"]
        assert [r["age"] for r in rows(df.orderBy("id"))] == ["30", None, "41"]


def test_long_lines_dropped_short_padded_tokens_null(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'a,b\n1,x\n2,y,z\n3\n4,NaN\n5,"p,q"\n6,"say ""hi"""\n')
    got = {r["a"]: r["b"] for r in rows(read_csv(spark, path))}
    assert got == {"1": "x", "3": None, "4": None, "5": "p,q", "6": 'say "hi"'}


def test_late_bytes_dialects_and_refused_lines(spark, tmp_path):
    """A latin-1 byte far down, UTF-8 beside it, two delimiters in one folder, empty surplus fields, and the count of lines left out."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    lines = [f"{i},name {i}\n".encode() for i in range(2000)] + [b"2000,Zo\xeb\n", "2001,Ægir 東京\n".encode(), b"3,4,\n", b'2002,"x,y"\n', b'2003,"x,y",z\n', b"2004\n"]
    (folder / "a.csv").write_bytes(b"\xef\xbb\xbfid,name\n" + b"".join(lines))
    write(folder / "b.csv", "name;id;more\nBea;9000;m\nCarl;9001;n;o;p\n")
    (folder / "c.csv").write_bytes(b"")
    df = read_csv(spark, str(folder))
    assert df.columns == ["id", "name", "more"]
    got = {r["id"]: r["name"] for r in rows(df)}
    assert len(got) == df.count() == 2005
    assert [got[k] for k in ("2000", "2001", "2002", "2004", "9000")] == ["Zoë", "Ægir 東京", "x,y", None, "Bea"]
    refused = {r["file"].rsplit("/", 1)[-1]: r["lines"] for r in rows(refused_lines(spark, str(folder)))}
    assert refused == {"a.csv": 2, "b.csv": 1}
    assert {r["name"] for r in rows(df.select("name").where("id = '2001'"))} == {"Ægir 東京"}
    assert rows(read_csv(spark, write(tmp_path / "w.csv", "a,b\n€,1\n", "cp1252"), encoding="windows-1252"))[0]["a"] == "€"


def test_latin_text(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,name\n1,Zoë\n2,Ægir\n", "latin-1")
    assert sniff_csv((tmp_path / "t.csv").read_bytes())[0] == "ISO-8859-1"
    assert [r["name"] for r in rows(read_csv(spark, path).orderBy("id"))] == ["Zoë", "Ægir"]


def test_detect_and_read(spark, tmp_path, small):
    assert detect_format(spark, f"{small}/nation.parquet") == "parquet"
    assert read_table(spark, f"{small}/nation.parquet").count() == 25
    (tmp_path / "x.dat").write_bytes(b"PK\x03\x04rest")
    assert detect_format(spark, str(tmp_path / "x.dat")) == "spreadsheet"
    assert detect_format(spark, write(tmp_path / "r.json", '{"a": 1}\n')) == "json"


def test_open_workspace(spark, tmp_path):
    lines = "\n".join(f"2024-01-{i:02d},{i},A{i}" for i in range(1, 13))
    paths = [write(tmp_path / "north_sales.csv", "day,units,code\n" + lines + "\n"), write(tmp_path / "empty.csv", "a,b\n")]
    ws = Workspace.open(spark, paths)
    assert list(ws.tables) == ["North_Sales"]
    kinds = dict(ws.sql("SELECT * FROM north_sales").dtypes)
    assert kinds == {"day": "timestamp_ntz", "units": "bigint", "code": "string"}
    log = ws.with_derived()
    assert {e["derived_column"] for e in log} == {"day_year", "day_month", "day_day_of_week"}


def test_records(spark):
    df = records_to_df(spark, [{"a": 1, "b": "x"}, {"a": 2.5, "c": True}])
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "boolean")]
    assert df.count() == 2


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', float("nan")), (2, None, 2.5)], "id int, s string, v double")
    write_csv(df, str(tmp_path / "out"))
    back = {r["id"]: (r["s"], r["v"]) for r in rows(read_csv(spark, str(tmp_path / "out")))}
    assert back == {"1": ('say "hi", ok', None), "2": (None, "2.5")}
    assert write_workspace({"My Table": df}, str(tmp_path / "ws")) == [f"{tmp_path}/ws/my_table"]
    assert spark.read.parquet(f"{tmp_path}/ws/my_table").count() == 2


def test_logs(spark, tmp_path):
    scored = spark.createDataFrame([(i, "yes") for i in range(60)], "id int, p string")
    for _ in range(2):
        append_log(prediction_log_entry(scored, "m1"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [(r["rows"], len(r["sample"])) for r in rows(log)] == [(60, 50), (60, 50)]
    data = [(f"q{i % 25}", datetime(2024, 1, 1, i % 24, i % 60), i == 3) for i in range(50)]
    history = spark.createDataFrame(data, "sql string, ts timestamp, is_pinned boolean")
    assert query_history(history).first()["is_pinned"]
    assert saved_queries(history).count() == 25
    kept = rows(saved_queries(history, keep=20))
    assert len(kept) == 20 and len({r["sql"] for r in kept}) == 20


def test_registry(spark):
    data = [("a", "c1", 1), ("b", "c1", 2), ("c", "c2", 1)]
    models = spark.createDataFrame(data, "model_id string, chart_id string, trained_at int")
    assert {r["model_id"] for r in rows(active_models(models))} == {"b", "c"}
    assert [(r["model_id"], r["is_active"]) for r in rows(registry_view(models))][0] == ("b", True)
    one = deploy(models, None, "a")
    assert deploy(models, one, "a").count() == 1


def test_nested_floats(spark):
    df = spark.sql("SELECT array(1.0D, double('nan')) a, named_struct('x', double('inf'), 'b', true) s, map('k', double('-inf')) m")
    assert sanitize_floats(df).first().asDict(True) == {"a": [1.0, None], "s": {"x": None, "b": True}, "m": {"k": None}}


def test_number_formats(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(25_000_000.0,), (250_000.0,), (1_500.0,), (12.5,), (-1500.0,)], "v double")
    got = df.select(format_inr(F.col("v"), "Revenue"), format_inr(F.col("v"), "n", "chart"), format_inr(F.col("v"), "price", "kpi")).collect()
    assert [tuple(r) for r in got] == [
        ("₹2.50 Cr", "2.5 Cr", "₹2.5 Cr"), ("₹2.50 Lakh", "2.5 L", "₹2.5 L"), ("₹1.5 K", "1.5 K", "₹1,500"), ("₹12.50", "12.5", "₹12.5"),
        ("₹-1.5 K", "-1.5 K", "₹-1,500"),
    ]
