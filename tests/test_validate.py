import pytest
from pyspark.sql import functions as F

from strandline.operators import validate as v
from strandline.operators.metadata import Declared


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("int", ["5", " 5 ", "+5", "-7", "1_000", "", None], ["5.0", "x", "1__0", "5e1"]),
        ("numeric", ["5", "5.", ".5", "-1e3", "nan", "inf", "1_0.5"], [".", "e5", "1,5", "x"]),
        ("date", ["2025-02-15", "20250215", "2025-02-15T10:00:00", "2025-02-15 10:00"], ["10", "2025-02", "Feb 3", "2025-02-30", "20251345"]),
        ("string", ["x", ""], []),
        ("whatever", ["x"], []),
    ],
)
def test_type_ok(spark, kind, good, bad):
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, want boolean")
    got = df.select("t", "want", v.type_ok(F.col("t"), kind).alias("ok")).collect()
    assert [(r["t"], r["ok"]) for r in got] == [(r["t"], r["want"]) for r in got]


def test_lenient_dates(spark):
    df = spark.createDataFrame([("Feb 3",), ("10",), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(v.type_ok(F.col("t"), "date", lenient_dates=True)).collect()] == [True, True, False, True]


COLUMNS = (Declared("s", "a", "int", False), Declared("s", "b", "date"), Declared("s", "c", "string", False))


def errors(df):
    return sorted((r["batch_id"], r["row_no"], r["column"], r["kind"]) for r in df.collect())


def test_csv_cells_and_the_prefix(spark):
    rows = spark.createDataFrame([("x", 1, "1", "2025-01-01"), ("x", 2, "", "bad"), ("x", 201, "bad", None), ("y", 1, "1", "")], "batch_id string, row_no long, a string, b string")
    missing = [("x", 0, "c", "missing_column"), ("y", 0, "c", "missing_column")]
    cells = [(b, n, "c", "null_not_allowed") for b, n in (("x", 1), ("x", 2), ("y", 1))]
    first = [("x", 2, "a", "null_not_allowed"), ("x", 2, "b", "type_mismatch(date)")]
    assert errors(v.csv_errors(rows, COLUMNS)) == sorted(missing + cells + first)
    everything = v.csv_errors(rows, COLUMNS, sample_rows=None)
    assert ("x", 201, "a", "type_mismatch(int)") in errors(everything)
    found = {r["batch_id"]: (r["total_rows"], r["n_errors"], r["ok"]) for r in v.verdicts(rows, v.csv_errors(rows, COLUMNS[:1])).collect()}
    assert found == {"x": (3, 1, False), "y": (1, 0, True)}


def test_json_errors(spark):
    columns = (Declared("s", "id", "string", False), Declared("s", "n", "point"), Declared("s", "f", "double"), Declared("s", "ok", "bool"))
    lines = [
        ('{"id": "7", "n": 1, "f": 1.5, "ok": true}', None), ('{"id": "7", "n": 1.0, "extra": {"x": 1}}', None), ('{"id": "7"', "invalid_json"),
        ("[1]", "schema_mismatch"), ('{"n": 1}', "schema_mismatch"), ('{"id": 7}', "schema_mismatch"), ('{"id": "7", "n": null}', "schema_mismatch"),
        ('{"id": "7", "n": "1"}', "schema_mismatch"), ('{"id": "7", "f": 2}', None), ('{"id": "7", "ok": 1}', "schema_mismatch"),
    ]
    rows = spark.createDataFrame([("b", i, t) for i, (t, _) in enumerate(lines)], "batch_id string, row_no long, line string")
    want = sorted(("b", i, "", k) for i, (_, k) in enumerate(lines) if k)
    assert errors(v.json_errors(rows, columns)) == want
    assert ("b", 6, "", "schema_mismatch") not in errors(v.json_errors(rows, columns, allow_null=True))


def test_message_errors(spark):
    columns = (Declared("h", "PID-3", "string", False), Declared("h", "PID-5", "string", True), Declared("h", "PID-17", "string", True))
    messages = ["MSH|x\nPID|||1||A", "MSH|x", "PID|||  ||A", "PID|||1||"]
    rows = spark.createDataFrame([("b", i, m) for i, m in enumerate(messages)], "batch_id string, row_no long, message string")
    assert errors(v.message_errors(rows, columns)) == [("b", 1, "PID", "missing_pid"), ("b", 2, "PID-3", "blank_field")]
    strict = errors(v.message_errors(rows, columns, strict=True))
    assert ("b", 0, "PID-17", "blank_field") in strict and ("b", 3, "PID-5", "blank_field") in strict


def test_error_sample_is_bounded(spark):
    rows = spark.createDataFrame([("b", i, "a", "k") for i in range(50)], "batch_id string, row_no long, column string, kind string")
    assert [r["row_no"] for r in v.error_sample(rows).orderBy("rank").collect()] == list(range(20))
