import json

from strandline.operators import canonical, scrub
from strandline.operators.metadata import Declared
from strandline.operators.rules import LAST_MATCH, RuleSet


def test_table(spark):
    columns = (Declared("s", "patient_name", "string", False, True), Declared("s", "born", "date", True, True), Declared("s", "ssn", "string", False, True), Declared("s", "notes", "string"))
    rows = spark.createDataFrame([("b", 1, "Ann", None, "1", "call 555-123-4567 or 5 Main St", "555-123-4567")], "batch_id string, row_no long, patient_name string, born string, ssn string, notes string, extra string")
    out = scrub.scrub_table(rows, columns, RuleSet(spark)).first()
    assert (out["patient_name"], out["born"], out["ssn"]) == (scrub.NAME, scrub.DATE, scrub.GENERIC)
    assert out["notes"] == "call [REDACTED_PHONE] or [REDACTED_ADDRESS]" and out["extra"] == "555-123-4567"
    assert sorted(out["hits"]) == sorted([*scrub.COLUMN_RULES.values(), "PHI_ADDRESS_SIMPLE", "PHI_PHONE"])
    assert scrub.scrub_table(rows, columns, RuleSet(spark), scrub_extra=True).first()["extra"] == "[REDACTED_PHONE]"
    last = scrub.scrub_table(rows, columns, RuleSet(spark, mode=LAST_MATCH)).first()
    assert last["notes"] == "call [REDACTED_PHONE] or 5 Main St"


def test_objects(spark):
    columns = (Declared("s", "name", "string", False, True), Declared("s", "date_of_birth", "text", True, True), Declared("s", "free", "string"))
    line = {"name": None, "date_of_birth": {"y": 1}, "free": "a@b.org", "other": "20250101", "n": 7, "deep": {"t": "a@b.org"}, "id": "007", "z": None}
    rows = spark.createDataFrame([("b", 1, json.dumps(line)), ("b", 2, "not json"), ("b", 3, "[1]")], "batch_id string, row_no long, line string")
    out = {r["row_no"]: r for r in scrub.scrub_objects(rows, columns, RuleSet(spark)).collect()}
    got = json.loads(out[1]["line"])
    assert got == {**line, "name": scrub.NAME, "date_of_birth": scrub.DATE, "free": "[REDACTED_EMAIL]", "other": "[REDACTED_DATE]"}
    assert sorted(out[1]["hits"]) == ["PHI_COLUMN_REDACT_DATE", "PHI_COLUMN_REDACT_NAME", "PHI_DATE_YYYYMMDD", "PHI_EMAIL"]
    assert [out[n]["line"] for n in (2, 3)] == ["not json", "[1]"]


COLUMNS = (
    Declared("h", "PID-3", "string", False), Declared("h", "PID-5", "string", False, True), Declared("h", "PID-7", "date", False, True),
    Declared("h", "PID-11", "string", True, True), Declared("h", "PID-16", "string", True, True), Declared("h", "PID-50", "string", True, True),
)
MESSAGE = "MSH|a\r\nPID|||77||Ann||19800101|M|||12 Main St|||||123-45-6789\nOBX|1|call 555-123-4567"


def test_messages(spark):
    rows = spark.createDataFrame([("b", 1, MESSAGE), ("b", 2, "PID|||77||  ||")], "batch_id string, row_no long, message string")
    out = {r["row_no"]: r for r in scrub.scrub_messages(rows, COLUMNS, RuleSet(spark)).collect()}
    assert out[1]["message"] == "MSH|a\nPID|||77||[REDACTED_NAME]||[REDACTED_DATE]|M|||[REDACTED_ADDRESS]|||||[REDACTED_SSN]\nOBX|1|call [REDACTED_PHONE]"
    assert sorted(out[1]["hits"]) == ["PHI_ADDRESS_SIMPLE", "PHI_COLUMN_REDACT_DATE", "PHI_COLUMN_REDACT_NAME", "PHI_PHONE", "PHI_SSN"]
    assert out[2]["message"] == "PID|||77||  ||"
    everything = scrub.scrub_messages(rows, COLUMNS, RuleSet(spark), all_fields=True).orderBy("row_no").first()
    assert everything["message"].split("\n")[1].split("|")[3] == scrub.GENERIC


def test_counts(spark):
    rows = spark.createDataFrame([("b", ["x", "y"]), ("b", ["x"]), ("c", [])], "batch_id string, hits array<string>")
    assert {r["batch_id"]: (r["total_rows"], r["replacements"], r["rules"]) for r in scrub.counts(rows).collect()} == {"b": (2, 3, ["x", "y"]), "c": (1, 0, [])}


def test_message_columns(spark):
    rows = spark.createDataFrame([(1, MESSAGE + "\nOBX|2|b "), (2, "MSH|a"), (3, "PID|||9|" + "|" * 12 + "|S17")], "i int, message string")
    out = {r["i"]: r for r in canonical.canonicalise(canonical.message_columns(rows), "hospital_c_hl7", keep=("i",)).collect()}
    assert (out[1]["patient_id"], out[1]["address"], out[1]["ssn"]) == ("77", "12 Main St", "123-45-6789")
    assert out[1]["note_text"] == "OBX|1|call 555-123-4567 OBX|2|b"
    assert out[2]["patient_id"] is None and out[2]["note_text"] is None and out[2]["ssn"] is None
    assert out[3]["ssn"] == "S17"
    blank = {r["i"]: r["ssn"] for r in canonical.message_columns(rows, first_blank_wins=True).collect()}
    assert blank[3] == "" and blank[2] == ""


def test_canonical_tables(spark):
    a = spark.createDataFrame([("1", "A", "n")], "patient_id string, patient_name string, note string")
    b = spark.createDataFrame([("2", "B", "x", "t")], "id string, name string, icd string, free_text string")
    one, two = canonical.canonicalise(a, "hospital_a"), canonical.canonicalise(b, "clinic_b")
    assert one.columns == two.columns == ["patient_id", "patient_name", "dob", "visit_date", "diagnosis", "note_text", "source"]
    rows = {r["patient_id"]: r for r in canonical.unite([one, two]).collect()}
    assert rows["1"]["note_text"] == "n" and rows["2"]["diagnosis"] == "x" and rows["2"]["visit_date"] is None
    assert canonical.canonicalise(a, "unknown").columns == a.columns
