"""Readers, writers, the catalogue, versioned tables and the whole pipeline, on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from strandline.operators.metadata import COLUMNS, metadata
from strandline.operators.rules import RuleSet
from strandline.plans.catalog import Catalog, may
from strandline.plans.pipeline import Pipeline
from strandline.plans.versioned import EVENT_TIME, VersionedTable
from strandline.sources import generate, readers, sinks
from strandline.streaming import incremental

NOW = dt.datetime(2025, 3, 1, 12, tzinfo=dt.timezone.utc)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


def test_csv_reader(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,note\n1,"say ""hi"", ok"\n\n2,"two\nlines"\n3\n4,x,y\n5,NA\n')
    rows = readers.read_csv(spark, path).orderBy("row_no").collect()
    assert [(r["row_no"], r["id"], r["note"], r["malformed"]) for r in rows] == [
        (1, "1", 'say "hi", ok', False), (2, "2", "two\nlines", False), (3, "3", None, True), (4, "4", "x", True), (5, "5", "NA", False),
    ]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    write(tmp_path / "t" / "a.jsonl", "".join(f'{{"k": {i}}}\n' if i % 7 else "\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() > 1 or rows.count()
        got = {json.loads(r["line"])["k"]: r["row_no"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: i + 1 for i in range(5000) if i % 7}


def test_messages(spark, tmp_path):
    path = write(tmp_path / "a.hl7", "MSH|1\r\nPID|x\r\n\r\n\r\n\r\nMSH|2\r\nPID|y\r\n")
    assert [(r["row_no"], r["message"]) for r in readers.read_messages(spark, path).orderBy("row_no").collect()] == [(1, "MSH|1\nPID|x"), (2, "MSH|2\nPID|y")]
    path = write(tmp_path / "b.hl7", "MSH|1\nPID|x\n\n\n\nMSH|2\nPID|y\n")
    want = [(r["row_no"], r["message"]) for r in readers.read_messages(spark, path).orderBy("row_no").collect()]
    assert want == [(1, "MSH|1\nPID|x"), (2, "MSH|2\nPID|y")]
    ends = ["\n\n", "\r\n\r\n", "\r\r", "\n\n\n\n\n", "\r\n\n", "\n\r\n"]
    write(tmp_path / "m" / "c.hl7", "".join(f"MSH|{i}\r\nPID|{i * 37}" + ends[i % len(ends)] for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.read_messages(spark, str(tmp_path / "m")).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["row_no"], r["message"]) for r in got] == [(i + 1, f"MSH|{i}\nPID|{i * 37}") for i in range(3000)]
    out = sinks.write_messages(readers.read_messages(spark, path), str(tmp_path / "out"))
    assert [r["message"] for r in readers.read_messages(spark, out).collect()] == [m for _, m in want]


def test_objects_keep_text(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"id": "007", "n": 1}\n{"id": "8"}\n')
    out = readers.object_columns(readers.read_lines(spark, path), ["id", "n"]).orderBy("row_no").collect()
    assert [(r["id"], r["n"]) for r in out] == [("007", "1"), ("8", None)]


def test_listing_hashes_and_probe(spark, tmp_path):
    a = write(tmp_path / "d" / "a.csv", "x,y\n1,2\n")
    (tmp_path / "d" / "sub").mkdir()
    assert [r["name"] for r in readers.files(spark, str(tmp_path / "d")).collect()] == ["a.csv"]
    assert readers.files(spark, str(tmp_path / "none")).count() == 0
    import hashlib

    assert readers.hashes(spark, a).first()["sha256"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert readers.hashes(spark, a, whole_bytes=3).first()["sha256"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert "x" in readers.read_source(spark, None, a).columns and "x" in readers.read_source(spark, "csv", a).columns
    assert "line" in readers.read_source(spark, None, write(tmp_path / "e.txt", '\n{"x": 1}\n')).columns
    assert "message" in readers.read_source(spark, "HL7v2", write(tmp_path / "f.txt", "MSH|a\n")).columns
    for text in ("hello\n", "", "[1]"):
        with pytest.raises(ValueError):
            readers.read_source(spark, "xml", write(tmp_path / "g.txt", text))


def test_headers_of_many_files(spark, tmp_path):
    texts = ["a,b\n1,2\n", '"a, b","c ""d"""\n1,2\n', '\n\nx,y\n', '"two\nlines",z\n1,2\n', "a,a,\n1,2,3\n", "\ufeffid,n\n1,2\n"]
    paths = [write(tmp_path / f"{i}.csv", t) for i, t in enumerate(texts)]
    got = readers.csv_headers(spark, paths)
    assert got[:4] == [["a", "b"], ["a, b", 'c "d"'], ["x", "y"], ["two\nlines", "z"]] and got[5] == ["id", "n"]
    assert len(set(got[4])) == 3


def test_two_contents_of_one_name(spark, tmp_path):
    """Both pending at once: each batch has its own rows, and both go on to the end."""
    head = "patient_id,patient_name,ssn,dob,visit_date,diagnosis,notes\n"
    row = lambda i: f"P{i},Ann,123-45-6789,1980-01-01,2025-02-01,flu,fine\n"
    at = tmp_path / "landing" / "hospital_a" / "same.csv"
    p = Pipeline(spark, str(tmp_path / "lake"), now=NOW)
    write(at, head + "".join(row(i) for i in range(3)))
    first = p.ingest(str(tmp_path / "landing"))
    write(at, head + "".join(row(i) for i in range(10, 15)))
    second = p.ingest(str(tmp_path / "landing"))
    assert len(first) == len(second) == 1 and first != second
    assert p.validate() == {first[0]: True, second[0]: True}
    assert sorted(p.scrub()) == sorted(first + second) and list(p.transform()) == ["hospital_a"]
    state = {r["batch_id"]: r for r in p.catalog.batches().collect()}
    assert (state[first[0]]["total_rows"], state[second[0]]["total_rows"]) == (3, 5)
    ids = lambda b: {r["patient_id"] for r in spark.read.parquet(state[b]["version_path"]).collect()}
    assert ids(first[0]) == {"P0", "P1", "P2"} and ids(second[0]) == {f"P{i}" for i in range(10, 15)}
    assert state[first[0]]["final_sha256"] != state[second[0]]["final_sha256"] != state[second[0]]["curated_sha256"]


def test_failed_runs_leave_an_audit_row(spark, tmp_path, monkeypatch):
    p = Pipeline(spark, str(tmp_path / "lake"), now=NOW)
    monkeypatch.setattr(p, "_types", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        p.validate()
    row = p.catalog.latest_audit().first()
    assert (row["action"], row["severity"], json.loads(row["details"])) == ("run_validate_failed", "ERROR", {"error": "ZeroDivisionError"})


def test_roles_read_and_write_what_they_are_granted(spark, tmp_path):
    rows = spark.createDataFrame([("b1", "s", "p", "h")], "batch_id string, source_name string, raw_file_path string, raw_sha256 string")
    as_role = lambda role: Catalog(spark, str(tmp_path / "cat"), NOW, role)
    as_role("etl").create_batches(rows)
    assert as_role("analyst").found("b1")["status"] == "INGESTED" and as_role("audit").batches().count() == 1
    for role, act in (("analyst", lambda c: c.create_batches(rows)), ("etl", lambda c: c.write_audit("a", "b")), ("analyst", lambda c: c.latest_audit()), ("nobody", lambda c: c.batches())):
        with pytest.raises(PermissionError):
            act(as_role(role))
    with pytest.raises(LookupError):
        as_role("audit").found("b2")


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "b string, a int")
    assert sinks.content_hash(a) == sinks.content_hash(b) != sinks.content_hash(a.unionByName(a))


def test_catalogue(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"), NOW)
    rows = spark.createDataFrame([("b1", "s", "p", "h"), ("b1", "s", "p", "h"), ("b2", "t", "p", "h")], "batch_id string, source_name string, raw_file_path string, raw_sha256 string")
    assert c.create_batches(rows).count() == 2
    assert c.create_batches(rows).count() == 0
    one = spark.createDataFrame([("b1",)], "batch_id string")
    c.set_status(one, "FAILED_SCRUB", error_details=F.lit("why"))
    assert c.batch("b1").first()["error_details"] == "why"
    c.set_status(one, "VALIDATED", total_rows=F.lit(5))
    c.set_curated_hash(one.withColumn("curated_sha256", F.lit("cc")))
    state = c.batch("b1").first()
    assert (state["status"], state["error_details"], state["total_rows"], state["curated_sha256"], state["raw_sha256"]) == ("VALIDATED", None, 5, "cc", "h")
    assert c.batch("nope").count() == 0
    c.record_steps(one.withColumns({"step_name": F.lit("INGEST"), "details_json": F.lit("{}")}))
    c.record_rules(spark.createDataFrame([("b1", "r1")], "batch_id string, rule_id string"))
    assert [r["step_name"] for r in c.steps_of("b1").collect()] == ["INGEST"]
    assert [r["rule_id"] for r in c.rules_of("b1").collect()] == ["r1"]
    assert {r["batch_id"] for r in c.search_batches("", "").collect()} == {"b1", "b2"}
    assert [r["batch_id"] for r in c.search_batches("INGESTED", "t").collect()] == ["b2"]
    assert c.latest_batches("s", 1).count() == 1 and c.failed_batches().count() == 0
    c.write_audit("me", "DO")
    assert c.latest_audit().first()["severity"] == "INFO"
    assert all(o.count() == 0 for o in c.orphans().values())
    header = spark.createDataFrame([("c1", "s")], "control_id string, source_name string")
    c.append("control_header", header)
    c.append("control_detail", spark.createDataFrame([("c1", 2, "b"), ("c1", 1, "a")], "control_id string, step_order int, step_type string"))
    assert c.pending_controls().count() == 1
    assert [r["step_type"] for r in c.control_steps("c1").collect()] == ["a", "b"]
    c.mark_control("c1", "DONE")
    assert c.pending_controls().count() == 0
    assert may("engineer", "curated") and not may("scientist", "raw") and may("admin", "audit", "w")


def test_versions(spark, tmp_path):
    schema = "patient_id string, visit_date string, v int"
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.snapshot()
    first = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", None, 3), ("c", "9", 4)], schema)
    assert t.upsert(first, "20250101") == {"inserted": 3, "updated": 0, "row_count": 3}
    assert t.upsert(spark.createDataFrame([("a", "0", 9), ("d", "1", 5)], schema), "20250102") == {"inserted": 1, "updated": 1, "row_count": 4}
    assert t.upsert(spark.createDataFrame([("b", "1", 6), ("c", "1", 7)], schema), "20250103")["updated"] == 2
    values = lambda df: {r["patient_id"]: r["v"] for r in df.collect()}
    assert values(t.snapshot()) == {"a": 9, "b": 6, "c": 7, "d": 5}
    assert values(t.snapshot("20250101")) == {"a": 2, "b": 3, "c": 4}
    assert values(t.snapshot("20250102120000")) == {"a": 9, "b": 3, "c": 4, "d": 5}
    assert t.commits() == ["20250103", "20250102", "20250101"]
    from strandline.plans.versioned import commits_of

    assert [r[0] for r in commits_of(t.snapshot()).collect()] == ["20250103", "20250102"]
    with pytest.raises(ValueError):
        t.upsert(first, "20250102")
    written = {f.parent.name for f in (tmp_path / "t" / "commit_time=20250103").rglob("*.parquet")}
    assert 1 <= len(written) <= 2  # of sixteen buckets only those of the two keys
    hashes = [r["content_hash"] for r in t.log().orderBy("commit_time").collect()]
    assert len(set(hashes)) == 3
    again = VersionedTable(spark, str(tmp_path / "again"))
    again.upsert(t.snapshot().drop("_commit_time"), "20250103")
    assert values(again.snapshot()) == values(t.snapshot())
    none = VersionedTable(spark, str(tmp_path / "none"))
    assert none.upsert(first.limit(0), "1") == {"inserted": 0, "updated": 0, "row_count": 0} and none.snapshot().columns == [*first.columns, "_commit_time"]
    assert none.upsert(first, "2")["inserted"] == 3 and none.upsert(first.limit(0), "3")["row_count"] == 3 and none.snapshot().count() == 3
    e = VersionedTable(spark, str(tmp_path / "e"), mode=EVENT_TIME)
    e.upsert(first, "1")
    e.upsert(spark.createDataFrame([("a", "1", 8), ("b", "1", 6), ("c", "9", 7)], schema), "2")
    assert values(e.snapshot()) == {"a": 2, "b": 6, "c": 7}


def land(folder):
    write(folder / "hospital_a" / "ok.csv", "patient_id,patient_name,ssn,dob,visit_date,diagnosis,notes\nP1,Ann,123-45-6789,1980-01-01,2025-02-01,flu,\"call 555-123-4567, or 5 Main St\"\nP2,Bob,123-45-6780,1981-01-01,2025-02-02,NA,fine\n")
    write(folder / "hospital_a" / "missing.csv", "patient_id,patient_name\nP3,Cy\n")
    write(folder / "clinic_b" / "ok.jsonl", '{"id": "007", "name": "Di", "date_of_birth": "1990-01-01", "encounter": "x", "icd": "J10", "free_text": "secret"}\n')
    write(folder / "clinic_b" / "bad.jsonl", '{"id": 7, "name": "secret name"}\n')
    write(folder / "hospital_c_hl7" / "ok.hl7", "MSH|a\nPID|||9||Eve||19800101|M|||12 Main St|||||123-45-6789\nOBX|1|ok\n\nMSH|b\nPID|||10||Flo||19810101|M|||||||||\nOBX|1|mail a@b.org\n\n")


def test_pipeline(spark, tmp_path):
    land(tmp_path / "landing")
    p = Pipeline(spark, str(tmp_path / "lake"), now=NOW)
    assert p.run(str(tmp_path / "landing")) == {"ingested": 5, "validated": 3, "scrubbed": 3, "tables": 3}
    state = {r["raw_file_path"].rsplit("/", 1)[-1]: r for r in p.catalog.batches().collect()}
    assert {k: r["status"] for k, r in state.items()} == {
        "ok.csv": "COMPLETED", "missing.csv": "FAILED_VALIDATION", "ok.jsonl": "COMPLETED", "bad.jsonl": "FAILED_VALIDATION", "ok.hl7": "COMPLETED",
    }
    assert "/quarantine/" in state["bad.jsonl"]["raw_file_path"] and "secret" not in state["bad.jsonl"]["error_details"]
    assert "missing_column" in state["missing.csv"]["error_details"]
    a = {r["patient_id"]: r for r in spark.read.parquet(state["ok.csv"]["version_path"]).collect()}
    assert a["P1"]["patient_name"] == "[REDACTED_NAME]" and a["P1"]["note_text"] == "call [REDACTED_PHONE], or [REDACTED_ADDRESS]"
    assert a["P2"]["diagnosis"] is None and "ssn" not in a["P1"].asDict()
    b = spark.read.parquet(state["ok.jsonl"]["version_path"]).first()
    assert (b["patient_id"], b["patient_name"], b["note_text"], b["diagnosis"]) == ("007", "[REDACTED_NAME]", "[REDACTED]", "J10")
    c = {r["patient_id"]: r for r in spark.read.parquet(state["ok.hl7"]["version_path"]).collect()}
    assert c["9"]["ssn"] == "[REDACTED_SSN]" and c["10"]["note_text"] == "OBX|1|mail [REDACTED_EMAIL]"
    steps = [r["step_name"] for r in p.catalog.steps_of(state["ok.csv"]["batch_id"]).collect()]
    assert steps == ["INGEST", "VALIDATION_PASSED", "SCRUB_PHI", "TRANSFORM"]
    rules = [r["rule_id"] for r in p.catalog.rules_of(state["ok.csv"]["batch_id"]).collect()]
    assert rules == sorted(rules) and {"PHI_PHONE", "PHI_COLUMN_REDACT_NAME"} <= set(rules)
    assert p.run(str(tmp_path / "landing"))["ingested"] == 0  # known contents are not taken twice
    table = VersionedTable(spark, p.zones.versioned + "/hospital_a")
    assert table.snapshot().count() == 2 and len(table.commits()) == 1
    assert p.register("hospital_a") == table.commits()


def test_sources_without_metadata_pass(spark, tmp_path):
    write(tmp_path / "landing" / "hospital_a" / "x.csv", "a,b\n1,2\n")
    none = metadata(spark, [c for c in COLUMNS if c.source_name != "hospital_a"])
    p = Pipeline(spark, str(tmp_path / "lake"), now=NOW, columns=none)
    p.ingest(str(tmp_path / "landing"))
    assert list(p.validate().values()) == [True]
    assert p.catalog.batches().first()["status"] == "VALIDATED"


def test_stream(spark, tmp_path):
    header = ["patient_id", "visit_date", "notes"]
    write(tmp_path / "in" / "1.csv", "patient_id,visit_date,notes\na,1,mail a@b.org\n")
    table = VersionedTable(spark, str(tmp_path / "t"))
    columns = [c for c in COLUMNS if c.source_name == "hospital_a"]
    rows = incremental.scrubbed_stream(incremental.csv_stream(spark, str(tmp_path / "in"), header), columns, RuleSet(spark))

    def run():
        incremental.upsert_stream(rows, table, str(tmp_path / "cp")).awaitTermination()
        return {r["patient_id"]: r["notes"] for r in table.snapshot().collect()}

    assert run() == {"a": "mail [REDACTED_EMAIL]"}
    write(tmp_path / "in" / "2.csv", "patient_id,visit_date,notes\na,2,x\nb,1,y\n")
    assert run() == {"a": "x", "b": "y"} and len(table.commits()) == 2


def test_generated_feeds_pass_the_pipeline(spark, tmp_path):
    want = generate.write_feeds(spark, str(tmp_path / "landing"), 60, parts=2)
    assert generate.people(spark, 20).collect() == generate.people(spark, 20, parts=7).orderBy("n").collect()
    for f in (tmp_path / "landing").rglob("*"):
        if f.is_file() and (f.name.startswith(("_", ".")) or not f.stat().st_size):
            f.unlink()
    p = Pipeline(spark, str(tmp_path / "lake"), now=NOW)
    done = p.run(str(tmp_path / "landing"))
    assert done["ingested"] == done["validated"] == done["scrubbed"] == 6 and done["tables"] == 3
    got = {r["source_name"]: r["n"] for r in p.catalog.batches().groupBy("source_name").agg(F.sum("total_rows").alias("n")).collect()}
    assert got == want
    ready = spark.read.option("mergeSchema", True).parquet(*[r["version_path"] for r in p.catalog.batches().select("version_path").distinct().collect()])
    assert ready.count() == 180 and ready.where("note_text LIKE '%555-%' OR note_text LIKE '%@%' OR note_text LIKE '% Mill Road%'").count() == 0


def test_feeds_take_suppliers_of_any_key(spark, sf_dir):
    """Suppliers lie in the file that their key's parity names, however large the key; the second same.jsonl has nations alone."""
    from strandline import pipeline_queries as pq

    real, many = pq._t, spark.range(990, 1040).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(3 AS INT) AS s_nationkey")
    pq._t = lambda spark, sf_dir, name, *a: many if name == "supplier" else real(spark, sf_dir, name, *a)
    try:
        feeds = pq._feeds(spark, sf_dir)
        found = {r["file"]: r["n"] for r in feeds["clinic_b"].groupBy("file").agg(F.count("*").alias("n")).collect()}
        again = [(r["file"], r["n"]) for r in feeds["clinic_b again"].groupBy("file").agg(F.count("*").alias("n")).collect()]
    finally:
        pq._t = real
    assert found == {"even.jsonl": 25, "odd.jsonl": 25, "same.jsonl": 5} and again == [("same.jsonl", 25)]
