"""Queries over one run of the whole pipeline, and over the control plane and the declared data.

The tables become feeds in the three formats, with planted faults, in a landing folder: customers as CSV files by market segment,
suppliers as JSON Lines, orders as messages by status, a file without declared columns, one of no known format, one that is
gone from the raw zone, two contents under one name, and a source that is switched off. The run is made once for each session and
table folder; every query reads its own part of what the run left.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as fx
from strandline.operators import metadata as meta
from strandline.operators import rules as rl
from strandline.operators import validate
from strandline.operators.metadata import COLUMNS, SOURCES, Declared, Source
from strandline.plans import catalog, versioned
from strandline.plans.pipeline import Pipeline
from strandline.queries import ORACLE_SQL, QUERIES, _query, _re, _t, _test, specific_first
from strandline.session import scratch
from strandline.sources import readers, sinks
from strandline.streaming import incremental

__all__ = ["ORACLE_SQL", "QUERIES"]

_NOW = dt.datetime(2025, 3, 1, 12, tzinfo=dt.timezone.utc)
_SOURCES = (*SOURCES, Source("bare", "csv", "bare"), Source("odd", "xml", "odd"), Source("idle", "csv", "idle", False))
_COLUMNS = (*COLUMNS, Declared("odd", "id", "string", False))

# The feeds: rows (file, n, value), the lines of each file in order. SQL first, as it is the shorter; Spark's own follows.

_A_SQL = """(SELECT lower(c_mktsegment) || '.csv' AS file, c_custkey AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, 'C' || c_custkey AS patient_id,
  c_name AS patient_name, (100 + c_custkey % 800) || '-' || (10 + c_custkey % 90) || '-' || (1000 + c_custkey % 9000) AS ssn,
  strftime(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER), '%Y-%m-%d') AS dob,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 40 = 0 OR c_mktsegment = 'FURNITURE' AND row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) > 200 THEN 'soon'
    ELSE strftime(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') END AS visit_date,
  CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE 'D' || (c_custkey % 7) END AS diagnosis,
  CASE c_custkey % 4 WHEN 0 THEN 'mail c' || c_custkey || '@x.org' WHEN 1 THEN 'call 555-123-' || (1000 + c_custkey % 9000) || '; later' WHEN 2 THEN 'fine' ELSE '' END AS notes FROM customer)"""
_A_LINES = f"""(SELECT DISTINCT file, 0 AS n, 'patient_id,patient_name,ssn,dob,visit_date,diagnosis' || CASE WHEN file <> 'machinery.csv' THEN ',notes' ELSE '' END AS value FROM {_A_SQL}
  UNION ALL SELECT file, n, concat_ws(',', patient_id, patient_name, ssn, dob, visit_date, diagnosis) || CASE WHEN file <> 'machinery.csv' THEN ',' || notes ELSE '' END FROM {_A_SQL}
  UNION ALL SELECT 'gone.csv', 0, 'patient_id,patient_name' UNION ALL SELECT 'gone.csv', 1 + n_nationkey, n_nationkey || ',' || n_name FROM nation)"""
_B_SQL = """(SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even.jsonl' ELSE 'odd.jsonl' END AS file, s_suppkey AS n, 'S' || s_suppkey AS id, s_name AS name, '1970-02-03' AS date_of_birth,
  'visit ' || s_nationkey AS encounter, 'J' || s_nationkey AS icd, 'wrote to s' || s_suppkey || '@x.org' AS free_text, s_suppkey % 10 = 1 AS broken FROM supplier
  UNION ALL SELECT 'same.jsonl', r_regionkey, 'R' || r_regionkey, r_name, '1970-02-03', 'call 555-123-4567', 'J' || r_regionkey, 'x', false FROM region
  UNION ALL SELECT 'same.jsonl', 1000 + n_nationkey, 'N' || n_nationkey, n_name, '1970-02-03', 'on 20240102', 'J' || n_nationkey, 'x', false FROM nation)"""
_B_LINE = """'{"id":"' || id || '","name":"' || name || '","date_of_birth":"' || date_of_birth || '","encounter":"' || encounter || '","icd":"' || icd || '","free_text":"' || free_text || '"' || CASE WHEN broken THEN '' ELSE '}' END"""
_B_LINES = f"(SELECT file, n, {_B_LINE} AS value FROM {_B_SQL})"
_C_SQL = """(SELECT lower(o_orderstatus) || '.hl7' AS file, o_orderkey AS k, o_orderstatus = 'P' AND o_orderkey % 100 = 0 AS headless, 'O' || o_orderkey AS pid3, o_orderpriority AS pid5,
  strftime(o_orderdate, '%Y%m%d') AS pid7, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE (o_custkey + 1) || ' Elm St' END AS pid11,
  (100 + o_custkey % 800) || '-45-' || (1000 + o_custkey % 9000) AS pid16, 'OBX|1|seen ' || strftime(o_orderdate, '%Y-%m-%d') AS obx FROM orders)"""
_C_LINES = f"""(SELECT file, 5 * k AS n, 'MSH|^~&|x' AS value FROM {_C_SQL}
  UNION ALL SELECT file, 5 * k + 1, CASE WHEN headless THEN 'PV1|1' ELSE 'PID|||' || pid3 || '||' || pid5 || '||' || pid7 || '||||' || pid11 || '|||||' || pid16 END FROM {_C_SQL}
  UNION ALL SELECT file, 5 * k + 2, obx FROM {_C_SQL} UNION ALL SELECT file, 5 * k + 3, '' FROM {_C_SQL})"""
_BARE_LINES = "(SELECT 'region.csv' AS file, 0 AS n, 'key,note' AS value UNION ALL SELECT 'region.csv', 1 + r_regionkey, r_regionkey || ',mail ' || lower(r_name) || '@x.org' FROM region)"
_ODD_LINES = "(SELECT 'hello.txt' AS file, 0 AS n, 'hello' AS value)"


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customer, supplier, orders, nation, region = (_t(spark, sf_dir, n) for n in ("customer", "supplier", "orders", "nation", "region"))
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    file = _text(F.lower(segment), ".csv")
    place = F.row_number().over(Window.partitionBy(segment).orderBy(k))
    late = ((segment == "BUILDING") & (k % 40 == 0)) | ((segment == "FURNITURE") & (F.col("n") > 200))
    day = lambda first, n: F.date_format(F.date_add(F.lit(first).cast("date"), n.cast("int")), "yyyy-MM-dd")
    number = lambda low, c, m: (c % m + low).cast("string")
    ssn = F.concat_ws("-", number(100, k, 800), number(10, k, 90), number(1000, k, 9000))
    notes = F.when(k % 4 == 0, _text("mail c", k, "@x.org")).when(k % 4 == 1, _text("call 555-123-", number(1000, k, 9000), "; later")).when(k % 4 == 2, "fine").otherwise("")
    cells = [_text("C", k), F.col("c_name"), ssn, day("1950-01-01", k % 20000), F.when(late, "soon").otherwise(day("2024-01-01", k % 365)), F.when(k % 5 == 0, "NA").otherwise(_text("D", k % 7))]
    more = F.when(segment != "MACHINERY", _text(",", notes)).otherwise("")
    rows = customer.withColumn("n", place).select(file.alias("file"), F.col("n").cast("long"), _text(F.concat_ws(",", *cells), more).alias("value"))
    head = F.when(F.col("file") != "machinery.csv", "patient_id,patient_name,ssn,dob,visit_date,diagnosis,notes").otherwise("patient_id,patient_name,ssn,dob,visit_date,diagnosis")
    heads = customer.select(file.alias("file")).distinct().select("file", F.lit(0).cast("long").alias("n"), head.alias("value"))
    gone = nation.select(F.lit("gone.csv").alias("file"), (F.col("n_nationkey") + 1).cast("long").alias("n"), F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    gone = gone.unionByName(spark.createDataFrame([("gone.csv", 0, "patient_id,patient_name")], gone.schema))

    def objects(rows: DataFrame, file: Column, n: Column, key: Column, name: str, encounter: Column, mark: Column, text: Column, broken: Column) -> DataFrame:
        line = F.to_json(F.struct(key.alias("id"), F.col(name).alias("name"), F.lit("1970-02-03").alias("date_of_birth"), encounter.alias("encounter"), mark.alias("icd"), text.alias("free_text")))
        return rows.select(file.alias("file"), n.cast("long").alias("n"), F.when(broken, F.regexp_replace(line, "}$", "")).otherwise(line).alias("value"))

    s, no = F.col("s_suppkey"), F.lit(False)
    lines = objects(supplier, F.when(s % 2 == 0, "even.jsonl").otherwise("odd.jsonl"), s, _text("S", s), "s_name", _text("visit ", F.col("s_nationkey")), _text("J", F.col("s_nationkey")), _text("wrote to s", s, "@x.org"), s % 10 == 1)
    same = lambda rows, key, low, mark, name, seen: objects(rows, F.lit("same.jsonl"), F.col(key) + low, _text(mark, F.col(key)), name, F.lit(seen), _text("J", F.col(key)), F.lit("x"), no)
    c = F.col("o_custkey")
    pid = {0: F.lit("PID"), 3: _text("O", F.col("o_orderkey")), 5: F.col("o_orderpriority"), 7: F.date_format("o_orderdate", "yyyyMMdd"), 11: F.when(c % 3 == 0, "").otherwise(_text((c + 1).cast("string"), " Elm St")), 16: F.concat_ws("-", number(100, c, 800), F.lit("45"), number(1000, c, 9000))}
    pid_line = F.concat_ws("|", *[pid.get(i, F.lit("")) for i in range(17)])
    headless = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 100 == 0)
    parts = F.array(F.lit("MSH|^~&|x"), F.when(headless, "PV1|1").otherwise(pid_line), _text("OBX|1|seen ", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(""))
    messages = orders.select(_text(F.lower("o_orderstatus"), ".hl7").alias("file"), "o_orderkey", F.posexplode(parts).alias("i", "value"))
    messages = messages.select("file", (F.col("o_orderkey") * 5 + F.col("i")).cast("long").alias("n"), "value")
    bare = region.select(F.lit("region.csv").alias("file"), (F.col("r_regionkey") + 1).cast("long").alias("n"), _text(F.col("r_regionkey"), ",mail ", F.lower("r_name"), "@x.org").alias("value"))
    one = lambda file, value: spark.createDataFrame([(file, 0, value)], "file string, n long, value string")
    return {
        "hospital_a": rows.unionByName(heads).unionByName(gone), "clinic_b": lines.unionByName(same(region, "r_regionkey", 0, "R", "r_name", "call 555-123-4567")),
        "clinic_b again": same(nation, "n_nationkey", 1000, "N", "n_name", "on 20240102"), "hospital_c_hl7": messages,
        "bare": bare.unionByName(one("region.csv", "key,note")), "odd": one("hello.txt", "hello"), "idle": one("idle.csv", "a,b"),
    }


def _write_files(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Each file of rows (file, n, value) as one text file under its own name."""
    path = scratch(spark)
    rows.repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)
    made = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    sinks.land(spark, [(p, f"{folder}/{p.rsplit('/', 2)[-2].removeprefix('file=')}") for p in made])


_RUNS: dict[tuple[str, str], Pipeline] = {}


def _run(spark: SparkSession, sf_dir: str) -> Pipeline:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _RUNS and readers.exists(spark, _RUNS[key].zones.root):
        return _RUNS[key]
    root = scratch(spark)
    p = Pipeline(spark, f"{root}/lake", sources=meta.registry(spark, _SOURCES), columns=meta.metadata(spark, _COLUMNS), now=_NOW)
    feeds, landing = _feeds(spark, sf_dir), f"{root}/landing"
    for name, rows in feeds.items():
        if " " not in name:
            _write_files(spark, rows, f"{landing}/{name}")
    p.ingest(landing)
    _write_files(spark, feeds["clinic_b again"], f"{landing}/clinic_b")
    p.ingest(landing)
    gone = [r["raw_file_path"] for r in p.catalog.batches().select("raw_file_path").collect() if r["raw_file_path"].endswith("/gone.csv")]
    jvm = spark.sparkContext._jvm
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
    p.validate()
    p.scrub()
    p.transform()
    for source in ("hospital_a", "clinic_b", "hospital_c_hl7"):
        p.register(source, order=None)
    _RUNS[key] = p
    return p


def _batches(p: Pipeline) -> DataFrame:
    """The batches with their files' names; the second content of one name under a name of its own."""
    state = p.catalog.batches().withColumn("file", fx.base_name(F.col("raw_file_path")))
    second = (F.col("file") == "same.jsonl") & (F.col("total_rows") == 25)
    return state.withColumn("file", F.when(second, "same.jsonl (2)").otherwise(F.col("file")))


# What the faults come to: files that fail, by SQL.

_FILES = f"""(SELECT 'hospital_a' AS source, file, n, value FROM {_A_LINES} UNION ALL SELECT 'clinic_b', CASE WHEN n >= 1000 THEN 'same.jsonl (2)' ELSE file END, n, value FROM {_B_LINES}
  UNION ALL SELECT 'hospital_c_hl7', file, n, value FROM {_C_LINES} UNION ALL SELECT 'bare', file, n, value FROM {_BARE_LINES} UNION ALL SELECT 'odd', file, n, value FROM {_ODD_LINES})"""
_FAULTS = f"""(SELECT file, n AS "row", 'visit_date' AS "column", 'type_mismatch(date)' AS kind FROM {_A_SQL} WHERE visit_date = 'soon' AND n <= 200 AND file <> 'machinery.csv'
  UNION ALL SELECT DISTINCT file, 0, 'notes', 'missing_column' FROM {_A_SQL} WHERE file = 'machinery.csv'
  UNION ALL SELECT file, row_number() OVER (PARTITION BY file ORDER BY n), '', CASE WHEN broken THEN 'invalid_json' END FROM {_B_SQL} WHERE n < 1000
  UNION ALL SELECT file, row_number() OVER (PARTITION BY file ORDER BY k), 'PID', CASE WHEN headless THEN 'missing_pid' END FROM {_C_SQL})"""
_FAULTS = f"(SELECT * FROM {_FAULTS} WHERE kind IS NOT NULL)"
_BAD = f"(SELECT file FROM {_FAULTS} UNION SELECT 'gone.csv' UNION SELECT 'hello.txt')"
_LOST = "file IN ('gone.csv', 'hello.txt')"  # files that no row is read from
_ROWS = f"""(SELECT file, CAST(count(*) AS BIGINT) AS n FROM {_A_SQL} GROUP BY file UNION ALL SELECT CASE WHEN n >= 1000 THEN 'same.jsonl (2)' ELSE file END, count(*) FROM {_B_SQL} GROUP BY 1
  UNION ALL SELECT file, count(*) FROM {_C_SQL} GROUP BY file)"""


@_query(
    f"SELECT source, f.file, CASE WHEN f.file IN (SELECT file FROM {_BAD}) THEN 'FAILED_VALIDATION' ELSE 'COMPLETED' END AS status, "
    f"CASE WHEN f.file NOT IN (SELECT file FROM {_BAD}) THEN r.n END AS total_rows, f.file IN (SELECT file FROM {_BAD}) AS has_error "
    f"FROM (SELECT DISTINCT source, file FROM {_FILES}) f LEFT JOIN {_ROWS} r ON r.file = f.file"
)
def feed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batches(_run(spark, sf_dir))
    return rows.select(F.col("source_name").alias("source"), "file", "status", "total_rows", F.col("error_details").isNotNull().alias("has_error"))


@_query(f"SELECT source, file, sha256(string_agg(value || chr(10), '' ORDER BY n)) AS raw_sha256 FROM {_FILES} GROUP BY source, file")
def feed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each raw file's bytes, as the catalogue has it."""
    return _batches(_run(spark, sf_dir)).select(F.col("source_name").alias("source"), "file", "raw_sha256")


@_query(
    f"SELECT source, file, sha256(string_agg(value || chr(10), '' ORDER BY n)) AS sha256, file IN (SELECT file FROM {_BAD}) AND NOT {_LOST} AS quarantined FROM {_FILES} WHERE file <> 'gone.csv' GROUP BY source, file"
)
def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file where the catalogue says it lies: raw zone or quarantine, bytes unchanged."""
    rows = _batches(_run(spark, sf_dir)).where("file <> 'gone.csv'").select("source_name", "file", "raw_file_path")
    paths = [r["raw_file_path"] for r in rows.select("raw_file_path").collect()]
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    sha = readers.hashes(spark, paths).select(plain(F.col("path")).alias("at"), "sha256")
    out = rows.join(sha, plain(F.col("raw_file_path")) == F.col("at"))
    return out.select(F.col("source_name").alias("source"), "file", "sha256", F.col("raw_file_path").contains("/quarantine/").alias("quarantined"))


@_query(f"SELECT file, \"row\", \"column\", kind FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY \"row\", \"column\", kind) AS r FROM {_FAULTS}) WHERE r <= 20")
def feed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error samples that failed batches bear."""
    rows = _batches(_run(spark, sf_dir)).where("status = 'FAILED_VALIDATION'")
    errors = F.from_json("error_details", "array<struct<row:long,column:string,kind:string>>")
    return rows.select("file", F.explode(errors).alias("e")).where("e.kind IS NOT NULL").select("file", "e.row", "e.column", "e.kind")


@_query(
    f"SELECT file, CASE WHEN {_LOST} THEN ['INGEST', 'VALIDATION_FAILED'] WHEN file IN (SELECT file FROM {_BAD}) THEN ['INGEST', 'VALIDATION_FAILED', 'QUARANTINE_MOVED'] "
    f"WHEN source = 'bare' THEN ['INGEST', 'VALIDATION_SKIPPED', 'SCRUB_PHI', 'TRANSFORM'] ELSE ['INGEST', 'VALIDATION_PASSED', 'SCRUB_PHI', 'TRANSFORM'] END AS steps "
    f"FROM (SELECT DISTINCT source, file FROM {_FILES})"
)
def feed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _run(spark, sf_dir)
    steps = p.catalog.table("steps").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("seq", "step_name"))).alias("s"))
    return _batches(p).join(steps, "batch_id").select("file", F.transform("s", lambda x: x["step_name"]).alias("steps"))


def _chained(column: str) -> str:
    for r in specific_first():
        column = _re(column, r)
    return column


_GOOD_A = f"(SELECT * FROM {_A_SQL} WHERE file NOT IN (SELECT file FROM {_BAD}))"
_GOOD_B = f"(SELECT CASE WHEN n >= 1000 THEN 'same.jsonl (2)' ELSE file END AS file, n, id, encounter, icd FROM {_B_SQL} b WHERE b.file NOT IN (SELECT file FROM {_BAD}))"
_GOOD_C = f"(SELECT * FROM {_C_SQL} WHERE file NOT IN (SELECT file FROM {_BAD}))"


def _curated(p: Pipeline, source: str) -> DataFrame:
    return p.curated(source).join(_batches(p).select("batch_id", "file"), "batch_id")


@_query(
    f"SELECT file, patient_id, '[REDACTED_NAME]' AS patient_name, {'{ssn}'} AS ssn, '[REDACTED_DATE]' AS dob, {_chained('visit_date')} AS visit_date, diagnosis, "
    f"CASE WHEN notes <> '' THEN {_chained('notes')} END AS notes FROM {_GOOD_A}".replace("{ssn}", "'[REDACTED]'")
)
def feed_curated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _curated(_run(spark, sf_dir), "hospital_a")
    return rows.select("file", "patient_id", "patient_name", "ssn", "dob", "visit_date", "diagnosis", F.nullif("notes", F.lit("")).alias("notes"))


@_query(f"SELECT file, id, '[REDACTED_NAME]' AS name, '[REDACTED_DATE]' AS date_of_birth, {_chained('encounter')} AS encounter, icd, '[REDACTED]' AS free_text FROM {_GOOD_B}")
def feed_curated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.object_columns(_curated(_run(spark, sf_dir), "clinic_b"), ["id", "name", "date_of_birth", "encounter", "icd", "free_text"])
    return rows.select("file", "id", "name", "date_of_birth", "encounter", "icd", "free_text")


_PID = "'PID|||' || pid3 || '||[REDACTED_NAME]||[REDACTED_DATE]||||' || {a} || '|||||' || {s}"
_PID = _PID.format(a="CASE WHEN pid11 = '' THEN '' ELSE '[REDACTED_ADDRESS]' END", s="'[REDACTED_SSN]'")


@_query(f"SELECT file, 'MSH|^~&|x' || chr(10) || {_PID} || chr(10) || 'OBX|1|seen [REDACTED_DATE]' AS message FROM {_GOOD_C}")
def feed_curated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curated(_run(spark, sf_dir), "hospital_c_hl7").select("file", "message")


def _ready(p: Pipeline, source: str) -> DataFrame:
    """The artifacts that the batches' paths name."""
    rows = [(r["version_path"], r["file"]) for r in _batches(p).where((F.col("source_name") == source) & F.col("version_path").isNotNull()).select("version_path", "file").collect()]
    return _all([p.spark.read.parquet(path).withColumn("file", F.lit(file)) for path, file in rows])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(
    f"SELECT file, patient_id, '[REDACTED_NAME]' AS patient_name, '[REDACTED_DATE]' AS dob, {_chained('visit_date')} AS visit_date, CASE WHEN diagnosis <> 'NA' THEN diagnosis END AS diagnosis, "
    f"CASE WHEN notes <> '' THEN {_chained('notes')} END AS note_text, 'hospital_a' AS source FROM {_GOOD_A}"
)
def feed_ready_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(_run(spark, sf_dir), "hospital_a")


@_query(f"SELECT file, id AS patient_id, '[REDACTED_NAME]' AS patient_name, '[REDACTED_DATE]' AS dob, {_chained('encounter')} AS visit_date, icd AS diagnosis, '[REDACTED]' AS note_text, 'clinic_b' AS source FROM {_GOOD_B}")
def feed_ready_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(_run(spark, sf_dir), "clinic_b")


@_query(
    f"SELECT file, pid3 AS patient_id, '[REDACTED_NAME]' AS patient_name, '[REDACTED_DATE]' AS dob, CASE WHEN pid11 = '' THEN '' ELSE '[REDACTED_ADDRESS]' END AS address, "
    f"'[REDACTED_SSN]' AS ssn, 'OBX|1|seen [REDACTED_DATE]' AS note_text, 'hospital_c_hl7' AS source FROM {_GOOD_C}"
)
def feed_ready_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(_run(spark, sf_dir), "hospital_c_hl7")


@_query("SELECT 'region.csv' AS file, CAST(r_regionkey AS VARCHAR) AS key, 'mail ' || lower(r_name) || '@x.org' AS note FROM region")
def feed_ready_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are not declared pass through."""
    return _ready(_run(spark, sf_dir), "bare").select("file", "key", "note")


def _rule_hits(column: str, files: str) -> str:
    """Rows (file, rule_id) of the rules that a chain applies to a column."""
    out, text = [], column
    for r in specific_first():
        out.append(f"SELECT DISTINCT file, '{r.rule_id}' AS rule_id FROM {files} WHERE {_test(text, r)}")
        text = _re(text, r)
    return " UNION ".join(out)


_COLUMN_HITS = "SELECT DISTINCT f.file, v.r FROM {files} f, (VALUES {rules}) AS v(r)"
_RULES_SQL = " UNION ".join(
    [
        _COLUMN_HITS.format(files=_GOOD_A, rules="('PHI_COLUMN_REDACT_NAME'), ('PHI_COLUMN_REDACT_DATE'), ('PHI_COLUMN_REDACT_GENERIC')"),
        _COLUMN_HITS.format(files=_GOOD_B, rules="('PHI_COLUMN_REDACT_NAME'), ('PHI_COLUMN_REDACT_DATE'), ('PHI_COLUMN_REDACT_GENERIC')"),
        _COLUMN_HITS.format(files=_GOOD_C, rules="('PHI_COLUMN_REDACT_NAME'), ('PHI_COLUMN_REDACT_DATE')"),
        *[_rule_hits(c, _GOOD_A) for c in ("visit_date", "notes")],
        _rule_hits("encounter", _GOOD_B),
        *[_rule_hits(c, _GOOD_C) for c in ("pid11", "pid16", "obx")],
        "SELECT 'region.csv', 'PHI_EMAIL' WHERE false",
    ]
)


@_query(f"SELECT file, rule_id, 'applied, rule set v1' AS description FROM ({_RULES_SQL}) AS t(file, rule_id)")
def feed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _run(spark, sf_dir)
    return p.catalog.table("rules_applied").join(_batches(p).select("batch_id", "file"), "batch_id").select("file", "rule_id", "description")


@_query(
    f"WITH f AS (SELECT DISTINCT file FROM {_FILES}) SELECT 'validation' AS action, 'INFO' AS severity, CAST((SELECT count(*) FROM f) AS BIGINT) AS n, "
    f"CAST((SELECT count(*) FROM f WHERE file NOT IN (SELECT file FROM {_BAD})) AS BIGINT) AS n_ok "
    "UNION ALL SELECT 'run_ingest', 'INFO', 2, 0 UNION ALL SELECT 'run_validate', 'INFO', 1, 0 UNION ALL SELECT 'run_scrub', 'INFO', 1, 0 UNION ALL SELECT 'run_transform', 'INFO', 1, 0"
)
def feed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if(F.get_json_object("details", "$.ok") == "true")
    return _run(spark, sf_dir).catalog.latest_audit(1000).groupBy("action", "severity").agg(F.count("*").alias("n"), ok.alias("n_ok"))


@_query(f"SELECT DISTINCT file, true AS curated, true AS final, true AS differ FROM {_FILES} WHERE file NOT IN (SELECT file FROM {_BAD})")
def feed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hashes that batches bear are those of the rows that lie in their folders now."""
    p = _run(spark, sf_dir)
    state = _batches(p).where("status = 'COMPLETED'")
    curated, final = [], []
    for source in sorted(r[0] for r in state.select("source_name").distinct().collect()):  # a handful of sources
        curated.append(sinks.content_hashes(p.curated(source).drop("run"), ["batch_id"]))
        final.append(sinks.content_hashes(_ready(p, source), ["file"]).withColumn("source_name", F.lit(source)))
    out = state.join(_all(curated).withColumnRenamed("content_sha256", "a"), "batch_id", "left").join(_all(final).withColumnRenamed("content_sha256", "b"), ["source_name", "file"], "left")
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    return out.select("file", same("curated_sha256", "a").alias("curated"), same("final_sha256", "b").alias("final"), (F.col("curated_sha256") != F.col("final_sha256")).alias("differ"))


@_query(
    f"SELECT 'hospital_a' AS source_name, '20250301120000000' AS version_ts, CAST((SELECT count(*) FROM {_GOOD_A}) AS BIGINT) AS n UNION ALL "
    f"SELECT 'clinic_b', '20250301120000000', (SELECT count(*) FROM {_GOOD_B}) UNION ALL SELECT 'hospital_c_hl7', '20250301120000000', (SELECT count(*) FROM {_GOOD_C}) "
    "UNION ALL SELECT 'bare', '20250301120000000', (SELECT count(*) FROM region)"
)
def feed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset versions that the run recorded, and the rows in their folders."""
    p = _run(spark, sf_dir)
    rows = p.catalog.table("dataset_versions").select("source_name", "version_ts", "path").collect()  # one for each source and run
    counts = [spark.read.parquet(r["path"]).agg(F.count("*").alias("n")).select(F.lit(r["source_name"]).alias("source_name"), F.lit(r["version_ts"]).alias("version_ts"), "n") for r in rows]
    return _all(counts)


@_query(f"SELECT patient_id, patient_name, dob, address, ssn, note_text, source, '20250301120000000' AS _commit_time FROM ({ORACLE_SQL['feed_ready_c']})")
def feed_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of the versioned table after the run's version was upserted."""
    p = _run(spark, sf_dir)
    return versioned.VersionedTable(spark, f"{p.zones.versioned}/hospital_c_hl7", order=None).snapshot()


@_query(f"SELECT file, source AS source_name, 'COMPLETED' AS status, '2025-03-01 12:00:00' AS ingest_time, ['INGEST', 'VALIDATION_PASSED', 'SCRUB_PHI', 'TRANSFORM'] AS steps, true AS missing FROM (SELECT DISTINCT 'o.hl7' AS file, 'hospital_c_hl7' AS source FROM {_C_SQL})")
def feed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lineage endpoints give for one batch: the batch with its times as text, its steps, and an error for an unknown id."""
    p = _run(spark, sf_dir)
    known = _batches(p).where("file = 'o.hl7'").first()["batch_id"]
    found, steps = p.catalog.found(known), [r["step_name"] for r in p.catalog.steps_of(known).collect()]
    try:
        p.catalog.found("none")
        missing = False
    except LookupError:
        missing = True
    row = [(str(found["raw_file_path"]).rsplit("/", 1)[-1], found["source_name"], found["status"], found["ingest_time"], steps, missing)]
    return spark.createDataFrame(row, "file string, source_name string, status string, ingest_time string, steps array<string>, missing boolean")


@_query(f"SELECT rule_id, description, '2025-03-01 12:00:00' AS applied_time FROM ({ORACLE_SQL['feed_rules']}) WHERE file = 'o.hl7'")
def feed_rules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _run(spark, sf_dir)
    return p.catalog.rules_of(_batches(p).where("file = 'o.hl7'").first()["batch_id"])


# The control plane: one control for each supplier, its steps in reverse, those of even keys done.


def _controls(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    c = catalog.Catalog(spark, scratch(spark), _NOW)
    suppliers = _t(spark, sf_dir, "supplier")
    at = F.make_timestamp_ntz(F.lit(2025), F.lit(1), (F.col("s_suppkey") % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp")
    c.append("control_header", suppliers.select(F.col("s_name").alias("control_id"), _text("n", F.col("s_nationkey")).alias("source_name"), at.alias("scheduled_time")))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step_order"), F.lit(s).alias("step_type")) for i, s in ((3, "transform"), (1, "ingest"), (2, "validate"))]))
    c.append("control_detail", suppliers.select(F.col("s_name").alias("control_id"), steps.alias("x")).select("control_id", "x.step_order", "x.step_type"))
    done = suppliers.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("control_id"))
    c.append("control_events", done.withColumns({"seq": F.lit(1), "status": F.lit("RUNNING"), "run_time": F.lit(_NOW)}))
    c.append("control_events", done.withColumns({"seq": F.lit(2), "status": F.lit("DONE"), "run_time": F.lit(_NOW)}))
    c.mark_control("Supplier#000000001", "DONE")
    return c


@_query(
    "SELECT s_name AS control_id, 'n' || s_nationkey AS source_name, strftime(make_date(2025, 1, CAST(s_suppkey % 28 + 1 AS INTEGER)), '%Y-%m-%d') AS day, 'PENDING' AS status "
    "FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey <> 1"
)
def control_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir).pending_controls().select("control_id", "source_name", F.date_format("scheduled_time", "yyyy-MM-dd").alias("day"), "status")


@_query("SELECT CASE WHEN s_suppkey % 2 = 0 OR s_suppkey = 1 THEN 'DONE' ELSE 'PENDING' END AS status, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1")
def control_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir).controls().groupBy("status").agg(F.count("*").alias("n"))


@_query("SELECT place, step_type FROM (VALUES (1, 'ingest'), (2, 'validate'), (3, 'transform')) AS v(place, step_type)")
def control_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of one control in their order: what is left of the order is checked by the place among the rows."""
    rows = [r["step_type"] for r in _controls(spark, sf_dir).control_steps("Supplier#000000003").collect()]
    return spark.createDataFrame(list(enumerate(rows, 1)), "place int, step_type string")


# Declared data


@_query(
    "SELECT * FROM (VALUES ('hospital_a', 'patient_id', 'string', false, false), ('hospital_a', 'patient_name', 'string', false, true), ('hospital_a', 'ssn', 'string', false, true), "
    "('hospital_a', 'dob', 'date', true, true), ('hospital_a', 'visit_date', 'date', true, false), ('hospital_a', 'diagnosis', 'string', true, false), ('hospital_a', 'notes', 'string', true, false), "
    "('clinic_b', 'id', 'string', false, false), ('clinic_b', 'name', 'string', false, true), ('clinic_b', 'date_of_birth', 'date', true, true), ('clinic_b', 'encounter', 'date', true, false), "
    "('clinic_b', 'icd', 'string', true, false), ('clinic_b', 'free_text', 'string', true, true), ('hospital_c_hl7', 'PID-3', 'string', false, false), ('hospital_c_hl7', 'PID-5', 'string', false, true), "
    "('hospital_c_hl7', 'PID-7', 'date', false, true), ('hospital_c_hl7', 'PID-11', 'string', true, true), ('hospital_c_hl7', 'PID-16', 'string', true, true)) "
    "AS v(source_name, column_name, data_type, is_nullable, is_phi)"
)
def declared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's columns as the lookup gives them."""
    rows = meta.metadata(spark)
    found = [(c.source_name, c.column_name, c.data_type, c.is_nullable, c.is_phi) for s in SOURCES for c in meta.declared(rows, s.source_name)]
    return spark.createDataFrame(found, "source_name string, column_name string, data_type string, is_nullable boolean, is_phi boolean")


@_query("SELECT place, source_name, id FROM (VALUES (1, 'clinic_b', 8), (2, 'clinic_b', 9), (3, 'clinic_b', 10), (4, 'clinic_b', 11), (5, 'clinic_b', 12), (6, 'clinic_b', 13), (7, 'hospital_a', 1)) AS v(place, source_name, id)")
def declared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven of all declared columns by source, then id; the rows went in the other way round."""
    rows = meta.metadata(spark).orderBy(F.desc("id"))
    first = [(i, r["source_name"], r["id"]) for i, r in enumerate(meta.ordered(rows).limit(7).collect(), 1)]
    return spark.createDataFrame(first, "place int, source_name string, id int")


@_query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hl7' WHEN '2-HIGH' THEN 'jsonl' ELSE 'csv' END AS source_type, o_orderpriority = '1-URGENT' AS is_message FROM orders")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with their sources' types, csv by default, and whether these are messages."""
    sources = spark.createDataFrame([("1-URGENT", "hl7"), ("2-HIGH", "jsonl")], "source_name string, source_type string")
    batches = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source_name"))
    kinds = [k for k in ("hl7", "HL7v2", "csv", "jsonl", None) if meta.is_message_type(k)]
    return meta.with_source_type(batches, sources).select("o_orderkey", "source_type", F.lower("source_type").isin(*[k.lower() for k in kinds]).alias("is_message"))


@_query("SELECT * FROM (VALUES ('a', true), ('c', true)) AS v(source_name, active)")
def sources_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meta.registry(spark, [Source("a", "csv", "a"), Source("b", "csv", "b", False), Source("c", "hl7", "c")])
    return meta.active_sources(rows).select("source_name", F.lit(True).alias("active"))


@_query(
    "SELECT * FROM (VALUES ('PHI_ADDRESS_SIMPLE', '[REDACTED_ADDRESS]', 'Simple street address (approx)', 'v2'), ('PHI_DATE_ISO', '[REDACTED_DATE]', 'Date like 2025-02-15', 'v2'), "
    "('PHI_DATE_YYYYMMDD', '[REDACTED_DATE]', 'Date like 20250215', 'v2'), ('PHI_EMAIL', '[REDACTED_EMAIL]', 'Email addresses', 'v2'), ('PHI_PHONE', '[REDACTED_PHONE]', 'Phone like 555-123-4567', 'v2'), "
    "('PHI_SSN', '[REDACTED_SSN]', 'US SSN pattern xxx-xx-xxxx', 'v2'), ('PHI_SSN_DIGITS', '[REDACTED_SSN]', '9-digit SSN', 'v2')) AS v(rule_id, token, description, version)"
)
def rules_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table of another version, loaded."""
    found = rl.load(rl.rule_table(spark).withColumn("rule_version", F.lit("v2")))
    return spark.createDataFrame([(r.rule_id, r.token, r.description, r.version) for r in found], "rule_id string, token string, description string, version string")


@_query("SELECT p_partkey, replace(p_name, 'e r', '[X]') AS redacted, contains(p_name, 'e r') AS hit, replace(p_brand, 'Brand#(', '[Y]') AS same FROM part")
def rules_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that the engine can't compile stands for its own text."""
    plain, broken = rl.Rule("A", "e r", "[X]"), rl.Rule("B", "Brand#(", "[Y]")
    a, b = rl.RuleSet(spark, [plain]), rl.RuleSet(spark, [broken])
    return _t(spark, sf_dir, "part").select("p_partkey", a.apply(F.col("p_name")).alias("redacted"), a.flag(F.col("p_name")).alias("hit"), b.apply(F.col("p_brand")).alias("same"))


@_query("SELECT * FROM (VALUES ('a.csv', 'csv'), ('b.jsonl', 'jsonl'), ('c.txt', 'hl7'), ('d.xml', 'error')) AS v(name, kind)")
def formats_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"a.csv": (None, "x,y"), "b.jsonl": ("xml", '{"a": 1}'), "c.txt": ("HL7v2", "MSH|"), "d.xml": ("xml", "<a/>")}
    rows = []
    for name, (declared, head) in texts.items():
        try:
            rows.append((name, readers.kind_of(declared, head)))
        except ValueError:
            rows.append((name, "error"))
    return spark.createDataFrame(rows, "name string, kind string")


@_query("SELECT r_name AS name, sha256(r_name || chr(10)) AS sha256, CAST(length(r_name) + 1 AS BIGINT) AS length FROM region")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, hashed whole and as streams; a folder inside it is no file of it."""
    rows = _t(spark, sf_dir, "region").select(F.col("r_name").alias("file"), F.lit(0).cast("long").alias("n"), F.col("r_name").alias("value"))
    folder = scratch(spark)
    _write_files(spark, rows, folder)
    _write_files(spark, rows, f"{folder}/inner")
    listed = readers.files(spark, folder)
    paths = [r["path"] for r in listed.select("path").collect()]
    sha = readers.hashes(spark, paths, whole_bytes=6)  # some names are longer
    return listed.join(sha, "path").select("name", "sha256", "length")


@_query("SELECT doc_id, text, lang, coalesce(source, '') AS source FROM documents")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_parquet(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), scratch(spark), by_source=True)
    return spark.read.parquet(path).select("doc_id", "text", "lang", F.coalesce("source", F.lit("")).alias("source"))


@_query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of the streaming part, over a table at rest."""
    out = incremental.status_counts(_t(spark, sf_dir, "events"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n")


@_query("SELECT s_name AS batch_id, '2025-03-01 12:00:00' AS ingest_time, '2025-03-01 12:00:00' AS created_at FROM supplier WHERE s_suppkey = 3")
def batch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch, the run's time as text."""
    c = catalog.Catalog(spark, scratch(spark), _NOW)
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("batch_id"), F.lit("s").alias("source_name"), F.lit("p").alias("raw_file_path"), F.lit("h").alias("raw_sha256"))
    c.create_batches(rows)
    return c.batch("Supplier#000000003").select("batch_id", "ingest_time", "created_at")


@_query(
    "SELECT * FROM (VALUES ('etl', 'batch_events', true, true), ('etl', 'audit', false, false), ('analyst', 'steps', true, false), ('analyst', 'audit', false, false), "
    "('audit', 'rules_applied', true, false), ('admin', 'audit', true, true), ('nobody', 'steps', false, false)) AS v(role, name, can_read, can_write)"
)
def role_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalogue opened under a role lets it do."""
    root, rows = scratch(spark), []
    for role, name in (("etl", "batch_events"), ("etl", "audit"), ("analyst", "steps"), ("analyst", "audit"), ("audit", "rules_applied"), ("admin", "audit"), ("nobody", "steps")):
        c = catalog.Catalog(spark, root, _NOW, role)
        rows.append((role, name, _allowed(lambda: c.table(name)), _allowed(lambda: c.append(name, spark.createDataFrame([("b",)], "batch_id string")))))
    return spark.createDataFrame(rows, "role string, name string, can_read boolean, can_write boolean")


def _allowed(act) -> bool:
    try:
        act()
    except PermissionError:
        return False
    return True


@_query("SELECT 'ok' AS status")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(catalog.health().values())], "status string")


@_query("SELECT event_id, event_type IN ('click', 'view') AND event_id % 3 = 0 AS flagged FROM events WHERE event_type IN ('click', 'view') OR event_id % 3 <> 0")
def boolean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, third = F.col("event_type").isin("click", "view"), F.col("event_id") % 3 == 0
    return _t(spark, sf_dir, "events").where(kind | ~third).select("event_id", (kind & third).alias("flagged"))


@_query(
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'invalid_json' WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0 THEN 'schema_mismatch' END AS kind FROM events "
    "WHERE event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0"
)
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are broken, lack a key, hold another type, or are no object."""
    i = F.col("event_id")
    line = F.when(i % 11 == 0, '{"k":').when(i % 7 == 0, '{"j":1}').when(i % 5 == 0, '{"k":"x"}').when(i % 13 == 0, "[1]").otherwise(F.col("props"))
    rows = _t(spark, sf_dir, "events").select(F.lit("b").alias("batch_id"), i.alias("row_no"), line.alias("line"))
    return validate.json_errors(rows, (Declared("events", "k", "int", False),)).select(F.col("row_no").alias("event_id"), "kind")
