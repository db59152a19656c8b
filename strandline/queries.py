"""The registered queries of the library's own operators, each with equivalent SQL where SQL can express it.

The operators work on clinical files, which the shared tables lack; each query applies an operator to a table of like
shape. Literal rows are added where no row of the tables would exercise a rule.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as fx
from strandline.operators import canonical, relational, scrub, validate
from strandline.operators.metadata import Declared
from strandline.operators.rules import LAST_MATCH, RULES, Rule, RuleSet, by_id, match_counts, rules_applied, specific_first
from strandline.plans import catalog, versioned
from strandline.session import scratch
from strandline.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rules, over all documents and some literal rows. RE2 knows ASCII word borders only, so the SQL spells the borders out: what
# stands before and after is captured and put back. A border can serve one match at a time, so each rule is applied twice.

_BY_ID = {r.rule_id: r for r in RULES}
_LITERALS = (
    (-1, "ssn 123-45-6789 here"), (-2, "id 123456789 end"), (-3, "call 555-123-4567 now"), (-4, "seen 2025-02-15 twice, 2025-03-01"),
    (-5, "on 20250215 again"), (-6, "mail a.b@x.org or c@d.net"), (-7, "at 12 Main St, 3rd floor"), (-8, "12 a.b@x.org"),
    (-9, "ssn 123-45-6789 phone 555-123-4567"), (-10, ""), (-11, "nothing here"), (-12, "é123-45-6789 ü@ö.de"), (-13, "12 Hauptstraße,34 Ölweg 5-é"),
    (-14, "123-45-6789 987-65-4321 111-22-3333 555-123-4567"),
)
_LIT = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _LITERALS) + ") AS v(id, txt)"
_TEXTS = f"(SELECT doc_id AS id, source, text AS txt FROM documents UNION ALL SELECT id, 'literal', txt FROM {_LIT})"
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_B, _E, _D = rf"(^|[^{_W}])", rf"($|[^{_W}])", r"\p{Nd}"
#: Each rule's pattern for RE2: the character before as the first group, those after as the last ones.
_RE2 = {
    "PHI_SSN": (rf"{_B}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_E}", r"\2"),
    "PHI_SSN_DIGITS": (rf"{_B}{_D}{{9}}{_E}", r"\2"),
    "PHI_PHONE": (rf"{_B}{_D}{{3}}-{_D}{{3}}-{_D}{{4}}{_E}", r"\2"),
    "PHI_EMAIL": (rf"{_B}[{_W}][{_W}.+-]*@[{_W}-]+\.[{_W}.-]*[{_W}]", ""),
    "PHI_DATE_YYYYMMDD": (rf"{_B}{_D}{{8}}{_E}", r"\2"),
    "PHI_DATE_ISO": (rf"{_B}{_D}{{4}}-{_D}{{2}}-{_D}{{2}}{_E}", r"\2"),
    # The stretch ends where a word ends, or where one begins.
    "PHI_ADDRESS_SIMPLE": (rf"{_B}{_D}+[\s\x0B\x85\p{{Z}}]+[A-Za-z0-9. -]*(?:[A-Za-z0-9]{_E}|[. -]([{_W}]))", r"\2\3"),
}


def _re(column: str, rule: Rule) -> str:
    pattern, after = _RE2[rule.rule_id]
    once = f"regexp_replace({column}, '{pattern}', '\\1{rule.token}{after}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '\\1{rule.token}{after}', 'g')"


def _test(column: str, rule: Rule) -> str:
    return f"coalesce(regexp_matches({column}, '{_RE2[rule.rule_id][0]}'), false)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("txt"))
    own = spark.createDataFrame([(i, "literal", t) for i, t in _LITERALS], "id long, source string, txt string")
    return docs.unionByName(own)


def _one_rule(spark: SparkSession, sf_dir: str, rule_id: str) -> DataFrame:
    rules = RuleSet(spark, [_BY_ID[rule_id]])
    return _texts(spark, sf_dir).select("id", rules.apply(F.col("txt")).alias("redacted"), rules.flag(F.col("txt")).alias("hit"))


def _one_rule_sql(rule_id: str) -> str:
    return f"SELECT id, {_re('txt', _BY_ID[rule_id])} AS redacted, {_test('txt', _BY_ID[rule_id])} AS hit FROM {_TEXTS}"


@_query(_one_rule_sql("PHI_EMAIL"))
def scrub_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(spark, sf_dir, "PHI_EMAIL")


@_query(_one_rule_sql("PHI_SSN"))
def scrub_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(spark, sf_dir, "PHI_SSN")


def _chain_sql() -> str:
    """One step for each rule: the text so far, and the list of the rules that changed it."""
    steps, last = [], f"(SELECT doc_id, source, text AS t, CAST([] AS VARCHAR[]) AS h FROM documents)"
    for k, r in enumerate(specific_first()):
        hit = f"CASE WHEN {_test('t', r)} THEN list_append(h, '{r.rule_id}') ELSE h END"
        steps.append(f"s{k} AS (SELECT doc_id, source, {_re('t', r)} AS t, {hit} AS h FROM {last})")
        last = f"s{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, t AS redacted, h AS rules FROM {last}"


@_query(_chain_sql())
def scrub_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document, redacted, with the rules that changed it."""
    found = _t(spark, sf_dir, "documents").select("doc_id", "source", RuleSet(spark).redact(F.col("text")).alias("r"))
    return found.select("doc_id", "source", F.col("r.text").alias("redacted"), F.col("r.hits").alias("rules"))


_LAST = "txt"
for _r in by_id():
    _LAST = f"CASE WHEN {_test('txt', _r)} THEN {_re('txt', _r)} ELSE {_LAST} END"


@_query(f"SELECT id, {_LAST} AS redacted FROM {_TEXTS}")
def scrub_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", RuleSet(spark, mode=LAST_MATCH).apply(F.col("txt")).alias("redacted"))


_HITS = " UNION ALL ".join(f"SELECT source, '{r.rule_id}' AS rule_id FROM {_TEXTS} WHERE {_test('txt', r)}" for r in RULES)


@_query(f"SELECT source, rule_id, CAST(count(*) AS BIGINT) AS hits FROM ({_HITS}) GROUP BY source, rule_id")
def scrub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_counts(_texts(spark, sf_dir), "txt", RuleSet(spark, mode=LAST_MATCH), ["source"])


@_query(f"SELECT DISTINCT source, rule_id FROM ({_HITS})")
def rules_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_applied(_texts(spark, sf_dir), "txt", RuleSet(spark, mode=LAST_MATCH), ["source"])


_PROPS = (Declared("events", "k", "int", False),)


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_integer FROM events")
def json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.element_at(F.from_json("props", "map<string,variant>"), F.lit("k"))
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$", "long").alias("k"), (validate.json_kind(v) == "integer").alias("is_integer"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, '[REDACTED]' AS redacted_k FROM events")
def json_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.lit("b").alias("batch_id"), F.col("event_id").alias("row_no"), F.col("props").alias("line"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    out = scrub.scrub_objects(rows, [Declared("events", "k", "int", False, True)], RuleSet(spark))
    return out.select(F.col("row_no").alias("event_id"), "k", "event_type", F.get_json_object("line", "$.k").alias("redacted_k"))


@_query("SELECT c_custkey, '[REDACTED_NAME]' AS c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, '[REDACTED]' AS c_mktsegment FROM customer")
def redact_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment")
    columns = [Declared("customer", "c_name", "string", False, True), Declared("customer", "c_mktsegment", "string", True, True)]
    return scrub.scrub_table(rows, columns, RuleSet(spark), keep=("c_custkey",)).drop("hits")


# Validation


_FORMS = ("12", "-7", "1.5", "1e3", "x", "2024-02-30", "2024-02-29", "20240229", "2024-01-01T10:00:00Z", " 5 ", "")
_FORM_SQL = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_FORMS)) + " END"


@_query(
    f"SELECT event_id, trim(t) = '' AND t = '' OR regexp_full_match(trim(t), '[+-]?[0-9]+') AS is_int, t = '' OR try_cast(trim(t) AS DOUBLE) IS NOT NULL AS is_float, "
    "t = '' OR try_strptime(trim(t), '%Y%m%d') IS NOT NULL AND length(trim(t)) = 8 OR try_cast(trim(t) AS TIMESTAMP) IS NOT NULL AND contains(t, '-') AND length(t) > 3 AS is_date, true AS is_text "
    f"FROM (SELECT event_id, {_FORM_SQL} AS t FROM events)"
)
def type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, dates and texts in forms that fit some types and not others."""
    t = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("event_id") % 11 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select(
        "event_id", validate.type_ok(t, "int").alias("is_int"), validate.type_ok(t, "numeric").alias("is_float"),
        validate.type_ok(t, "date").alias("is_date"), validate.type_ok(t, "text").alias("is_text"),
    )


@_query(
    "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE trim(coalesce(c_name, '')) = '') AS BIGINT) AS blank_c_name, "
    "CAST(count(*) FILTER (WHERE c_nationkey IS NULL) AS BIGINT) AS blank_c_nationkey, "
    "count(*) FILTER (WHERE trim(coalesce(c_name, '')) = '' OR c_nationkey IS NULL) = 0 AS ok FROM customer GROUP BY c_mktsegment"
)
def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.null_check(_t(spark, sf_dir, "customer"), ["c_name", "c_nationkey"], ["c_mktsegment"])


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a text file: one batch for each status; large prices as text that is no number."""
    price = F.when(F.col("o_totalprice") > 400000, F.lit("high")).otherwise(F.col("o_totalprice").cast("string"))
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")).otherwise(F.col("o_orderpriority"))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("batch_id"), F.col("o_orderkey").alias("row_no"), price.alias("price"), priority.alias("priority")
    )


_ORDER_COLUMNS = (Declared("orders", "price", "float", False), Declared("orders", "priority", "string", False), Declared("orders", "clerk", "string"))
_ORDER_ERRORS = """(SELECT o_orderstatus AS batch_id, o_orderkey AS row_no, 'price' AS "column", 'type_mismatch(float)' AS kind FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderstatus, o_orderkey, 'priority', 'null_not_allowed' FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT DISTINCT o_orderstatus, 0, 'clerk', 'missing_column' FROM orders)"""


@_query(f"SELECT * FROM {_ORDER_ERRORS}")
def cell_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.csv_errors(_order_rows(spark, sf_dir), _ORDER_COLUMNS, sample_rows=None)


@_query(
    f"WITH e AS (SELECT batch_id, count(*) AS n FROM {_ORDER_ERRORS} GROUP BY batch_id) SELECT o_orderstatus AS batch_id, "
    "CAST(count(*) AS BIGINT) AS total_rows, CAST(coalesce(max(n), 0) AS BIGINT) AS n_errors, coalesce(max(n), 0) = 0 AS ok "
    "FROM orders LEFT JOIN e ON batch_id = o_orderstatus GROUP BY o_orderstatus"
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_rows(spark, sf_dir)
    return validate.verdicts(rows, validate.csv_errors(rows, _ORDER_COLUMNS, sample_rows=None))


@_query(
    f'SELECT batch_id, row_no, "column", kind, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY batch_id '
    f'ORDER BY row_no, "column", kind) AS rank FROM {_ORDER_ERRORS}) WHERE rank <= 20'
)
def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = validate.csv_errors(_order_rows(spark, sf_dir), _ORDER_COLUMNS, sample_rows=None)
    return validate.error_sample(errors).withColumn("rank", F.col("rank").cast("long"))


@_query(
    "SELECT o_orderstatus, o_orderkey, CAST(rank AS BIGINT) AS rank FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER "
    "(PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 200"
)
def sample_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate")
    out = validate.prefix(rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderstatus", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@_query("SELECT r_regionkey, ['dob', 'ssn'] AS missing, ['r_name', 'r_regionkey'] AS extra FROM region")
def header_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _t(spark, sf_dir, "region")
    diff = relational.column_difference(["ssn", "dob", "id"], [*region.columns, "id"], region.limit(1))
    return region.select("r_regionkey").join(F.broadcast(diff))  # one row


@_query("SELECT event_id, CAST(event_id % 3 <> 0 AS BIGINT) AS has_k, CAST(event_id % 3 = 0 AS BIGINT) AS n_errors FROM events")
def json_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line lacks the required key."""
    line = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", '"k"', '"other"')).otherwise(F.col("props"))
    rows = _t(spark, sf_dir, "events").select(F.lit("b").alias("batch_id"), F.col("event_id").alias("row_no"), line.alias("line"))
    bad = validate.json_errors(rows, _PROPS).groupBy("row_no").agg(F.count("*").alias("n"))
    has = F.map_contains_key(F.from_json("line", "map<string,string>"), F.lit("k")).cast("long")
    out = rows.join(bad, "row_no", "left")
    return out.select(F.col("row_no").alias("event_id"), has.alias("has_k"), F.coalesce("n", F.lit(0)).cast("long").alias("n_errors"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: a header, a PID line with fields 3, 5, 7, 11 and 16, and two notes."""
    fields: list[Column] = [F.lit("PID"), *[F.lit("")] * 16]
    for n, c in ((3, F.col("o_orderkey").cast("string")), (5, F.col("o_orderpriority")), (7, F.date_format("o_orderdate", "yyyyMMdd")), (11, F.col("o_orderstatus")), (16, F.col("o_custkey").cast("string"))):
        fields[n] = c
    pid = F.concat_ws("|", *fields)
    notes = [F.concat_ws("|", F.lit("OBX"), F.lit(str(i)), F.col("o_orderstatus")) for i in (1, 2)]
    message = F.concat_ws("\n", F.lit("MSH|^~&|A"), pid, *notes)
    return _t(spark, sf_dir, "orders").select(F.lit("b").alias("batch_id"), F.col("o_orderkey").alias("row_no"), message.alias("message"))


@_query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS patient_id, o_orderpriority AS patient_name, strftime(o_orderdate, '%Y%m%d') AS dob, o_orderstatus AS address, "
    "CAST(o_custkey AS VARCHAR) AS ssn, 'OBX|1|' || o_orderstatus || ' OBX|2|' || o_orderstatus AS note_text, 'hospital_c_hl7' AS source FROM orders"
)
def segment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalise(canonical.message_columns(_messages(spark, sf_dir)), "hospital_c_hl7")


_MESSAGE_COLUMNS = (
    Declared("o", "PID-3", "string", False), Declared("o", "PID-5", "string", False, True), Declared("o", "PID-7", "date", False, True),
    Declared("o", "PID-11", "string", True, True),
)


@_query(
    "SELECT o_orderkey, 'MSH|^~&|A' || chr(10) || 'PID|||' || o_orderkey || '||[REDACTED_NAME]||[REDACTED_DATE]||||[REDACTED]|||||' || o_custkey || chr(10) || "
    "'OBX|1|' || o_orderstatus || chr(10) || 'OBX|2|' || o_orderstatus AS message, CAST(3 AS BIGINT) AS n_hits FROM orders"
)
def segment_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scrub.scrub_messages(_messages(spark, sf_dir), _MESSAGE_COLUMNS, RuleSet(spark))
    return out.select(F.col("row_no").alias("o_orderkey"), "message", F.size("hits").cast("long").alias("n_hits"))


@_query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, 'PID-16' AS \"column\", 'blank_field' AS kind FROM orders WHERE false UNION ALL SELECT o_orderkey, 'PID-8', 'blank_field' FROM orders")
def message_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (*_MESSAGE_COLUMNS, Declared("o", "PID-16", "string", False), Declared("o", "PID-8", "string", False))
    return validate.message_errors(_messages(spark, sf_dir), columns).select(F.col("row_no").alias("o_orderkey"), "column", "kind")


# Projection

_CUSTOMER = canonical._map(patient_id="c_custkey", patient_name="c_name", diagnosis=("segment", "c_mktsegment"), dob="birth")
_SUPPLIER = canonical._map(patient_id="s_suppkey", patient_name="s_name", address="s_nationkey")
_CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS patient_name, c_mktsegment AS diagnosis, CAST(NULL AS VARCHAR) AS dob, 'customer' AS source"
_SUPPLIER_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS patient_id, s_name AS patient_name, CAST(s_nationkey AS VARCHAR) AS address, 'supplier' AS source"


@_query(f"{_CUSTOMER_SQL} FROM customer")
def canonical_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalise(_t(spark, sf_dir, "customer"), "customer", _CUSTOMER)


@_query(f"{_SUPPLIER_SQL} FROM supplier")
def canonical_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalise(_t(spark, sf_dir, "supplier"), "supplier", _SUPPLIER)


@_query(
    f"{_CUSTOMER_SQL}, CAST(NULL AS VARCHAR) AS address FROM customer UNION ALL SELECT patient_id, patient_name, NULL, NULL, source, address FROM ({_SUPPLIER_SQL} FROM supplier)"
)
def canonical_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unite([canonical_customer(spark, sf_dir), canonical_supplier(spark, sf_dir)])


_NA_ROWS = ("NA", "null", "None", "N/A", "", "nan", "na", "Null", "x", "0")


@_query("SELECT i, CASE WHEN i >= 6 THEN t END AS t FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_NA_ROWS)) + ") AS v(i, t)")
def null_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.missing_to_null(spark.createDataFrame(list(enumerate(_NA_ROWS)), "i int, t string"))


# Hashes and ids


@_query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", fx.sha256(F.col("text")).alias("content_sha256"))


@_query("SELECT sha256(text) AS content_sha256, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_key FROM documents GROUP BY text HAVING count(*) > 1 AND text IS NOT NULL")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_content(_t(spark, sf_dir, "documents"), "text", "doc_id")


@_query(
    "SELECT o_orderkey, o_orderpriority || '_' || replace(p_name || '.csv', '.', '_') || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS batch_id "
    "FROM orders JOIN part ON p_partkey = o_custkey"
)
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", fx.batch_id(F.col("o_orderpriority"), F.concat("p_name", F.lit(".csv")), F.col("o_orderdate")).alias("batch_id"))


@_query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(url, '[.][^./]*$', '.txt') AS swapped, split_part(url, '/', 3) AS host FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", fx.base_name(url).alias("name"), fx.swap_suffix(url, ".txt").alias("swapped"), F.split_part(url, F.lit("/"), F.lit(3)).alias("host"))


@_query(
    "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, string_split(text, chr(10))[1] AS first_line, lower(source) AS low, "
    "upper(source) AS up, starts_with(source, 'src1') AS is_src1, ends_with(source, '9') AS is_nine, contains(source, 'rc1') AS has FROM documents"
)
def text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, source = fx.lines(F.col("text")), F.col("source")
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.get(lines, 0).alias("first_line"), F.lower(source).alias("low"), F.upper(source).alias("up"),
        source.startswith("src1").alias("is_src1"), source.endswith("9").alias("is_nine"), source.contains("rc1").alias("has"),
    )


# Catalogue and lineage


@_query("SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'O'")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global sort by range; places come from the sorted partitions' sizes, so no task holds the whole queue."""
    rows = relational.queue(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "O", column="o_orderstatus", order=("o_orderdate", "o_orderkey"))
    return relational.placed(rows, "place").drop("o_orderstatus")


@_query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def search_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.search(_t(spark, sf_dir, "orders"), {"o_orderstatus": "", "o_orderpriority": "2-HIGH"}, [F.desc("o_orderdate")])
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return relational.latest(rows, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_orderdate")


@_query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(_t(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type", "ts")


@_query("SELECT c_custkey, coalesce(n_name, 'csv') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON c_nationkey = n_nationkey")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _t(spark, sf_dir, "nation").where("n_regionkey <> 4").withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.lookup(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", {"n_name": "csv"}).drop("c_nationkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000")
    return relational.unknown_keys(_t(spark, sf_dir, "customer"), known, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return relational.unknown_keys(_t(spark, sf_dir, "lineitem"), orders, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@_query("SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_by(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])


@_query(
    "SELECT CAST(user_id AS VARCHAR) AS batch_id, arg_max(event_type, event_id) AS status, CAST(arg_max(CASE WHEN event_type = 'purchase' THEN event_id END, event_id) AS BIGINT) AS total_rows, "
    "arg_max(CASE WHEN event_type = 'error' THEN 'e' || event_id ELSE '' END, event_id) AS details FROM events GROUP BY user_id"
)
def batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's view over an event log: each field's latest value that was set, error details with the latest status."""
    kind, none = F.col("event_type"), F.lit(None)
    fields = {
        "source_name": none, "ingest_time": none, "raw_file_path": none, "raw_sha256": none, "curated_sha256": none, "final_sha256": none,
        "version_path": none, "rule_set_version": none, "status": kind, "total_rows": F.when(kind == "purchase", F.col("event_id")),
        "error_details": F.when(kind == "error", F.concat(F.lit("e"), "event_id")),
    }
    stamped = {"batch_id": F.col("user_id").cast("string"), "seq": F.col("event_id"), "event_time": F.col("ts")}
    events = _t(spark, sf_dir, "events").withColumns({**stamped, **fields})
    out = catalog.batch_state(events)
    return out.select("batch_id", "status", "total_rows", F.coalesce("error_details", F.lit("")).alias("details"))


@_query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS place FROM events")
def step_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.ranked(_t(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "place")
    return out.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "place")


@_query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'er%'")
def failed_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.starting_with(_t(spark, sf_dir, "events"), "event_type", "er").select("event_id", "event_type")


@_query(
    "SELECT zone, role, role = 'admin' OR role = 'compliance' OR zone = 'provenance' OR role = 'engineer' AND zone IN ('curated', 'ready', 'versioned') "
    "OR role = 'scientist' AND zone IN ('ready', 'versioned') AS can_read, role = 'admin' AS can_write "
    "FROM (VALUES ('raw'), ('curated'), ('ready'), ('versioned'), ('provenance'), ('audit')) AS z(zone), (VALUES ('admin'), ('compliance'), ('engineer'), ('scientist'), ('api_user')) AS r(role)"
)
def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.access_rows(spark)


# The versioned table

_CUT = dt.datetime(2024, 1, 15)
_COLUMNS = ["user_id", "ts", "event_id", "event_type", "value"]


def _one_per_user(where: str) -> str:
    return f"(SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events WHERE {where}) WHERE r = 1)"


_BASE, _NEW = _one_per_user("ts < TIMESTAMP '2024-01-15'"), _one_per_user("ts >= TIMESTAMP '2024-01-15' AND event_type <> 'view'")


@_query(f"SELECT *, 'b' AS commit_time FROM {_NEW} UNION ALL SELECT *, 'a' FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.user_id = b.user_id)")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select(*_COLUMNS)
    base = versioned.deduplicated(events.where(F.col("ts") < F.lit(_CUT)), "user_id", "ts").withColumn("commit_time", F.lit("a"))
    new = versioned.deduplicated(events.where((F.col("ts") >= F.lit(_CUT)) & (F.col("event_type") != "view")), "user_id", "ts").withColumn("commit_time", F.lit("b"))
    return versioned.upserted(base, new, "user_id", "ts")


@_query("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def upsert_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows do not win: the newer half is stored first, then the older half comes in."""
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    base = versioned.deduplicated(events.where(F.col("ts") >= F.lit(_CUT)), "user_id", "ts")
    late = versioned.deduplicated(events.where(F.col("ts") < F.lit(_CUT)), "user_id", "ts")
    return versioned.upserted(base, late, "user_id", "ts", mode=versioned.EVENT_TIME)


@_query("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")
def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.as_of(_t(spark, sf_dir, "events"), "user_id", "ts", ["ts", "event_type"], _CUT)


@_query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS commit_time FROM orders")
def commit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("commit_time"))
    return versioned.commits_of(rows, "commit_time")


@_query(
    "SELECT source, version_ts, path FROM (SELECT source, lang AS version_ts, 'p' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY lang DESC, n_chars DESC, 'p' || doc_id DESC) AS r "
    "FROM documents) WHERE r = 1"
)
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "documents").select("source", F.col("lang").alias("version_ts"), F.col("n_chars").alias("modified"), F.concat(F.lit("p"), "doc_id").alias("path"))
    return versioned.latest_artifact(files)


# Files: tables are written in a feed's format to the shared folder and read again by the readers.


@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, false AS malformed FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), quoted.alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"))
    path = sinks.write_csv(rows, scratch(spark))
    return readers.read_csv(spark, path, rows.columns).select("c_custkey", "c_name", "c_nationkey", "malformed")


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are numbered within each file; every number up to the file's length turns up once, or the row would be lost."""
    line = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").alias("k")))
    path = sinks.write_lines(_t(spark, sf_dir, "events").select(line.alias("line")), scratch(spark))
    rows = readers.read_lines(spark, path)
    top = rows.groupBy("file").agg(F.max("row_no").alias("_last"), F.countDistinct("row_no").alias("_n"))
    whole = rows.join(top.where("_last = _n").select("file"), "file")
    return readers.object_columns(whole, ["event_id", "k"]).select(F.col("event_id").cast("long").alias("event_id"), "k")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS patient_id, o_orderpriority AS patient_name, o_orderstatus AS address FROM orders")
def messages_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_messages(_messages(spark, sf_dir), scratch(spark))
    return canonical.canonicalise(canonical.message_columns(readers.read_messages(spark, path)), "hospital_c_hl7").select("patient_id", "patient_name", "address")


# The versioned table and the catalogue on storage.


def _two_commits(spark: SparkSession, sf_dir: str) -> versioned.VersionedTable:
    table = versioned.VersionedTable(spark, scratch(spark), "user_id", "ts")
    events = _t(spark, sf_dir, "events").select(*_COLUMNS)
    table.upsert(events.where(F.col("ts") < F.lit(_CUT)), "20240115", source_version="first")
    table.upsert(events.where((F.col("ts") >= F.lit(_CUT)) & (F.col("event_type") != "view")), "20240131", source_version="second")
    return table


@_query(f"SELECT *, '20240131' AS _commit_time FROM {_NEW} UNION ALL SELECT *, '20240115' FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.user_id = b.user_id)")
def versioned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_commits(spark, sf_dir).snapshot()


@_query(f"SELECT *, '20240115' AS _commit_time FROM {_BASE}")
def versioned_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_commits(spark, sf_dir).snapshot("20240120")


@_query(
    f"WITH b AS (SELECT user_id FROM {_BASE}), n AS (SELECT user_id FROM {_NEW}), u AS (SELECT count(*) AS k FROM n WHERE user_id IN (SELECT user_id FROM b)) "
    "SELECT '20240115' AS commit_time, 'upsert' AS operation, CAST((SELECT count(*) FROM b) AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated, CAST((SELECT count(*) FROM b) AS BIGINT) AS row_count, 'first' AS source_version "
    "UNION ALL SELECT '20240131', 'upsert', (SELECT count(*) FROM n) - k, k, (SELECT count(*) FROM b) + (SELECT count(*) FROM n) - k, 'second' FROM u"
)
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_commits(spark, sf_dir).log().drop("content_hash")


_RUN = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)


def _filled(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    """A catalogue of one batch for each supplier, of the nation as source: all validated, those in debt failed, then known ids again."""
    c = catalog.Catalog(spark, scratch(spark), _RUN)
    suppliers = _t(spark, sf_dir, "supplier")
    source = F.concat(F.lit("n"), "s_nationkey")
    rows = suppliers.select(F.col("s_name").alias("batch_id"), source.alias("source_name"), F.lit("p").alias("raw_file_path"), F.sha2("s_name", 256).alias("raw_sha256"))
    c.create_batches(rows)
    ids = suppliers.select(F.col("s_name").alias("batch_id"), F.col("s_suppkey").alias("total_rows"))
    c.set_status(ids, catalog.VALIDATED, total_rows=F.col("total_rows"))
    bad = suppliers.where("s_acctbal < 1000").select(F.col("s_name").alias("batch_id"))
    c.set_status(bad, catalog.FAILED_SCRUB, error_details=F.lit("low"))
    c.record_rules(bad.withColumn("rule_id", F.lit("PHI_SSN")))
    c.record_steps(ids.select("batch_id").withColumns({"step_name": F.lit("INGEST"), "details_json": F.lit("{}")}))
    c.create_batches(rows)
    return c


_STATE = (
    "SELECT s_name AS batch_id, 'n' || s_nationkey AS source_name, sha256(s_name) AS raw_sha256, CASE WHEN s_acctbal < 1000 THEN 'FAILED_SCRUB' ELSE 'VALIDATED' END AS status, "
    "CAST(s_suppkey AS BIGINT) AS total_rows, CASE WHEN s_acctbal < 1000 THEN 'low' ELSE '' END AS details FROM supplier"
)


def _state(rows: DataFrame) -> DataFrame:
    return rows.select("batch_id", "source_name", "raw_sha256", "status", "total_rows", F.coalesce("error_details", F.lit("")).alias("details"))


@_query(_STATE)
def catalogue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_filled(spark, sf_dir).batches())


@_query(f"SELECT * FROM ({_STATE}) WHERE status = 'VALIDATED' AND source_name = 'n3'")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_filled(spark, sf_dir).search_batches("VALIDATED", "n3"))


@_query(f"SELECT * FROM ({_STATE}) WHERE status LIKE 'FAILED%'")
def catalogue_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_filled(spark, sf_dir).failed_batches())


@_query(f"SELECT * FROM ({_STATE}) WHERE source_name = 'n3' ORDER BY batch_id LIMIT 20")
def catalogue_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(_filled(spark, sf_dir).latest_batches("n3"))


@_query("SELECT s_name AS batch_id, 'PHI_SSN' AS rule_id, 'applied, rule set v1' AS description FROM supplier WHERE s_acctbal < 1000")
def catalogue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).table("rules_applied").select("batch_id", "rule_id", "description")


@_query(
    "SELECT 'steps' AS name, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'rules_applied', 0 UNION ALL SELECT 'control_detail', count(*) FROM region"
)
def catalogue_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of customers, who are no batches, and details of controls without a header are planted."""
    c = _filled(spark, sf_dir)
    strangers = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("batch_id"))
    c.record_steps(strangers.withColumns({"step_name": F.lit("INGEST"), "details_json": F.lit("{}")}))
    c.append("control_detail", _t(spark, sf_dir, "region").select(F.col("r_name").alias("control_id")))
    found = c.orphans()
    return canonical.unite([rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in found.items()])
