"""Validation: typed and null checks of records against declared columns, and verdicts by batch.

Errors name column, row and kind of the fault, never the value: error details go to the catalogue, where unredacted text
must not turn up. Rows of all operators: (batch_id, row_no, column, kind).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from strandline.functions.text import blank, fields, lines, starting, strip
from strandline.operators.metadata import Declared, position

MISSING_COLUMN, NULL, TYPE = "missing_column", "null_not_allowed", "type_mismatch"
BAD_JSON, BAD_SHAPE = "invalid_json", "schema_mismatch"
NO_PID, BLANK = "missing_pid", "blank_field"
MALFORMED = "malformed_row"
SAMPLE_ROWS, SAMPLE_ERRORS = 200, 20

_INT = r"^[+-]?\d+(?:_\d+)*$"
_FLOAT = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*)?\.?(?:\d+(?:_\d+)*)?(?<=[\d.])(?:e[+-]?\d+(?:_\d+)*)?|nan|inf(?:inity)?)$"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


@F.pandas_udf(BooleanType())
def lenient_date(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether dateutil parses the text. Slow, and its defaults come from today's date: an option, never the default."""
    from dateutil import parser

    def ok(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            parser.parse(text)
        except (ValueError, OverflowError, TypeError):
            return False
        return True

    for texts in batches:
        yield texts.map(ok).astype("boolean")


def type_ok(c: Column, data_type: str, *, lenient_dates: bool = False) -> Column:
    """Whether a text is of the declared type. Null and empty texts always are; nullability is another check."""
    kind, text = data_type.lower(), strip(c)
    if kind in ("int", "integer"):
        good = text.rlike(_INT)
    elif kind in ("float", "double", "numeric"):
        good = text.rlike(_FLOAT) & (text.rlike(r"\d") | text.rlike(r"(?i)^[+-]?(?:nan|inf)"))
    elif kind in ("date", "datetime", "timestamp"):
        if lenient_dates:
            good = lenient_date(c)
        else:
            compact = text.rlike(r"^\d{8}$") & F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull()
            good = compact | (text.rlike(_ISO) & text.try_cast("timestamp").isNotNull())
    else:
        return F.lit(True)
    return c.isNull() | (c == "") | F.coalesce(good, F.lit(False))


def missing_columns(present: Sequence[str], columns: Sequence[Declared]) -> list[str]:
    return [c.column_name for c in columns if c.column_name not in set(present)]


def extra_columns(present: Sequence[str], columns: Sequence[Declared]) -> list[str]:
    return [c for c in present if c not in {x.column_name for x in columns}]


def _errors(tests: list[tuple[str, Column]]) -> Column:
    """The array of (column, kind) of cells whose kind is not null."""
    found = [F.when(kind.isNotNull(), F.struct(F.lit(name).alias("column"), kind.alias("kind"))) for name, kind in tests]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def csv_errors(
    rows: DataFrame,
    columns: Sequence[Declared],
    *,
    sample_rows: int | None = SAMPLE_ROWS,
    lenient_dates: bool = False,
) -> DataFrame:
    """Cell errors of rows (batch_id, row_no, text columns), in the first sample_rows rows of each batch, or in all."""
    present, tests = set(rows.columns), []
    for c in columns:
        cell = F.col(f"`{c.column_name}`") if c.column_name in present else F.lit(None).cast("string")
        empty = cell.isNull() | (cell == "")
        null = F.when(empty, F.lit(None if c.is_nullable else NULL))
        wrong = F.when(~type_ok(cell, c.data_type, lenient_dates=lenient_dates), F.lit(f"{TYPE}({c.data_type})"))
        tests.append((c.column_name, F.when(empty, null).otherwise(wrong)))
    checked = rows if sample_rows is None else rows.where(F.col("row_no") <= sample_rows)
    found = checked.select("batch_id", "row_no", F.explode(_errors(tests)).alias("e"))
    out = found.select("batch_id", "row_no", "e.column", "e.kind")
    for name in missing_columns(rows.columns, columns):
        header = rows.select("batch_id").distinct()
        out = out.unionByName(header.select("batch_id", F.lit(0).cast("long").alias("row_no"), F.lit(name).alias("column"), F.lit(MISSING_COLUMN).alias("kind")))
    if "malformed" in present:
        bad = rows.where("malformed").select("batch_id", "row_no", F.lit("").alias("column"), F.lit(MALFORMED).alias("kind"))
        out = out.unionByName(bad)
    return out


def json_kinds(data_type: str) -> tuple[str, ...] | None:
    """The kinds of JSON value that a type name allows, by the words it contains; None if all do not matter."""
    name = data_type.lower()
    if "int" in name:
        return ("integer",)
    if any(w in name for w in ("float", "double", "numeric")):
        return ("integer", "number")
    if "bool" in name:
        return ("boolean",)
    return ("string",)


def json_kind(value: Column) -> Column:
    """The kind of a variant: string, integer, number, boolean, null, object or array. 1.0 counts as an integer."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(schema == "STRING", "string")
        .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | schema.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "number")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def json_errors(rows: DataFrame, columns: Sequence[Declared], *, allow_null: bool = False) -> DataFrame:
    """One error at most for each row (batch_id, row_no, line), over all rows: bad JSON, or values unlike the columns."""
    parsed = rows.select("batch_id", "row_no", "line", F.try_parse_json("line").alias("v"))
    parsed = parsed.withColumn("m", F.from_json("line", "map<string,variant>"))
    wrong = F.col("m").isNull()
    for c in columns:
        value = F.element_at("m", F.lit(c.column_name))
        has = F.coalesce(F.map_contains_key("m", F.lit(c.column_name)), F.lit(False))
        kinds = (*json_kinds(c.data_type), *(("null",) if allow_null and c.is_nullable else ()))
        fault = has & ~F.coalesce(json_kind(value), F.lit("null")).isin(*kinds)
        wrong = wrong | fault | (F.lit(False) if c.is_nullable else ~has)
    kind = F.when(F.col("v").isNull(), BAD_JSON).when(F.coalesce(wrong, F.lit(True)), BAD_SHAPE)
    return parsed.select("batch_id", "row_no", F.lit("").alias("column"), kind.alias("kind")).where("kind IS NOT NULL")


def message_errors(rows: DataFrame, columns: Sequence[Declared], *, strict: bool = False) -> DataFrame:
    """Errors of messages (batch_id, row_no, message): no PID line, or blank declared fields. strict also condemns blank
    fields that may be null."""
    pid = F.get(starting(lines(F.col("message")), "PID|"), 0)
    parts = fields(pid)
    tests = []
    for c in columns:
        at = position(c.column_name)
        if at is not None and (strict or not c.is_nullable):
            tests.append((c.column_name, F.when(blank(F.get(parts, at)), F.lit(BLANK))))
    none = F.array(F.struct(F.lit("PID").alias("column"), F.lit(NO_PID).alias("kind")))
    found = F.when(pid.isNull(), none).otherwise(_errors(tests) if tests else F.array().cast("array<struct<column:string,kind:string>>"))
    out = rows.select("batch_id", "row_no", F.explode(found).alias("e"))
    return out.select("batch_id", "row_no", "e.column", "e.kind")


def error_sample(errors: DataFrame, keys: Sequence[str] = ("batch_id",), *, limit: int = SAMPLE_ERRORS) -> DataFrame:
    """The first errors by key, in row order."""
    order = Window.partitionBy(*keys).orderBy("row_no", "column", "kind")
    return errors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def verdicts(rows: DataFrame, errors: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """By key: total_rows, n_errors and ok. Counts are added up before the shuffle."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("total_rows"))
    bad = errors.groupBy(*keys).agg(F.count("*").alias("n_errors"))
    out = total.join(bad, list(keys), "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)).cast("long"))
    return out.withColumn("ok", F.col("n_errors") == 0)


def null_check(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """By key: rows, and rows with a blank in each column; ok if there is none. One pass."""
    counts = [F.count_if(blank(F.col(c).cast("string"))).alias(f"blank_{c}") for c in columns]
    out = rows.groupBy(*keys).agg(F.count("*").alias("total_rows"), *counts)
    return out.withColumn("ok", sum([F.col(f"blank_{c}") for c in columns[1:]], F.col(f"blank_{columns[0]}")) == 0)


def prefix(rows: DataFrame, keys: Sequence[str], order: Sequence, *, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows by key; Spark cuts each partition to the limit before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)
