"""Declared columns of sources: the data that validation and redaction are driven by."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Declared:
    source_name: str
    column_name: str
    data_type: str
    is_nullable: bool = True
    is_phi: bool = False
    phi_rule: str | None = None


@dataclass(frozen=True)
class Source:
    source_name: str
    source_type: str
    file_path: str = ""
    active: bool = True


#: The seeded sources and their columns, but for two: folders are relative to the landing folder, and the last
#: column of the messages is PID-16, where the feed has the SSN (the seed says 17).
SOURCES = (
    Source("hospital_a", "csv", "hospital_a"),
    Source("clinic_b", "jsonl", "clinic_b"),
    Source("hospital_c_hl7", "hl7", "hospital_c_hl7"),
)
COLUMNS = (
    Declared("hospital_a", "patient_id", "string", False),
    Declared("hospital_a", "patient_name", "string", False, True),
    Declared("hospital_a", "ssn", "string", False, True),
    Declared("hospital_a", "dob", "date", True, True),
    Declared("hospital_a", "visit_date", "date"),
    Declared("hospital_a", "diagnosis", "string"),
    Declared("hospital_a", "notes", "string"),
    Declared("clinic_b", "id", "string", False),
    Declared("clinic_b", "name", "string", False, True),
    Declared("clinic_b", "date_of_birth", "date", True, True),
    Declared("clinic_b", "encounter", "date"),
    Declared("clinic_b", "icd", "string"),
    Declared("clinic_b", "free_text", "string", True, True),
    Declared("hospital_c_hl7", "PID-3", "string", False),
    Declared("hospital_c_hl7", "PID-5", "string", False, True),
    Declared("hospital_c_hl7", "PID-7", "date", False, True),
    Declared("hospital_c_hl7", "PID-11", "string", True, True),
    Declared("hospital_c_hl7", "PID-16", "string", True, True),
)

REGISTRY = T.StructType(
    [
        T.StructField("source_name", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("active", T.BooleanType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("is_nullable", T.BooleanType()),
        T.StructField("is_phi", T.BooleanType()),
        T.StructField("phi_rule", T.StringType()),
    ]
)


def registry(spark: SparkSession, sources: Sequence[Source] = SOURCES) -> DataFrame:
    return spark.createDataFrame([(s.source_name, s.source_type, s.file_path, s.active) for s in sources], REGISTRY)


def active_sources(rows: DataFrame) -> DataFrame:
    return rows.where("active").select("source_name", "source_type", "file_path")


def metadata(spark: SparkSession, columns: Sequence[Declared] = COLUMNS) -> DataFrame:
    rows = [(i, c.source_name, c.column_name, c.data_type, c.is_nullable, c.is_phi, c.phi_rule) for i, c in enumerate(columns, 1)]
    return spark.createDataFrame(rows, METADATA)


def declared(rows: DataFrame, source: str) -> list[Declared]:
    """A source's columns in order of id."""
    found = rows.where(F.col("source_name") == source).orderBy("id").collect()
    return [Declared(source, r["column_name"], r["data_type"], r["is_nullable"], r["is_phi"], r["phi_rule"] if "phi_rule" in rows.columns else None) for r in found]


def ordered(rows: DataFrame) -> DataFrame:
    """All declared columns by source, then id."""
    return rows.orderBy("source_name", "id")


def with_source_type(batches: DataFrame, sources: DataFrame) -> DataFrame:
    """Batches with the type of their source, csv where the registry has none."""
    types = sources.select("source_name", "source_type").dropDuplicates(["source_name"])
    return batches.join(types, "source_name", "left").withColumn("source_type", F.coalesce("source_type", F.lit("csv")))


MESSAGE_TYPES = ("hl7", "hl7v2")


def is_message_type(source_type: str | None) -> bool:
    return (source_type or "").lower() in MESSAGE_TYPES


def position(column_name: str) -> int | None:
    """The field position that a name such as PID-5 declares."""
    head, _, tail = column_name.partition("-")
    return int(tail) if head.upper() == "PID" and tail.isdigit() else None
