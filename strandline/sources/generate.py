"""Seeded synthetic feeds in the three formats, for tests and volume runs: rows come from their number and a hash of it, so any
part can be made anywhere and the same seed gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.sinks import write_csv, write_lines, write_messages

_FIRST = ("Asta", "Bruno", "Cleo", "Dario", "Edda", "Falk", "Gwen", "Hugo")
_LAST = ("Abend", "Brook", "Castell", "Dorn", "O'Fell", "Grau", "Hain", "Iven")
_FINDINGS = ("asthma", "migraine", "anaemia", "sprain", "eczema", "bronchitis")
_CODES = ("J45", "G43", "D50", "S93", "L30", "J20")


def _pick(values: Sequence[str], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("n", "seed", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _number(low: int, high: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("n", "seed", F.lit(salt)), F.lit(high - low + 1)) + low


def people(spark: SparkSession, rows: int, *, seed: int = 42, parts: int | None = None) -> DataFrame:
    """rows persons with identifiers, dates, a finding and a note; a quarter of the notes hold a phone number, a quarter an address, a
    quarter an e-mail address."""
    born = F.date_add(F.lit("1940-01-01").cast("date"), _number(0, 365 * 65, 3).cast("int"))
    ssn = F.format_string("%03d-%02d-%04d", _number(100, 899, 4), _number(10, 99, 5), _number(1000, 9999, 6))
    phone = F.format_string("555-%03d-%04d", _number(100, 999, 7), _number(1000, 9999, 8))
    extra = F.element_at(
        F.array(
            F.concat(F.lit("phone "), phone), F.concat(F.lit("lives at "), _number(1, 99, 9).cast("string"), F.lit(" Mill Road")),
            F.concat(F.lit("mail p"), F.col("n").cast("string"), F.lit("@example.org")), F.lit("no remarks"),
        ),
        (F.pmod(F.col("n"), F.lit(4)) + 1).cast("int"),
    )
    name = F.concat(_pick(_FIRST, 1), F.lit(" "), _pick(_LAST, 2))
    base = spark.range(0, rows, 1, parts).withColumnRenamed("id", "n").withColumn("seed", F.lit(seed))
    return base.select(
        "n", name.alias("name"), ssn.alias("ssn"), born.alias("born"), F.date_add(F.lit("2025-02-01").cast("date"), _number(0, 27, 10).cast("int")).alias("seen"),
        _pick(_FINDINGS, 11).alias("finding"), _pick(_CODES, 11).alias("code"), extra.alias("extra"), _number(1, 200, 12).alias("level"),
    ).withColumn("note", F.concat(F.lit("Seen: "), "name", F.lit(", "), "extra"))


def write_feeds(spark: SparkSession, landing: str, rows: int, *, seed: int = 42, parts: int = 1) -> dict[str, int]:
    """Writes rows of each feed below landing, in parts files; returns the rows of each, an oracle for counts."""
    p = people(spark, rows, seed=seed, parts=parts)
    text = lambda c: F.col(c).cast("string")
    table = p.select(
        F.concat(F.lit("P"), (F.col("n") + 10000).cast("string")).alias("patient_id"), F.col("name").alias("patient_name"), "ssn", text("born").alias("dob"),
        text("seen").alias("visit_date"), F.col("finding").alias("diagnosis"), F.col("note").alias("notes"),
    )
    write_csv(table, f"{landing}/hospital_a")
    objects = F.to_json(
        F.struct(
            F.concat(F.lit("C"), (F.col("n") + 20000).cast("string")).alias("id"), "name", text("born").alias("date_of_birth"), text("seen").alias("encounter"),
            F.col("code").alias("icd"), F.col("note").alias("free_text"),
        )
    )
    write_lines(p.select(objects.alias("line")), f"{landing}/clinic_b")
    pid = F.concat_ws(
        "|", F.lit("PID"), F.lit(""), F.lit(""), text("n"), F.lit(""), "name", F.lit(""), F.date_format("born", "yyyyMMdd"), F.lit("M"), F.lit(""), F.lit(""),
        F.concat(text("level"), F.lit(" Mill Road")), F.lit(""), F.lit(""), F.lit(""), F.lit(""), "ssn",
    )
    message = F.concat_ws("\n", F.lit("MSH|^~\\&|LAB"), pid, F.lit("OBR|1"), F.concat(F.lit("OBX|1|NM|"), text("level")))
    write_messages(p.select(message.alias("message")), f"{landing}/hospital_c_hl7")
    return {"hospital_a": rows, "clinic_b": rows, "hospital_c_hl7": rows}

