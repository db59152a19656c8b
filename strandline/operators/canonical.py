"""Projection of sources onto shared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import fields, lines, null_if_missing, starting, strip


@dataclass(frozen=True)
class Mapped:
    """A canonical column and the source columns that may hold it, the first present one taken."""

    target: str
    sources: tuple[str, ...]


def _map(**columns: str | tuple[str, ...]) -> tuple[Mapped, ...]:
    return tuple(Mapped(t, (s,) if isinstance(s, str) else s) for t, s in columns.items())


#: The shared schema and where each source holds its columns.
MAPPINGS: Mapping[str, tuple[Mapped, ...]] = {
    "hospital_a": _map(
        patient_id="patient_id", patient_name="patient_name", dob="dob", visit_date="visit_date", diagnosis="diagnosis",
        note_text=("notes", "note"),
    ),
    "clinic_b": _map(
        patient_id="id", patient_name="name", dob="date_of_birth", visit_date="encounter", diagnosis="icd",
        note_text="free_text",
    ),
    "hospital_c_hl7": _map(
        patient_id="PID-3", patient_name="PID-5", dob="PID-7", address="PID-11", ssn="ssn", note_text="OBX",
    ),
}
PID_FIELDS = (3, 5, 7, 11, 16, 17, 19)
SSN_FIELDS = ("PID-16", "PID-17", "PID-19")


def canonicalise(rows: DataFrame, source: str, mapping: Sequence[Mapped] | None = None, *, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with the canonical columns as text, null where the source lacks them, and the source's name. Sources without a
    mapping pass through."""
    mapping = mapping if mapping is not None else MAPPINGS.get(source)
    if mapping is None:
        return rows
    present = set(rows.columns)

    def column(m: Mapped) -> Column:
        found = next((F.col(f"`{s}`") for s in m.sources if s in present), F.lit(None))
        return found.cast("string").alias(m.target)

    return rows.select(*keep, *[column(m) for m in mapping], F.lit(source).alias("source"))


def missing_to_null(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NA tokens of text columns, and NaN of float columns, as null."""
    chosen = set(columns if columns is not None else rows.columns)
    out = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if name in chosen and kind == "string":
            c = null_if_missing(c).alias(name)
        elif name in chosen and kind in ("double", "float"):
            c = F.when(~F.isnan(c), c).alias(name)
        out.append(c)
    return rows.select(*out)


def message_columns(rows: DataFrame, message: str = "message", *, first_blank_wins: bool = False) -> DataFrame:
    """The columns of messages: fields of the first PID line, stripped, null beyond its end; ssn; and the lines that begin with
    OBX|, as they are, joined by a space. first_blank_wins takes PID-16 for the ssn even if it is blank."""
    split = lines(F.col(message))
    staged = rows.withColumns({"_pid": fields(F.get(starting(split, "PID|"), 0)), "_obx": starting(split, "OBX|")})
    out = {f"PID-{n}": strip(F.get("_pid", F.lit(n))) for n in PID_FIELDS}
    filled = [F.nullif(out[c], F.lit("")) for c in SSN_FIELDS]
    ssn = F.coalesce(out["PID-16"], F.lit("")) if first_blank_wins else F.coalesce(*filled)
    note = F.when(F.size("_obx") > 0, F.array_join("_obx", " "))
    return staged.withColumns({**out, "ssn": ssn, "OBX": note}).drop("_pid", "_obx", message)


def unite(parts: Sequence[DataFrame]) -> DataFrame:
    """Canonical rows of several sources by column name, null where a source has no such column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
