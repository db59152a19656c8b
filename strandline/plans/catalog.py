"""The provenance catalogue: append-only event tables, and the present state as a view of them.

Tables are Parquet folders. Nothing is updated in place: a batch's state is, for each field, the value of its latest
event that sets the field. Writers take DataFrames of many batches at once, so a run appends one file set a table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.relational import latest, queue, search, unknown_keys
from strandline.operators.rules import RULE_SET_VERSION
from strandline.sources.readers import exists

INGESTED, VALIDATED, SCRUBBED, COMPLETED, PENDING = "INGESTED", "VALIDATED", "SCRUBBED", "COMPLETED", "PENDING"
FAILED_VALIDATION, FAILED_SCRUB, FAILED_TRANSFORM = "FAILED_VALIDATION", "FAILED_SCRUB", "FAILED_TRANSFORM"

_FIELDS = {
    "source_name": "string", "ingest_time": "timestamp", "raw_file_path": "string", "raw_sha256": "string",
    "curated_sha256": "string", "final_sha256": "string", "status": "string", "version_path": "string",
    "total_rows": "long", "error_details": "string", "rule_set_version": "string",
}
SCHEMAS = {
    "batch_events": "batch_id string, seq long, event_time timestamp, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items()),
    "steps": "batch_id string, seq long, step_name string, step_time timestamp, details_json string",
    "rules_applied": "batch_id string, seq long, rule_id string, description string, created_at timestamp",
    "audit": "seq long, actor string, action string, batch_id string, details string, severity string, created_at timestamp",
    "control_header": "control_id string, source_name string, scheduled_time timestamp, comments string",
    "control_detail": "control_id string, step_order int, step_type string, config_json string",
    "control_events": "control_id string, seq long, status string, run_time timestamp",
    "dataset_versions": "source_name string, version_ts string, path string, sha256 string, created_by string, created_at timestamp",
}


class Catalog:
    """now is the one time of a run; every event of the run bears it, in order of seq. Tables are read and written under the
    grants of role: what it lacks is a PermissionError."""

    def __init__(self, spark: SparkSession, path: str, now: dt.datetime | None = None, role: str = "admin") -> None:
        self.spark, self.path, self.role = spark, path.rstrip("/"), role
        self.now = (now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=dt.timezone.utc)
        self._seq = int(self.now.timestamp() * 1_000_000)

    # Storage

    def schema(self, name: str) -> T.StructType:
        return T._parse_datatype_string(SCHEMAS[name])

    def _ask(self, name: str, action: str) -> None:
        if not may(self.role, name, action, GRANTS):
            raise PermissionError(f"{self.role} may not {'read' if action == 'r' else 'write'} {name}")

    def table(self, name: str) -> DataFrame:
        self._ask(name, "r")
        path = f"{self.path}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        """Appends rows, columns that they lack as null."""
        self._ask(name, "w")
        have = set(rows.columns)
        fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(name)]
        rows.select(*fields).write.mode("append").parquet(f"{self.path}/{name}")

    def _rows(self, **values: object) -> DataFrame:
        kinds = {str: "string", int: "long", dt.datetime: "timestamp"}
        return self.spark.createDataFrame(
            [tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
        )

    def next_seq(self) -> int:
        self._seq += 1
        return self._seq

    def _event(self, rows: DataFrame, **fields: Column) -> None:
        stamped = {"seq": F.lit(self.next_seq()), "event_time": F.lit(self.now), **fields}
        self.append("batch_events", rows.withColumns(stamped))

    # Batches

    def unknown_batches(self, rows: DataFrame) -> DataFrame:
        """The rows (batch_id) of which no batch is registered, one of each id."""
        return unknown_keys(rows.dropDuplicates(["batch_id"]), self.table("batch_events"), "batch_id")

    def create_batches(self, rows: DataFrame, version: str = RULE_SET_VERSION) -> DataFrame:
        """Registers rows (batch_id, source_name, raw_file_path, raw_sha256) as ingested, ids already known left out;
        returns what is new."""
        new = self.unknown_batches(rows)
        self._event(new, ingest_time=F.lit(self.now), status=F.lit(INGESTED), rule_set_version=F.lit(version))
        return new

    def set_status(self, rows: DataFrame, status: str, *, error_details: Column | None = None, total_rows: Column | None = None) -> None:
        """A new status for the batches in rows (batch_id). Error details are overwritten each time, by null too."""
        fields = {"status": F.lit(status), "error_details": error_details if error_details is not None else F.lit(None).cast("string")}
        if total_rows is not None:
            fields["total_rows"] = total_rows
        self._event(rows, **fields)

    def set_curated_hash(self, rows: DataFrame) -> None:
        """Takes rows (batch_id, curated_sha256)."""
        self._event(rows)

    def complete(self, rows: DataFrame) -> None:
        """Takes rows (batch_id, final_sha256, version_path)."""
        self._event(rows, status=F.lit(COMPLETED))

    def batches(self) -> DataFrame:
        """The present state of every batch: one aggregation over its events."""
        return batch_state(self.table("batch_events"))

    # Steps, rules, audit

    def record_steps(self, rows: DataFrame) -> None:
        """Takes rows (batch_id, step_name, details_json)."""
        self.append("steps", rows.withColumns({"seq": F.lit(self.next_seq()), "step_time": F.lit(self.now)}))

    def record_rules(self, rows: DataFrame, version: str = RULE_SET_VERSION) -> None:
        """Takes distinct rows (batch_id, rule_id)."""
        stamped = {"seq": F.lit(self.next_seq()), "description": F.lit(f"applied, rule set {version}"), "created_at": F.lit(self.now)}
        self.append("rules_applied", rows.withColumns(stamped))

    def write_audit(self, actor: str, action: str, batch_id: str | None = None, details: str = "{}", severity: str = "INFO") -> None:
        self.append("audit", self._rows(seq=self.next_seq(), actor=actor, action=action, batch_id=batch_id, details=details, severity=severity, created_at=self.now))

    def write_audits(self, actor: str, action: str, rows: DataFrame, severity: str = "INFO") -> None:
        """One audit row for each of rows (batch_id, details)."""
        fixed = {"actor": actor, "action": action, "severity": severity, "created_at": self.now}
        self.append("audit", rows.withColumns({"seq": F.lit(self.next_seq()), **{k: F.lit(v) for k, v in fixed.items()}}))

    def record_version(self, source: str, version_ts: str, path: str, sha256: str, created_by: str = "strandline") -> None:
        self.append("dataset_versions", self._rows(source_name=source, version_ts=version_ts, path=path, sha256=sha256, created_by=created_by, created_at=self.now))

    # Control

    def pending_controls(self) -> DataFrame:
        """Controls in PENDING, by scheduled time."""
        return queue(self.controls(), PENDING, order=("scheduled_time",))

    def controls(self) -> DataFrame:
        events = self.table("control_events").groupBy("control_id").agg(F.max_by(F.struct("status", "run_time"), "seq").alias("s"))
        out = self.table("control_header").join(events, "control_id", "left")
        return out.select("control_id", "source_name", "scheduled_time", "comments", F.coalesce("s.status", F.lit(PENDING)).alias("status"), "s.run_time")

    def control_steps(self, control_id: str) -> DataFrame:
        return self.table("control_detail").where(F.col("control_id") == control_id).orderBy("step_order")

    def mark_control(self, control_id: str, status: str) -> None:
        self.append("control_events", self._rows(control_id=control_id, seq=self.next_seq(), status=status, run_time=self.now))

    # Lineage queries

    def batch(self, batch_id: str) -> DataFrame:
        """The batch, times as text; no row if there is none."""
        found = self.batches().where(F.col("batch_id") == batch_id)
        return found.withColumns({c: F.col(c).cast("string") for c in ("ingest_time", "created_at")})

    def found(self, batch_id: str) -> dict[str, object]:
        """The batch as a mapping, times as text; a LookupError if there is none."""
        row = self.batch(batch_id).first()
        if row is None:
            raise LookupError(f"no batch {batch_id}")
        return row.asDict()

    def steps_of(self, batch_id: str) -> DataFrame:
        return self.table("steps").where(F.col("batch_id") == batch_id).orderBy("step_time", "seq")

    def rules_of(self, batch_id: str) -> DataFrame:
        found = self.table("rules_applied").where(F.col("batch_id") == batch_id).orderBy("created_at", "seq", "rule_id")
        return found.select("rule_id", "description", F.col("created_at").cast("string").alias("applied_time"))

    def latest_batches(self, source: str, limit: int = 20) -> DataFrame:
        return latest(self.batches().where(F.col("source_name") == source), [F.desc("ingest_time"), F.col("batch_id")], limit)

    def search_batches(self, status: str | None = None, source: str | None = None) -> DataFrame:
        return search(self.batches(), {"status": status, "source_name": source}, [F.desc("ingest_time"), F.col("batch_id")])

    def failed_batches(self) -> DataFrame:
        return self.batches().where(F.col("status").startswith("FAILED_"))

    def latest_audit(self, limit: int = 50) -> DataFrame:
        return latest(self.table("audit"), [F.desc("created_at"), F.desc("seq")], limit)

    def orphans(self) -> dict[str, DataFrame]:
        """Rows that refer to no known batch or control; all should be empty."""
        batches = self.table("batch_events")
        return {
            "steps": unknown_keys(self.table("steps"), batches, "batch_id"),
            "rules_applied": unknown_keys(self.table("rules_applied"), batches, "batch_id"),
            "control_detail": unknown_keys(self.table("control_detail"), self.table("control_header"), "control_id"),
        }


def batch_state(events: DataFrame) -> DataFrame:
    """For each batch_id, every field's latest value that was set; error_details goes with the latest status."""
    last = lambda c: F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    kept = [last(c) for c in _FIELDS if c != "error_details"]
    details = F.expr("max_by(struct(error_details), seq) FILTER (WHERE status IS NOT NULL)").alias("_e")
    out = events.groupBy("batch_id").agg(*kept, details, F.min("event_time").alias("created_at"))
    return out.withColumn("error_details", F.col("_e.error_details")).drop("_e")


def health() -> Mapping[str, str]:
    return {"status": "ok"}


#: The documented access of the roles to zones and logs, r read, w write.
ACCESS: Mapping[str, Mapping[str, str]] = {
    "raw": {"admin": "rw", "compliance": "r", "engineer": "", "scientist": "", "api_user": ""},
    "curated": {"admin": "rw", "compliance": "r", "engineer": "r", "scientist": "", "api_user": ""},
    "ready": {"admin": "rw", "compliance": "r", "engineer": "r", "scientist": "r", "api_user": ""},
    "versioned": {"admin": "rw", "compliance": "r", "engineer": "r", "scientist": "r", "api_user": ""},
    "provenance": {"admin": "rw", "compliance": "r", "engineer": "r", "scientist": "r", "api_user": "r"},
    "audit": {"admin": "rw", "compliance": "r", "engineer": "", "scientist": "", "api_user": ""},
}
#: The granted access of the database roles to the catalogue's tables. Batches, steps and rules are granted by name;
#: all else is the administrator's.
_GRANTED = {"admin": "rw", "etl": "rw", "analyst": "r", "audit": "r"}
GRANTS: Mapping[str, Mapping[str, str]] = {
    name: _GRANTED if name in ("batch_events", "steps", "rules_applied") else {"admin": "rw"} for name in SCHEMAS
}


def may(role: str, zone: str, action: str = "r", access: Mapping[str, Mapping[str, str]] = ACCESS) -> bool:
    return action in access.get(zone, {}).get(role, "")


def access_rows(spark: SparkSession, access: Mapping[str, Mapping[str, str]] = ACCESS) -> DataFrame:
    """Every zone and role of the matrix, by what may() answers."""
    roles = sorted({role for by in access.values() for role in by})
    rows = [(zone, role, may(role, zone, "r", access), may(role, zone, "w", access)) for zone in access for role in roles]
    return spark.createDataFrame(rows, "zone string, role string, can_read boolean, can_write boolean")
