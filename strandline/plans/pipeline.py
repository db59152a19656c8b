"""The batch pipeline: ingest, validate, scrub, canonicalise, version, all traced in the catalogue.

Each stage takes all batches of a source in one DataFrame; the driver handles file names and verdicts only.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import content_id
from strandline.operators import canonical, scrub, validate
from strandline.operators import metadata as meta
from strandline.operators.relational import queue
from strandline.operators.rules import RuleSet
from strandline.plans import catalog as cat
from strandline.plans.versioned import VersionedTable
from strandline.sources import readers, sinks


@dataclass
class Zones:
    root: str
    raw: str = field(init=False)
    quarantine: str = field(init=False)
    curated: str = field(init=False)
    ready: str = field(init=False)
    versioned: str = field(init=False)

    def __post_init__(self) -> None:
        base = self.root.rstrip("/")
        self.raw, self.quarantine, self.curated = f"{base}/raw", f"{base}/quarantine", f"{base}/curated"
        self.ready, self.versioned = f"{base}/ready", f"{base}/versioned"


def _folder(path: str) -> str:
    """The folder a file lies in: in the raw zone each batch has its own."""
    return path.rsplit("/", 2)[-2]


def _batch_key(batch_id: Column) -> Column:
    """A batch's folder name: letters and digits alone, and never a number."""
    return F.concat(F.lit("b"), F.substring(F.sha2(batch_id, 256), 1, 16))


def _audited(stage: str) -> Callable:
    """Every run of a stage leaves an audit row, one that raises too, with its severity."""

    def wrap(run: Callable) -> Callable:
        @wraps(run)
        def audited(self: Pipeline, *args: object) -> object:
            try:
                out = run(self, *args)
            except Exception as e:
                self.catalog.write_audit("pipeline", f"run_{stage}_failed", details=json.dumps({"error": type(e).__name__}), severity="ERROR")
                raise
            self.catalog.write_audit("pipeline", f"run_{stage}", details=json.dumps({"count": len(out)}))
            return out

        return audited

    return wrap


class Pipeline:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        sources: DataFrame | None = None,
        columns: DataFrame | None = None,
        rules: RuleSet | None = None,
        now: dt.datetime | None = None,
        sample_rows: int | None = validate.SAMPLE_ROWS,
        strict_messages: bool = False,
    ) -> None:
        self.spark, self.zones = spark, Zones(root)
        self.catalog = cat.Catalog(spark, f"{root.rstrip('/')}/catalog", now)
        self.sources = sources if sources is not None else meta.registry(spark)
        self.columns = columns if columns is not None else meta.metadata(spark)
        self.rules = rules or RuleSet(spark)
        self.sample_rows, self.strict_messages = sample_rows, strict_messages
        self.stamp = self.catalog.now.strftime("%Y%m%d%H%M%S%f")[:17]

    def _types(self) -> dict[str, str]:
        return {r["source_name"]: r["source_type"] for r in self.sources.select("source_name", "source_type").collect()}

    def _batches(self, status: str) -> dict[str, list]:
        """The batches in a status by source, oldest first."""
        out: dict[str, list] = {}
        for row in queue(self.catalog.batches(), status).select("batch_id", "source_name", "raw_file_path").collect():
            out.setdefault(row["source_name"], []).append(row)
        return out

    def _read(self, source_type: str | None, batches: list) -> DataFrame:
        """The records of files of one source, each with its batch_id."""
        return canonical.unite(self._parts(source_type, batches))

    def _parts(self, source_type: str | None, batches: list) -> list[DataFrame]:
        """The same in parts: CSV files of one header are read together, others apart."""
        paths = [b["raw_file_path"] for b in batches]
        kind = self._kind(source_type, paths)
        if kind == readers.MESSAGES:
            parts = [readers.read_messages(self.spark, paths)]
        elif kind == readers.LINES:
            parts = [readers.read_lines(self.spark, paths)]
        else:
            by_header: dict[tuple, list[str]] = {}
            for path, header in zip(paths, readers.csv_headers(self.spark, paths), strict=True):
                by_header.setdefault(tuple(header), []).append(path)
            parts = [readers.read_csv(self.spark, some, header) for header, some in by_header.items()]
        ids = self.spark.createDataFrame([(_folder(b["raw_file_path"]), b["batch_id"]) for b in batches], "_at string, batch_id string")
        ids = F.broadcast(ids)  # one row for each file read
        at = F.element_at(F.split("file", "/"), -2)
        return [rows.withColumn("_at", at).join(ids, "_at").drop("_at", "file") for rows in parts]

    def _kind(self, source_type: str | None, paths: list[str]) -> str:
        """The format of a source's files; heads are read only where the declared type is none that is known."""
        known = (source_type or "").lower() in (*meta.MESSAGE_TYPES, readers.CSV, readers.LINES)
        heads = [""] if known else readers.first_lines(self.spark, paths)
        kinds = [readers.kind_of(source_type, head) for head in heads]
        if len(set(kinds)) > 1:
            raise ValueError(f"files of one source in unlike formats: {sorted(set(kinds))}")
        return kinds[0]

    # Ingest

    @_audited("ingest")
    def ingest(self, landing: str) -> list[str]:
        """Copies the new files of every active source from landing to the raw zone, each batch in a folder of its own, and
        registers them; returns new batch ids. A file of known name and content is no new batch."""
        listed = []
        for row in meta.active_sources(self.sources).collect():
            found = readers.files(self.spark, f"{landing.rstrip('/')}/{row['file_path']}")
            listed.append(found.select(F.lit(row["source_name"]).alias("source_name"), "path", "name"))
        names = canonical.unite(listed).collect() if listed else []
        if not names:
            return []
        sha = readers.hashes(self.spark, [r["path"] for r in names])
        rows = self.spark.createDataFrame(names, "source_name string, path string, name string").join(sha, "path")
        rows = rows.withColumnRenamed("sha256", "raw_sha256").withColumn("batch_id", content_id(F.col("source_name"), F.col("name"), F.col("raw_sha256")))
        folder = F.concat_ws("/", F.lit(self.zones.raw), "source_name", _batch_key(F.col("batch_id")), "name")
        new = self.catalog.unknown_batches(rows).withColumn("target", folder)
        taken = new.select("batch_id", "source_name", "path", "target", "raw_sha256").collect()  # one row for each new file
        if not taken:
            return []
        landed = sinks.land(self.spark, [(r["path"], r["target"]) for r in taken])
        values = [(r["batch_id"], r["source_name"], at, r["raw_sha256"], r["path"]) for r, at in zip(taken, landed, strict=True)]
        rows = self.spark.createDataFrame(values, "batch_id string, source_name string, raw_file_path string, raw_sha256 string, source_file string")
        self.catalog.create_batches(rows.drop("source_file"), self.rules.version)
        details = F.to_json(F.struct("source_file", F.col("raw_file_path").alias("raw_copy"), F.col("raw_sha256").alias("sha256")))
        self.catalog.record_steps(rows.select("batch_id", F.lit("INGEST").alias("step_name"), details.alias("details_json")))
        return sorted(r["batch_id"] for r in taken)

    # Validate

    @_audited("validate")
    def validate(self) -> dict[str, bool]:
        """Checks all ingested batches; failed files move to quarantine. Returns the verdict of each batch."""
        out: dict[str, bool] = {}
        types = self._types()
        for source, batches in self._batches(cat.INGESTED).items():
            gone = [b for b in batches if not readers.exists(self.spark, b["raw_file_path"])]
            batches = [b for b in batches if b not in gone]
            self._fail(gone, cat.FAILED_VALIDATION, "VALIDATION_FAILED", {b["batch_id"]: "raw file is missing" for b in gone})
            out |= {b["batch_id"]: False for b in gone}
            if not batches:
                continue
            columns = meta.declared(self.columns, source)
            if not columns:
                done = self._ids([b["batch_id"] for b in batches])
                self.catalog.record_steps(done.withColumns({"step_name": F.lit("VALIDATION_SKIPPED"), "details_json": F.lit("{}")}))
                self.catalog.set_status(done, cat.VALIDATED)
                out |= {b["batch_id"]: True for b in batches}
                continue
            try:
                parts = self._parts(types.get(source, "csv"), batches)
            except ValueError as e:  # files of no known format
                self._fail(batches, cat.FAILED_VALIDATION, "VALIDATION_FAILED", {b["batch_id"]: str(e) for b in batches})
                out |= {b["batch_id"]: False for b in batches}
                continue
            rows = canonical.unite(parts)
            errors = canonical.unite([self._errors(part, columns) for part in parts])
            found = {r["batch_id"]: r for r in validate.verdicts(rows, errors).collect()}  # one row for each file
            sample: dict[str, list] = {}
            for e in validate.error_sample(errors).collect():  # twenty at most for each file
                sample.setdefault(e["batch_id"], []).append({"row": e["row_no"], "column": e["column"], "kind": e["kind"]})
            good = [b for b in batches if b["batch_id"] not in found or found[b["batch_id"]]["ok"]]
            bad = [b for b in batches if b not in good]
            out |= {b["batch_id"]: b in good for b in batches}
            if good:
                values = [(b["batch_id"], found[b["batch_id"]]["total_rows"] if b["batch_id"] in found else 0) for b in good]
                done = self.spark.createDataFrame(values, "batch_id string, total_rows long")
                self.catalog.record_steps(done.select("batch_id", F.lit("VALIDATION_PASSED").alias("step_name"), F.to_json(F.struct("total_rows")).alias("details_json")))
                self.catalog.set_status(done.select("batch_id", "total_rows"), cat.VALIDATED, total_rows=F.col("total_rows"))
            self._fail(bad, cat.FAILED_VALIDATION, "VALIDATION_FAILED", {b["batch_id"]: json.dumps(sample.get(b["batch_id"], [])) for b in bad})
            places = [f"{self.zones.quarantine}/{source}/{'/'.join(b['raw_file_path'].rsplit('/', 2)[-2:])}" for b in bad]
            moved = sinks.quarantine(self.spark, [(b["raw_file_path"], at) for b, at in zip(bad, places, strict=True)])
            if moved:
                rows = self.spark.createDataFrame([(b["batch_id"], at) for b, at in zip(bad, moved, strict=True)], "batch_id string, raw_file_path string")
                self.catalog.record_steps(rows.select("batch_id", F.lit("QUARANTINE_MOVED").alias("step_name"), F.to_json(F.struct("raw_file_path")).alias("details_json")))
                self.catalog._event(rows)
        if out:
            each = self.spark.createDataFrame([(i, json.dumps({"ok": ok})) for i, ok in out.items()], "batch_id string, details string")
            self.catalog.write_audits("pipeline", "validation", each)
        return out

    def _errors(self, rows: DataFrame, columns: list[meta.Declared]) -> DataFrame:
        if "message" in rows.columns:
            return validate.message_errors(rows, columns, strict=self.strict_messages)
        if "malformed" in rows.columns:
            return validate.csv_errors(rows, columns, sample_rows=self.sample_rows)
        return validate.json_errors(rows, columns)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "batch_id string")

    def _fail(self, batches: list, status: str, step: str, details: dict[str, str]) -> None:
        if batches:
            rows = self.spark.createDataFrame([(b["batch_id"], details[b["batch_id"]]) for b in batches], "batch_id string, d string")
            self.catalog.record_steps(rows.select("batch_id", F.lit(step).alias("step_name"), F.to_json(F.struct(F.col("d").alias("errors"))).alias("details_json")))
            self.catalog.set_status(rows.select("batch_id", "d").withColumn("_d", F.col("d")).drop("_d"), status, error_details=F.col("d"))

    # Scrub

    @_audited("scrub")
    def scrub(self) -> list[str]:
        """Redacts all validated batches into the curated zone; a source that fails is recorded and the others go on."""
        done: list[str] = []
        types = self._types()
        for source, batches in self._batches(cat.VALIDATED).items():
            ids = [b["batch_id"] for b in batches]
            try:
                columns = meta.declared(self.columns, source)
                rows = self._read(types.get(source, "csv"), batches)
                if "message" in rows.columns:
                    out = scrub.scrub_messages(rows, columns, self.rules)
                elif "line" in rows.columns:
                    out = scrub.scrub_objects(rows, columns, self.rules)
                else:
                    out = scrub.scrub_table(rows.drop("malformed"), columns, self.rules)
                target = f"{self.zones.curated}/{source}/run={self.stamp}"
                out.write.mode("overwrite").partitionBy("batch_id").parquet(target)
                written = self.spark.read.parquet(target).withColumn("batch_id", F.col("batch_id").cast("string"))
                found = scrub.counts(written)
                detail = F.to_json(F.struct("total_rows", "replacements", "rules"))
                applied = written.select("batch_id", F.explode("hits").alias("rule_id")).distinct().orderBy("batch_id", "rule_id")
                self.catalog.record_rules(applied, self.rules.version)
                self.catalog.record_steps(found.select("batch_id", F.lit("SCRUB_PHI").alias("step_name"), detail.alias("details_json")))
                self.catalog.set_curated_hash(self._hashed(written, ids, "curated_sha256"))
                self.catalog.set_status(self._ids(ids), cat.SCRUBBED)
                done += ids
            except Exception as e:  # one source's failure must not stop the others
                self._fail(batches, cat.FAILED_SCRUB, "SCRUB_ERROR", {i: type(e).__name__ for i in ids})
        return done

    def _hashed(self, rows: DataFrame, ids: list[str], name: str) -> DataFrame:
        """Content hashes of all batches in one pass; a batch without rows has the hash of none."""
        none = sinks.content_hash(rows.limit(0).drop("batch_id"))
        found = self._ids(ids).join(sinks.content_hashes(rows, ["batch_id"]), "batch_id", "left")
        return found.select("batch_id", F.coalesce("content_sha256", F.lit(none)).alias(name))

    # Transform

    def curated(self, source: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.zones.curated}/{source}").withColumn("batch_id", F.col("batch_id").cast("string"))

    @_audited("transform")
    def transform(self) -> dict[str, str]:
        """Canonical tables of all scrubbed batches, from the curated zone; returns the path written for each source."""
        out: dict[str, str] = {}
        for source, batches in self._batches(cat.SCRUBBED).items():
            ids = [b["batch_id"] for b in batches]
            try:
                rows = self.curated(source).where(F.col("batch_id").isin(ids)).drop("hits", "run")
                if "message" in rows.columns:
                    rows = canonical.message_columns(rows)
                elif "line" in rows.columns:
                    rows = readers.object_columns(rows, [c.column_name for c in meta.declared(self.columns, source)])
                else:
                    rows = canonical.missing_to_null(rows)
                known = source in canonical.MAPPINGS
                table = canonical.canonicalise(rows if known else rows.drop("row_no"), source, keep=("batch_id",))
                key = _batch_key(F.col("batch_id"))
                path = f"{self.zones.ready}/{source}/version_ts={self.stamp}"
                table.withColumn("batch", key).drop("batch_id").write.mode("overwrite").partitionBy("batch").parquet(path)
                written = self.spark.read.parquet(path)
                sha = sinks.content_hash(written.drop("batch"))
                names = F.broadcast(self._ids(ids).withColumn("batch", key))  # one row for each batch
                written = written.join(names, "batch").drop("batch")
                own = self._hashed(written, ids, "final_sha256").withColumn("version_path", F.concat(F.lit(f"{path}/batch="), key))
                details = F.to_json(F.struct("version_path", F.coalesce("count", F.lit(0)).alias("rows")))
                found = own.join(written.groupBy("batch_id").count(), "batch_id", "left")
                self.catalog.record_steps(found.select("batch_id", F.lit("TRANSFORM").alias("step_name"), details.alias("details_json")))
                self.catalog.complete(own)
                self.catalog.record_version(source, self.stamp, path, sha)
                out[source] = path
            except Exception as e:
                self._fail(batches, cat.FAILED_TRANSFORM, "TRANSFORM_ERROR", {i: type(e).__name__ for i in ids})
        return out

    # Version

    def register(self, source: str, *, key: str = "patient_id", order: str | None = "visit_date", latest_only: bool = False) -> list[str]:
        """Upserts the versions that the versioned table has not taken, oldest first (only the newest with latest_only);
        returns all commits, newest first."""
        table = VersionedTable(self.spark, f"{self.zones.versioned}/{source}", key, order)
        versions = self.catalog.table("dataset_versions").where(F.col("source_name") == source)
        todo = table.unregistered(versions).collect()
        for v in todo[-1:] if latest_only else todo:
            table.upsert(self.spark.read.parquet(v["path"]).drop("batch", "batch_id"), v["version_ts"], source_version=v["version_ts"])
        return table.commits()

    def run(self, landing: str) -> dict[str, int]:
        """All stages in order; how many batches each took."""
        new, verdicts, done, tables = self.ingest(landing), self.validate(), self.scrub(), self.transform()
        for source in tables:
            if source in canonical.MAPPINGS:
                self.register(source)
        return {"ingested": len(new), "validated": sum(verdicts.values()), "scrubbed": len(done), "tables": len(tables)}
