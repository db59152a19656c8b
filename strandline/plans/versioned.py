"""A versioned table on Parquet: buckets by key hash, of which a commit writes those anew that it touches, and append-only logs.

A commit is visible once its log row is written. A snapshot holds, of every bucket, what the newest commit that wrote it
left: of all logged commits, or of those at or before an instant. An upsert keeps, of rows of one key in a batch, the one greatest by the order column, and replaces the stored row
(merge mode commit_time) or the lesser by the order column (event_time).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.relational import latest_by
from strandline.sources.readers import exists
from strandline.sources.sinks import content_hashes

COMMIT_TIME, EVENT_TIME = "commit_time", "event_time"
STAMP = "_commit_time"
_BUCKETS = "commit_time string, bucket int, row_count long, content_hash string"
_LOG = "commit_time string, operation string, inserted long, updated long, row_count long, content_hash string, source_version string"


def deduplicated(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row for each key: the greatest by order (nulls least), ties by the rows' hash. Partial maxima, no sort."""
    columns = rows.columns
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    staged = rows.withColumns({"_o": F.col(order) if order else F.lit(0), "_has": F.col(order).isNotNull() if order else F.lit(True), "_h": tie})
    best = latest_by(staged, [key], ["_has", "_o", "_h"], [c for c in columns if c != key])
    return best.select(*columns)


def upserted(base: DataFrame, incoming: DataFrame, key: str, order: str | None = None, *, mode: str = COMMIT_TIME) -> DataFrame:
    """base with incoming merged in by key; incoming must have one row for each key. One shuffle on the key."""
    if mode == EVENT_TIME and order:
        both = base.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        staged = both.withColumn("_has", F.col(order).isNotNull())
        return latest_by(staged, [key], ["_has", order, "_new"], [c for c in both.columns if c not in (key, "_new")])
    kept = base.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def as_of(rows: DataFrame, key: str, order: str, columns: list[str], instant: object) -> DataFrame:
    """Each key's latest state at an instant, from rows of a log."""
    return latest_by(rows.where(F.col(order) <= F.lit(instant)), [key], [order], columns)


def commits_of(rows: DataFrame, stamp: str = STAMP) -> DataFrame:
    """The distinct commit times on live rows, newest first: a commit whose rows are all replaced is not among them."""
    return rows.select(stamp).distinct().orderBy(F.desc(stamp))


class VersionedTable:
    """buckets is fixed once a table has a commit."""

    def __init__(
        self, spark: SparkSession, path: str, key: str = "patient_id", order: str | None = "visit_date", mode: str = COMMIT_TIME, *, buckets: int = 16
    ) -> None:
        self.spark, self.path, self.key, self.order, self.mode, self.buckets = spark, path.rstrip("/"), key, order, mode, buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def log(self) -> DataFrame:
        return self._table("_commits", _LOG)

    def commits(self) -> list[str]:
        """All commit times, newest first."""
        return [r[0] for r in self.log().select("commit_time").distinct().orderBy(F.desc("commit_time")).collect()]

    def latest_commit(self, instant: str | None = None) -> str | None:
        rows = self.log() if instant is None else self.log().where(F.col("commit_time") <= instant)
        return rows.agg(F.max("commit_time")).first()[0]

    def _manifest(self, at: str | None) -> dict[int, tuple[str, int, str]]:
        """By bucket the commit that wrote it last, up to one, its rows and their hash: one small row for each bucket."""
        if at is None:
            return {}
        logged = self.log().select("commit_time").where(F.col("commit_time") <= at)
        rows = self._table("_buckets", _BUCKETS).join(logged, "commit_time", "left_semi")
        last = latest_by(rows, ["bucket"], ["commit_time"], ["commit_time", "row_count", "content_hash"])
        return {r["bucket"]: (r["commit_time"], r["row_count"], r["content_hash"]) for r in last.collect()}

    def _folder(self, commit: str, bucket: int) -> str:
        return f"{self.path}/commit_time={commit}/_bucket={bucket}"

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*folders)

    def snapshot(self, instant: str | None = None) -> DataFrame:
        """The rows of the newest commit, or of the newest at or before an instant."""
        at = self.latest_commit(instant)
        if at is None:
            raise LookupError("no commit" if instant is None else f"no commit at or before {instant}")
        return self._read([self._folder(commit, bucket) for bucket, (commit, _, _) in sorted(self._manifest(at).items())])

    def upsert(self, rows: DataFrame, commit_time: str, *, source_version: str | None = None) -> dict[str, int]:
        """Merges rows as one commit; returns how many were inserted, updated and stored. Only buckets that rows touch are read
        and written; counts and hashes come from one pass over what was written."""
        newest = self.latest_commit()
        if newest is not None and commit_time <= newest:
            raise ValueError(f"commit {commit_time} is not after {newest}")
        order = self.order if self.order in rows.columns else None
        incoming = deduplicated(rows.where(F.col(self.key).isNotNull()), self.key, order).withColumn(STAMP, F.lit(commit_time))
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        arrived = {r["bucket"]: r["count"] for r in incoming.groupBy(bucket.alias("bucket")).count().collect()}
        before = self._manifest(newest)
        old = [self._folder(before[k][0], k) for k in sorted(arrived) if k in before]
        merged = upserted(self._read(old), incoming, self.key, order, mode=self.mode) if old else incoming
        if not arrived and not before:
            arrived, merged = {0: 0}, incoming  # an empty table has a schema all the same
        target = f"{self.path}/commit_time={commit_time}"
        after = dict(before)
        if arrived:
            merged.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(target)
            if sum(arrived.values()) == 0:
                merged.write.mode("overwrite").parquet(self._folder(commit_time, 0))
            written = self._read([self._folder(commit_time, k) for k in sorted(arrived)])
            hashes = content_hashes(written.withColumn("_bucket", bucket), ["_bucket"]).join(written.groupBy(bucket.alias("_bucket")).count(), "_bucket")
            stats = {r["_bucket"]: (r["count"], r["content_sha256"]) for r in hashes.collect()}
            after |= {k: (commit_time, *stats.get(k, (0, ""))) for k in arrived}
            made = [(commit_time, k, n, sha) for k, (at, n, sha) in after.items() if at == commit_time]
            self.spark.createDataFrame(made, _BUCKETS).coalesce(1).write.mode("append").parquet(f"{self.path}/_buckets")
        n_old, n_all = (sum(n for _, n, _ in m.values()) for m in (before, after))
        counts = {"inserted": n_all - n_old, "updated": sum(arrived.values()) - (n_all - n_old), "row_count": n_all}
        whole = hashlib.sha256(",".join(f"{k}:{sha}" for k, (_, n, sha) in sorted(after.items()) if n).encode()).hexdigest()
        row = [(commit_time, "upsert", counts["inserted"], counts["updated"], n_all, whole, source_version)]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/_commits")
        return counts

    def unregistered(self, versions: DataFrame) -> DataFrame:
        """The rows of versions (version_ts, path) that no commit has taken, oldest first."""
        taken = self.log().select(F.col("source_version").alias("version_ts")).where("version_ts IS NOT NULL")
        return versions.join(taken, "version_ts", "left_anti").orderBy("version_ts")


def latest_artifact(files: DataFrame) -> DataFrame:
    """By source, of files (source, version_ts, modified, path) the path of the newest version, then of the latest file."""
    return latest_by(files, ["source"], ["version_ts", "modified", "path"], ["version_ts", "path"])
