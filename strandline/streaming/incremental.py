"""Incremental loading by Structured Streaming, beside the batch pipeline: new files of a folder are redacted and
upserted, a commit for each micro-batch. The checkpoint makes restarts take up where a run stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from strandline.operators.metadata import Declared
from strandline.operators.rules import RuleSet
from strandline.operators.scrub import scrub_table
from strandline.plans.versioned import VersionedTable


def csv_stream(spark: SparkSession, path: str, header: Sequence[str], *, files_at_once: int = 100) -> DataFrame:
    """Rows of text columns of files as they arrive."""
    schema = ", ".join(f"`{c}` string" for c in header)
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "maxFilesPerTrigger": files_at_once}
    return spark.readStream.schema(schema).options(**options).csv(path)


def scrubbed_stream(rows: DataFrame, columns: Sequence[Declared], rules: RuleSet) -> DataFrame:
    return scrub_table(rows, columns, rules, keep=())


def upsert_stream(
    rows: DataFrame,
    table: VersionedTable,
    checkpoint: str,
    *,
    stamp: Callable[[int], str] = lambda n: f"{n:017d}",
    project: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Upserts each micro-batch as the commit stamp(batch number); one that is already logged is not taken twice."""

    def take(batch: DataFrame, number: int) -> None:
        at = stamp(number)
        newest = table.latest_commit()
        if newest is None or at > newest:
            table.upsert(project(batch) if project else batch, at, source_version=at)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window of time, late ones taken up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))
