"""Generic relational operators that the catalogue, the lineage queries and the versioned table are built from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import scratch


def search(rows: DataFrame, filters: Mapping[str, str | None], order: Sequence[Column] = ()) -> DataFrame:
    """Rows that equal every filter given; null or empty filters do not count. All matches, in order."""
    tests = [F.col(k) == v for k, v in filters.items() if v]
    found = rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows
    return found.orderBy(*order) if order else found


def queue(rows: DataFrame, status: str, *, column: str = "status", order: Sequence[str] = ("ingest_time",)) -> DataFrame:
    """The rows in a status, oldest first."""
    return rows.where(F.col(column) == status).orderBy(*order)


def latest(rows: DataFrame, order: Sequence[Column], limit: int = 20) -> DataFrame:
    """The first rows by a descending order."""
    return rows.orderBy(*order).limit(limit)


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """By key the columns of the row that is greatest by order. One aggregation with partial maxima: no sort, no window, and a
    hot key is reduced before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in columns])


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rows with their rank by key in the order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a global order with their place, from 1. Only one small row for each sorted partition is brought together. The
    sorted rows are written once, so that partitions are the same for rows and sizes."""
    spark, path = ordered.sparkSession, scratch(ordered.sparkSession)
    ordered.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}).write.parquet(path)
    marked = spark.read.parquet(path)
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_p", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return marked.join(F.broadcast(shifts), "_p").withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_m", "_shift")


def lookup(rows: DataFrame, table: DataFrame, key: str, columns: Mapping[str, str | None]) -> DataFrame:
    """Rows with columns of a table by key: defaults where the table has no such key. Spark broadcasts the table if it is
    under its size threshold."""
    out = rows.join(table.select(key, *columns), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in columns.items() if d is not None})


def unknown_keys(rows: DataFrame, table: DataFrame, key: str, table_key: str | None = None) -> DataFrame:
    """Rows whose key the table lacks: orphans of a reference, or new rows of an insert that ignores known keys. Null keys are
    no orphans and are left out."""
    other = table.select(F.col(table_key or key).alias("_k")).distinct()
    return rows.where(F.col(key).isNotNull()).join(other, F.col(key) == F.col("_k"), "left_anti")


def starting_with(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(F.col(column).startswith(prefix))


def duplicate_content(rows: DataFrame, content: str, key: str) -> DataFrame:
    """content_sha256, n and first_key of contents that occur more than once."""
    hashed = rows.select(F.sha2(F.col(content), 256).alias("content_sha256"), key).where("content_sha256 IS NOT NULL")
    return hashed.groupBy("content_sha256").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def column_difference(left: Sequence[str], right: Sequence[str], df: DataFrame) -> DataFrame:
    """One row for each row of df: names of left missing in right, and the reverse, in order."""
    a, b = F.array(*map(F.lit, left)), F.array(*map(F.lit, right))
    return df.select(F.sort_array(F.array_except(a, b)).alias("missing"), F.sort_array(F.array_except(b, a)).alias("extra"))
