"""Writers. Each writes a directory under Spark's commit protocol, so a failure leaves no half-written output."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> str:
    rows.write.options(header=True, quote='"', escape='"').mode("overwrite").csv(path)
    return path


def write_lines(rows: DataFrame, path: str, column: str = "line") -> str:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return path


def write_messages(rows: DataFrame, path: str, column: str = "message") -> str:
    """Messages, each ended by a blank line."""
    rows.select(F.col(column).alias("value")).write.option("lineSep", "\n\n").mode("overwrite").text(path)
    return path


def write_parquet(rows: DataFrame, path: str, *, by_source: bool = False) -> str:
    """Parquet, a folder for each source if asked for. A failure is raised; there is no silent other format."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("source") if by_source else writer).parquet(path)
    return path


_COPIES = 16  # files copied at once


def _copy(spark: SparkSession, source: str, target: str, move: bool) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = b.getFileSystem(conf)
    fs.mkdirs(b.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, fs, b, move, True, conf)
    return b.toString()


def land(spark: SparkSession, files: Sequence[tuple[str, str]]) -> list[str]:
    """Copies files (source, target) into the raw zone, many at once; the originals stay. Bytes stream through the driver's JVM:
    Spark has no writer of binary files."""
    with ThreadPoolExecutor(_COPIES) as pool:
        return list(pool.map(lambda f: _copy(spark, *f, False), files))


def quarantine(spark: SparkSession, files: Sequence[tuple[str, str]]) -> list[str]:
    """Moves failed files (source, target) and returns where they are now."""
    with ThreadPoolExecutor(_COPIES) as pool:
        return list(pool.map(lambda f: _copy(spark, *f, True), files))


def content_hashes(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """By key content_sha256, a hash of the rows as a multiset: the same for the same rows, whatever their order or their files'
    bytes. Each row's SHA-256 over its canonical JSON is cut in eight numbers; their sums and the row count are hashed
    again, so one small row for each key is shuffled by each task."""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns) if c not in keys]
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    piece = lambda i: F.conv(F.substring("_r", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.select(*keys, row.alias("_r")).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(piece(i)).alias(f"_s{i}") for i in range(8)])
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sums.columns if c not in keys])
    return sums.select(*keys, F.sha2(text, 256).alias("content_sha256"))


def content_hash(rows: DataFrame) -> str:
    """The same of all rows."""
    return content_hashes(rows).first()["content_sha256"]
