"""Readers of raw files. Every row carries the file it came from; nothing is inferred."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import base_name, strip

_FILE, _BLOCK, _ID = "_file", "_block", "_id"


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, not of its sub-folders: path, name, length and modification time; empty if there is none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    if not exists(spark, path):
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").load(path)
    return found.select("path", base_name(F.col("path")).alias("name"), "length", "modificationTime")


#: Files up to this size are hashed whole by tasks; larger ones, which no row can hold, as streams by the driver's JVM.
WHOLE_BYTES = 256 << 20
_HEAD_THREADS = 16


def hashes(spark: SparkSession, paths: Sequence[str] | str, *, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path and SHA-256 of the bytes of each file, of any size."""
    found = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    small = found.where(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    large = [r["path"] for r in found.where(F.col("length") > whole_bytes).select("path").collect()]
    if not large:
        return small
    with ThreadPoolExecutor(_HEAD_THREADS) as pool:
        rows = list(zip(large, pool.map(lambda p: _streamed_hash(spark, p), large), strict=True))
    return small.unionByName(spark.createDataFrame(rows, "path string, sha256 string"))


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)


def _streamed_hash(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(_open(spark, path), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
    return bytes(digest.digest()).hex()


def first_lines(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The first line of each file that is not blank, with the lines after it that a quoted cell runs into; empty for an empty
    file. Only the heads of the files are read, many at once, without a job."""
    jvm = spark.sparkContext._jvm

    def head(path: str) -> str:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(_open(spark, path), "UTF-8"))
        try:
            out, line = "", reader.readLine()
            while line is not None and (not (out + line).strip() or (out + line).count('"') % 2):
                out, line = (out + line + "\n") if (out + line).strip() else "", reader.readLine()
            return out + (line or "")
        finally:
            reader.close()

    with ThreadPoolExecutor(_HEAD_THREADS) as pool:
        return list(pool.map(head, paths))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({_FILE: F.col("_metadata.file_path"), _BLOCK: F.col("_metadata.file_block_start"), _ID: F.monotonically_increasing_id()})


def _numbered(df: DataFrame) -> DataFrame:
    """row_no within each file: the place in the file's block, after the rows of the blocks before. Only one small row for
    each block is shuffled, never the rows."""
    blocks = df.groupBy(_FILE, _BLOCK).agg(F.min(_ID).alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(_FILE, _BLOCK, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    out = df.join(blocks, [_FILE, _BLOCK]).withColumn("row_no", F.col(_ID) + F.col("_shift"))
    return out.withColumnRenamed(_FILE, "file").drop(_BLOCK, _ID, "_shift")


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """The column names in the first line of each file. Names that are empty or repeat are left to Spark to make unlike."""
    out = []
    for path, line in zip(paths, first_lines(spark, paths), strict=True):
        names = next(csv.reader([line.removeprefix("\ufeff")], strict=False), [])
        if not names or "" in names or len({n.lower() for n in names}) < len(names) or "\n" in line:
            names = csv_header(spark, path)
        out.append(names)
    return out


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names in a file's first line, as Spark reads them."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).columns


def read_csv(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """Rows of text columns by header, with file, row_no and malformed (more or fewer cells than the header).

    Quoted cells may hold commas, doubled quotes and line ends; blank lines are skipped. Short rows keep their cells,
    nulls after them."""
    header = list(header) if header is not None else csv_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_raw"]])
    reader = spark.read.schema(schema).options(
        header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_raw"
    )
    rows = _numbered(_marked(reader.csv(path)))
    # Spark refuses to read the raw record alone, so the flag leans on a cell as well.
    read = F.coalesce(F.length(F.col(f"`{header[0]}`")), F.lit(0)) >= 0
    return rows.withColumn("malformed", F.col("_raw").isNotNull() & read).drop("_raw")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, row_no (of the physical line) and line of text files; blank lines are counted, then skipped."""
    rows = _numbered(_marked(spark.read.text(path)))
    return rows.where(F.length(strip(F.col("value"))) > 0).select("file", "row_no", F.col("value").alias("line"))


def split_messages(text: Column) -> Column:
    """Messages of a file: blocks parted by blank lines, stripped, empty ones dropped. All line ends count."""
    plain = F.regexp_replace(text, r"\r\n|\r", "\n")
    return F.filter(F.transform(F.split(plain, "\n\n"), strip), lambda m: m != "")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """file, row_no (among the messages kept, from 1) and message. Files are split between tasks at empty LF lines, each piece
    then at blank lines of any line end; only a file without a single empty LF line is held whole by a task."""
    pieces = spark.read.option("lineSep", "\n\n").text(path)
    pieces = pieces.withColumns({_FILE: F.col("_metadata.file_path"), _BLOCK: F.col("_metadata.file_block_start")})
    rows = pieces.select(_FILE, _BLOCK, F.explode(split_messages(F.col("value"))).alias("message"))
    rows = _numbered(rows.withColumn(_ID, F.monotonically_increasing_id()))
    return rows.select("file", F.col("row_no").cast("long").alias("row_no"), "message")


def object_columns(rows: DataFrame, columns: Sequence[str], line: str = "line") -> DataFrame:
    """Text columns of JSON objects, values kept as written ("007" stays so); null where a key is absent."""
    m = F.from_json(F.col(line), "map<string,string>")
    kept = [c for c in rows.columns if c != line]
    return rows.withColumn("_m", m).select(*kept, *[F.element_at("_m", F.lit(c)).alias(c) for c in columns])


MESSAGES, CSV, LINES = "hl7", "csv", "jsonl"


def kind_of(source_type: str | None, head: str) -> str:
    """The format of a file by its declared type; where the type is none that is known, by its first line: a JSON object, or
    else a header of several columns. Anything else is an error."""
    kind = (source_type or "").lower()
    if kind in ("hl7", "hl7v2"):
        return MESSAGES
    if kind in (CSV, LINES):
        return kind
    try:
        if isinstance(json.loads(head), dict):
            return LINES
    except ValueError:
        pass
    if len(next(csv.reader([head]), [])) > 1:
        return CSV
    raise ValueError(f"unknown source type {source_type!r}, and the file is neither CSV nor JSON Lines")


def read_source(spark: SparkSession, source_type: str | None, path: str) -> DataFrame:
    """Rows of a file by kind_of()."""
    kind = kind_of(source_type, first_lines(spark, [path])[0])
    return {MESSAGES: read_messages, CSV: read_csv, LINES: read_lines}[kind](spark, path)
