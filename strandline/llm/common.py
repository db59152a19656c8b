"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from strandline.session import shared_dir

#: The white space that separates words in every operator: space and the controls 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on the session hands Python workers at most so many rows at once, so that whole texts stay in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns, clashing names included, are never read. Batches are made small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def fold(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def thinned(key: Column, want: int, total: int | Column) -> Column:
    """True for about twice as many rows as wanted of so many, by the key's hash; for all where they are few. What a bounded
    sample is then cut from stays small however many rows there are."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) * (total if isinstance(total, Column) else F.lit(total)) < F.lit(2 << 30) * F.lit(want)


class Temporary:
    """What was settled and held for the work in hand, to be freed when its result is written. Within the block settle() and hold()
    register what they make; at its end all of it is freed. Blocks may be nested: the innermost counts."""

    _open: ClassVar[list[Temporary]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.held = spark, [], []

    def __enter__(self) -> Temporary:
        self._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._open.remove(self)
        for df in self.held:
            df.unpersist()
        for path in self.paths:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: a cut lineage that survives lost executors. A path that is
    given is the caller's to delete."""
    spark = df.sparkSession
    if path is None:
        path = settled_path(spark)
        if Temporary._open:
            Temporary._open[-1].paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"


def hold(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks once made. Its lineage stays: what a lost executor held is made again. For tables
    that are read a few times soon; where lineage must be cut, settle() is used."""
    df = df.persist(StorageLevel.DISK_ONLY)
    if Temporary._open:
        Temporary._open[-1].held.append(df)
    return df


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
