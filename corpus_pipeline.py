"""The corpus pipeline: language ID, quality, near-duplicates, decontamination, then subword encoding.

Each stage takes all documents that the stage before it kept. Columns other than doc_id and text pass through untouched,
whatever their names. Defined results: a document without a letter, or whose language is not clear, goes in the first
stage, and so do null and empty texts; of rows that repeat an id and a text one stays after the third, and unlike texts under
one id stay; rows with a null id are judged like others, but as duplicates they cannot be named and stay. An empty table
gives an empty result. Near-duplicates share four fifths of their five-word shingles or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language_id, near_dup, quality_rules, subword
from strandline.llm.common import Temporary, delete, fold, free_name, settle, settled_path, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Dictionaries are cut from three quarters of the documents."""
    small_batches(spark)
    dictionaries = language_id.learn(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return docs.where(language_id.predictor(dictionaries)("text")["accepted"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at a half or more. Rules are learned from two thirds of the labels."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold(F.col("doc_id"), 3) != 1)
    model = quality_rules.learn(docs, labels)
    return docs.where(quality_rules.score(F.col("text"), model) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. The ids to drop are as many as the
    documents allow, so they meet them in a shuffle, never in a broadcast."""
    with Temporary(spark):
        found = settle(near_dup.near_duplicates(docs.select("doc_id", "text"), near_dup.FOUR_FIFTHS), settled_path(spark))
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(dropped.hint("merge"), "doc_id", "left_anti")
    repeated = settle(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = left.join(repeated.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated.hint("merge"), "doc_id", "left_anti").unionByName(once)
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    test = decontaminate.contaminated(table(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.where(~test(F.col("text")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, the number of ids, and whether decoding gives the text again."""
    e = free_name(docs, "_e")
    with_ids = docs.withColumn(e, subword.encoder_column()("text"))
    return with_ids.select(*docs.columns, *[F.col(e)[c].alias(free_name(docs, c)) for c in subword.ENCODED.names])


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("near_dup", near_duplicates),
    ("decontaminate", decontaminated),
    ("subword", encoded),
]

#: SQL can express neither the compression, the ensemble nor the merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = settled_path(spark)
        with Temporary(spark):
            docs = settle(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
