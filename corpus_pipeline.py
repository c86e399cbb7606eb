"""A corpus in five stages: quality, line dedup, near-duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm import decontaminate, line_dedup, mixing, quality, simhash_dedup
from zonecast.llm.shared import Scratch, bound_batches, id_key


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(quality.judge_quality(docs, labels, keep_columns=True).where("keep"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that five documents or more share (but in the one of the largest id), n_chars counted anew."""
    bound_batches(spark)
    kept = line_dedup.drop_shared_lines(docs, min_docs=5, min_chars=40, keep_columns=True)
    return _columns(kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id."""
    bound_batches(spark)
    groups = simhash_dedup.near_duplicate_groups(docs, similarity=0.8, words=5)
    gone = groups.where("not kept").select(id_key("doc_id").alias("gone"))
    return docs.join(gone, id_key("doc_id") == gone["gone"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bound_batches(spark)
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of its draws in the mix, and its place in it."""
    return mixing.mix_sources(docs, max_repetition=4.0, keep_columns=True)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Training, fingerprints, alignment and hashed permutations have no SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their draws in the mix; each stage reads what the one before it wrote to the shared folder.

    Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables and columns of its own
    names, as its operator's docstring says. Stages keep the columns of documents, the last adds its own. A null id is one document.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
