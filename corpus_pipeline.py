"""From raw documents to packed training sequences; each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm.common import Scratch, read_table
from courtflow.llm.linededup import dedup_lines
from courtflow.llm.mixing import apply_mix
from courtflow.llm.packing import pack_documents
from courtflow.llm.quality import keep_quality
from courtflow.llm.simhash import near_duplicates
from courtflow.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(spark, docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which nothing else is left."""
    out = dedup_lines(spark, docs).where("lines_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    groups = Scratch(spark, "groups").table(near_duplicates(spark, docs).toDF("_cf_gid", "_cf_gtie", "_cf_copies", "_cf_keep"), "groups")
    key = F.col("_cf_id").eqNullSafe(F.col("_cf_gid")) & (F.col("_cf_tie") == F.col("_cf_gtie"))
    rows = docs.withColumn("_cf_id", F.col("doc_id").cast("long")).withColumn("_cf_tie", F.xxhash64("text"))
    rows = rows.join(groups.where("_cf_keep").hint("merge"), key, "left_semi")
    if groups.where("_cf_keep and _cf_copies > 1").limit(1).count():  # rows that repeat id and text
        rows = rows.dropDuplicates(["_cf_id", "_cf_tie"])
    return rows.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return apply_mix(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return pack_documents(spark, docs, default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Neither the discriminant, nor the tilt, nor the packing can be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
