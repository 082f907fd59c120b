"""The training-data queries of __spark_entry__.py, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .common import read_table, shared_dir
from .licenses import oracle as license_sql
from .licenses import scan
from .linededup import dedup_lines
from .lm import load_vocabulary, score_documents
from .mixing import mix_copies
from .nndescent import near_duplicates
from .packing import pack_documents
from .quality import score_quality
from .simhash import hex_fingerprint, simhash_components
from .tokenio import read_tokens, write_tokens
from .tokens import default_pieces, default_tokenizer


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, read_table(spark, sf_dir, "embeddings"), k=20, query_every=20)[0]


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    got = score_quality(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out("id"))
    return got.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack_documents(spark, read_table(spark, sf_dir, "documents"), default_tokenizer())
    return got.withColumnRenamed("id", "doc_id")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = score_documents(spark, read_table(spark, sf_dir, "documents"), load_vocabulary(default_pieces()), held_out)
    return got.withColumnRenamed("id", "doc_id")


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix_copies(spark, read_table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(spark, read_table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), hex_fingerprint().alias("fingerprint"), "component_id")


def op7_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(spark, read_table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("tie").alias("text_md5"), "license", "template", "matched", "containment")


def op8_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(spark, read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text", "lines_removed")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))[0].withColumnRenamed("id", "vec_id")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex[:12]}"
    write_tokens(spark, read_table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_tokens(spark, folder, digest_only=True).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_kmeans_tree": op1_kmeans_tree,
        "op2_quality_qda": op2_quality_qda,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_lattice_lm": op4_lattice_lm,
        "op5_entropy_mixing": op5_entropy_mixing,
        "op6_simhash_bktree": op6_simhash_bktree,
        "op7_license_minhash": op7_license_minhash,
        "op8_line_suffix_array": op8_line_suffix_array,
        "op9_nn_descent": op9_nn_descent,
        "op10_token_output": op10_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_license_minhash": license_sql()}
