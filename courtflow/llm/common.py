"""What the training-data operators share: scratch tables, word rules, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="courtflow-")
    return _OWN_DIRS[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs a re-read, not a recompute.

    ``table`` writes and reads back; ``drop`` deletes what later steps no longer
    need. Tables that a returned DataFrame still reads stay until the caller
    empties the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, the text as UTF-8 bytes; a null text stays null. Any other column is left behind."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))


def rows_of(batches: Iterable[pa.RecordBatch], *cols: str, size: int = 512) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, converted a few hundred at a time to bound memory."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            yield from zip(*(part.column(c).to_pylist() for c in cols), strict=True)


def words_of(body: bytes | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of bytes other than space and \\t\\n\\v\\f\\r (so: [^\\x20\\x09-\\x0D]+)."""
    return body.lower().split() if body else []


#: The same word rule for Spark's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) by alternating large-star and small-star steps.

    Returns (node, root): one row for each node that is not the smallest of its
    component; the smallest is the root. Minima are aggregated before the shuffle
    and written before they are joined back, so that the join can split a hub.
    """

    def sizes(t: DataFrame) -> tuple:
        r = t.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        return (r["n"], r["h"])

    cur = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = sizes(cur)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "large")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = sizes(new)
        scratch.drop(cur, large, least, low)
        cur = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
