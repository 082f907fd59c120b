"""Line dedup: repeated runs of lines, by a suffix array built with prefix doubling.

All documents' lines, in ascending order of id, form one text whose letters are
line ids. Round k sorts the suffixes that repeat by their first 2**k lines: from
the pair of round k-1's ranks, at the suffix and 2**(k-1) lines on, sorted over
all tasks. Suffixes of one pair are an interval of the suffix array whose common
prefix is 2**k lines or more; its left end is their rank, and its first place in
the text is kept with it. Suffixes alone in their interval leave, so rounds
shrink fast. An interval of any depth in between is a pair of intervals of the
power of two below, one at the suffix and one that ends the prefix.

A run of at least ``min_words`` words is deleted if the same run ends before it
starts, in an earlier document or earlier in its own; so the first copy stays
whole, also of a run that overlaps its own copy. It's enough to test, for each
line, the shortest run of that many words from it on and the shortest that ends
with it: their lengths depend on their contents alone, so copies agree on them,
and they cover exactly the lines of all longer repeated runs. Runs that overlap
join to maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, rows_of

_DOC = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("lines", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("len", pa.list_(pa.int32()))])
_RANK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n", pa.int64())])
_START = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])


def windows(words: np.ndarray, min_words: int) -> np.ndarray:
    """(start, length) of the shortest runs of ``min_words`` words from each line on and up to each line."""
    n = len(words)
    c = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    end = np.searchsorted(c, c[:-1] + min_words, "left")
    begin = np.searchsorted(c, c[1:] - min_words, "right") - 1
    ahead = np.stack([i, end - i], 1)[end <= n]
    back = np.stack([begin, i + 1 - begin], 1)[begin >= 0]
    return np.unique(np.concatenate([ahead, back]), axis=0)


def line_table(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, lines, at, len): 64-bit ids of each text's lines, stripped, and its windows; no row for null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for i, tie, body in rows_of(batches, "id", "tie", "body"):
            lines = [x.strip() for x in body.split(b"\n")]
            win = windows(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), min_words)
            ids = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64)
            out.append((i, tie, ids, win[:, 0], win[:, 1]))
            if len(out) == 2048:
                yield batch(_DOC, **dict(zip(_DOC.names, zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield batch(_DOC, **dict(zip(_DOC.names, zip(*out, strict=True), strict=True)))

    rows = keyed(docs, id_col, text_col).where(F.col(text_col).isNotNull())
    rows = rows.select("_cf_id", "_cf_tie", F.col(text_col).cast("binary")).toDF("id", "tie", "body")
    return rows.mapInArrow(run, "id long, tie long, lines array<long>, at array<int>, len array<int>").dropDuplicates(["id", "tie"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of one id and one text are one document: both columns' values key it."""
    return docs.withColumn("_cf_id", F.col(id_col).cast("long")).withColumn("_cf_tie", F.xxhash64(text_col))


def starts(scratch: Scratch, table: DataFrame) -> DataFrame:
    """(id, tie, start): the number of lines before each document, in ascending order of id (nulls first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = np.cumsum(n) + at
            yield batch(_START, id=b.column("id"), tie=b.column("tie"), n=n, part=np.full(len(n), part, np.int32), local=ends - n)
            at = int(ends[-1]) if len(ends) else at

    rows = table.select("id", "tie", F.size("lines").cast("long").alias("n"))
    done = scratch.table(rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").mapInArrow(run, "id long, tie long, n long, part int, local long"), "starts")
    before, offsets = 0, []
    for r in done.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row for each partition
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = scratch.spark.createDataFrame(offsets, "part int, offset long")
    return done.join(F.broadcast(offsets), "part").select("id", "tie", (F.col("offset") + F.col("local")).alias("start"))


def same_doc(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on (id, tie), a null id equal to itself."""
    r = right.withColumnRenamed("id", "r_id").withColumnRenamed("tie", "r_tie")
    return left.join(r, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie"))).drop("r_id", "r_tie")


def ranked(scratch: Scratch, groups: DataFrame) -> DataFrame:
    """(a, b, rank) of (a, b, n) rows: the suffixes before each interval, in the order of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for x in batches:
            n = x.column("n").to_numpy()
            ends = np.cumsum(n) + at
            yield batch(_RANK, a=x.column("a"), b=x.column("b"), part=np.full(len(n), part, np.int32), local=ends - n, n=n)
            at = int(ends[-1]) if len(ends) else at

    done = scratch.table(groups.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long, part int, local long, n long"), "ranks")
    before, offsets = 0, []
    for r in done.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row for each partition
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = scratch.spark.createDataFrame(offsets, "part int, offset long")
    return done.join(F.broadcast(offsets), "part").select("a", "b", (F.col("offset") + F.col("local")).alias("rank"))


def refine(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """(pos, end, rank) of the (pos, end, a, b) rows whose pair repeats.

    Pairs are counted before the shuffle and written, so that the join back has a
    shuffle of its own on either side and a pair of very many suffixes can be split.
    """
    groups = scratch.table(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    order = scratch.table(ranked(scratch, groups), "order")
    return scratch.table(pairs.join(order, ["a", "b"]).select("pos", "end", "rank"), "suffixes")


def repeated_runs(spark: SparkSession, scratch: Scratch, table: DataFrame) -> DataFrame:
    """(id, tie, at, len): the maximal runs of lines that have an earlier copy, of a ``line_table``."""
    begin = scratch.table(starts(scratch, table), "begin")
    placed = scratch.table(same_doc(table, begin), "placed")
    rows = placed.select("start", (F.col("start") + F.size("lines")).alias("end"), F.posexplode("lines").alias("i", "line")).select((F.col("start") + F.col("i")).alias("pos"), "end", F.col("line").alias("a"), F.lit(0).cast("long").alias("b"))
    suffixes = refine(scratch, rows)
    tests = placed.select("start", F.explode(F.arrays_zip("at", "len")).alias("w")).select("start", (F.col("start") + F.col("w.at")).alias("pos"), F.col("w.len").alias("len"))
    tests = scratch.table(tests.join(suffixes.select("pos"), "pos"), "tests")  # a run whose first line is alone is alone
    longest = tests.agg(F.max("len").alias("n")).first()["n"] or 0
    found, span = spark.createDataFrame([], "start long, at int, len int"), 1
    while span <= longest:
        a = suffixes.select("pos", F.col("rank").alias("a"))
        b = suffixes.select(F.col("pos").alias("tail"), F.col("rank").alias("b"))
        # intervals of depth len: those of depth span at the run's start and at its last span lines
        got = tests.where(F.col("len").between(span, 2 * span - 1)).join(a, "pos").withColumn("tail", F.col("pos") + F.col("len") - span).join(b, "tail")
        got = scratch.table(got.select("start", "pos", "len", "a", "b"), "depth")
        first = scratch.table(got.groupBy("len", "a", "b").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
        late = got.join(first, ["len", "a", "b"]).where(F.col("first") + F.col("len") <= F.col("pos"))
        found = found.unionByName(scratch.table(late.select("start", (F.col("pos") - F.col("start")).cast("int").alias("at"), "len"), "late"))
        scratch.drop(got, first)
        if 2 * span > longest:
            break
        pairs = suffixes.where(F.col("pos") + 2 * span <= F.col("end")).select("pos", "end", F.col("rank").alias("a"), (F.col("pos") + span).alias("tail")).join(b, "tail")
        deeper = refine(scratch, scratch.table(pairs.select("pos", "end", "a", "b"), "pairs"))
        scratch.drop(suffixes)
        suffixes, span = deeper, 2 * span
    # runs that overlap are one maximal run: at most two for each line of a document
    w = Window.partitionBy("start").orderBy("at", "len")
    seen = F.max(F.col("at") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.distinct().withColumn("new", F.coalesce((F.col("at") >= seen).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("start", "run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("len")).alias("stop"))
    return begin.join(runs, "start").select("id", "tie", "at", (F.col("stop") - F.col("at")).alias("len"))


def maximal_runs(spark: SparkSession, docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, at, len): the runs that ``dedup_lines`` deletes, by their first line's place and their length in lines."""
    scratch = Scratch(spark, "runs")
    return repeated_runs(spark, scratch, scratch.table(line_table(docs, min_words, id_col, text_col), "lines"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete each run of lines, of ``min_words`` words or more, that ends somewhere before it starts, too.

    Before is by id (nulls first), then by place in the text: of a run repeated at
    once, as of equal lines in a row, the first stays whole. Returns all columns
    of ``docs``, the text without its deleted lines, and ``lines_removed`` (a
    column of that name is replaced). Lines are compared stripped, in full. Rows
    that repeat both id and text are one document and all keep their text, or
    lose the same lines. Null texts stay null; an empty table gives no rows.
    """
    scratch = Scratch(spark, "lines")
    table = scratch.table(line_table(docs, min_words, id_col, text_col), "lines")
    runs = repeated_runs(spark, scratch, table).groupBy("id", "tie").agg(F.sort_array(F.collect_list(F.struct("at", "len"))).alias("runs"))
    runs = scratch.table(runs, "runs").toDF("_cf_rid", "_cf_rtie", "_cf_runs")
    # merged at every size: texts are shuffled once, whatever the runs' size
    joined = keyed(docs, id_col, text_col).join(runs.hint("merge"), F.col("_cf_id").eqNullSafe(F.col("_cf_rid")) & (F.col("_cf_tie") == F.col("_cf_rtie")), "left")
    lines = F.split(F.col(text_col), "\n")
    gone = lambda i: F.exists("_cf_runs", lambda r: (i >= r["at"]) & (i < r["at"] + r["len"]))
    hit = F.col("_cf_runs").isNotNull()
    joined = joined.withColumn("_cf_kept", F.when(hit, F.filter(lines, lambda x, i: ~gone(i))))
    out = joined.withColumn("lines_removed", F.when(hit, F.size(lines) - F.size("_cf_kept")).otherwise(0))
    out = out.withColumn(text_col, F.when(hit, F.array_join("_cf_kept", "\n")).otherwise(F.col(text_col)))
    return out.select(*[c for c in docs.columns if c != "lines_removed"], "lines_removed")
