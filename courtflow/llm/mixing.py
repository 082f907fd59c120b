"""Mixing sources to target weights by entropy balancing.

Find document rates r as close as possible, in relative entropy, to one copy
each, so that every source's taken tokens meet its target and no rate passes the
cap. The solution tilts exponentially: r = min(cap, exp(lambda * size / mean)),
with one multiplier for each source, found by Newton steps on the convex dual.
Rates are then rounded to whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch

_STEP = pa.schema([("k", pa.int32()), ("f", pa.float64()), ("g", pa.float64())])

_FAR = 1e6  #: a multiplier that puts every rate at its bound


def word_count(text: str) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+ in a text; 0 for null and empty."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def code_point_order(names: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def capped_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Share the total of all sizes by weight; what passes ``cap`` times a source's size goes to the others by weight."""
    left, targets = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in over]
    return targets


@dataclass
class Mix:
    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    means: np.ndarray
    lam: np.ndarray
    cap: float

    def rates(self, k: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.minimum(self.cap, np.exp(np.minimum(self.lam[k] * size / self.means[k], 50)))


def solve(spark: SparkSession, histogram: DataFrame, mix: Mix, tol: float = 1e-10, rounds: int = 100) -> np.ndarray:
    """Newton on the dual: each step sums taken tokens and their slope over (k, size, n) in the tasks.

    The dual's gradient rises with the multiplier, so a step that leaves the
    bracket known so far is replaced by its middle. Two numbers for each source
    reach the driver.
    """
    n = len(mix.names)
    lam, lo, hi = np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf)
    target, size = np.array(mix.targets), np.array(mix.sizes, float)
    full = target >= mix.cap * size * (1 - 1e-12)  # all copies are wanted
    lam[full] = _FAR
    lam[target <= 0] = -_FAR
    done = full | (target <= 0)
    for _ in range(rounds):
        if done.all():
            break
        at = np.where(done, 0.0, lam)

        def run(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            f, g = np.zeros(n), np.zeros(n)
            for b in batches:
                k, s, c = (b.column(x).to_numpy() for x in ("k", "size", "n"))
                r = np.exp(np.minimum(at[k] * s / mix.means[k], 50))
                f += np.bincount(k, c * s * np.minimum(r, mix.cap), n)
                g += np.bincount(k, c * s * np.where(r < mix.cap, r, 0) * s / mix.means[k], n)
            seen = np.flatnonzero(f + g)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(f[seen]), pa.array(g[seen])], schema=_STEP)

        f, g = np.zeros(n), np.zeros(n)
        for r in histogram.mapInArrow(run, "k int, f double, g double").groupBy("k").agg(F.sum("f").alias("f"), F.sum("g").alias("g")).collect():
            f[r["k"]], g[r["k"]] = r["f"], r["g"]
        done |= np.abs(f - target) <= tol * np.maximum(target, 1)
        lo, hi = np.where(f < target, np.maximum(lo, at), lo), np.where(f >= target, np.minimum(hi, at), hi)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = at + np.log(target / f) * f / g  # Newton on the logarithm: nearly straight for tilts
            middle = np.where(np.isinf(hi), np.maximum(1.0, 2 * lo), np.where(np.isinf(lo), np.minimum(-1.0, 2 * hi), (lo + hi) / 2))
        bad = ~np.isfinite(step) | (step <= lo) | (step >= hi)
        done |= (hi - lo) <= 1e-15 * np.maximum(1.0, np.abs(at))
        lam = np.where(done, lam, np.where(bad, middle, step))
    return lam


def round_rates(size: np.ndarray, rate: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Whole copies whose taken tokens end within about the shortest text of ``target``.

    Longest first, each rate goes to its floor or ceiling and passes on what it
    owes. If one huge text leaves more open than the others' fractions can take,
    further rounds move others by a copy, within 0 and ``cap``.
    """
    low = np.minimum(np.floor(rate + 1e-9).astype(np.int64), cap)
    copies, want = low.copy(), size * rate
    owed = target - float(want.sum())  # what the rates themselves leave open
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0].tolist()
    for i in order:
        owed += want[i] - size[i] * low[i]
        if low[i] < cap and rate[i] > low[i] and owed >= size[i] / 2:
            copies[i] += 1
            owed -= size[i]
    for _ in range(cap):
        before = owed
        for i in order:
            if owed > size[i] / 2 and copies[i] < cap:
                copies[i] += 1
                owed -= size[i]
            elif -owed > size[i] / 2 and copies[i] > 0:
                copies[i] -= 1
                owed += size[i]
        if owed == before:
            break
    return copies


def mix_copies(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, shard_rows: int = 5_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies of each document that mix the sources to target weights.

    Returns (id, tie, size, source, source_size, target, copies, taken), one row for
    each input row (``tie``: xxhash64 of source and text): sizes in words, ``copies`` from 0 to ``cap``. Sources take the
    weights in code-point order, repeated, null last; targets above ``cap`` times
    a source's size are cut and the rest reshared. Documents are rounded in shards
    by a hash of id and text, so reruns agree and a large source is many tasks.
    Rows without words take nothing; an empty table gives no rows. The number of
    sources is a bounded dimension that the driver holds.
    """
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(source_col, text_col).alias("tie"))
    rows = scratch.table(rows, "sizes")
    by = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    names = code_point_order(list(by))
    sizes = [by[s]["size"] for s in names]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], cap)
    means = np.array([max(1.0, by[s]["size"] / by[s]["n"]) for s in names])
    mix = Mix(names, sizes, targets, means, np.zeros(len(names)), float(cap))
    shards = [max(1, -(-by[s]["n"] // shard_rows)) for s in names]
    plan = spark.createDataFrame(
        [(k, s, sizes[k], targets[k], shards[k]) for k, s in enumerate(names)], "k int, source string, source_size long, target double, shards int"
    )
    plan = F.broadcast(plan)  # one row for each source
    keyed = rows.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    histogram = scratch.table(keyed.where("size > 0").groupBy("k", "size").agg(F.count("*").alias("n")), "histogram")
    mix.lam = solve(spark, histogram, mix)
    shared, wanted = np.array(targets), np.array(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        got = pa.Table.from_batches(held).sort_by([("k", "ascending"), ("shard", "ascending"), ("size", "descending"), ("tie", "ascending"), ("id", "ascending")])
        k, shard, size = (got.column(x).to_numpy() for x in ("k", "shard", "size"))
        copies = np.zeros(len(k), np.int64)
        cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(shard) != 0)) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(k)).tolist(), strict=True):
            rate = mix.rates(k[a:b], size[a:b].astype(float))
            # a shard owes its own rates' tokens; only a source in one shard can aim at the target itself
            aim = shared[k[a]] if wanted[k[a]] == 1 else float((size[a:b] * rate).sum())
            copies[a:b] = round_rates(size[a:b], rate, aim, cap)
        out = got.select(["id", "tie", "k", "size"]).append_column("copies", pa.array(copies.astype(np.int32)))
        yield from out.combine_chunks().to_batches(max_chunksize=16384)

    # rows that repeat in full are numbered, so that they fall into all shards
    alike = keyed.groupBy("id", "tie", "k", "size", "shards").agg(F.count("*").alias("rows")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    dealt = alike.withColumn("shard", F.pmod(F.xxhash64("id", "tie", "i", F.lit(5)), F.col("shards")).cast("int")).select("id", "k", "shard", "size", "tie").repartition("k", "shard")
    taken = dealt.mapInArrow(run, "id long, tie long, k int, size long, copies int")
    return taken.join(plan, "k").select("id", "tie", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as ``mix_copies`` takes it; rows that repeat in full share their copies.

    Null and empty texts hold no words and are left out; an empty table gives no rows.
    """
    copies = mix_copies(spark, docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    one = copies.groupBy("id", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).toDF("_cf_cid", "_cf_ctie", "_cf_copies", "_cf_rows")
    one = Scratch(spark, "mixed").table(one.where("_cf_copies > 0"), "copies")
    rows = docs.withColumn("_cf_id", F.col(id_col).cast("long")).withColumn("_cf_tie", F.xxhash64(source_col, text_col))
    rows = rows.join(one.hint("merge"), F.col("_cf_id").eqNullSafe(F.col("_cf_cid")) & (F.col("_cf_tie") == F.col("_cf_ctie")))
    if one.where("_cf_rows > 1").limit(1).count():
        # of rows that repeat in full, the first by an arbitrary but complete order takes all copies
        rows = rows.dropDuplicates(["_cf_id", "_cf_tie"])
    return rows.withColumn("_cf_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_cf_copies")))).select(*docs.columns)
