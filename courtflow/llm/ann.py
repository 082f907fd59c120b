"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; leaves that still hold many rows get a
subtree of their own, fitted in a task each on a bounded sample of theirs. Every
vector is then put into a leaf. A query walks the tree with a priority queue: the
open branch with the largest bound on the inner product comes next. How many
leaves a query visits is calibrated: for some queries the true neighbours are
found by brute force, and visits widen until the leaves visited hold the wanted
share of them, among vectors with copies and among those without.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

_HIT = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


@dataclass
class Tree:
    """Inner nodes hold their children's centers; ``leaf`` is a leaf's number or -1, ``radii`` the rms distance of a node's sample to its mean."""

    centers: list[np.ndarray] = field(default_factory=list)  # (children, d) of each node
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    leaves: int = 0

    def _node(self, x: np.ndarray) -> int:
        self.centers.append(np.zeros((0, 0), np.float32))
        self.children.append([])
        self.leaf.append(-1)
        self.radii.append(float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean())) if len(x) else 0.0)
        return len(self.leaf) - 1

    def graft(self, subtrees: dict[int, Tree]) -> None:
        """Put subtrees in the place of leaves; their first leaf keeps the number, the others get new ones."""
        where = {n: i for i, n in enumerate(self.leaf) if n >= 0}
        for number, sub in sorted(subtrees.items()):
            at, shift = where[number], len(self.leaf) - 1
            renamed = [-1 if n < 0 else number if n == 0 else self.leaves + n - 1 for n in sub.leaf]
            self.centers[at], self.children[at], self.leaf[at] = sub.centers[0], [c + shift for c in sub.children[0]], renamed[0]
            self.centers += sub.centers[1:]
            self.children += [[c + shift for c in own] for own in sub.children[1:]]
            self.leaf += renamed[1:]
            self.radii += sub.radii[1:]
            self.leaves += sub.leaves - 1

    def grow(self, x: np.ndarray, branch: int, leaf_size: int, rng: np.random.Generator) -> int:
        me = self._node(x)
        if len(x) <= leaf_size or (x == x[0]).all():
            self.leaf[me], self.leaves = self.leaves, self.leaves + 1
            return me
        centers = kmeans(x, branch, rng)
        of = nearest(x, centers)
        parts = [x[of == k] for k in range(len(centers))]
        if max(map(len, parts)) == len(x):
            self.leaf[me], self.leaves = self.leaves, self.leaves + 1
            return me
        used = [k for k, p in enumerate(parts) if len(p)]
        self.centers[me] = centers[used].astype(np.float32)
        self.children[me] = [self.grow(parts[k], branch, leaf_size, rng) for k in used]
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at each level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
            elif len(at):
                of = nearest(x[at], self.centers[node])
                todo += [(c, at[of == k]) for k, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, spread: float = 0.25) -> Iterator[int]:
        """All leaves by falling bound: inner product with the center plus |q| times a share of the branch's radius.

        Members spread over all directions, so few lie a whole radius along the query's.
        """
        size = float(np.linalg.norm(q)) * spread
        heap, n = [(0.0, 0, 0)], 0
        while heap:
            _, _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            dots = (self.centers[node] @ q).tolist()
            for d, c in zip(dots, self.children[node], strict=True):
                n += 1
                heapq.heappush(heap, (-(d + size * self.radii[c]), n, c))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's steps from k-means++ seeds."""
    centers = [x[rng.integers(len(x))]]
    d = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k and d.sum() > 0:
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(1))
    c = np.array(centers)
    for _ in range(rounds):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit_tree(sample: np.ndarray, total: int, branch: int = 16, leaf_rows: int = 256, seed: int = 7) -> Tree:
    """Leaves of about ``leaf_rows`` of all ``total`` rows, but no fewer than eight sample rows each."""
    share = max(8, int(leaf_rows * len(sample) / max(total, 1)))
    tree = Tree()
    tree.grow(sample.astype(np.float64), branch, share, np.random.default_rng(seed))
    return tree


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec: array<double>): finite, not zero, without null components."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec is not null and size(vec) > 0")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad & F.exists("vec", lambda c: c != 0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _above(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of all scores that can be among a row's k best, ties included, and the raised lower bounds on the k-th best."""
    if scores.shape[1] >= k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return *np.nonzero(scores >= least[:, None]), least


def _search(batches: Iterator[pa.RecordBatch], k: int, held_hits: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows dealt by part: kind 0 has a vector of a cell, 1 a query and the cells of the part that it visits.

    Each query's best k of the part come out, merged over its cells. A bound on each
    query's k-th best rises from cell to cell, so that few others are ever held.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks().sort_by([("part", "ascending"), ("kind", "ascending"), ("cell", "ascending")])
    part, kind, cell, ids = (t.column(c).to_numpy() for c in ("part", "kind", "cell", "id"))
    vec, lists, visits = matrix(t.column("vec").combine_chunks()), t.column("ids").combine_chunks(), t.column("cells").combine_chunks()
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(part)).tolist(), strict=True):
        n = lo + int(np.searchsorted(kind[lo:hi], 1))
        if n in (lo, hi):
            continue
        own = visits.slice(n, hi - n)
        wanted = np.array(own.flatten(), np.int64)
        asks = np.repeat(np.arange(n, hi), np.array(pa.compute.list_value_length(own), np.int64))
        order = np.argsort(wanted, kind="stable")
        wanted, asks = wanted[order], asks[order]
        least = np.full(hi - n, -np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for c in np.unique(wanted):
            x, y = lo + np.searchsorted(cell[lo:n], [c, c + 1])
            mine = asks[slice(*np.searchsorted(wanted, [c, c + 1]))]
            for at in range(0, len(mine) if y > x else 0, 512):
                q = mine[at : at + 512]
                scores = vec[q] @ vec[x:y].T
                i, j, least[q - n] = _above(scores, k, least[q - n])
                hits.append((q[i], j + x, scores[i, j]))
                size += len(i)
            if size > held_hits:
                hits = [_best(hits, ids, k)]
                size = len(hits[0][0])
        if hits:
            q, pick, score = _best(hits, ids, k)
            for at in range(0, len(q), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[at : at + (1 << 14)]]), lists.take(pa.array(pick[at : at + (1 << 14)])), pa.array(score[at : at + (1 << 14)])], schema=_HIT)


def _best(hits: list, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query."""
    q, pick, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((ids[pick], -score, q))
    q, pick, score = q[order], pick[order], score[order]
    start = np.append(True, q[1:] != q[:-1])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return q[rank < k], pick[rank < k], score[rank < k]


def deepen(spark: SparkSession, indexed: DataFrame, tree: Tree, sizes: dict[int, int], leaf_rows: int, deep_rows: int, sample_rows: int) -> bool:
    """Give each leaf of over ``deep_rows`` rows a subtree, fitted in a task of its own on about ``sample_rows`` of its rows; False if there is none.

    A subtree has no more leaves than an eighth of its sample, so all of them together
    are a bounded table, whatever the number of rows.
    """
    big = {leaf: n for leaf, n in sizes.items() if n > deep_rows}
    if not big:
        return False

    def run(t: pa.Table) -> pa.Table:
        leaf, n = t.column("leaf")[0].as_py(), t.column("n")[0].as_py()
        x = matrix(t.column("vec").combine_chunks())
        sub = Tree()
        sub.grow(x, 16, max(8, leaf_rows * len(x) // n), np.random.default_rng([7, leaf]))
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(sub)], pa.binary())})

    wide = F.broadcast(spark.createDataFrame([(leaf, n) for leaf, n in big.items()], "leaf int, n long"))  # one row for each leaf of the tree
    drawn = indexed.join(wide, "leaf").where(F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")) < sample_rows).select("leaf", "n", "id", "vec")
    subs = {r["leaf"]: pickle.loads(r["tree"]) for r in drawn.groupBy("leaf").applyInArrow(run, "leaf int, tree binary").toLocalIterator()}
    tree.graft({leaf: sub for leaf, sub in subs.items() if sub.leaves > 1})
    return True


def search(
    spark: SparkSession, table: DataFrame, k: int = 20, query_every: int = 20, sample_rows: int = 20_000, leaf_rows: int = 256, recall: float = 0.97, calibrate: int = 200,
    cell_rows: int = 4096, part_rows: int = 4096, query_rows: int = 20_000, deep_sample: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
) -> tuple[DataFrame, dict]:
    """The ``k`` rows of largest inner product for each query: rows whose id is divisible by ``query_every``.

    Returns (query_id, rank, vec_id, score) and what was measured: leaves, visits
    and the calibrated recall. Ties go to the smaller id; scores are double. Equal
    vectors are one candidate with their k + 1 smallest ids (a query needs no
    more), and equal queries are searched once, so groups of copies cost one row.
    A row repeated in id and vector is one candidate, and asks as often as it is
    there. The tree is fitted on at most ``sample_rows`` rows, subtrees of leaves of
    over ``cell_rows`` rows on about ``deep_sample`` of each, and calibration takes at
    most ``calibrate`` queries without copies and as many with, against all rows: the
    recall is that of the worse of the two. Every row is indexed. A leaf still over
    ``cell_rows`` vectors is cut into cells, and a part asked by over ``query_rows``
    queries is dealt to several tasks. Null, zero and non-finite vectors and null ids
    take no part; vectors of another length than the most common one neither. An
    empty table gives no rows.
    """
    scratch = Scratch(spark, "ann")
    rows = valid_vectors(table, id_col, vec_col).where("id is not null")
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty, {"leaves": 0, "visits": 0, "recall": 1.0}
    rows = rows.where(F.size("vec") == dims["d"])
    rows = scratch.table(rows.select("id", "vec", F.xxhash64("vec").alias("h")), "rows")
    # the k + 1 smallest ids of each distinct vector; ranks are cut before the shuffle
    rank = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))
    classes = rows.distinct().withColumn("rn", rank).where(F.col("rn") <= k + 1).groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.select(F.col("ids")[0].alias("id"), "ids", "vec", "h")
    asked = rows.where(F.col("id") % query_every == 0).select("id", "h", "vec")
    classes = scratch.table(classes, "classes")
    n = classes.count()
    share = min(1.0, 1.5 * sample_rows / n)
    got = classes.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) < int(1_000_003 * share)).select("vec").limit(sample_rows).toArrow()
    sample = matrix(got.column("vec").combine_chunks())
    if len(sample) == 0:
        sample = matrix(classes.select("vec").limit(sample_rows).toArrow().column("vec").combine_chunks())
    tree = fit_tree(sample, n, leaf_rows=leaf_rows)

    def placed(df: DataFrame, name: str) -> tuple[DataFrame, dict[int, int]]:
        """Every row with its leaf, and the leaves' sizes: one number for each leaf of the bounded tree."""
        known = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("vec"))
                leaf = known.value.assign(x) if len(x) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "ids", "vec", "h")), pa.array(leaf, pa.int32())], names=["id", "ids", "vec", "h", "leaf"])

        out = scratch.table(df.select("id", "ids", "vec", "h").mapInArrow(place, "id long, ids array<long>, vec array<double>, h long, leaf int"), name)
        return out, {r["leaf"]: r["count"] for r in out.groupBy("leaf").count().collect()}

    indexed, sizes = placed(classes, "indexed")
    if deepen(spark, indexed, tree, sizes, leaf_rows, cell_rows, deep_sample):
        former = indexed
        indexed, sizes = placed(former, "deeper")
        scratch.drop(former)
    known = spark.sparkContext.broadcast(tree)  # bounded by the samples
    queries = scratch.table(asked.groupBy("h", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "h", "vec", "n"), "queries")

    # calibration: true neighbours of some queries, by blocks of rows against them. A vector's copies
    # are its neighbours and lie in one leaf, so queries with and without copies are drawn apart;
    # each weighs as often as it is asked
    kinds = queries.join(classes.select("h", "vec", (F.size("ids") > 1).alias("copied")), ["h", "vec"]).select("id", "vec", "n", "copied")
    kinds = scratch.table(kinds, "kinds")
    drawn = [kinds.where(c).orderBy(F.xxhash64("id")).limit(calibrate) for c in ("copied", "not copied")]
    probe = drawn[0].unionByName(drawn[1]).toArrow()
    weight, copied = np.array(probe.column("n"), float), np.array(probe.column("copied"), bool)
    pid, pvec = np.array(probe.column("id")), matrix(probe.column("vec").combine_chunks())
    probes = spark.sparkContext.broadcast((pid, pvec))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vecs = probes.value
        least = np.full(len(own), -np.inf)
        for b in batches:
            if not b.num_rows or not len(own):
                continue
            scores = vecs @ matrix(b.column("vec")).T
            i, j, least = _above(scores, k + 1, least)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), b.column("ids").take(pa.array(j)), pa.array(scores[i, j]), b.column("leaf").take(pa.array(j))], names=["q", "ids", "score", "leaf"])

    near = indexed.mapInArrow(brute, "q long, ids array<long>, score double, leaf int")
    first = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    near = near.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)  # cut in the tasks, before the shuffle
    truth: dict[int, list] = {}
    for r in near.select("q", "score", "leaf", F.explode("ids").alias("id")).where("q <> id").collect():  # bounded by the probes
        truth.setdefault(r["q"], []).append((-r["score"], r["id"], r["leaf"]))
    steps, weights, kind = [], [], []
    for j, q in enumerate(pid.tolist()):
        leaves = [leaf for _, _, leaf in heapq.nsmallest(k, truth.get(q, []))]
        left, order = set(leaves), {}
        for i, leaf in enumerate(tree.visits(pvec[j])):
            if leaf in left:
                order[leaf] = i
                left.discard(leaf)
                if not left:
                    break
        steps += [order[leaf] for leaf in leaves]
        weights += [weight[j]] * len(leaves)
        kind += [copied[j]] * len(leaves)
    step, w, kind = np.array(steps, int), np.array(weights), np.array(kind, bool)
    sides = [(step[kind == c], w[kind == c]) for c in (False, True) if (kind == c).any()]
    visits = 1
    for own, by in sides:
        at = np.argsort(own, kind="stable")
        widest = int(np.searchsorted(np.cumsum(by[at]) / by.sum(), min(recall, 1 - 1e-12)))
        visits = max(visits, int(own[at][min(widest, len(own) - 1)]) + 1)
    reached = min((float(by[own < visits].sum() / by.sum()) for own, by in sides), default=1.0)

    # cells of leaves; neighbouring leaves share a part, so a query's visits fall into few of them
    cuts = np.array([max(1, -(-sizes.get(i, 0) // cell_rows)) for i in range(tree.leaves)])
    first_cell = np.concatenate([[0], np.cumsum(cuts)])
    rows_of_cell = np.repeat([sizes.get(i, 0) for i in range(tree.leaves)] / cuts, cuts)
    part_of = ((np.cumsum(rows_of_cell) - rows_of_cell) // part_rows).astype(int)
    cell_of = spark.sparkContext.broadcast((first_cell, cuts, part_of))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, n_cells, parts_of = (a.tolist() for a in cell_of.value)
        for b in batches:
            x = matrix(b.column("vec"))
            for lo in range(0, len(x), 256):
                part, who, lists = [], [], []
                for j in range(lo, min(lo + 256, len(x))):
                    by: dict[int, list[int]] = {}
                    for f in islice(known.value.visits(x[j]), visits):
                        for c in range(begin[f], begin[f] + n_cells[f]):
                            by.setdefault(parts_of[c], []).append(c)
                    part += by
                    lists += by.values()
                    who += [j] * len(by)
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("id").take(take), b.column("vec").take(take), pa.array(lists, pa.list_(pa.int32()))], names=["part", "id", "vec", "cells"])

    going = scratch.table(queries.select("id", "vec").mapInArrow(visit, "part int, id long, vec array<double>, cells array<int>"), "going")
    # a part asked by very many queries is dealt to several tasks, each with all its rows
    deals = scratch.table(going.groupBy("part").agg(F.ceil(F.count("*") / query_rows).alias("deals")), "deals")
    starts = spark.createDataFrame([(i, int(first_cell[i]), int(cuts[i])) for i in range(tree.leaves)], "leaf int, first int, cuts int")
    cell = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(11)), F.col("cuts"))).cast("int")
    in_part = spark.createDataFrame([(c, int(x)) for c, x in enumerate(part_of)], "cell int, part int")
    cells = indexed.join(F.broadcast(starts), "leaf").withColumn("cell", cell).join(F.broadcast(in_part), "cell").join(deals, "part")
    cells = cells.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    asks = going.join(deals, "part").withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")))
    task = F.xxhash64("part", "deal").alias("part")
    cells = cells.select(task, "cell", F.lit(0).cast("byte").alias("kind"), "id", "ids", "vec", F.array().cast("array<int>").alias("cells"))
    asks = asks.select(task, F.lit(0).alias("cell"), F.lit(1).cast("byte").alias("kind"), "id", F.array().cast("array<long>").alias("ids"), "vec", "cells")
    tasks = int(deals.agg(F.sum("deals").alias("n")).first()["n"] or 1)
    hits = cells.unionByName(asks).repartition(tasks, "part").mapInArrow(lambda bs: _search(bs, k + 1), "q long, ids array<long>, score double")
    # a query's best k + 1 classes of each part, merged; then its own id leaves
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    merged = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    merged = merged.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    merged = scratch.table(merged, "merged").withColumnRenamed("q", "rep")
    to_rep = asked.join(queries.select("h", "vec", F.col("id").alias("rep")), ["h", "vec"]).select(F.col("id").alias("query_id"), "rep")
    flat = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("less"), i.alias("id")))))
    final = to_rep.join(merged, "rep").withColumn("all", F.slice(F.array_sort(F.filter(flat, lambda c: c["id"] != F.col("query_id"))), 1, k))
    out = final.select("query_id", F.posexplode("all").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
    scratch.drop(kinds, indexed, classes, going, deals)  # the result reads the merged hits alone
    return out, {"leaves": tree.leaves, "visits": visits, "recall": reached}
