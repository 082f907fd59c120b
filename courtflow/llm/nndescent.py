"""Embedding near-duplicates by NN-descent on a neighbour graph.

Lists of neighbours start from small cells that random hyperplanes cut, and
improve by joins with neighbours' neighbours until few change. Only neighbours
near the threshold stay in a list. A list that is full of links (saturated) hides
the farther ones, so links are also kept apart from the lists: each cell gives
links that span its components, and the descent every link it meets. Groups are
what these links connect; a group's members are compared in blocks, so link
counts within it are exact however dense it is. Dense cells are compared in
blocks too, so a pair is only missed if no cut leaves it in one cell; cuts grow
with the logarithm of the rows, so that the chance of that stays the same.

An audit measures recall: cuts of its own, by other hyperplanes, find vectors
that do have close neighbours, whatever the graph holds; those are compared with
all rows of their label. Under the target more cells are cut, and if that doesn't
do, all pairs of a label are compared in blocks, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, components

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
_LIST = pa.schema([*_EDGE, ("span", pa.bool_())])
_PART = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))


def number(table: DataFrame, vec_col: str) -> str:
    """Vectors keep their own precision: float stays float, all else is double. Cosines are always double."""
    return "float" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "double"


def classes_of(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(node, copies, label, h, vec): the distinct valid labelled vectors, each by its smallest id."""
    v = F.col(vec_col).cast(f"array<{number(table, vec_col)}>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vec")).where("id is not null and label is not null and vec is not null and size(vec) > 0")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad & F.exists("vec", lambda c: c != 0)).withColumn("h", F.xxhash64("vec"))
    return rows.groupBy("label", "h", "vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))


def blocks(rows: DataFrame, key: str, size: int, *cols: str) -> DataFrame:
    """(block, side, node, and ``cols``): each key's rows in blocks of about ``size``, once for each pair of blocks they are in.

    side 0 rows are compared with one another; 1 with 2.
    """
    big = rows.groupBy(key).count().where(F.col("count") > size).select(key, F.ceil(F.col("count") / size).alias("cuts"))
    n = F.coalesce("cuts", F.lit(1).cast("long"))
    rows = rows.join(big, key, "left").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(9)), n))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    side = F.when(F.col("cut") == F.col("other"), 0).when(F.col("cut") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64(key, F.least("cut", "other"), F.greatest("cut", "other")).alias("block"), side.cast("byte").alias("side"), "node", *cols)


def groups(batches: Iterator[pa.RecordBatch], key: str, *by: str) -> Iterator[pa.Table]:
    """The rows of a task, one Arrow table for each value of ``key`` with two rows or more."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks().sort_by([(k, "ascending") for k in (key, *by, "node")])
    keys = t.column(key).to_numpy()
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist(), strict=True):
        if hi - lo > 1:
            yield t.slice(lo, hi - lo)


def cell_bits(n: int) -> int:
    """Hyperplanes for cells of about 128 of ``n`` rows."""
    return int(np.clip(np.ceil(np.log2(max(n, 2) / 128)), 1, 40))


def rounds_for(n: int, threshold: float, miss: float = 0.005) -> int:
    """Cuts so that a pair of cosine ``threshold`` shares no cell with probability ``miss`` at most."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** cell_bits(n)
    return int(np.ceil(np.log(miss) / np.log1p(-min(together, 1 - 1e-9))))


def first_lists(classes: DataFrame, n: int, rounds: range, k: int, floor: float, threshold: float, cell: int = 512) -> DataFrame:
    """(u, v, sim, span): each vector's best ``k`` of its cell (none for 0), for several cuts by random hyperplanes.

    Rows with span are links of ``threshold`` or more that connect all that the
    cell's links connect, however many better neighbours a vector has there.
    Cells of over 2 * ``cell`` rows are compared in blocks; lists start from a
    row's own block.
    """
    bits = cell_bits(n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = pa.compute.list_value_length(b.column("vec")).to_numpy()
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                x = _matrix(part.column("vec"))
                for t in rounds:
                    planes = np.random.default_rng([t, int(d)]).normal(size=(int(d), bits))
                    code = ((x @ planes) > 0).astype(np.int64) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code), pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), d, np.int32)), *(part.column(c) for c in ("label", "node", "copies", "vec"))],
                        names=["code", "t", "d", "label", "node", "copies", "vec"],
                    )

    kind, vec = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    cells = classes.select("label", "node", "copies", "vec").mapInArrow(cut, f"code long, t int, d int, label {kind}, node long, copies long, vec {vec}")
    cells = cells.withColumn("cell", F.xxhash64("label", "d", "t", "code"))
    cells = blocks(cells, "cell", 2 * cell, "vec")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "block", "side"):
            x, node, side = _matrix(g.column("vec")), g.column("node").to_numpy(), g.column("side").to_numpy()
            if side[0] == side[-1] != 0:
                continue
            sims = cosines(x, x)
            np.fill_diagonal(sims, -2)
            if side[0]:
                sims[side[:, None] == side[None, :]] = -2
            if sims.max() < floor:
                continue
            if not side[0] and k:
                take = min(k, len(node) - 1)
                near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                s = np.take_along_axis(sims, near, 1)
                u, j = np.nonzero(s >= floor)
                yield batch(_LIST, u=node[u], v=node[near[u, j]], sim=s[u, j], span=np.zeros(len(u), bool))
            hit = sims >= threshold
            linked = np.flatnonzero(hit.any(1))
            root = spread(hit[np.ix_(linked, linked)])
            far = np.flatnonzero(root != np.arange(len(root)))
            yield batch(_LIST, u=node[linked[far]], v=node[linked[root[far]]], sim=np.full(len(far), threshold), span=np.ones(len(far), bool))

    return cells.repartition("block").mapInArrow(best, "u long, v long, sim double, span boolean")


def keep_best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest, cut in the tasks before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.dropDuplicates(["u", "v"]).withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


def descend(scratch: Scratch, classes: DataFrame, graph: DataFrame, k: int, floor: float, threshold: float, rounds: int = 6, still: float = 0.01) -> tuple[DataFrame, list[DataFrame]]:
    """Refine lists: whoever shares a neighbour is compared, until under ``still`` of the entries are new.

    Returns the lists and, as tables (u, v), all links met, also those that no list has room for.
    """
    graph = scratch.table(keep_best(graph, k), "graph")
    size, links = graph.count(), []
    for _ in range(rounds):
        if not size:
            break
        both = keep_best(graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")), k)
        a, b = both.select(F.col("u").alias("w"), F.col("v").alias("u")), both.select(F.col("u").alias("w"), "v")
        pairs = a.join(b, "w").where("u < v").select("u", "v").distinct()
        known = graph.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = pairs.join(known, ["u", "v"], "left_anti")
        vec = classes.select("node", "vec")
        pairs = pairs.join(vec.toDF("u", "x"), "u").join(vec.toDF("v", "y"), "v")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                size = pa.compute.list_value_length(b.column("x")).to_numpy()
                for d in np.unique(size):
                    part = b.filter(pa.array(size == d))
                    x, y = _matrix(part.column("x")), _matrix(part.column("y"))
                    s = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    hit = s >= floor
                    u, v, s = part.column("u").to_numpy()[hit], part.column("v").to_numpy()[hit], s[hit]
                    yield batch(_EDGE, u=np.append(u, v), v=np.append(v, u), sim=np.append(s, s))

        new = scratch.table(pairs.select("u", "v", "x", "y").mapInArrow(compare, "u long, v long, sim double"), "new")
        wider = scratch.table(keep_best(graph.unionByName(new), k), "graph")
        links.append(scratch.table(new.where((F.col("u") < F.col("v")) & (F.col("sim") >= threshold)).select("u", "v"), "links"))
        fresh = wider.join(graph, ["u", "v"], "left_anti").count()
        scratch.drop(graph, new)
        graph = wider
        if fresh <= still * size:
            break
        size = wider.count()
    return graph, links


def count_links(scratch: Scratch, classes: DataFrame, graph: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(node, links, root) parts: links within each connected group of the graph, all its pairs compared in blocks.

    A part has the copies a node links to in one pair of blocks, and a node of
    its component there.
    """
    roots = scratch.table(components(scratch, graph.select(F.col("u").alias("a"), F.col("v").alias("b"))), "groups")
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return links_within(classes.join(member, "node").select("root", "node", "copies", "vec"), threshold, block)


def links_within(rows: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(node, links, root) parts of all pairs of each root of (root, node, copies, vec)."""
    rows = blocks(rows, "root", block, "copies", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "block", "side"):
            x, node, n, side = _matrix(g.column("vec")), *(g.column(c).to_numpy() for c in ("node", "copies", "side"))
            if side[0] == 0:
                hit = cosines(x, x) >= threshold
                np.fill_diagonal(hit, False)
                yield batch(_PART, node=node, links=hit @ n, root=node[spread(hit)])
            elif side[0] != side[-1]:
                a, b = side == 1, side == 2
                part = cosines(x[a], x[b]) >= threshold
                hit = np.zeros((len(node), len(node)), bool)
                hit[np.ix_(a, b)], hit[np.ix_(b, a)] = part, part.T
                yield batch(_PART, node=node, links=hit @ n, root=node[spread(hit)])

    return rows.repartition("block").mapInArrow(compare, "node long, links long, root long")


def spread(hit: np.ndarray) -> np.ndarray:
    """The smallest position connected to each, by a symmetric link matrix."""
    lab = np.full(len(hit), -1)
    for i in range(len(hit)):
        if lab[i] >= 0:
            continue
        front = np.zeros(len(hit), bool)
        front[i] = True
        while front.any():
            lab[front] = i
            front = hit[front].any(0) & (lab < 0)
    return lab


def close_vectors(scratch: Scratch, classes: DataFrame, n: int, threshold: float, linked: int, first_cut: int) -> DataFrame:
    """(node): some vectors that have a link, found by cuts of their own.

    Two cuts first, then as many as find all but one pair in two hundred: only a
    table with hardly any link needs those.
    """
    most = rounds_for(n, threshold)
    for cuts in (range(first_cut, first_cut + min(2, most)), range(first_cut + 2, first_cut + most)):
        spans = first_lists(classes, n, cuts, 0, threshold, threshold).where("span")
        near = scratch.table(spans.select("u").union(spans.select("v")).toDF("node").distinct(), "near")
        if near.limit(linked).count() == linked:
            break
    return near


def audit(spark: SparkSession, classes: DataFrame, counts: DataFrame, threshold: float, probes: int = 200, linked: int = 200, first_cut: int = 1 << 20) -> float:
    """The share of true links that were counted, for three bounded samples of vectors compared with all rows of their label.

    ``linked`` vectors that cuts of the audit's own show to have a link, as many of
    those with counted links, and ``probes`` of all. The lower of the share of links
    and its mean over vectors, in which a pair weighs as much as a dense group; 1
    where none of them has a link, which says that the table has next to none.
    """
    near = close_vectors(Scratch(spark, "audit"), classes, classes.count(), threshold, linked, first_cut)
    draw = lambda t, m: t.select("node", F.col("label").cast("string").alias("label"), "vec").orderBy(F.xxhash64("node", F.lit(13))).limit(m)
    half = draw(classes, probes).unionByName(draw(classes.join(near, "node", "left_semi"), linked)).unionByName(draw(classes.join(counts.where("links > 0"), "node", "left_semi"), linked)).dropDuplicates(["node"]).toArrow()
    node, label = np.array(half.column("node")), np.array(half.column("label"))
    vecs = [np.array(v, float) for v in half.column("vec").to_pylist()]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(node), np.int64)
        for b in batches:
            size = pa.compute.list_value_length(b.column("vec")).to_numpy()
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                x, n, of, own = _matrix(part.column("vec")), part.column("copies").to_numpy(), np.array(part.column("label")), part.column("node").to_numpy()
                at = [i for i, v in enumerate(vecs) if len(v) == d]
                if at:
                    hit = (cosines(np.array([vecs[i] for i in at]), x) >= threshold) & (label[at][:, None] == of[None, :]) & (node[at][:, None] != own[None, :])
                    total[at] += hit @ n
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "want"])

    want = {r["node"]: r["want"] for r in classes.select("node", "copies", F.col("label").cast("string").alias("label"), "vec").mapInArrow(brute, "node long, want long").groupBy("node").agg(F.sum("want").alias("want")).collect()}
    got = {r["node"]: r["links"] for r in counts.where(F.col("node").isin([int(i) for i in node])).collect()} if len(node) else {}
    total = sum(want.values())
    if not total:
        return 1.0
    share = {i: min(got.get(i, 0), w) / w for i, w in want.items() if w}
    return min(sum(share[i] * want[i] for i in share) / total, sum(share.values()) / len(share))


def near_duplicates(
    spark: SparkSession, table: DataFrame, threshold: float = 0.98, k: int = 12, slack: float = 0.03, recall: float = 0.99, first_rounds: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, dict]:
    """Links of cosine ``threshold`` or more between vectors of one label.

    Returns (id, n_links, component_id, kept) for each row of ``table``, and the
    audited recall, which is ``recall`` or more. Equal vectors of a label are one node with a count. Vectors
    null, zero, non-finite or with null components, and rows without id or label,
    link with nothing; vectors of different lengths neither. Rows that repeat an
    id count as vectors of their own. Where the audit finds under ``recall`` of
    the links, twice as many first cells are cut and the graph refined again; where
    that doesn't do either, all pairs of a label are compared, exact at the cost of
    the square of a label. An empty table gives no rows.
    """
    scratch = Scratch(spark, "nn")
    classes = scratch.table(classes_of(table, id_col, vec_col, label_col), "classes")
    n, floor = classes.count(), threshold - slack
    graph, spans, done, reached, total = None, [], 0, 0.0, max(first_rounds, rounds_for(n, threshold))
    for attempt in range(3):
        cells = scratch.table(first_lists(classes, n, range(done, total), k, floor, threshold), "cells")
        lists = cells.where("not span").drop("span")
        graph, links = descend(scratch, classes, lists if graph is None else graph.unionByName(lists), k, floor, threshold)
        spans += [cells.where("span").select("u", "v"), *links]
        edges = graph.where(F.col("sim") >= threshold).select("u", "v")  # nearer neighbours than links only guide the descent
        for s in spans:
            edges = edges.unionByName(s)
        parts = scratch.table(count_links(scratch, classes, edges, threshold), "parts")
        counts = scratch.table(parts.groupBy("node").agg(F.sum("links").alias("links")), "counts")
        reached = audit(spark, classes, counts, threshold, first_cut=(attempt + 1) << 20)  # other cuts each time
        if reached >= recall:
            break
        done, total = total, 2 * total
    else:
        whole = classes.select(F.xxhash64("label", F.size("vec")).alias("root"), "node", "copies", "vec")
        parts = scratch.table(links_within(whole, threshold), "parts")
        counts, reached = scratch.table(parts.groupBy("node").agg(F.sum("links").alias("links")), "counts"), 1.0
    roots = components(scratch, parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "node", "left").join(roots, "node", "left")
    known = scratch.table(known.select("label", "h", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")), "known")
    # ids that can't link have no class: a left join on keys that are null for them
    v = F.col(vec_col).cast(f"array<{number(table, vec_col)}>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vec")).withColumn("h", F.xxhash64("vec"))
    alone = F.when(F.col("id").isNull(), None)
    rows = rows.withColumn("h", F.when(F.col("id").isNotNull(), F.col("h")))
    out = rows.join(known, ["label", "h", "vec"], "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", alone.otherwise(F.col("id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), {"recall": reached, "rounds": total}
