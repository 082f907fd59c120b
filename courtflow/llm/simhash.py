"""SimHash fingerprints and near-duplicate components by BK-trees over shards.

Shards come from the pigeonhole rule: cut 64 bits into ``k`` blocks; two
fingerprints that differ in at most ``radius`` bits agree wholly on some
``k - radius`` of them. Each choice of blocks and each value on them is a shard;
every pair within the radius shares at least one, so no link is lost. ``k`` grows
with the number of distinct fingerprints (not with a cap on results), which
keeps shards small. One BK-tree is built for each shard in the task that owns
it: fingerprints of the corpus never pass through the driver, so the trees are
dealt by a shuffle instead of a driver broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, components, rows_of, with_bytes, words_of
from .nndescent import spread

_FP = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_HASH_ROWS = 1 << 16


def fingerprint(body: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text, as a signed number: a bit is 1 if set in over half of its shingles' XXH64."""
    words = words_of(body)
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    counts = np.zeros(64, np.int64)
    left = n
    while left:
        take = min(left, _HASH_ROWS)
        raw = b"".join(map(xxhash.xxh64_digest, (next(shingles) for _ in range(take)), repeat(seed)))
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        left -= take
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; null and empty texts get fingerprint 0. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fps = [], []
        for i, body in rows_of(batches, "id", "body"):
            ids.append(i)
            fps.append(fingerprint(body, shingle))
            if len(ids) == 8192:
                yield batch(_FP, id=ids, fp=fps)
                ids, fps = [], []
        if ids:
            yield batch(_FP, id=ids, fp=fps)

    return with_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose last axis holds their 64-bit words."""
    d = np.bitwise_count(a ^ b)
    return d[..., 0] if d.shape[-1] == 1 else d.sum(-1, dtype=np.uint16)


class BKTree:
    """A BK-tree over (n, words) fingerprints: children are keyed by their Hamming distance to the parent.

    Nodes of at most ``leaf`` entries are kept flat. A search takes all queries
    at once and follows, from each node, only the edges within the radius.
    """

    def __init__(self, fps: np.ndarray, leaf: int = 8):
        self.fps = fps
        self.nodes: list[tuple] = []  # (pivot, {distance: node}) or (None, entries)
        todo = [(np.arange(len(fps)), -1, 0)]
        while todo:
            idx, parent, key = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][1][key] = me
            if len(idx) <= leaf:
                self.nodes.append((None, idx))
                continue
            pivot, rest = int(idx[0]), idx[1:]
            self.nodes.append((pivot, {}))
            d = distance(fps[rest], fps[pivot])
            todo += [(rest[d == k], me, int(k)) for k in np.unique(d)]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(entry, positions of the queries within the radius of it)."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            pivot, below = self.nodes[node]
            if pivot is None:
                d = distance(queries[q][:, None], self.fps[below][None, :]) <= radius
                for j in np.flatnonzero(d.sum(0) > 0):
                    yield int(below[j]), q[d[:, j]]
                continue
            d = distance(queries[q], self.fps[pivot]).astype(np.int16)
            if len(hit := q[d <= radius]):
                yield pivot, hit
            for k, child in below.items():
                if len(near := q[np.abs(d - k) <= radius]):
                    todo.append((child, near))


def spanning_links(tree_fps: np.ndarray, query_fps: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, that span the same components as all pairs within the radius; at most one for each fingerprint.

    ``query_fps`` None searches the tree's own entries; else they follow the tree's.
    """
    own = query_fps is None
    lab = np.arange(len(tree_fps) + (0 if own else len(query_fps)))
    shift = 0 if own else len(tree_fps)
    for entry, hits in BKTree(tree_fps).search(tree_fps if own else query_fps, radius):
        if own and len(hits) == 1:
            continue  # itself
        labs = lab[hits + shift]
        mine = lab[entry]
        if (labs != mine).any():
            labs = np.unique(np.append(labs, mine))
            lab[np.isin(lab, labs)] = labs[0]
    far = np.flatnonzero(lab != np.arange(len(lab)))
    return far, lab[far]


def choose_blocks(n: int, radius: int, per_shard: int = 256) -> int:
    """Blocks k, so that n random fingerprints leave about ``per_shard`` or fewer in a shard, at the least copies."""
    for k in range(radius + 1, radius + 5):
        if n / 2 ** (64 * (k - radius) / k) <= per_shard:
            return k
    return radius + 4


def shards(classes: DataFrame, radius: int, k: int) -> DataFrame:
    """(shard, fp): each fingerprint once for each choice of k - radius of its k blocks."""
    cuts = [round(64 * i / k) for i in range(k + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    picks = [sum(masks[i] for i in c) for c in combinations(range(k), k - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in picks]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))
    return classes.select("fp", F.explode(keys).alias("shard"))


def shard_links(rows: DataFrame, radius: int, hot: int = 16384) -> DataFrame:
    """(a, b): links that span the components of (shard, node, fp) rows, by one BK-tree for each shard.

    ``fp`` is the node itself (null) or its fingerprint as bytes. A shard of over
    ``hot`` entries is cut into blocks of about that size; each pair of blocks is
    a task of its own, so no shard is gathered whole.
    """
    big = rows.groupBy("shard").count().where(F.col("count") > hot).select("shard", F.ceil(F.col("count") / hot).alias("cuts"))
    rows = rows.join(big, "shard", "left").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(7)), F.coalesce("cuts", F.lit(1))))
    rows = rows.select("shard", "node", "fp", "cut", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cuts", F.lit(1)) - 1)).alias("other"))
    pair = F.when(F.col("cut") + F.col("other") == 0, F.col("shard")).otherwise(F.xxhash64("shard", F.least("cut", "other"), F.greatest("cut", "other")))
    side = F.when(F.col("cut") == F.col("other"), 0).when(F.col("cut") < F.col("other"), 1).otherwise(2)
    rows = rows.select(pair.alias("shard"), "node", "fp", side.cast("byte").alias("side")).repartition("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("shard").to_numpy(), b.column("node").to_numpy(), _words(b.column("fp"), b.column("node")), b.column("side").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        shard, node, fp, side = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((node, side, shard))
        shard, node, fp, side = shard[order], node[order], fp[order], side[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(shard)), strict=True):
            if hi - lo < 2:
                continue
            f, s = fp[lo:hi], side[lo:hi]
            a, b = spanning_links(f, None, radius) if s[0] == 0 else spanning_links(f[s == 1], f[s == 2], radius)
            if len(a):
                out.append((node[lo:hi][a], node[lo:hi][b]))
        if out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield batch(_LINK, a=a, b=b)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _words(fp: pa.Array, node: pa.Array) -> np.ndarray:
    """(n, words) from fingerprints' bytes, or from 64-bit nodes."""
    if fp.null_count:
        return node.to_numpy().view(np.uint64)[:, None]
    return np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(fp), -1).astype(np.uint64)


def near_links(classes: DataFrame, radius: int = 4, hot: int = 16384) -> DataFrame:
    """(a, b): links between distinct 64-bit fingerprints that span all components at ``radius`` bits."""
    k = choose_blocks(classes.count(), radius)
    if comb(k, radius) >= 1000:
        raise ValueError(f"a radius of {radius} is too large for pigeonhole shards")
    rows = shards(classes, radius, k).select("shard", F.col("fp").alias("node"), F.lit(None).cast("binary").alias("fp"))
    return shard_links(rows, radius, hot)


def similar_radius(similarity: float, bits: int, deviations: float = 4.0) -> int:
    """Differing bits that sets of this Jaccard similarity stay within: the mean and ``deviations`` standard deviations.

    Indicator vectors of similarity J have a cosine of about 2J/(1+J), and each bit
    differs with the angle's share of a half turn; with a quarter more where the sets
    are small (at 0.8: four shingles against five).
    """
    p = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def band_count(similarity: float, width: int, miss: float = 1e-3) -> int:
    """Bands of ``width`` MinHash values so that sets of this similarity share none with probability ``miss`` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-min(similarity**width, 1 - 1e-12))))


def _mix(h: np.ndarray, key: int) -> np.ndarray:
    """64-bit hashes hashed again (a splitmix step)."""
    z = h + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Sketch:
    """What a set of shingle hashes is compared by before its shingles are: a 128-bit SimHash, and MinHash bands as shards.

    Bands don't widen with the corpus, so their number doesn't grow with it, and only
    texts that share shingles meet in one.
    """

    def __init__(self, similarity: float, width: int = 4):
        self.bands, self.width = band_count(similarity, width), width
        rng = np.random.default_rng(11)
        self.odd = rng.integers(0, 1 << 63, self.bands * width, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, hashes: np.ndarray, rows: int = 4096) -> tuple[bytes, list[int]]:
        if not len(hashes):
            return bytes(16), []
        h = hashes.view(np.uint64)
        counts, least = np.zeros(128, np.int64), np.full(len(self.odd), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(h), rows):
                x = h[lo : lo + rows]
                both = np.stack([_mix(x, 1), _mix(x, 2)], 1)
                counts += np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int64)
                np.minimum(least, _mix(np.multiply.outer(self.odd, x), 0).min(1), out=least)
        # of the bits that half of the shingles have, every other is set, so that small sets of an even size don't lean to zeros
        on = np.where(counts * 2 == len(h), np.arange(128) % 2, counts * 2 > len(h))
        keys = [xxhash.xxh3_64_intdigest(least[i : i + self.width].tobytes(), i) for i in range(0, len(least), self.width)]
        return np.packbits(on.astype(np.uint8)).tobytes(), [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def shingle_set(body: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    words = words_of(body)
    if not words:
        return np.zeros(0, np.int64)
    rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, rows)), np.int64))


def similar_sets(sets: list[np.ndarray], similarity: float, width: int = 4096) -> np.ndarray:
    """Which pairs of sets have that Jaccard similarity or more."""
    size = np.array([len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    of, at = np.repeat(np.arange(len(sets)), size)[shared], (np.cumsum(n > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        x, y = np.searchsorted(at, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[of[x:y], at[x:y] - lo] = 1
        both += has @ has.T
    return both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9


def verified_links(scratch: Scratch, docs: DataFrame, members: DataFrame, shingle: int, similarity: float, block: int = 256) -> DataFrame:
    """(a, b): links that span what a similarity of ``similarity`` or more connects within each proposed group.

    ``docs`` has (id, tie, body), ``members`` (root, node, m_id, m_tie). Every member is
    compared with its group's root first, which settles most groups at a cost in
    proportion to their size. Members that are not like the root are then compared,
    in blocks, with all of the group; pairs that the root links need no look.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_set(body, shingle) for (body,) in rows_of([b], "body")]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), pa.array(got, pa.list_(pa.int64()))], names=["root", "node", "parts"])

    rows = docs.join(members, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("tie") == F.col("m_tie")))
    rows = scratch.table(rows.select("root", "node", "body").mapInArrow(sets, "root long, node long, parts array<long>").dropDuplicates(["node"]), "sets")

    def like_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for lo in range(0, b.num_rows, 256):
                x, y = (b.column(c).slice(lo, 256) for c in ("parts", "center"))
                for p, q in zip(x, y, strict=True):
                    p, q = p.values.to_numpy(), q.values.to_numpy()
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    near.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), pa.array(near, pa.bool_())], names=["root", "node", "near"])

    centers = rows.where("node = root").select("root", F.col("parts").alias("center"))
    star = rows.where("node <> root").join(centers, "root").select("root", "node", "parts", "center").mapInArrow(like_root, "root long, node long, near boolean")
    star = scratch.table(star, "star")
    links = star.where("near").select(F.col("node").alias("a"), F.col("root").alias("b"))
    per = star.groupBy("root").agg(F.ceil(F.count_if(~F.col("near")) / block).alias("apart"), F.ceil((F.count_if("near") + 1) / block).alias("like")).where("apart > 0")
    if per.limit(1).count() == 0:
        return links
    left = rows.join(per, "root").join(star.where("near").select("node", F.lit(True).alias("near")), "node", "left").withColumn("near", F.coalesce("near", F.col("node") == F.col("root")))
    own = F.when(F.col("near"), F.col("apart") + F.pmod(F.xxhash64("node", F.lit(9)), F.col("like"))).otherwise(F.pmod(F.xxhash64("node", F.lit(9)), F.col("apart")))
    left = left.withColumn("cut", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("near"), F.col("apart") - 1).otherwise(F.col("apart") + F.col("like") - 1))))
    side = F.when(F.col("cut") == F.col("other"), 0).when(F.col("cut") < F.col("other"), 1).otherwise(2)
    left = left.select(F.xxhash64("root", F.least("cut", "other"), F.greatest("cut", "other")).alias("block"), side.cast("byte").alias("side"), "node", "parts")

    def compare(t: pa.Table) -> pa.Table:
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        if len(node) < 2 or side.min() == side.max() != 0:
            return _LINK.empty_table()
        hit = similar_sets([np.array(x, np.int64) for x in t.column("parts").to_pylist()], similarity)
        hit &= (side[:, None] != side[None, :]) | (side[:, None] == 0)
        root = spread(hit)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[far], "b": node[root[far]]}, schema=_LINK)

    return links.unionByName(left.groupBy("block").applyInArrow(compare, "a long, b long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their sets of word shingles of ``similarity`` or more.

    A BK-tree over 128-bit SimHashes in each shard proposes groups; shards are MinHash
    bands, of a number that depends on ``similarity`` alone (a pair at it shares none
    with probability 0.001 at most, and lies beyond the radius far less often).
    Members are then compared by their sets. Returns (id, tie, copies, keep) for each
    distinct (id, text), ``tie`` being xxhash64 of the text: keep is true for the
    smallest id of each group (null ids last). Texts of one set of shingles fold
    first; so all null, empty and blank texts, whose sets are empty, are one group.
    Texts of fewer words than a shingle are one shingle. Repeated rows are counted in
    copies; an empty table gives no rows.
    """
    scratch, sketch = Scratch(spark, "near"), Sketch(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, bands, nodes = [], [], []
            for (body,) in rows_of([b], "body"):
                parts = shingle_set(body, shingle)
                fp, band = sketch.of(parts)
                fps.append(fp)
                bands.append(band)
                nodes.append(int.from_bytes(xxhash.xxh3_64_digest(parts.tobytes()), "big", signed=True))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), pa.array(nodes, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "tie", "node", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("binary").alias("body"))
    prints = scratch.table(rows.mapInArrow(run, "id long, tie long, node long, fp binary, bands array<long>"), "prints")
    copies = prints.groupBy("id", "tie", "node").agg(F.count("*").alias("copies"))
    # a set's prints depend on the set alone
    classes = scratch.table(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("rep")), "classes")
    near = components(scratch, shard_links(classes.select(F.explode("bands").alias("shard"), "node", "fp"), similar_radius(similarity, 128)))
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    members = scratch.table(members.join(classes, "node").select("root", "node", F.col("rep.id").alias("m_id"), F.col("rep.tie").alias("m_tie")), "members")
    roots = components(scratch, scratch.table(verified_links(scratch, rows, members, shingle, similarity), "verified"))
    rooted = classes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "rep")
    best = rooted.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.id", "rep.tie")
    best = scratch.table(best.withColumn("kept", F.lit(True)).toDF("b_id", "b_tie", "kept"), "best")
    joined = copies.join(best, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("tie") == F.col("b_tie")), "left")
    return joined.select("id", "tie", "copies", F.coalesce("kept", F.lit(False)).alias("keep"))


def simhash_components(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of documents.

    Returns (id, fp, component_id) for each input row; component_id is the
    smallest id reachable by links of at most ``radius`` differing bits (null if
    no reachable row has an id). Exact copies share a fingerprint and are folded
    before any shuffle of pairs. Null and empty texts have fingerprint 0 and link
    like any other; repeated rows give repeated results; an empty table gives none.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.table(fingerprints(docs, shingle, id_col, text_col), "prints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    roots = components(scratch, near_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = scratch.table(rooted.join(least, "root").select("fp", "component_id"), "by-fp")
    return prints.join(by_fp, "fp").select("id", "fp", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))
