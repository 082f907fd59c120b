"""A regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import Scratch, rows_of

#: Byte classes whose shares are statistics.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|\\/_<>[]{}",
    "symbol": b"#$%&*+=@^~`",
    "quote": b"\"'()-",
    "line": b"\n",
}
_OF_BYTE = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes)] = _k
FEATURES = ("log_words", "log_bytes_a_word", "sd_word", *_CLASSES, "long_words", "mark_words", "upper_words", "distinct_words", "top_word", "same_next", "distinct_pairs", "lines_distinct", "words_a_line")


def _share(x: float, n: float) -> float:
    """log-odds of a share, smoothed: spreads out shares near 0 and 1."""
    return math.log((x + 0.5) / (max(n - x, 0) + 0.5))


def statistics(body: bytes | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty. No id, source or language enters."""
    body = body or b""
    n = len(body)
    kinds = np.bincount(_OF_BYTE, np.bincount(np.frombuffer(body, np.uint8), minlength=256), len(_CLASSES) + 1)
    words = body.split()
    w = len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if w else 0
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in body.split(b"\n") if x]
    last = np.frombuffer(body, np.uint8)
    # a mark ends a word: a byte of a mark class followed by white space
    space = np.isin(last, (9, 10, 11, 12, 13, 32)) if n else np.zeros(0, bool)
    marks = int((np.isin(_OF_BYTE[last[:-1]], (4, 5, 6)) & space[1:]).sum()) if n else 0
    upper = sum(map(bytes.isupper, words))
    out = [math.log1p(w), math.log1p(n / max(w, 1)), math.log1p(float(sizes.std()) if w else 0.0)]
    out += [_share(100 * k / max(n, 1), 100) for k in kinds[: len(_CLASSES)].tolist()]
    out += [_share(100 * x / max(m, 1), 100) for x, m in ((int((sizes > 14).sum()), w), (marks, w), (upper, w), (len(counts), w), (top, w), (same, w - 1), (pairs, w - 1), (len(set(lines)), len(lines)))]
    return [*out, math.log1p(w / max(len(lines), 1))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row..., x: array of statistics) for every row; other columns than id and text stay behind."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs = [], []
        for i, body in rows_of(batches, "id", "body"):
            ids.append(i)
            xs.append(statistics(body))
            if len(ids) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, schema.field("x").type)], schema=schema)
                ids, xs = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, schema.field("x").type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, "id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, cached inverse Cholesky factors of shrunk covariances, and log-density offsets."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # (2, d)
    whiten: np.ndarray  # (2, d, d): inverse Cholesky factors
    offset: np.ndarray  # (2,): log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the logistic of the difference of log densities by Mahalanobis distances."""
        z = (x - self.center) / self.scale
        logs = [self.offset[k] - 0.5 * (((z - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """From each class's row count, sum and sum of outer products.

    Each class covariance is shrunk towards the pooled one, more so the fewer its
    rows, and towards its diagonal. A class without rows gets the pooled mean, so
    scores are then the smoothed prior.
    """
    d = s.shape[1]
    total = max(n.sum(), 1.0)
    center = s.sum(0) / total
    var = np.diag(ss.sum(0)) / total - center**2
    scale = np.sqrt(np.maximum(var, 1e-12))
    scale[var < 1e-9] = 1.0
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        if n[k]:
            mu = s[k] / n[k]
            means[k] = (mu - center) / scale
            covs[k] = (ss[k] / n[k] - np.outer(mu, mu)) / np.outer(scale, scale)
    pooled = (n[:, None, None] * covs).sum(0) / total
    whiten, offset = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        a = (n[k] / (n[k] + 2.0 * d)) * (1 - shrink)
        c = a * covs[k] + (1 - a) * pooled
        c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + ridge * np.eye(d)
        low = np.linalg.cholesky(c)
        whiten[k] = np.linalg.solve(low, np.eye(d))
        offset[k] = math.log((n[k] + 1) / (total + 2)) - np.log(np.diag(low)).sum()
    return Discriminant(center, scale, means, whiten, offset)


def moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row counts, sums and outer products by class over (x, label): one small row from each task."""
    d = len(FEATURES)
    size = 1 + d + d * d
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for b in batches:
            x = np.array(b.column("x").flatten()).reshape(-1, d)
            y = b.column("label").to_numpy()
            for k in (0, 1):
                if len(z := x[y == k]):
                    total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], schema=schema)

    out = np.zeros(2 * size)
    for r in labelled.select("x", "label").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    out = out.reshape(2, size)
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d)


def fit_quality(stats: DataFrame, labels: DataFrame, train_if: Column, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """The discriminant of all rows of ``stats`` whose id has a label of 0 or 1 and ``train_if`` (over ``id``)."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)").where(train_if).distinct()
    # one text for each labelled id, so that repeated rows don't weigh more; of several, the one of the least statistics
    return fit(*moments(stats.join(known, "id").groupBy("id", "label").agg(F.min("x").alias("x"))))


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_if: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more; see ``score_quality``.

    Statistics are computed once and written beside the text, so that the second pass
    only scores them; no text is shuffled. Null and empty texts are scored as empty,
    repeated rows are decided alike, and an empty table gives no rows.
    """
    scratch, names, at = Scratch(spark, "quality"), docs.columns, docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = []
            for lo in range(0, b.num_rows, 512):
                xs += [statistics(t if t is None else t.encode()) for t in b.column(at).slice(lo, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(xs, pa.list_(pa.float64()))], names=[*b.schema.names, "_cf_x"])

    rows = scratch.table(docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("_cf_x", ArrayType(DoubleType()))])), "rows")
    stats = rows.select(F.col(id_col).cast("long").alias("id"), F.col("_cf_x").alias("x"))
    model = spark.sparkContext.broadcast(fit_quality(stats, labels, F.lit(True) if train_if is None else train_if, id_col, label_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(b.num_columns - 1).flatten()).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.value.score(x) >= threshold)).select(names)

    return rows.mapInArrow(keep, docs.schema)


def score_quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, train_if: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Score every whole text; learn from the labels whose ``train_if`` (over the column ``id``) is true.

    Returns (id, score, predicted) for each row of ``docs``: the probability of
    label 1 and 1 if that is at least ``threshold``. All labelled rows enter the
    fit, as sums; labels other than 0 and 1 or without an id are left out, and
    repeated (id, label) rows count once. Null and empty texts are scored as
    empty; with no labels at all every score is 0.5; an empty table gives no rows.
    """
    scratch = Scratch(spark, "quality")
    stats = scratch.table(features(docs, id_col, text_col), "features")
    model = spark.sparkContext.broadcast(fit_quality(stats, labels, train_if, id_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").flatten()).reshape(-1, len(FEATURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return stats.mapInArrow(run, "id long, score double, predicted int")
