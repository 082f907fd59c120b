"""Rules over per-frame picture statistics: similar frames, brightness, detector responses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays of one length; null if either is constant."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    n = F.size(a).cast("double")
    cov, va, vb = dot(a, b) - total(a) * total(b) / n, dot(a, a) - total(a) * total(a) / n, dot(b, b) - total(b) * total(b) / n
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def similar_pairs(frames: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(match_id, a, b, corr) of all pairs of a match's histograms (match_id, frame_id, hist) that correlate above ``threshold``.

    Histograms are centered and scaled once, so a pair costs one dot product. The
    match is the equal key; its pairs are the result's own size.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    f = frames.withColumn("mean", total(F.col("hist")) / F.size("hist")).withColumn("c", F.transform("hist", lambda v: v - F.col("mean")))
    f = f.withColumn("norm", F.sqrt(total(F.transform("c", lambda v: v * v)))).where("norm > 0").select("match_id", "frame_id", F.transform("c", lambda v: v / F.col("norm")).alias("u"))
    a, b = f.select("match_id", F.col("frame_id").alias("a"), F.col("u").alias("ua")), f.select("match_id", F.col("frame_id").alias("b"), F.col("u").alias("ub"))
    pairs = a.join(b, "match_id").where("b > a")
    return pairs.select("match_id", "a", "b", total(F.zip_with("ua", "ub", lambda p, q: p * q)).alias("corr")).where(F.col("corr") > threshold)


def distinct_frames(frames: DataFrame, threshold: float = 0.93, most: int | None = None) -> DataFrame:
    """Greedy keep-first: a frame goes if it correlates above ``threshold`` with any kept one; stops at ``most`` kept."""

    def run(g):
        kept, rows = [], []
        for frame, hist in zip(g["frame_id"], g["hist"], strict=True):
            if most is not None and len(rows) == most:
                break
            v = np.asarray(hist, float)
            v = v - v.mean()
            v = v / (np.linalg.norm(v) or 1.0)
            if kept and (np.array(kept) @ v).max() > threshold:
                continue
            kept.append(v)
            rows.append(frame)
        out = g[g["frame_id"].isin(rows)][["match_id", "frame_id"]]
        return out.reset_index(drop=True)

    return frames.groupBy("match_id").applyInPandas(lambda g: run(g.sort_values("frame_id")), "match_id long, frame_id long")


def playable(stats: DataFrame, brightness: float = 30.0, court: float = 0.15) -> DataFrame:
    """Frames bright enough and with enough of the court's colour."""
    return stats.where((F.col("brightness") >= brightness) & (F.col("court_ratio") > court))


def court_visible(stats: DataFrame) -> DataFrame:
    """Adds visible: court colour, white lines in a band, and three lines or more."""
    return stats.withColumn("visible", (F.col("court_ratio") >= 0.15) & F.col("white_ratio").between(0.003, 0.15) & (F.col("lines") >= 3))


def response_summary(stats: DataFrame, thresholds: tuple[int, ...] = (10, 30, 50, 80, 127), by: str = "run") -> DataFrame:
    """One row for each ``by`` over its frames: spread of maxima, frames with a valid blob at each threshold, and advice.

    Frames hold (top, blobs: map threshold -> valid blobs) with the newest frame
    first, and old_blobs, the same with the oldest first.
    """
    hit = lambda c, t: F.count_if(F.coalesce(F.try_element_at(c, F.lit(t)), F.lit(0)) > 0)
    row = stats.groupBy(by).agg(
        F.avg("top").alias("mean_top"), F.min("top").alias("min_top"), F.max("top").alias("max_top"), F.count_if(F.col("top") > 0).alias("responding"), F.count("*").alias("frames"),
        *(hit("blobs", t).alias(f"n{t}") for t in thresholds), hit("old_blobs", 50).alias("o50"),
    )
    advice = F.when(F.col("n127") > F.col("frames") * 0.1, "keep 127").when(F.col("n50") > F.col("frames") * 0.1, "lower to 50").when(F.col("o50") > F.col("n50"), "oldest first").when(F.col("n50") > 0, "weak").otherwise("none")
    return row.withColumn("advice", advice)


def frame_buffer(frames: DataFrame, depth: int = 3) -> DataFrame:
    """The last ``depth`` frames of each match; null until there are as many."""
    w = Window.partitionBy("match_id").orderBy("frame_id").rowsBetween(-(depth - 1), 0)
    ids = F.collect_list("frame_id").over(w)
    return frames.select("match_id", "frame_id", F.when(F.size(ids) == depth, ids).alias("buffer"))


def largest_blob(mask: np.ndarray, most: int = 200) -> np.ndarray | None:
    """Cells of the largest 8-connected region of a mask; None if there is none or it has over ``most`` cells."""
    left, best = {tuple(c) for c in np.argwhere(mask)}, []
    while left:
        todo, blob = [left.pop()], []
        while todo:
            y, x = todo.pop()
            blob.append((y, x))
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            todo += near
        best = max(best, blob, key=len)
    return np.array(best) if best and len(best) <= most else None


def ball_in_response(response: np.ndarray, scale: tuple[float, float], cut: float = 0.5, rescale: bool = False) -> tuple[float, float, float] | None:
    """(x, y, confidence) of the ball in a response map; ``rescale`` stretches it to 0-255 first and cuts above 127."""
    r = response
    if rescale:
        top = float(r.max())
        if top <= 0:
            return None
        r = (r / top * 255).astype(np.uint8)
        blob = largest_blob(r > 127)
    else:
        blob = largest_blob(r >= cut)
    if blob is None:
        return None
    y, x = blob.mean(0)
    peak = float(r[blob[:, 0], blob[:, 1]].max())
    return float(x * scale[0]), float(y * scale[1]), peak / 255 if rescale else peak
