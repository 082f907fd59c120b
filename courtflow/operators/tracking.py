"""Detections to frames: projection, selection, filters over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import clamp_to_court, foot, iou, on_court, project


def located(detections: DataFrame, calibration: DataFrame, most: int = 4) -> DataFrame:
    """Boxes whose feet are on the court (a metre of margin), clamped to it; the best ``most`` of each frame."""
    d = detections.join(calibration.select("match_id", "homography"), "match_id").withColumn("at", project(foot(F.col("bbox")), F.col("homography")))
    d = d.where(on_court(F.col("at"))).withColumn("position", clamp_to_court(F.col("at")))
    w = Window.partitionBy("match_id", "frame_id").orderBy(F.desc("confidence"), "ord")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("at", "homography")


def kalman_step(state: tuple | None, x: float | None, y: float | None, gate: float = 3.0, most: int = 10, q: float = 0.25, r: float = 0.09):
    """One frame of a constant-velocity filter, axes alike: (state, place or None, visibility).

    The four-state filter falls apart into one covariance (p00, p01, p11) for
    both axes. The first detection is taken as it is; later ones must lie within
    ``gate`` of the prediction; after ``most`` misses the track is lost.
    """
    seen = x is not None and y is not None
    if state is None:
        return ((x, y, 0.0, 0.0, 1.0, 0.0, 1.0, 0), (x, y), "visible") if seen else (None, None, "occluded")
    px, py, vx, vy, a, b, c, lost = state
    px, py = px + vx, py + vy
    a, b, c = a + 2 * b + c + q, b + c, c + q
    if not seen or float(np.hypot(px - x, py - y)) > gate:
        lost += 1
        return (None, None, "occluded") if lost > most else ((px, py, vx, vy, a, b, c, lost), (px, py), "inferred")
    k0, k1 = a / (a + r), b / (a + r)
    dx, dy = x - px, y - py
    state = (px + k0 * dx, py + k0 * dy, vx + k1 * dx, vy + k1 * dy, (1 - k0) * a, (1 - k0) * b, c - k1 * b, 0)
    return state, state[:2], "visible"


def track_ball(raw: DataFrame) -> DataFrame:
    """(match_id, frame_id, x, y, visibility) from raw detections; one linear pass for each match, places clamped to the court."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for frame, x, y in zip(*(rows.sort_values("frame_id")[c].tolist() for c in ("frame_id", "x", "y")), strict=True):
            miss = x is None or y is None or x != x or y != y
            state, at, seen = kalman_step(state, None if miss else x, None if miss else y)
            out.append((frame, None if at is None else min(10.0, max(0.0, at[0])), None if at is None else min(20.0, max(0.0, at[1])), seen))
        done = pd.DataFrame(out, columns=["frame_id", "x", "y", "visibility"])
        done.insert(0, "match_id", rows["match_id"].iloc[0])
        return done

    return raw.select("match_id", "frame_id", "x", "y").groupBy("match_id").applyInPandas(run, "match_id long, frame_id long, x double, y double, visibility string")


def smooth_pose(players: DataFrame, alpha: float = 0.6) -> DataFrame:
    """(match_id, frame_id, player_id, name, x, y): keypoints averaged with the player's frame before.

    A keypoint that the player's last frame with keypoints lacks starts anew.
    """
    rows = players.where("size(keypoints) > 0").select("match_id", "frame_id", "player_id", F.dense_rank().over(Window.partitionBy("match_id", "player_id").orderBy("frame_id")).alias("step"), F.explode("keypoints").alias("k"))
    rows = rows.select("match_id", "frame_id", "player_id", "step", "k.*")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["name", "step"])
        names, steps = g["name"].to_numpy(), g["step"].to_numpy()
        vals = g[["x", "y", "confidence"]].to_numpy(float).copy()
        for i in range(1, len(g)):
            if names[i] == names[i - 1] and steps[i] == steps[i - 1] + 1:
                vals[i] = alpha * vals[i] + (1 - alpha) * vals[i - 1]
        g[["x", "y", "confidence"]] = vals
        return g.drop(columns="step")

    return rows.groupBy("match_id", "player_id").applyInPandas(run, "match_id long, frame_id long, player_id string, name string, x double, y double, confidence double")


def iou_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap of every pair of boxes within a frame."""
    a, b = left.select("match_id", "frame_id", F.col("ord").alias("a"), F.col("bbox").alias("box_a")), right.select("match_id", "frame_id", F.col("ord").alias("b"), F.col("bbox").alias("box_b"))
    return a.join(b, ["match_id", "frame_id"]).select("match_id", "frame_id", "a", "b", iou(F.col("box_a"), F.col("box_b")).alias("iou"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row with the least total cost, rows at most as many as columns: shortest augmenting paths, cubic."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[j]:
            done[j] = True
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[row_of[j] - 1, open_ - 1] - u[row_of[j]] - v[open_]
            better = open_[reduced < least[open_]]
            least[better], came[better] = reduced[reduced < least[open_]], j
            k = open_[least[open_].argmin()]
            step = least[k]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def match_boxes(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """One-to-one pairs of each frame with the largest total overlap, those of ``least`` or more; a match is one Arrow group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for frame, f in g.groupby("frame_id"):
            m = f.pivot(index="a", columns="b", values="iou")
            flip = m.shape[0] > m.shape[1]
            m = m.T if flip else m
            for i, j in enumerate(assignment(1 - m.to_numpy())):
                if m.iat[i, j] >= least:
                    a, b = (m.columns[j], m.index[i]) if flip else (m.index[i], m.columns[j])
                    out.append((frame, a, b, m.iat[i, j]))
        done = pd.DataFrame(out, columns=["frame_id", "a", "b", "iou"])
        done.insert(0, "match_id", g["match_id"].iloc[0])
        return done

    return pairs.groupBy("match_id").applyInPandas(run, "match_id long, frame_id long, a long, b long, iou double")


def kmeans_2(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two centers: the first row and the farthest from it, then Lloyd's steps; ties go to the first, and the centers before the last step count."""
    c = np.stack([x[0], x[int(((x - x[0]) ** 2).sum(1).argmax())]])
    for _ in range(rounds):
        of = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.stack([x[of == k].mean(0) if (of == k).any() else c[k] for k in (0, 1)])
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def kmeans_2_table(features: DataFrame, rounds: int = 20) -> np.ndarray:
    """``kmeans_2`` of a whole table (id, vec), row 0 being the smallest id: two rows of sums a round reach the driver."""
    dist = lambda c: F.aggregate(F.zip_with("vec", F.array(*(F.lit(float(v)) for v in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    first = features.agg(F.min(F.struct("id", "vec")).alias("m")).first()["m"]
    if first is None:
        raise ValueError("no rows")
    far = features.agg(F.max(F.struct(dist(first["vec"]).alias("d"), (-F.col("id")).alias("less"), "vec")).alias("m")).first()["m"]
    c = np.array([first["vec"], far["vec"]], float)
    for _ in range(rounds):
        near = features.select(F.when(dist(c[0]) <= dist(c[1]), 0).otherwise(1).alias("team"), F.posexplode("vec").alias("i", "v"))
        new = c.copy()
        for r in near.groupBy("team", "i").agg(F.avg("v").alias("v")).collect():
            new[r["team"], r["i"]] = r["v"]
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def assign_teams(features: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, team) by the nearer center, ties to T_2; distances stay in the JVM."""
    d = lambda k: F.aggregate(F.zip_with("vec", F.array(*(F.lit(float(v)) for v in centers[k])), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return features.select("id", F.when(d(0) < d(1), "T_1").otherwise("T_2").alias("team"))


def fit_homography(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, float]:
    """Least-squares homography by the normalized direct linear transform, and its RMS error; ValueError if degenerate."""
    if len(src) < 4:
        raise ValueError("four points are needed")

    def norm(p: np.ndarray) -> np.ndarray:
        m, s = p.mean(0), np.sqrt(2) / max(np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean(), 1e-12)
        return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    ts, td = norm(src), norm(dst)
    one = np.ones((len(src), 1))
    a, b = np.hstack([src, one]) @ ts.T, np.hstack([dst, one]) @ td.T
    rows = []
    for p, q in zip(a, b, strict=True):
        rows += [[*np.zeros(3), *(-p), *(q[1] * p)], [*p, *np.zeros(3), *(-q[0] * p)]]
    _, sing, vt = np.linalg.svd(np.array(rows))
    h = np.linalg.inv(td) @ vt[-1].reshape(3, 3) @ ts
    if len(sing) > 7 and sing[7] < 1e-9 or abs(h[2, 2]) < 1e-12:
        raise ValueError("the points don't fix a homography")
    h /= h[2, 2]
    at = np.hstack([src, one]) @ h.T
    return h, float(np.sqrt((((at[:, :2] / at[:, 2:]) - dst) ** 2).sum(1).mean()))




def best_ball(detections: DataFrame, kind: int = 32) -> DataFrame:
    """The ball detection with the highest confidence of each frame."""
    best = detections.where(F.col("class_id") == kind).groupBy("match_id", "frame_id").agg(F.max(F.struct("confidence", F.negative("ord").alias("less"), "bbox")).alias("b"))
    return best.select("match_id", "frame_id", F.col("b.confidence").alias("confidence"), F.col("b.bbox").alias("bbox"))


def warm_up(features: DataFrame, frames: int = 10, least: int = 2) -> DataFrame:
    """Adds ready: from the frame on in which the ``frames``-th frame with ``least`` usable crops was seen."""
    per = features.groupBy("match_id", "frame_id").agg((F.count_if(F.col("vec").isNotNull()) >= least).cast("int").alias("ok"))
    w = Window.partitionBy("match_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("match_id", "frame_id", (F.sum("ok").over(w) >= frames).alias("ready"))
    return features.join(per, ["match_id", "frame_id"])
