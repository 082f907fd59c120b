"""From line segments to a court calibration: grouping lines, crossing them, fitting a homography."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COURT_L, COURT_W, NET_Y, SERVICE_FAR, SERVICE_NEAR
from .tracking import fit_homography

#: The named points of a court, in metres.
COURT_POINTS = {
    "bottom_left": (0.0, 0.0), "bottom_right": (COURT_W, 0.0), "top_left": (0.0, COURT_L), "top_right": (COURT_W, COURT_L),
    "net_left": (0.0, NET_Y), "net_right": (COURT_W, NET_Y),
    "service_near_left": (0.0, SERVICE_NEAR), "service_near_center": (5.0, SERVICE_NEAR), "service_near_right": (COURT_W, SERVICE_NEAR),
    "service_far_left": (0.0, SERVICE_FAR), "service_far_center": (5.0, SERVICE_FAR), "service_far_right": (COURT_W, SERVICE_FAR),
}
ROWS_Y = (0.0, SERVICE_NEAR, NET_Y, SERVICE_FAR, COURT_L)


def directions(segments: DataFrame, split: float = 30.0) -> DataFrame:
    """Segments (match_id, x1, y1, x2, y2) with their direction, across or along, and midpoint; exactly ``split`` degrees is neither."""
    angle = F.degrees(F.atan2(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1"))))
    across = angle < split
    mid = F.when(across, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
    return segments.withColumn("direction", F.when(across, "across").when(angle > split, "along")).where("direction is not null").withColumn("mid", mid)


def line_clusters(directed: DataFrame, within: float = 25.0) -> DataFrame:
    """Mean line of each cluster: sorted by midpoint, a line joins if it lies within ``within`` of the cluster's running mean."""
    items = F.sort_array(F.collect_list(F.struct("mid", "x1", "y1", "x2", "y2")))
    empty = F.expr("cast(array() as array<struct<n:bigint,mid:double,x1:double,y1:double,x2:double,y2:double>>)")

    def add(kept, v):
        last = F.try_element_at(kept, F.lit(-1))
        fields = ("mid", "x1", "y1", "x2", "y2")
        fresh = F.struct(F.lit(1).cast("long").alias("n"), *(v[f].alias(f) for f in fields))
        joined = F.struct((last["n"] + 1).alias("n"), *((last[f] + v[f]).alias(f) for f in fields))
        near = last.isNotNull() & (F.abs(v["mid"] - last["mid"] / last["n"]) < within)
        return F.when(near, F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(kept, F.array(fresh)))

    got = directed.groupBy("match_id", "direction").agg(F.aggregate(items, empty, add).alias("c")).select("match_id", "direction", F.posexplode("c").alias("cluster", "c"))
    return got.select("match_id", "direction", "cluster", F.col("c.n").alias("lines"), *((F.col(f"c.{f}") / F.col("c.n")).alias(f) for f in ("x1", "y1", "x2", "y2")))


def merge_points(points: list[tuple[float, float]], within: float = 20.0) -> list[tuple[float, float]]:
    """Each point not yet used takes in later ones nearer than ``within`` to it, and gives their centroid."""
    left, out = list(points), []
    while left:
        seed = left[0]
        near = [p for p in left if np.hypot(p[0] - seed[0], p[1] - seed[1]) < within]
        left = [p for p in left if p not in near]
        out.append((float(np.mean([p[0] for p in near])), float(np.mean([p[1] for p in near]))))
    return out


def rows_by_gap(points: DataFrame, gap: float = 25.0) -> DataFrame:
    """Numbers rows of points (match_id, x, y): a new row where y lies ``gap`` or more below the one before."""
    w = Window.partitionBy("match_id").orderBy("y", "x")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) >= gap).cast("int"), F.lit(0))
    return points.withColumn("_new", new).withColumn("row", F.sum("_new").over(w)).drop("_new")


def row_places(n: int, y: float) -> list[float] | None:
    """Court x of the outermost (and middle) points of a row."""
    if n < 2:
        return None
    return [0.0, 5.0, COURT_W] if n == 3 and y in (SERVICE_NEAR, SERVICE_FAR) else [0.0, COURT_W]


def valid_homography(h: np.ndarray, width: int, height: int) -> bool:
    """Invertible, and the court it sees is convex and within half a frame of the frame."""
    if not 1e-10 <= abs(np.linalg.det(h)) <= 1e12:
        return False
    corners = np.array([[0, 0, 1], [COURT_W, 0, 1], [COURT_W, COURT_L, 1], [0, COURT_L, 1]]) @ np.linalg.inv(h).T
    if (np.abs(corners[:, 2]) < 1e-12).any():
        return False
    p, m = corners[:, :2] / corners[:, 2:], 0.5 * max(width, height)
    if not ((p >= -m) & (p <= [width + m, height + m])).all():
        return False
    e = np.roll(p, -1, 0) - p
    f = np.roll(e, -1, 0)
    cross = e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]
    return bool((cross > 0).all() or (cross < 0).all())


def score(src: list, dst: list, threshold: float = 0.5) -> float:
    """Inliers over mean error of a fit; -1 where there is none."""
    try:
        h, _ = fit_homography(np.array(src, float), np.array(dst, float))
    except (ValueError, np.linalg.LinAlgError):
        return -1.0
    at = np.hstack([np.array(src, float), np.ones((len(src), 1))]) @ h.T
    err = np.sqrt(((at[:, :2] / at[:, 2:] - np.array(dst)) ** 2).sum(1))
    inliers = int((err < threshold).sum())
    return inliers * 100.0 if err.mean() < 1e-6 else inliers / float(err.mean())


def assign_rows(rows: list[list[tuple[float, float]]]) -> tuple[list, list]:
    """(pixels, metres): the best choice of court lines for rows of points from top to bottom of the court; the first best wins."""
    best, best_score = ([], []), -1.0
    n = min(len(rows), len(ROWS_Y))
    for lines in combinations(ROWS_Y, n):
        src, dst = [], []
        for points, y in zip(rows, reversed(lines), strict=False):
            ordered = sorted(points)
            places = row_places(len(ordered), y)
            if places:
                own = ordered if len(places) == 3 else [ordered[0], ordered[-1]]
                src += own
                dst += [(x, y) for x in places]
        if len(src) >= 4 and (s := score(src, dst)) > best_score:
            best, best_score = (src, dst), s
    return best


def calibrate(named: dict[str, tuple[float, float]], width: int, height: int) -> dict | None:
    """A calibration from named pixel points; None if there are too few, they don't fit, or the fit isn't a court."""
    known = [(p, COURT_POINTS[n]) for n, p in named.items() if n in COURT_POINTS]
    try:
        h, error = fit_homography(np.array([p for p, _ in known], float).reshape(-1, 2), np.array([c for _, c in known], float).reshape(-1, 2))
    except (ValueError, np.linalg.LinAlgError):
        return None
    if not valid_homography(h, width, height):
        return None
    return {"frame_width": width, "frame_height": height, "homography_matrix": h.tolist(), "court_keypoints_px": [list(p) for p, _ in known], "court_keypoints_m": [list(c) for _, c in known], "reprojection_error": error}


def project_model(named: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """All points of the court in the picture's units, from four or more of them."""
    known = [(COURT_POINTS[n], p) for n, p in named.items() if n in COURT_POINTS]
    h, _ = fit_homography(np.array([c for c, _ in known], float), np.array([p for _, p in known], float))
    at = np.array([[*c, 1.0] for c in COURT_POINTS.values()]) @ h.T
    return {n: (float(x / w), float(y / w)) for n, (x, y, w) in zip(COURT_POINTS, at, strict=True)}


def best_calibration(calibrations: DataFrame, every: int = 300) -> DataFrame:
    """(match_id, frame_id, reprojection_error) of the least error among every ``every``-th frame; frames without one are passed over, the first of equals wins."""
    c = calibrations.where((F.col("frame_id") % every == 0) & F.col("reprojection_error").isNotNull())
    best = c.groupBy("match_id").agg(F.min(F.struct("reprojection_error", "frame_id")).alias("b"))
    return best.select("match_id", "b.frame_id", "b.reprojection_error")
