"""Court geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COURT_L, COURT_W, FENCE, NET_BAND, NET_Y, WALL_Z


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def point(x: Column, y: Column) -> Column:
    """A 2-D position, null unless both coordinates are known."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def foot(box: Column) -> Column:
    return point((box["x1"] + box["x2"]) / 2, box["y2"])


def center(box: Column) -> Column:
    return point((box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2)


def project(p: Column, h: Column) -> Column:
    """A point through a 3x3 homography; null where it goes to infinity."""
    row = lambda i: h[i][0] * p["x"] + h[i][1] * p["y"] + h[i][2]
    return point(F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2)))


def adjugate(h: Column) -> Column:
    """The inverse up to scale, which a projection cancels."""
    m = lambda a, b, c, d: h[a // 3][a % 3] * h[b // 3][b % 3] - h[c // 3][c % 3] * h[d // 3][d % 3]
    return F.array(
        F.array(m(4, 8, 5, 7), m(2, 7, 1, 8), m(1, 5, 2, 4)),
        F.array(m(5, 6, 3, 8), m(0, 8, 2, 6), m(2, 3, 0, 5)),
        F.array(m(3, 7, 4, 6), m(1, 6, 0, 7), m(0, 4, 1, 3)),
    )


def determinant(h: Column) -> Column:
    return h[0][0] * (h[1][1] * h[2][2] - h[1][2] * h[2][1]) - h[0][1] * (h[1][0] * h[2][2] - h[1][2] * h[2][0]) + h[0][2] * (h[1][0] * h[2][1] - h[1][1] * h[2][0])


def on_court(p: Column, margin: float = 1.0) -> Column:
    return p["x"].between(-margin, COURT_W + margin) & p["y"].between(-margin, COURT_L + margin)


def clamp_to_court(p: Column) -> Column:
    return point(clamp(p["x"], 0.0, COURT_W), clamp(p["y"], 0.0, COURT_L))


def surface(x: Column, y: Column, z: Column) -> Column:
    """What a ball at this place bounced on; an unknown height counts as the ground's."""
    high = F.coalesce(z, F.lit(0.0)) > WALL_Z
    back = (y < FENCE) | (y > COURT_L - FENCE)
    side = (x < FENCE) | (x > COURT_W - FENCE)
    return (
        F.when(F.abs(y - NET_Y) < NET_BAND, "net").when(back & side, "corner")
        .when(back, F.when(high, "back_wall").otherwise("back_fence"))
        .when(side, F.when(high, "side_wall").otherwise("side_fence")).otherwise("ground")
    )


def mini_court(p: Column, width: int, height: int) -> Column:
    """Pixel place on a small drawing of the court; casts cut towards zero."""
    return F.struct((p["x"] / COURT_W * width).cast("int").alias("px"), ((1 - p["y"] / COURT_L) * height).cast("int").alias("py"))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def line_intersection(a: Column, b: Column) -> Column:
    """Of the lines through two segments (x1, y1, x2, y2); null if nearly parallel."""
    dx1, dy1, dx2, dy2 = a["x1"] - a["x2"], a["y1"] - a["y2"], b["x1"] - b["x2"], b["y1"] - b["y2"]
    den = dx1 * dy2 - dy1 * dx2
    ca, cb = a["x1"] * a["y2"] - a["y1"] * a["x2"], b["x1"] * b["y2"] - b["y1"] * b["x2"]
    return F.when(F.abs(den) >= 1e-6, F.struct((F.try_divide(ca * dx2 - dx1 * cb, den)).alias("x"), (F.try_divide(ca * dy2 - dy1 * cb, den)).alias("y")))
