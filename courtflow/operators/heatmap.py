"""Position heatmaps: counts in bins, smoothed and scaled to a top of one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bins(positions: DataFrame, nx: int = 50, ny: int = 100) -> DataFrame:
    """(match_id, iy, ix, n) of (match_id, x, y) rows; places off the court go to the edge bins."""
    cell = lambda c, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.col(c) / size * (n - 1)).cast("int")))
    rows = positions.where("x is not null and y is not null")
    return rows.groupBy("match_id", cell("y", 20.0, ny).alias("iy"), cell("x", 10.0, nx).alias("ix")).agg(F.count("*").alias("n"))


def kernel(sigma: float = 1.5, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(binned: DataFrame, nx: int = 50, ny: int = 100, sigma: float = 1.5) -> DataFrame:
    """Gaussian smoothing along each axis with mirrored edges, then division by the match's top.

    Each bin is spread to its neighbours and summed: the work follows the bins
    that hold something, and nothing is gathered.
    """
    taps = [(i - len(kernel(sigma)) // 2, w) for i, w in enumerate(kernel(sigma))]
    rows = binned.withColumn("v", F.col("n").cast("double"))
    for c, n in (("iy", ny), ("ix", nx)):
        tap = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in taps))).alias("tap")
        spread = rows.select("match_id", "iy", "ix", "v", tap).withColumn("to", F.col(c) + F.col("tap.o"))
        # what falls off an edge comes from the mirror image on the other side of it: -1 is 0, n is n - 1
        inside = F.when(F.col("to") < 0, -F.col("to") - 1).when(F.col("to") >= n, 2 * n - 1 - F.col("to")).otherwise(F.col("to"))
        rows = spread.withColumn(c, inside).groupBy("match_id", "iy", "ix").agg(F.sum(F.col("v") * F.col("tap.w")).alias("v"))
    top = rows.groupBy("match_id").agg(F.max("v").alias("top"))
    return rows.join(top, "match_id").select("match_id", "iy", "ix", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(F.col("v")).alias("value"))
