"""Feature windows, weak labels and the small network that reads them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import in_match
from .events import bounces, contacts, indexed, nearest_player_distance

SLOTS = range(-4, 5)


def event_features(ball: DataFrame, players: DataFrame) -> DataFrame:
    """(match_id, frame_id, features): nine frames of eight values, zeros where a frame or its position is missing."""
    w = in_match("frame_id")
    rows = indexed(ball).join(nearest_player_distance(ball, players), ["match_id", "frame_id"], "left")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    step = lambda c: F.when(known & F.lag(c).over(w).isNotNull(), F.col(c) - F.lag(c).over(w)).otherwise(0.0)
    rows = rows.withColumn("dx", step("x")).withColumn("dy", step("y"))
    slot = F.array("x", "y", "dx", "dy", "confidence", (F.col("visibility") == "visible").cast("double"), F.coalesce("distance", F.lit(99.0)), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    zeros = F.array(*[F.lit(0.0)] * 8)
    rows = rows.withColumn("slot", F.when(known, slot).otherwise(zeros))
    at = lambda o: F.col("slot") if not o else F.coalesce(F.lag("slot", -o).over(w) if o < 0 else F.lead("slot", o).over(w), zeros)
    return rows.select("match_id", "frame_id", F.flatten(F.array(*(at(o) for o in SLOTS))).cast("array<float>").alias("features"))


def weak_labels(ball: DataFrame, players: DataFrame, hit_within: float = 1.5) -> DataFrame:
    """(match_id, frame_id, label): 3 occluded, 1 bounce, 2 hit, 0 flying; a bounce beside a player is a hit."""
    b = bounces(ball).select("match_id", "frame_id", F.lit(True).alias("bounce"))
    c = contacts(ball, players).select("match_id", "frame_id", F.lit(True).alias("hit")).distinct()
    rows = ball.select("match_id", "frame_id", "visibility").join(b, ["match_id", "frame_id"], "left").join(c, ["match_id", "frame_id"], "left").join(nearest_player_distance(ball, players), ["match_id", "frame_id"], "left")
    near = F.coalesce(F.col("distance"), F.lit(99.0)) < hit_within
    label = F.when(F.col("visibility") == "occluded", 3).when(F.col("bounce") & ~near, 1).when(F.col("bounce") | F.col("hit"), 2).otherwise(0)
    return rows.select("match_id", "frame_id", label.alias("label"))


def class_weights(labels: DataFrame, total: float = 4.0) -> DataFrame:
    """Inverse counts scaled to sum to ``total``; there are a handful of labels."""
    g = labels.groupBy("label").agg((F.lit(1.0) / F.greatest(F.count("*"), F.lit(1))).alias("w"))
    return g.select("label", (F.col("w") / F.sum("w").over(Window.partitionBy()) * total).alias("weight"))


def synthetic_weights(seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fixed layers of the network's shape, for queries without a trained one."""
    g, sizes = np.random.default_rng(seed), (72, 128, 64, 4)
    return [(g.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def mlp_probabilities(features: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(match_id, frame_id, p0..p3): rectified layers and a softmax, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["features"].to_numpy()) if len(b) else np.zeros((0, 72))
            for i, (w, bias) in enumerate(layers):
                x = x @ w + bias
                x = np.maximum(x, 0) if i < len(layers) - 1 else x
            e = np.exp(x - x.max(1, keepdims=True)) if len(x) else x.reshape(0, 4)
            p = e / e.sum(1, keepdims=True) if len(x) else e
            yield pd.DataFrame({"match_id": b["match_id"], "frame_id": b["frame_id"], **{f"p{i}": p[:, i] for i in range(4)}})

    return features.mapInPandas(run, "match_id long, frame_id long, p0 double, p1 double, p2 double, p3 double")


def detect_events(probabilities: DataFrame, least: float = 0.5, apart: int = 8) -> DataFrame:
    """(match_id, frame_id, kind): bounces and hits of probability above ``least``, each kept ``apart`` frames from the last."""
    from ..functions.sequence import suppress

    pick = lambda p, kind: suppress(probabilities.where(F.col(p) > least).select("match_id", "frame_id"), "frame_id", apart).withColumn("kind", F.lit(kind))
    return pick("p1", "bounce").unionByName(pick("p2", "hit"))


def class_accuracy(predictions: DataFrame) -> DataFrame:
    """(label, n, accuracy) of rows (label, pred)."""
    return predictions.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def split(rows: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash of the key: the same rows fall on the same side in every run."""
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return rows.where(~part), rows.where(part)
