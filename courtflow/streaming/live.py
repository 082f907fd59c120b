"""Live feeds: the ball tracker and pose smoothing with keyed state, play sessions with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import kalman_step

_STATE = "px double, py double, vx double, vy double, a double, b double, c double, lost int, alive boolean"


def track_ball(raw: DataFrame) -> DataFrame:
    """The batch tracker, a match a key: (match_id, frame_id, x, y) in arrival order of frames; state is nine numbers."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0.0,) * 7 + (0, False)
        track = tuple(held[:8]) if held[8] else None
        rows = pd.concat(list(parts)).sort_values("frame_id")
        out = []
        for frame, x, y in zip(rows["frame_id"].tolist(), rows["x"].tolist(), rows["y"].tolist(), strict=True):
            miss = x is None or y is None or x != x or y != y
            track, at, seen = kalman_step(track, None if miss else x, None if miss else y)
            out.append((key[0], frame, None if at is None else min(10.0, max(0.0, at[0])), None if at is None else min(20.0, max(0.0, at[1])), seen))
        state.update((*[float(v) for v in track[:7]], int(track[7]), True) if track else (0.0,) * 7 + (0, False))
        yield pd.DataFrame(out, columns=["match_id", "frame_id", "x", "y", "visibility"])

    return raw.groupBy("match_id").applyInPandasWithState(run, "match_id long, frame_id long, x double, y double, visibility string", _STATE, "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, window: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Counts by type in event-time windows; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def play_sessions(frames: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Live play sessions by match (ts: timestamp). A pause of exactly ``gap`` still joins here; the batch rule cuts there."""
    return frames.withWatermark("ts", late).groupBy("match_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames")).select("match_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")
