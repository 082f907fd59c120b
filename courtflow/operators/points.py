"""Points: play between pauses, and the shots in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import sessions


def boundaries(ball: DataFrame, gap_ms: float = 3000.0, least_ms: float = 500.0) -> DataFrame:
    """Runs of visible frames without a pause of ``gap_ms``, ``least_ms`` long at least."""
    return sessions(ball.where(F.col("visibility") == "visible").select("match_id", "timestamp_ms"), "timestamp_ms", gap_ms, least_ms)


def point_shots(shots: DataFrame, bounds: DataFrame, match_set: int = 1, game: int = 1) -> DataFrame:
    """Shots in the points of ``bounds`` (match_id, point, start_ms, end_ms): of ``boundaries`` or any other rule."""
    spans = bounds.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(F.col("point").cast("int").alias("point"), "start_ms", "end_ms"))).alias("sessions"))
    return in_points(shots.drop("sessions").join(spans, "match_id", "left"), match_set, game)


def in_points(shots: DataFrame, match_set: int = 1, game: int = 1) -> DataFrame:
    """Shots with their match's ``sessions`` in points, renumbered, with serve and outcome marked. Shots outside all points go.

    Both bounds are inclusive. Where a match has no session, all its shots are one
    point that lasts from the first to the last. Nothing is shuffled if the shots
    lie by match already.
    """
    whole = Window.partitionBy("match_id")
    alone = F.array(F.struct(F.lit(1).alias("point"), F.min("timestamp_ms").over(whole).alias("start_ms"), F.max("timestamp_ms").over(whole).alias("end_ms")))
    s = shots.withColumn("sessions", F.when(F.size(F.coalesce("sessions", F.array())) > 0, F.col("sessions")).otherwise(alone))
    s = s.withColumn("b", F.explode(F.filter("sessions", lambda p: F.col("timestamp_ms").between(p["start_ms"], p["end_ms"])))).withColumn("point", F.col("b.point"))
    w = Window.partitionBy("match_id", "point").orderBy("timestamp_ms", "n")
    s = s.withColumn("rn", F.row_number().over(w)).withColumn("cnt", F.count("*").over(Window.partitionBy("match_id", "point")))
    point_id = F.format_string(f"S_{match_set:03d}_{game:02d}_%02d", F.col("point"))
    first_unknown = (F.col("rn") == 1) & (F.col("shot_type") == "unknown")
    return s.select(
        "match_id", "point", point_id.alias("point_id"), F.concat(point_id, F.format_string("_%03d", F.col("rn"))).alias("shot_id"), "timestamp_ms", "player_id", "team_id", "position",
        F.when(first_unknown, "serve").otherwise(F.col("shot_type")).alias("shot_type"), "trajectory", F.when(F.col("rn") == F.col("cnt"), "winner").otherwise("next_shot").alias("outcome"), "confidence", "rn", (F.col("b.end_ms") - F.col("b.start_ms")).alias("duration_ms"),
    )


def points(shots_in_points: DataFrame) -> DataFrame:
    """One row for each point with shots: the last shot's team wins."""
    last = F.max(F.struct("rn", "team_id")).alias("last")
    p = shots_in_points.groupBy("match_id", "point_id").agg(last, F.first("duration_ms").alias("duration_ms"), F.count("*").alias("rally_length"))
    return p.select("match_id", "point_id", F.col("last.team_id").alias("winner_team_id"), "duration_ms", "rally_length")
