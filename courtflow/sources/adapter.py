"""Tracking views over the ``events`` table: integer arithmetic and one final division, equal in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES_A_MATCH = 500


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", k.alias("k"))
    return base.selectExpr("event_id div 500 as match_id", "event_id % 500 as frame_id", "k", "(event_id % 500) * 40.0D + ((event_id % 500) div 125) * 4000.0D as timestamp_ms")


def ball_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: the ball moves straight between waypoints, eight frames a leg."""
    wx, wy = "(({q} * 7919 + match_id * 104729 + {q} * {q} * 131) % 10001)", "(({q} * {q} * 613 + {q} * 7907 + match_id * 3571) % 20001)"
    leg = events(spark, sf_dir).selectExpr("*", "frame_id div 8 as s", "frame_id % 8 as ph")
    leg = leg.selectExpr("*", "s - (s % 6) div 5 as a", "(s + 1) - ((s + 1) % 6) div 5 as b")
    at = lambda w: f"if(k < 5, null, ({w.format(q='a')} * 8 + ({w.format(q='b')} - {w.format(q='a')}) * ph) / 8000.0D)"
    rows = leg.selectExpr("match_id", "frame_id", "timestamp_ms", "k", f"{at(wx)} as x", f"{at(wy)} as y")
    return rows.selectExpr(
        "match_id", "frame_id", "timestamp_ms",
        "if(k < 5, null, named_struct('x1', 100 * x - 4, 'y1', 50 * y - 4, 'x2', 100 * x + 4, 'y2', 50 * y + 4)) as bbox",
        "if(k < 5, null, named_struct('x', x, 'y', y, 'z', if(k % 10 = 0, 2.0D, 0.0D))) as position",
        "if(k < 5, 0.0D, (100 - k) / 100.0D) as confidence",
        "case when k < 5 then 'occluded' when k < 12 then 'inferred' else 'visible' end as visibility",
    )


def player_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows for each event."""
    rows = events(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("p"))
    rows = rows.selectExpr(
        "*",
        "if((frame_id + p) % 37 = 0, null, abs((frame_id * (30 + 10 * p) + p * 2500 + match_id * 300) % 20000 - 10000) / 1000.0D) as x",
        "abs((frame_id * (20 + 5 * p) + p * 1900) % 20000 - 10000) as t",
        "270 - ((13 * frame_id + 29 * p + 7 * match_id) % 160) as wy", "(17 * frame_id + 11 * p) % 70 as g", "(19 * frame_id + 5 * p) % 61 - 30 as h",
    ).selectExpr("*", "if(x is null, null, if(p <= 2, t / 1000.0D, (20000 - t) / 1000.0D)) as y")
    kp = lambda name, x, y, c="0.9D": f"named_struct('name', '{name}', 'x', cast({x} as double), 'y', cast({y} as double), 'confidence', {c})"
    points = [
        kp("left_shoulder", 400, 250), kp("right_shoulder", 500, 250), kp("left_wrist", 380, "wy", "if((frame_id + p) % 23 = 0, 0.2D, 0.9D)"), kp("right_wrist", 520, "wy"),
        kp("left_elbow", "380 - g", "(wy + 250) / 2"), kp("right_elbow", "520 + g", "(wy + 250) / 2"), kp("left_hip", "420 + h", 350), kp("right_hip", "480 + h", 350),
    ]
    return rows.selectExpr(
        "match_id", "frame_id", "timestamp_ms", "concat('P_00', p) as player_id", "p as ord",
        "case when frame_id % 50 = 0 then null when p <= 2 or (p = 3 and frame_id % 200 = 7) then 'T_1' else 'T_2' end as team_id",
        "named_struct('x1', if(x is null, 0.0D, 100 * x - 30), 'y1', if(x is null, 0.0D, 50 * y - 150), 'x2', if(x is null, 0.0D, 100 * x + 30), 'y2', if(x is null, 0.0D, 50 * y)) as bbox",
        "if(x is null, null, named_struct('x', x, 'y', y)) as position",
        "(60 + (frame_id * 7 + p * 13) % 40) / 100.0D as confidence", f"array({', '.join(points)}) as keypoints",
    )


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("match_id").distinct().selectExpr(
        "match_id", "1000 as frame_width", "1000 as frame_height", "array(array(0.01D, 0.0D, 0.0D), array(0.0D, 0.02D, 0.0D), array(0.0D, 0.0D, 1.0D)) as homography", "((match_id * 37) % 100) / 1000.0D as reprojection_error"
    )


#: The same views as DuckDB SQL, flat columns; each may read the ones before it.
SQL = {
    "ev": "select event_id // 500 as match_id, event_id % 500 as frame_id, cast(json_extract_string(props, '$.k') as bigint) as k, (event_id % 500) * cast(40 as double) + ((event_id % 500) // 125) * cast(4000 as double) as ts from events",
    "leg": "select *, s - (s % 6) // 5 as a, (s + 1) - ((s + 1) % 6) // 5 as b from (select *, frame_id // 8 as s, frame_id % 8 as ph from ev)",
    "way": "select *, (a * 7919 + match_id * 104729 + a * a * 131) % 10001 as xa, (b * 7919 + match_id * 104729 + b * b * 131) % 10001 as xb, (a * a * 613 + a * 7907 + match_id * 3571) % 20001 as ya, (b * b * 613 + b * 7907 + match_id * 3571) % 20001 as yb from leg",
    "ball": "select match_id, frame_id, ts, case when k >= 5 then (xa * 8 + (xb - xa) * ph) / cast(8000 as double) end as x, case when k >= 5 then (ya * 8 + (yb - ya) * ph) / cast(8000 as double) end as y, case when k < 5 then null when k % 10 = 0 then cast(2 as double) else cast(0 as double) end as z, case when k < 5 then cast(0 as double) else (100 - k) / cast(100 as double) end as conf, case when k < 5 then 'occluded' when k < 12 then 'inferred' else 'visible' end as vis from way",
    "pl0": "select ev.*, p, case when (frame_id + p) % 37 <> 0 then abs((frame_id * (30 + 10 * p) + p * 2500 + match_id * 300) % 20000 - 10000) / cast(1000 as double) end as x, abs((frame_id * (20 + 5 * p) + p * 1900) % 20000 - 10000) as t, 270 - ((13 * frame_id + 29 * p + 7 * match_id) % 160) as wy, (17 * frame_id + 11 * p) % 70 as g, (19 * frame_id + 5 * p) % 61 - 30 as h from ev, (select unnest([1, 2, 3, 4]) as p)",
    "players": "select match_id, frame_id, ts, 'P_00' || p as player_id, p as ord, case when frame_id % 50 = 0 then null when p <= 2 or (p = 3 and frame_id % 200 = 7) then 'T_1' else 'T_2' end as team_id, x, case when x is null then null when p <= 2 then t / cast(1000 as double) else (20000 - t) / cast(1000 as double) end as y, (60 + (frame_id * 7 + p * 13) % 40) / cast(100 as double) as conf, wy, g, h, (frame_id + p) % 23 = 0 as weak from pl0",
}
