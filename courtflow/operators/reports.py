"""What reports, charts and overlays show, as tables; and reports as JSON and HTML."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import nearest


def summary(rallies: DataFrame) -> DataFrame:
    """One row for each match: points, mean rally length, mean duration in seconds, wall bounces."""
    return rallies.groupBy("match_id").agg(F.count("*").alias("points"), F.avg("rally_length").alias("avg_rally"), (F.avg("duration_ms") / 1000).alias("avg_duration_s"), F.sum("wall_bounces").alias("wall_bounces"))


def rally_histogram(rallies: DataFrame) -> DataFrame:
    return rallies.groupBy("match_id", "rally_length").agg(F.count("*").alias("rallies"))


def net_control_chart(teams: DataFrame) -> DataFrame:
    return teams.where("net_control_pct is not null").select("match_id", "team_id", (F.col("net_control_pct") * 100).alias("pct"))


def animation_frames(ball: DataFrame, players: DataFrame, shots: DataFrame, fps: float = 25.0) -> DataFrame:
    """Everything with a place in each frame; the ball is a star on the ball frame nearest to a shot."""
    at = lambda df, who: df.where("position is not null").select("match_id", "frame_id", who.alias("entity"), F.col("position.x").alias("x"), F.col("position.y").alias("y"))
    rows = at(players, F.col("player_id")).unionByName(at(ball, F.lit("ball")))
    s = nearest(shots.select("match_id", F.col("timestamp_ms").alias("s_ms")), ball.select("match_id", "timestamp_ms", "frame_id"), "s_ms", "timestamp_ms", "frame_id")
    rows = rows.join(s.select("match_id", "frame_id", F.lit(True).alias("_hit")).distinct(), ["match_id", "frame_id"], "left")
    return rows.select("match_id", "frame_id", "entity", "x", "y", F.when(F.col("_hit") & (F.col("entity") == "ball"), "star").otherwise("circle").alias("marker"), F.lit(int(1000 // fps)).alias("duration_ms"))


def active_bounces(ball: DataFrame, bounces: DataFrame, fps: int = 25) -> DataFrame:
    """(match_id, frame_id, bounce, progress): each bounce on the second of frames from its own on; its frame is rounded half to even."""
    b = bounces.select("match_id", F.col("idx").alias("bounce"), F.bround(F.col("timestamp_ms") / (1000.0 / fps)).cast("long").alias("at"))
    shown = b.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fps - 1).cast("long")))).withColumn("frame_id", F.col("at") + F.col("step"))
    return ball.select("match_id", "frame_id").join(shown, ["match_id", "frame_id"]).select("match_id", "frame_id", "bounce", (F.col("step") / float(fps)).alias("progress"))


def shot_type_chart(players: DataFrame) -> DataFrame:
    """(match_id, player_id, shot_type, shots) of player metrics, out of their maps."""
    return players.select("match_id", "player_id", F.explode("shot_type_counts").alias("shot_type", "shots"))


def outcome_chart(players: DataFrame) -> DataFrame:
    return players.select("match_id", "player_id", "winners", "errors")


def bounce_rings(active: DataFrame) -> DataFrame:
    """Radius, opacity and label of each bounce shown, from its progress in 0..1."""
    p = F.col("progress")
    return active.select("match_id", "frame_id", "bounce", (12 + 8 * p).cast("int").alias("radius"), (1 - p).alias("alpha"), (p < 0.5).alias("labelled"))


def trajectory_lines(ball: DataFrame, last: int = 30) -> DataFrame:
    """Each visible ball place with the ones before it, up to ``last``."""
    w = Window.partitionBy("match_id").orderBy("frame_id").rowsBetween(-(last - 1), 0)
    b = ball.where("visibility = 'visible' and position is not null")
    return b.select("match_id", "frame_id", F.collect_list(F.struct("position.x", "position.y")).over(w).alias("line"))


def match_json(match_id: str, rallies: DataFrame, players: DataFrame, teams: DataFrame) -> dict:
    """One match's analytics: a few rows, gathered."""
    rows = lambda df: [json.loads(x) for x in df.drop("match_id").toJSON().collect()]
    return {"match_id": match_id, "rally_metrics": rows(rallies.orderBy("point_id")), "player_metrics": rows(players.orderBy("player_id")), "team_metrics": rows(teams.orderBy("team_id"))}


def write_json(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2))


def _table(head: list[str], rows: list[list], empty: str) -> str:
    if not rows:
        return f"<p>{empty}</p>"
    cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(cell("th", h) for h in head) + f"</tr>{body}</table>"


def to_html(report: dict) -> str:
    """Summary, players and teams as tables; what is not known shows as a dash."""
    known = lambda v, f: "—" if v is None else f.format(v)
    rallies, n = report["rally_metrics"], max(1, len(report["rally_metrics"]))
    mean = lambda k: sum(r[k] for r in rallies) / n
    top = [["Points", len(rallies)], ["Average rally", f"{mean('rally_length'):.1f}"], ["Average duration (s)", f"{mean('duration_ms') / 1000:.1f}"], ["Wall bounces", sum(r["wall_bounces"] for r in rallies)]] if rallies else []
    players = [[p["player_id"], p["total_shots"], p["winners"], p["errors"], known(p.get("serve_percentage") and p["serve_percentage"] * 100, "{:.0f}%"), known(p.get("distance"), "{:.1f}")] for p in report["player_metrics"]]
    teams = [[t["team_id"], *(known(t.get(k), "{:.2f}") for k in ("net_control_pct", "avg_pair_distance", "wall_utilization", "transition_efficiency")), t.get("formation_switches", 0)] for t in report["team_metrics"]]
    return (
        f"<html><body><h1>Match {html.escape(report['match_id'])}</h1>" + _table(["Metric", "Value"], top, "No rally data available.")
        + _table(["Player", "Shots", "Winners", "Errors", "Serves", "Distance (m)"], players, "No player data available.")
        + _table(["Team", "Net control", "Pair distance", "Wall use", "Transition", "Formation switches"], teams, "No team data available.") + "</body></html>"
    )
