"""Rally, player, team and match metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Shot types that attack and that defend; others are neutral.
ATTACK = ("smash", "smash_x3", "smash_x4", "bandeja", "vibora", "volley", "drop_shot")
DEFENSE = ("lob", "wall_return", "contra_pared")
NET_LOW, NET_HIGH, APPROACH = 3.0, 17.0, 7.0


def _turns(flags):
    """Changes from one element of an array to the next."""
    return F.size(F.filter(F.zip_with(F.slice(flags, 2, F.size(flags)), flags, lambda a, b: a != b), lambda x: x)).cast("long")


def _attacks():
    """Attack or defence, of a group's shots in order; neutral shots are passed over."""
    attack = F.when(F.col("shot_type").isin(*ATTACK), True).when(F.col("shot_type").isin(*DEFENSE), False)
    listed = F.sort_array(F.collect_list(F.when(attack.isNotNull(), F.struct("timestamp_ms", "shot_id", attack.alias("attack")))))
    return F.transform(listed, lambda s: s["attack"])


def switches(shots: DataFrame, *by: str) -> DataFrame:
    """Changes between attack and defence in each group of ``by`` that has either."""
    return shots.groupBy(*by).agg(_attacks().alias("a")).where(F.size("a") > 0).select(*by, _turns(F.col("a")).alias("switches"))


def rally_metrics(shots: DataFrame) -> DataFrame:
    """One row for each point, folded from its own shots: a rally is a few dozen."""
    by = ("match_id", "point_id")
    walls = F.size(F.filter("trajectory", lambda b: b["type"].isin("back_wall", "side_wall")))
    m = shots.groupBy(*by).agg(
        F.count("*").alias("rally_length"), F.first("duration_ms").alias("duration_ms"), F.count_if(F.col("position.y") >= APPROACH).alias("net_approaches"), F.sum(walls).alias("wall_bounces"), _attacks().alias("a")
    )
    return m.select(*by, "rally_length", "duration_ms", "net_approaches", "wall_bounces", _turns(F.col("a")).alias("attack_defense_switches"))


def player_shots(shots: DataFrame) -> DataFrame:
    c = lambda o: F.count_if(F.col("outcome") == o)
    return shots.groupBy("match_id", "player_id").agg(
        F.count("*").alias("total_shots"), c("winner").alias("winners"), c("error").alias("errors"), c("forced_error").alias("forced_errors"), (F.count_if(F.col("shot_type") == "serve") / F.count("*")).alias("serve_percentage")
    )


def shot_types(shots: DataFrame) -> DataFrame:
    """(match, player, type): how many, and the share that won."""
    return shots.groupBy("match_id", "player_id", "shot_type").agg(F.count("*").alias("shots"), (F.count_if(F.col("outcome") == "winner") / F.count("*")).alias("success"))


def distance(players: DataFrame) -> DataFrame:
    """Metres each player covers; frames without a position are bridged; null under two positions."""
    w = Window.partitionBy("match_id", "player_id").orderBy("frame_id")
    p = players.where("position is not null").select("match_id", "player_id", "frame_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"))
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    p = p.withColumn("step", F.sqrt(dx * dx + dy * dy))
    return p.groupBy("match_id", "player_id").agg(F.when(F.count("*") >= 2, F.sum("step")).alias("distance"), F.avg("y").alias("depth"))


def player_metrics(shots: DataFrame, players: DataFrame) -> DataFrame:
    """Players with shots, their counts, and what they moved. Shots are read once: counts by type add up to the player's."""
    by = ["match_id", "player_id"]
    c = lambda o: F.count_if(F.col("outcome") == o)
    kinds = shots.groupBy(*by, "shot_type").agg(F.count("*").alias("n"), c("winner").alias("w"), c("error").alias("e"), c("forced_error").alias("f"))
    listed = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("shot_type", v))))
    counts = kinds.groupBy(*by).agg(
        F.sum("n").alias("total_shots"), F.sum("w").alias("winners"), F.sum("e").alias("errors"), F.sum("f").alias("forced_errors"),
        (F.sum(F.when(F.col("shot_type") == "serve", F.col("n")).otherwise(0)) / F.sum("n")).alias("serve_percentage"),
        listed(F.col("n").alias("shots")).alias("shot_type_counts"), listed((F.col("w") / F.col("n")).alias("success")).alias("shot_type_success"),
    )
    return counts.join(distance(players), by, "left")


def members(players: DataFrame) -> DataFrame:
    """Everyone seen with a team in any frame belongs to it."""
    return players.where("team_id is not null").select("match_id", "team_id", "player_id").distinct()


def team_frames(players: DataFrame) -> DataFrame:
    """All frames of each team's members, whatever team the frame says; one scan."""
    teams = F.collect_set("team_id").over(Window.partitionBy("match_id", "player_id"))
    p = players.select("match_id", "player_id", "frame_id", "ord", F.col("position.x").alias("x"), F.col("position.y").alias("y"), teams.alias("teams"))
    return p.select("match_id", F.explode("teams").alias("team_id"), "player_id", "frame_id", "ord", "x", "y")


def net_control(players: DataFrame) -> DataFrame:
    """Share of a team's frames in which a member is within the band."""
    inside = F.coalesce(F.bool_or(F.col("y").between(NET_LOW, NET_HIGH)), F.lit(False)).cast("double")
    f = team_frames(players).groupBy("match_id", "team_id", "frame_id").agg(inside.alias("inside"))
    return f.groupBy("match_id", "team_id").agg(F.avg("inside").alias("net_control_pct"))


def formations(players: DataFrame) -> DataFrame:
    """(match, team, frame): members with a position, in listed order and from left to right."""
    f = team_frames(players).where("x is not null").groupBy("match_id", "team_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("listed"), F.sort_array(F.collect_list(F.struct("x", "ord", "player_id"))).alias("across"))
    return f.where(F.size("listed") >= 2)


def pair_distance(players: DataFrame) -> DataFrame:
    a, b = F.col("listed")[0], F.col("listed")[1]
    d = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    return formations(players).groupBy("match_id", "team_id").agg(F.avg(d).alias("avg_pair_distance"))


def formation_switches(players: DataFrame) -> DataFrame:
    w = Window.partitionBy("match_id", "team_id").orderBy("frame_id")
    f = formations(players).withColumn("order", F.transform("across", lambda s: s["player_id"]))
    f = f.withColumn("turn", F.coalesce((F.lag("order").over(w) != F.col("order")).cast("long"), F.lit(0)))
    return f.groupBy("match_id", "team_id").agg(F.sum("turn").alias("formation_switches"))


def team_shots(shots: DataFrame, players: DataFrame) -> DataFrame:
    """Wall play and won attacks of each team's members; null without shots of the kind."""
    s = shots.drop("team_id").join(members(players), ["match_id", "player_id"])
    attack = F.col("shot_type").isin(*ATTACK)
    return s.groupBy("match_id", "team_id").agg(
        F.avg(F.col("shot_type").isin("wall_return", "contra_pared").cast("double")).alias("wall_utilization"), F.avg(F.when(attack, (F.col("outcome") == "winner").cast("double"))).alias("transition_efficiency")
    )


def team_play(players: DataFrame) -> DataFrame:
    """(match, team): net control, pair distance and formation switches from one pass over the team's frames."""
    by = ["match_id", "team_id"]
    inside = F.coalesce(F.bool_or(F.col("y").between(NET_LOW, NET_HIGH)), F.lit(False)).cast("double")
    placed = F.col("x").isNotNull()
    listed, across = (F.sort_array(F.collect_list(F.when(placed, F.struct(*c)))) for c in (("ord", "x", "y"), ("x", "ord", "player_id")))
    f = team_frames(players).groupBy(*by, "frame_id").agg(inside.alias("inside"), listed.alias("listed"), across.alias("across"))
    pair = F.size("listed") >= 2
    a, b = F.get("listed", F.lit(0)), F.get("listed", F.lit(1))
    d = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    f = f.withColumn("d", F.when(pair, d)).withColumn("order", F.when(pair, F.transform("across", lambda s: s["player_id"])))
    before = F.expr("lag(order) ignore nulls over (partition by match_id, team_id order by frame_id)")
    f = f.withColumn("turn", F.when(pair, F.coalesce((before != F.col("order")).cast("long"), F.lit(0))))
    return f.groupBy(*by).agg(F.avg("inside").alias("net_control_pct"), F.avg("d").alias("avg_pair_distance"), F.sum("turn").alias("formation_switches"))


def team_metrics(shots: DataFrame, players: DataFrame) -> DataFrame:
    return team_play(players).join(team_shots(shots, players), ["match_id", "team_id"], "left")


def match_rollup(shots: DataFrame, players: DataFrame) -> DataFrame:
    """Everything known of a match in long form: (match_id, kind, name, metric, value), null values left out."""
    long = lambda df, kind, name, cols: df.select("match_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in cols)), F.array(*(F.col(c).cast("double") for c in cols)))).alias("metric", "value"))
    out = long(rally_metrics(shots), "rally", "point_id", ("rally_length", "duration_ms", "net_approaches", "wall_bounces", "attack_defense_switches"))
    p = player_metrics(shots, players)
    out = out.unionByName(long(p, "player", "player_id", ("total_shots", "winners", "errors", "forced_errors", "serve_percentage", "distance", "depth")))
    out = out.unionByName(long(team_metrics(shots, players), "team", "team_id", ("net_control_pct", "avg_pair_distance", "formation_switches", "wall_utilization", "transition_efficiency")))
    return out.where("value is not null")
