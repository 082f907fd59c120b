"""The engine's queries over the adapter views, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.court import adjugate, determinant, foot, line_intersection, mini_court, project
from ..functions.sequence import as_of, nearest
from ..operators import events as E
from ..operators import heatmap as H
from ..operators import metrics as M
from ..operators import points as P
from ..operators import reports as V
from ..operators import tracking as T
from ..sources import adapter as A

R = 6  # decimals kept of computed values, so that the order of a sum doesn't show


def r(c, name: str | None = None, digits: int = R):
    col = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return col.alias(name or c)


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return A.ball_frames(spark, d), A.player_frames(spark, d)


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return E.shots(*_all(spark, d))


def _point_shots(spark: SparkSession, d: str) -> DataFrame:
    return P.in_points(E.play_shots(E.match_play(*_all(spark, d))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the rules as SQL: each text may read those before it ------------------------------------
CTES = dict(A.SQL)
CTES |= {
    "idx": "select *, row_number() over (partition by match_id order by frame_id) - 1 as idx from ball",
    "seen": "select * from idx where vis = 'visible' and x is not null and conf >= 0.1",
    "rev0": "select *, row_number() over w - 1 as k, count(*) over (partition by match_id) as n, (x - lag(x, 2) over w) / 2 as xb, (lead(x, 2) over w - x) / 2 as xa, (y - lag(y, 2) over w) / 2 as yb, (lead(y, 2) over w - y) / 2 as ya from seen window w as (partition by match_id order by idx)",
    "cand": "select match_id, idx, frame_id, ts, x, y, z, row_number() over (partition by match_id order by idx) as rn from rev0 where n >= 7 and k between 2 and n - 4 and ((sign(xb) <> sign(xa) and abs(xb) > 0.3 and abs(xa) > 0.3) or (sign(yb) <> sign(ya) and abs(yb) > 0.3 and abs(ya) > 0.3))",
    "keptb": "select match_id, rn, idx, idx as last, true as kept from cand where rn = 1 union all select c.match_id, c.rn, c.idx, case when c.idx - k.last >= 8 then c.idx else k.last end, c.idx - k.last >= 8 from keptb k join cand c on c.match_id = k.match_id and c.rn = k.rn + 1",
    "bnc": "select c.*, case when abs(y - 10) < 0.5 then 'net' when (y < 0.8 or y > cast(20 as double) - cast(0.8 as double)) and (x < 0.8 or x > cast(10 as double) - cast(0.8 as double)) then 'corner' when y < 0.8 or y > cast(20 as double) - cast(0.8 as double) then case when coalesce(z, 0) > 1 then 'back_wall' else 'back_fence' end when x < 0.8 or x > cast(10 as double) - cast(0.8 as double) then case when coalesce(z, 0) > 1 then 'side_wall' else 'side_fence' end else 'ground' end as type from cand c join keptb k using (match_id, rn) where k.kept",
    "turn0": "select *, (lead(x) over w - x) - (x - lag(x) over w) as ax, (lead(y) over w - y) - (y - lag(y) over w) as ay from idx where vis <> 'inferred' and x is not null window w as (partition by match_id order by idx)",
    "turn": "select *, sqrt(ax * ax + ay * ay) as dv from turn0 where sqrt(ax * ax + ay * ay) >= 0.5",
    "near0": "select t.match_id, t.idx, t.frame_id, t.ts, t.x, t.y, t.dv, p.player_id, p.team_id, p.x as px, p.y as py, p.ord, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) as dist from turn t join players p using (match_id, frame_id) where p.x is not null",
    "near1": "select *, row_number() over (partition by match_id, idx order by dist, ord) as pr from near0 where dist <= 2",
    "near": "select *, row_number() over (partition by match_id order by ts, idx) as rn from near1 where pr = 1",
    "keptc": "select match_id, rn, ts, ts as last, true as kept from near where rn = 1 union all select c.match_id, c.rn, c.ts, case when c.ts - k.last >= 300 then c.ts else k.last end, c.ts - k.last >= 300 from keptc k join near c on c.match_id = k.match_id and c.rn = k.rn + 1",
    "con": "select c.match_id, c.idx, c.frame_id, c.ts, c.x, c.y, c.px, c.py, c.player_id, c.team_id, c.dist, least(1, c.dv / 1.5) as conf, row_number() over w as n, lag(c.ts) over w as prev_ts, lead(c.ts) over w as next_ts from near c join keptc k using (match_id, rn) where k.kept window w as (partition by c.match_id order by c.ts)",
    "trj": "select c.match_id, c.n, b.ts as b_ts, b.type, b.x as bx, b.y as by_ from con c join bnc b on b.match_id = c.match_id and b.ts >= c.ts and (c.next_ts is null or b.ts < c.next_ts)",
    "bfr": "select c.match_id, c.n, b.ts as b_ts, b.type from con c join bnc b on b.match_id = c.match_id and b.ts < c.ts and (c.prev_ts is null or b.ts > c.prev_ts)",
    "aft": "select c.match_id, c.n, i.idx - c.idx as o, i.x, i.y from con c join idx i on i.match_id = c.match_id and i.idx between c.idx and c.idx + 29",
    "aft2": "select *, lag(x) over w as lx, lag(y) over w as ly from aft where x is not null window w as (partition by match_id, n order by o)",
    "path": "select match_id, n, count(*) filter (o < 10) as n10, coalesce(sum(sqrt(pow(x - lx, 2) + pow(y - ly, 2))) filter (o < 10 and lx is not null), 0) as len10, count(*) filter (o < 15) as n15, abs(arg_max(y, o) filter (o < 15) - arg_min(y, o) filter (o < 15)) as rise15, arg_max(y, o) filter (o < 10) as end10, bool_or((y < 0.5 or y > 19.5 or x < 0.5 or x > 9.5)) filter (o < 20) as leaves from aft2 group by match_id, n",
    "pose": "select c.*, p.wy, p.g, p.h, p.weak, path.* exclude (match_id, n), exists (select 1 from bfr where bfr.match_id = c.match_id and bfr.n = c.n and type = 'ground') as ground, exists (select 1 from bfr where bfr.match_id = c.match_id and bfr.n = c.n and type in ('back_wall', 'side_wall', 'back_fence', 'side_fence', 'corner')) as wall from con c join players p on p.match_id = c.match_id and p.frame_id = c.frame_id and p.player_id = c.player_id left join path on path.match_id = c.match_id and path.n = c.n",
    "feat": "select *, case when weak then 0 else 250 - wy end as diff, not weak and 250 - wy > 0 as over_, coalesce(n10, 0) >= 2 and len10 < 2 as short_, coalesce(n15, 0) >= 3 and rise15 > 3 as lob, coalesce(n10, 0) >= 2 and abs(end10 - 10) < abs(py - 10) as chq, not weak and abs(380 - (380 - g)) > 40 as spin, weak or abs(520 - (450 + h)) > abs(380 - (450 + h)) as fh from pose",
    "kind": "select *, case when not ground then case when over_ then case when diff > 50 then case when coalesce(leaves, false) then 'smash_x3' else 'smash' end when spin then 'vibora' else 'bandeja' end when short_ then 'drop_shot' else 'volley' end when wall then case when py < 3 or py > 17 then case when lob then 'lob' else 'contra_pared' end else 'wall_return' end when over_ then case when lob then 'lob' else 'bajada' end when chq then 'chiquita' when fh then 'groundstroke_fh' else 'groundstroke_bh' end as shot_type from feat",
    "shot": "select match_id, n, ts, player_id, coalesce(team_id, 'T_UNKNOWN') as team_id, x, y, shot_type, conf * case when shot_type in ('smash_x3', 'bandeja', 'volley') then 0.7 when shot_type = 'smash' then 0.75 when shot_type in ('vibora', 'drop_shot', 'groundstroke_fh', 'groundstroke_bh') then 0.65 when shot_type = 'lob' and wall then 0.65 else 0.6 end as confidence from kind",
    "gap": "select match_id, ts, sum(case when ts - pts >= 3000 then 1 else 0 end) over (partition by match_id order by ts) as s from (select match_id, ts, lag(ts) over (partition by match_id order by ts) as pts from ball where vis = 'visible')",
    "bound": "select match_id, row_number() over (partition by match_id order by min(ts)) as point, min(ts) as a, max(ts) as b from gap group by match_id, s having max(ts) - min(ts) >= 500",
    "ps": "select s.match_id, b.point, b.b - b.a as duration, s.n, s.ts, s.player_id, s.team_id, s.x, s.y, s.shot_type, s.confidence, row_number() over (partition by s.match_id, b.point order by s.ts, s.n) as rn, count(*) over (partition by s.match_id, b.point) as cnt from shot s join bound b on b.match_id = s.match_id and s.ts between b.a and b.b",
    "pshot": "select *, case when rn = cnt then 'winner' else 'next_shot' end as outcome, printf('S_001_01_%02d', point) as point_id, printf('S_001_01_%02d_%03d', point, rn) as shot_id from ps",
    "member": "select distinct match_id, team_id, player_id from players where team_id is not null",
    "tf": "select p.match_id, m.team_id, p.player_id, p.frame_id, p.ord, p.x, p.y from players p join member m on m.match_id = p.match_id and m.player_id = p.player_id",
    "listed": "select match_id, team_id, frame_id, list(x order by ord) as xs, list(y order by ord) as ys, list(player_id order by x, ord) as across from tf where x is not null group by match_id, team_id, frame_id having count(*) >= 2",
}
_ATT, _DEF = ", ".join(f"'{t}'" for t in M.ATTACK), ", ".join(f"'{t}'" for t in M.DEFENSE)
_KERNEL = H.kernel()


def sql(body: str, upto: str) -> str:
    names = list(CTES)
    return "with recursive " + ", ".join(f"{n} as ({CTES[n]})" for n in names[: names.index(upto) + 1]) + " " + body


def query(name: str, upto: str | None = None, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, upto) if upto else oracle
        return f

    return add


# ---- frames and geometry ---------------------------------------------------------------------
@query("ball_frames", "ball", "select match_id, frame_id, ts as timestamp_ms, x, y, z, conf as confidence, vis as visibility from ball")
def _(s, d):
    return A.ball_frames(s, d).select("match_id", "frame_id", "timestamp_ms", F.col("position.x").alias("x"), F.col("position.y").alias("y"), F.col("position.z").alias("z"), "confidence", "visibility")


@query("player_frames", "players", "select match_id, frame_id, player_id, team_id, x, y, round(conf, 6) as confidence from players")
def _(s, d):
    return E.flat_players(A.player_frames(s, d)).join(A.player_frames(s, d).select("match_id", "frame_id", "ord", "confidence"), ["match_id", "frame_id", "ord"]).select("match_id", "frame_id", "player_id", "team_id", F.col("px").alias("x"), F.col("py").alias("y"), r("confidence"))


@query("visible_ball", "ball", "select match_id, frame_id, x, y from ball where vis = 'visible' and x is not null and conf >= 0.1")
def _(s, d):
    return E.visible_ball(A.ball_frames(s, d)).select("match_id", "frame_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"))


@query("frame_stride", "ball", "select match_id, frame_id, x from ball where frame_id >= 30 and frame_id < 400 and (frame_id - 30) % 7 = 0")
def _(s, d):
    from ..sources.files import frame_range

    return frame_range(A.ball_frames(s, d), 30, 400, 7).select("match_id", "frame_id", F.col("position.x").alias("x"))


@query("pixel_to_court", "players", "select match_id, frame_id, player_id, round((100 * x) * 0.01, 6) as x, round((50 * y) * 0.02, 6) as y from players where x is not null")
def _(s, d):
    p = A.player_frames(s, d).where("position is not null").join(A.calibration(s, d), "match_id")
    at = p.select("match_id", "frame_id", "player_id", project(foot(F.col("bbox")), F.col("homography")).alias("p"))
    return at.select("match_id", "frame_id", "player_id", r("p.x", "x"), r("p.y", "y"))


@query("court_to_pixel", "ball", "select match_id, frame_id, round(x * 100, 6) as px, round(y * 50, 6) as py from ball where x is not null")
def _(s, d):
    b = A.ball_frames(s, d).where("position is not null").join(A.calibration(s, d), "match_id")
    at = b.select("match_id", "frame_id", project(F.col("position"), adjugate(F.col("homography"))).alias("p"))
    return at.select("match_id", "frame_id", r("p.x", "px"), r("p.y", "py"))


@query("homography_checks", None, "select distinct event_id // 500 as match_id, round(cast(0.0002 as double), 9) as det from events")
def _(s, d):
    return A.calibration(s, d).select("match_id", r(determinant(F.col("homography")), "det", 9))


@query("mini_court", "ball", "select match_id, frame_id, cast(trunc(x / 10 * 120) as int) as px, cast(trunc((1 - y / 20) * 240) as int) as py from ball where vis = 'visible' and x is not null")
def _(s, d):
    b = A.ball_frames(s, d).where("visibility = 'visible' and position is not null")
    return b.select("match_id", "frame_id", mini_court(F.col("position"), 120, 240).alias("m")).select("match_id", "frame_id", "m.px", "m.py")


@query(
    "ghost_filter_top4",
    "players",
    "select match_id, frame_id, ord, round(greatest(0, least(10, px)), 6) as x, round(greatest(0, least(20, py)), 6) as y from (select *, row_number() over (partition by match_id, frame_id order by conf desc, ord) as rk from (select match_id, frame_id, ord, conf, 100 * x * 0.01 as px, 50 * y * 0.02 as py from players where x is not null union all select match_id, frame_id, 5, cast(0.3 as double), cast(5 as double), cast(5 as double) from ev)) where rk <= 4",
)
def _(s, d):
    p = A.player_frames(s, d).where("position is not null").select("match_id", "frame_id", "ord", "bbox", "confidence")
    box = lambda x, y: F.struct(F.lit(100.0 * x - 30).alias("x1"), F.lit(50.0 * y - 150).alias("y1"), F.lit(100.0 * x + 30).alias("x2"), F.lit(50.0 * y).alias("y2"))
    ev = A.events(s, d).select("match_id", "frame_id")
    extra = ev.select("match_id", "frame_id", F.lit(5).cast("long").alias("ord"), box(5, 5).alias("bbox"), F.lit(0.3).alias("confidence"))
    ghost = ev.select("match_id", "frame_id", F.lit(6).cast("long").alias("ord"), box(-2, -2).alias("bbox"), F.lit(0.99).alias("confidence"))
    got = T.located(p.unionByName(extra).unionByName(ghost), A.calibration(s, d))
    return got.select("match_id", "frame_id", "ord", r("position.x", "x"), r("position.y", "y"))


# ---- bounces and contacts --------------------------------------------------------------------
@query("ball_velocity", "seen", "select match_id, frame_id, x - lag(x) over w as vx, y - lag(y) over w as vy from seen window w as (partition by match_id order by frame_id)")
def _(s, d):
    return E.velocity(A.ball_frames(s, d))


@query("bounce_candidates", "cand", "select match_id, idx, x, y from cand")
def _(s, d):
    return E.bounce_candidates(A.ball_frames(s, d)).select("match_id", "idx", "x", "y")


@query("bounces", "bnc", "select match_id, idx, ts as timestamp_ms, x, y, type from bnc")
def _(s, d):
    return E.bounces(A.ball_frames(s, d)).select("match_id", "idx", "timestamp_ms", "x", "y", "type")


@query("bounce_surface_counts", "bnc", "select type, count(*) as n from bnc group by type")
def _(s, d):
    return E.bounces(A.ball_frames(s, d)).groupBy("type").agg(F.count("*").alias("n"))


@query("contact_candidates", "turn", "select match_id, idx, round(dv, 6) as dv from turn")
def _(s, d):
    return E.contact_candidates(A.ball_frames(s, d)).select("match_id", "idx", r("dv"))


@query("contacts", "con", "select match_id, idx, ts as timestamp_ms, player_id, team_id, round(dist, 6) as dist, round(conf, 6) as confidence from con")
def _(s, d):
    return E.contacts(*_all(s, d)).select("match_id", "idx", "timestamp_ms", "player_id", "team_id", r("dist"), r("confidence"))


@query("nearest_player_distance", "players", "select b.match_id, b.frame_id, round(least(99, coalesce(min(sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y))), 99)), 6) as distance from ball b left join players p on p.match_id = b.match_id and p.frame_id = b.frame_id where b.x is not null group by b.match_id, b.frame_id")
def _(s, d):
    return E.nearest_player_distance(*_all(s, d)).select("match_id", "frame_id", r("distance"))


@query("shot_trajectories", "trj", "select match_id, n, b_ts as b_ms, type, bx, by_ as by from trj")
def _(s, d):
    ball, pl = _all(s, d)
    return E.trajectories(E.spans(E.contacts(ball, pl)), E.bounces(ball)).select("match_id", "n", "b_ms", "type", "bx", "by")


@query("bounces_before_contact", "bfr", "select match_id, n, b_ts as b_ms, type from bfr")
def _(s, d):
    ball, pl = _all(s, d)
    return E.bounces_before(E.spans(E.contacts(ball, pl)), E.bounces(ball))


@query("ball_after_contact", "aft", "select match_id, n, o, x, y from aft")
def _(s, d):
    ball, pl = _all(s, d)
    return E.frames_after(E.spans(E.contacts(ball, pl)), ball)


@query("shots_classified", "shot", "select match_id, printf('S_001_01_01_%03d', n) as shot_id, ts as timestamp_ms, player_id, team_id, x, y, shot_type, round(confidence, 6) as confidence from shot")
def _(s, d):
    return _shots(s, d).select("match_id", "shot_id", "timestamp_ms", "player_id", "team_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"), "shot_type", r("confidence"))


@query("shot_type_counts", "shot", "select shot_type, count(*) as n from shot group by shot_type")
def _(s, d):
    return _shots(s, d).groupBy("shot_type").agg(F.count("*").alias("n"))


@query("bounces_filtered", "con", "select match_id, idx, type from bnc where not exists (select 1 from con c where c.match_id = bnc.match_id and abs(bnc.ts - c.ts) < 200)")
def _(s, d):
    ball, pl = _all(s, d)
    return E.without_contacts(E.bounces(ball), E.contacts(ball, pl)).select("match_id", "idx", "type")


# ---- points and metrics ----------------------------------------------------------------------
@query("point_boundaries", "bound", "select match_id, point, a as start_ms, b as end_ms from bound")
def _(s, d):
    return P.boundaries(A.ball_frames(s, d))


@query("point_shots", "pshot", "select match_id, point_id, shot_id, ts as timestamp_ms, player_id, shot_type, outcome from pshot")
def _(s, d):
    return _point_shots(s, d).select("match_id", "point_id", "shot_id", "timestamp_ms", "player_id", "shot_type", "outcome")


@query("points", "pshot", "select match_id, point_id, arg_max(team_id, rn) as winner_team_id, any_value(duration) as duration_ms, count(*) as rally_length from pshot group by match_id, point_id")
def _(s, d):
    return P.points(_point_shots(s, d))


_SW = f"(select match_id, {{by}}, sum(case when pa <> att then 1 else 0 end) as sw from (select *, lag(att) over (partition by match_id, {{by}} order by ts, shot_id) as pa from (select *, shot_type in ({_ATT}) as att from pshot where shot_type in ({_ATT}, {_DEF}))) group by match_id, {{by}})"


@query(
    "rally_metrics",
    "pshot",
    f"select p.match_id, p.point_id, count(*) as rally_length, any_value(duration) as duration_ms, count(*) filter (y >= 7) as net_approaches, cast(coalesce(sum((select count(*) from trj where trj.match_id = p.match_id and trj.n = p.n and trj.type in ('back_wall', 'side_wall'))), 0) as bigint) as wall_bounces, cast(coalesce(any_value(sw), 0) as bigint) as attack_defense_switches from pshot p left join {_SW.format(by='point_id')} s on s.match_id = p.match_id and s.point_id = p.point_id group by p.match_id, p.point_id",
)
def _(s, d):
    return M.rally_metrics(_point_shots(s, d))


@query("attack_defense_switches", "pshot", f"select match_id, player_id, cast(sw as bigint) as switches from {_SW.format(by='player_id')}")
def _(s, d):
    return M.switches(_point_shots(s, d), "match_id", "player_id")


@query("player_metrics", "pshot", "select match_id, player_id, count(*) as total_shots, count(*) filter (outcome = 'winner') as winners, count(*) filter (outcome = 'error') as errors, count(*) filter (outcome = 'forced_error') as forced_errors, round(count(*) filter (shot_type = 'serve') / cast(count(*) as double), 6) as serve_percentage from pshot group by match_id, player_id")
def _(s, d):
    return M.player_shots(_point_shots(s, d)).withColumn("serve_percentage", F.round("serve_percentage", R))


@query("player_shot_types", "pshot", "select match_id, player_id, shot_type, count(*) as shots, round(count(*) filter (outcome = 'winner') / cast(count(*) as double), 6) as success from pshot group by all")
def _(s, d):
    return M.shot_types(_point_shots(s, d)).withColumn("success", F.round("success", R))


@query("player_distance", "players", "select match_id, player_id, round(sum(step), 4) as distance, round(avg(y), 6) as depth from (select *, sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as step from players where x is not null window w as (partition by match_id, player_id order by frame_id)) group by match_id, player_id")
def _(s, d):
    return M.distance(A.player_frames(s, d)).select("match_id", "player_id", r("distance", digits=4), r("depth"))


@query("team_net_control", "tf", "select match_id, team_id, round(avg(inside), 6) as net_control_pct from (select match_id, team_id, frame_id, case when coalesce(bool_or(y between 3 and 17), false) then 1.0 else 0.0 end as inside from tf group by match_id, team_id, frame_id) group by match_id, team_id")
def _(s, d):
    return M.net_control(A.player_frames(s, d)).withColumn("net_control_pct", F.round("net_control_pct", R))


@query("team_pair_distance", "listed", "select match_id, team_id, round(avg(sqrt((xs[1] - xs[2]) * (xs[1] - xs[2]) + (ys[1] - ys[2]) * (ys[1] - ys[2]))), 6) as avg_pair_distance from listed group by match_id, team_id")
def _(s, d):
    return M.pair_distance(A.player_frames(s, d)).withColumn("avg_pair_distance", F.round("avg_pair_distance", R))


@query("team_formation_switches", "listed", "select match_id, team_id, cast(sum(case when pa <> across then 1 else 0 end) as bigint) as formation_switches from (select *, lag(across) over (partition by match_id, team_id order by frame_id) as pa from listed) group by match_id, team_id")
def _(s, d):
    return M.formation_switches(A.player_frames(s, d))


@query("team_shot_indices", "member", f"select p.match_id, m.team_id, round(avg(case when shot_type in ('wall_return', 'contra_pared') then 1.0 else 0.0 end), 6) as wall_utilization, round(avg(case when shot_type in ({_ATT}) then case when outcome = 'winner' then 1.0 else 0.0 end end), 6) as transition_efficiency from pshot p join member m on m.match_id = p.match_id and m.player_id = p.player_id group by p.match_id, m.team_id")
def _(s, d):
    t = M.team_shots(_point_shots(s, d), A.player_frames(s, d))
    return t.select("match_id", "team_id", r("wall_utilization"), r("transition_efficiency"))


@query("match_analytics", "pshot", "select match_id, 'rallies' as metric, '' as name, cast(count(distinct point_id) as double) as value from pshot group by match_id union all select match_id, 'shots', player_id, cast(count(*) as double) from pshot group by match_id, player_id union all select match_id, 'winners', team_id, cast(count(*) filter (outcome = 'winner') as double) from pshot group by match_id, team_id")
def _(s, d):
    p = _point_shots(s, d)
    row = lambda g, metric, name, v: g.agg(v.cast("double").alias("value")).select("match_id", F.lit(metric).alias("metric"), (F.col(name) if name else F.lit("")).alias("name"), "value")
    out = row(p.groupBy("match_id"), "rallies", None, F.countDistinct("point_id"))
    out = out.unionByName(row(p.groupBy("match_id", "player_id"), "shots", "player_id", F.count("*")))
    return out.unionByName(row(p.groupBy("match_id", "team_id"), "winners", "team_id", F.count_if(F.col("outcome") == "winner")))


# ---- heatmaps --------------------------------------------------------------------------------
def _places(s, d):
    return A.player_frames(s, d).select("match_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"))


CTES["bin"] = "select match_id, greatest(0, least(99, cast(trunc(y / 20 * 99) as int))) as iy, greatest(0, least(49, cast(trunc(x / 10 * 49) as int))) as ix, count(*) as n from players where x is not null group by all"
CTES["tap"] = "select unnest(range(-6, 7)) as o, unnest([" + ", ".join(f"cast({w!r} as double)" for w in _KERNEL) + "]) as w"
CTES["sm1"] = "select match_id, case when iy + o < 0 then -(iy + o) - 1 when iy + o >= 100 then 199 - (iy + o) else iy + o end as iy, ix, sum(n * w) as v from bin, tap group by all"
CTES["sm2"] = "select match_id, iy, case when ix + o < 0 then -(ix + o) - 1 when ix + o >= 50 then 99 - (ix + o) else ix + o end as ix, sum(v * w) as v from sm1, tap group by all"


@query("heatmap_bins", "bin", "select match_id, iy, ix, n from bin")
def _(s, d):
    return H.bins(_places(s, d))


@query("heatmap_smoothed", "sm2", "select match_id, cast(iy as int) as iy, cast(ix as int) as ix, round(v / max(v) over (partition by match_id), 6) as value from sm2")
def _(s, d):
    return H.smooth(H.bins(_places(s, d))).select("match_id", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), r("value"))


@query("bounce_heatmap", "bnc", "select match_id, greatest(0, least(99, cast(trunc(y / 20 * 99) as int))) as iy, greatest(0, least(49, cast(trunc(x / 10 * 49) as int))) as ix, count(*) as n from bnc group by all")
def _(s, d):
    return H.bins(E.bounces(A.ball_frames(s, d)).select("match_id", "x", "y"))


@query("shot_heatmap", "shot", "select match_id, greatest(0, least(99, cast(trunc(y / 20 * 99) as int))) as iy, greatest(0, least(49, cast(trunc(x / 10 * 49) as int))) as ix, count(*) as n from shot group by all")
def _(s, d):
    return H.bins(_shots(s, d).select("match_id", F.col("position.x").alias("x"), F.col("position.y").alias("y")))


# ---- joins over time -------------------------------------------------------------------------
@query("active_shot_asof", "shot", "select b.match_id, b.frame_id, case when b.ts <= s.ts + 1500 then s.n end as n, case when b.ts <= s.ts + 1500 then s.shot_type end as shot_type from ball b asof left join shot s on s.match_id = b.match_id and s.ts <= b.ts")
def _(s, d):
    shots = _shots(s, d).select("match_id", "n", F.col("timestamp_ms").alias("s_ms"), "shot_type")
    frames = A.ball_frames(s, d).select("match_id", "frame_id", "timestamp_ms")
    got = as_of(frames, shots, "timestamp_ms", "s_ms", 1500.0)
    return got.select("match_id", "frame_id", "n", "shot_type")


@query("active_bounces", "bnc", "select b.match_id, cast(b.frame_id as bigint) as frame_id, n.idx as bounce, (b.frame_id - cast(round_even(n.ts / 40.0, 0) as bigint)) / cast(25 as double) as progress from ball b join bnc n on n.match_id = b.match_id and b.frame_id - cast(round_even(n.ts / 40.0, 0) as bigint) between 0 and 24")
def _(s, d):
    ball = A.ball_frames(s, d)
    return V.active_bounces(ball, E.bounces(ball))


@query("top_shot_types", "shot", "select match_id, shot_type, n from (select match_id, substring(shot_type, 1, 12) as shot_type, count(*) as n, row_number() over (partition by match_id order by count(*) desc, min(n)) as rk from shot group by match_id, shot.shot_type) where rk <= 4")
def _(s, d):
    g = _shots(s, d).groupBy("match_id", "shot_type").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    w = Window.partitionBy("match_id").orderBy(F.desc("c"), "first")
    return g.withColumn("rk", F.row_number().over(w)).where("rk <= 4").select("match_id", F.substring("shot_type", 1, 12).alias("shot_type"), F.col("c").alias("n"))


@query("nearest_frame", "con", "select c.match_id, c.n, min(struct_pack(d := abs(b.ts - (c.ts + 13)), f := b.frame_id)).f as frame_id from con c join ball b on b.match_id = c.match_id group by c.match_id, c.n")
def _(s, d):
    ball, pl = _all(s, d)
    c = E.spans(E.contacts(ball, pl)).select("match_id", "n", (F.col("timestamp_ms") + 13).alias("at"))
    return nearest(c, ball.select("match_id", "timestamp_ms", "frame_id"), "at", "timestamp_ms", "frame_id").select("match_id", "n", "frame_id")


@query("best_calibration", None, "select min(struct_pack(e := ((m * 37) % 100) / cast(1000 as double), m := m)).m as match_id, min(((m * 37) % 100) / cast(1000 as double)) as reprojection_error from (select distinct event_id // 500 as m from events)")
def _(s, d):
    best = A.calibration(s, d).agg(F.min(F.struct("reprojection_error", "match_id")).alias("b"))
    return best.select("b.match_id", "b.reprojection_error")


@query("response_percentiles", None, "select max(value) as top, round(avg(value) filter (value > 0), 6) as mean, count(*) filter (value > 0) as n, cast(trunc(quantile_cont(value, 0.5)) as int) as p50, cast(trunc(quantile_cont(value, 0.9)) as int) as p90, cast(trunc(quantile_cont(value, 0.99)) as int) as p99 from events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    q = lambda p: F.percentile("value", F.lit(p)).cast("int")
    return e.agg(F.max("value").alias("top"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), R).alias("mean"), F.count_if(F.col("value") > 0).alias("n"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"))


# ---- features, labels and kernels ------------------------------------------------------------


_SLOT = ("x", "y", "dx", "dy", "conf", "seen", "d", "speed")
CTES["slot0"] = "select b.match_id, b.frame_id, b.x, b.y, b.conf, case when vis = 'visible' then 1.0 else 0.0 end as seen, case when x is not null then coalesce(x - lag(x) over w, 0) else 0 end as dx, case when x is not null then coalesce(y - lag(y) over w, 0) else 0 end as dy, least(99, coalesce((select min(sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y))) from players p where p.match_id = b.match_id and p.frame_id = b.frame_id), 99)) as d from ball b window w as (partition by match_id order by frame_id)"
CTES["slot"] = "select match_id, frame_id, " + ", ".join(f"case when x is null then 0 else {c} end as {c}" for c in ("x", "y", "dx", "dy", "conf", "seen", "d")) + ", case when x is null then 0 else sqrt(dx * dx + dy * dy) end as speed from slot0"
_FEATURE = lambda i: f"coalesce({'lag' if i < 32 else 'lead'}({_SLOT[i % 8]}, {abs(i // 8 - 4)}) over w, 0)"


@query("event_features", "slot", "select match_id, frame_id, " + ", ".join(f"round(cast(cast({_FEATURE(i)} as float) as double), 4) as f{i}" for i in range(72)) + " from slot window w as (partition by match_id order by frame_id)")
def _(s, d):
    from ..operators.features import event_features

    return event_features(*_all(s, d)).select("match_id", "frame_id", *(F.round(F.col("features")[i].cast("double"), 4).alias(f"f{i}") for i in range(72)))


@query(
    "weak_labels",
    "con",
    "select b.match_id, b.frame_id, case when vis = 'occluded' then 3 when exists (select 1 from bnc n where n.match_id = b.match_id and n.idx = b.frame_id) and coalesce((select min(sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y))) from players p where p.match_id = b.match_id and p.frame_id = b.frame_id), 99) >= 1.5 then 1 when exists (select 1 from bnc n where n.match_id = b.match_id and n.idx = b.frame_id) or exists (select 1 from con c where c.match_id = b.match_id and c.frame_id = b.frame_id) then 2 else 0 end as label from ball b",
)
def _(s, d):
    from ..operators.features import weak_labels

    return weak_labels(*_all(s, d))


@query("label_distribution", "ball", "select vis as visibility, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from ball group by vis")
def _(s, d):
    g = A.ball_frames(s, d).groupBy("visibility").agg(F.count("*").alias("n"))
    return g.select("visibility", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), R).alias("pct"))


@query("class_weights", "ball", "select vis as label, round((1.0 / greatest(count(*), 1)) / sum(1.0 / greatest(count(*), 1)) over () * 4, 4) as weight from ball group by vis")
def _(s, d):
    from ..operators.features import class_weights

    return class_weights(A.ball_frames(s, d).select(F.col("visibility").alias("label"))).select("label", r("weight", digits=4))


CTES["raw"] = "select match_id, frame_id, case when vis = 'visible' then x end as mx, case when vis = 'visible' then y end as my from ball"
_PRED = "select r.match_id, r.frame_id, mx, my, alive, lost, px + vx as qx, py + vy as qy, vx, vy, a + 2 * b + c + 0.25 as qa, b + c as qb, c + 0.25 as qc from kal k join raw r on r.match_id = k.match_id and r.frame_id = k.frame_id + 1"
_GAIN = f"select *, case when not alive then case when mx is null then 'none' else 'new' end when mx is not null and sqrt((qx - mx) * (qx - mx) + (qy - my) * (qy - my)) <= 3 then 'hit' when lost + 1 > 10 then 'none' else 'miss' end as act, qa / (qa + 0.09) as k0, qb / (qa + 0.09) as k1 from ({_PRED})"
_pick = lambda new, hit, miss, none="cast(0 as double)": f"case act when 'new' then {new} when 'hit' then {hit} when 'miss' then {miss} else {none} end"
CTES["kal"] = (
    "select match_id, frame_id, mx is not null as alive, coalesce(mx, 0) as px, coalesce(my, 0) as py, cast(0 as double) as vx, cast(0 as double) as vy, cast(1 as double) as a, cast(0 as double) as b, cast(1 as double) as c, 0 as lost, case when mx is null then 'none' else 'new' end as act from raw where frame_id = 0 union all "
    f"select match_id, frame_id, act <> 'none', {_pick('mx', 'qx + k0 * (mx - qx)', 'qx')}, {_pick('my', 'qy + k0 * (my - qy)', 'qy')}, {_pick('0', 'vx + k1 * (mx - qx)', 'vx')}, {_pick('0', 'vy + k1 * (my - qy)', 'vy')}, {_pick('1', '(1 - k0) * qa', 'qa')}, {_pick('0', '(1 - k0) * qb', 'qb')}, {_pick('1', 'qc - k1 * qb', 'qc')}, {_pick('0', '0', 'lost + 1', '0')}, act from ({_GAIN})"
)


@query("kalman_ball", "kal", "select match_id, frame_id, case when act <> 'none' then round(least(10, greatest(0, px)), 9) end as x, case when act <> 'none' then round(least(20, greatest(0, py)), 9) end as y, case act when 'none' then 'occluded' when 'miss' then 'inferred' else 'visible' end as visibility from kal")
def _(s, d):
    raw = A.ball_frames(s, d).select("match_id", "frame_id", F.when(F.col("visibility") == "visible", F.col("position.x")).alias("x"), F.when(F.col("visibility") == "visible", F.col("position.y")).alias("y"))
    return T.track_ball(raw).select("match_id", "frame_id", r("x", digits=9), r("y", digits=9), "visibility")  # places of six decimals fall on halves


_KP = {"left_shoulder": (400, 250), "right_shoulder": (500, 250), "left_wrist": (380, "wy"), "right_wrist": (520, "wy"), "left_elbow": ("380 - g", "(wy + 250) / 2"), "right_elbow": ("520 + g", "(wy + 250) / 2"), "left_hip": ("420 + h", 350), "right_hip": ("480 + h", 350)}
CTES["kps"] = " union all ".join(f"select match_id, frame_id, player_id, '{n}' as name, cast({x} as double) as x, cast({y} as double) as y, cast({'case when weak then 0.2 else 0.9 end' if n == 'left_wrist' else 0.9} as double) as confidence from players" for n, (x, y) in _KP.items())
CTES["ema"] = "select match_id, frame_id, player_id, name, x, y, confidence from kps where frame_id = 0 union all select k.match_id, k.frame_id, k.player_id, k.name, 0.6 * k.x + (1 - 0.6) * e.x, 0.6 * k.y + (1 - 0.6) * e.y, 0.6 * k.confidence + (1 - 0.6) * e.confidence from ema e join kps k on k.match_id = e.match_id and k.player_id = e.player_id and k.name = e.name and k.frame_id = e.frame_id + 1"


@query("pose_ema", "ema", "select match_id, frame_id, player_id, name, round(x, 6) as x, round(y, 6) as y, round(confidence, 6) as confidence from ema")
def _(s, d):
    return T.smooth_pose(A.player_frames(s, d)).select("match_id", "frame_id", "player_id", "name", r("x"), r("y"), r("confidence"))


@query("mlp_probabilities")
def _(s, d):
    from ..operators.features import event_features, mlp_probabilities, synthetic_weights

    return mlp_probabilities(event_features(*_all(s, d)), synthetic_weights())


@query("kmeans2_assign")
def _(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return T.assign_teams(e, T.kmeans_2_table(e)).withColumnRenamed("id", "vec_id")


def _boxes(s, d):
    p = A.player_frames(s, d).where("position is not null")
    shift = F.col("bbox").withField("x1", F.col("bbox.x1") + 15).withField("x2", F.col("bbox.x2") + 15)
    return p, p.withColumn("bbox", shift)


CTES["iou"] = "select match_id, frame_id, a, b, case when 18000 - w * h > 0 then w * h / (18000 - w * h) else 0 end as iou from (select a.match_id, a.frame_id, a.ord as a, b.ord as b, greatest(0, least(100 * a.x + 30, 100 * b.x + 45) - greatest(100 * a.x - 30, 100 * b.x - 15)) as w, greatest(0, least(50 * a.y, 50 * b.y) - greatest(50 * a.y - 150, 50 * b.y - 150)) as h from players a join players b on a.match_id = b.match_id and a.frame_id = b.frame_id where a.x is not null and b.x is not null)"
CTES["listing"] = "select match_id, frame_id, ord, row_number() over w as i, count(*) over (partition by match_id, frame_id) as n from players where x is not null window w as (partition by match_id, frame_id order by ord)"
CTES["deal"] = "select match_id, frame_id, n, cast(0 as bigint) as i, cast([] as bigint[]) as bs, cast(0 as double) as total from listing where i = 1 union all select d.match_id, d.frame_id, d.n, l.i, list_append(d.bs, q.b), d.total + q.iou from deal d join listing l on l.match_id = d.match_id and l.frame_id = d.frame_id and l.i = d.i + 1 join iou q on q.match_id = d.match_id and q.frame_id = d.frame_id and q.a = l.ord where not list_contains(d.bs, q.b)"


@query("iou_pairs", "iou", "select match_id, frame_id, a, b, round(iou, 6) as iou from iou")
def _(s, d):
    return T.iou_pairs(*_boxes(s, d)).withColumn("iou", F.round("iou", R))


@query("iou_match", "deal", "select q.match_id, q.frame_id, q.a, q.b, round(q.iou, 6) as iou from (select match_id, frame_id, arg_max(bs, total) as bs from deal where i = n group by match_id, frame_id) best join listing l using (match_id, frame_id) join iou q on q.match_id = best.match_id and q.frame_id = best.frame_id and q.a = l.ord and q.b = best.bs[l.i] where q.iou >= 0.3")
def _(s, d):
    return T.match_boxes(T.iou_pairs(*_boxes(s, d))).withColumn("iou", F.round("iou", R))


@query("json_props", "ev", "select match_id, frame_id, k from ev")
def _(s, d):
    return A.events(s, d).select("match_id", "frame_id", "k")


@query("line_intersections", None, "select a, b, case when a = 0 then cast(b * 2 as double) else cast(b * 2 as double) end as x, cast(a * 3 as double) as y from (select unnest(range(5)) as a), (select unnest(range(4)) as b)")
def _(s, d):
    seg = lambda x1, y1, x2, y2: F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))
    wide = s.range(5).select(F.col("id").alias("a"), seg(F.lit(0), F.col("id") * 3, F.lit(10), F.col("id") * 3).alias("p"))
    tall = s.range(4).select(F.col("id").alias("b"), seg(F.col("id") * 2, F.lit(0), F.col("id") * 2, F.lit(20)).alias("q"))
    got = wide.join(F.broadcast(tall), F.lit(True)).select("a", "b", line_intersection(F.col("p"), F.col("q")).alias("i"))
    return got.select("a", "b", F.round("i.x", 9).alias("x"), F.round("i.y", 9).alias("y"))


def player_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every player's metrics from raw frames."""
    ball, pl = _all(spark, sf_dir)
    return M.player_metrics(P.in_points(E.play_shots(E.match_play(ball, pl))), pl)
