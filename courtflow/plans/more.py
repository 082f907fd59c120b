"""Queries over reports, pictures and lines; added to the catalogue of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrating as C
from ..operators import events as E
from ..operators import metrics as M
from ..operators import pictures as X
from ..operators import reports as V
from ..sources import adapter as A
from .queries import CTES, R, _all, _point_shots, _shots, query, r


@query("report_summary", "pshot", "select match_id, count(*) as points, round(avg(n), 6) as avg_rally, round(avg(d) / 1000, 6) as avg_duration_s, cast(sum(w) as bigint) as wall_bounces from (select match_id, point_id, count(*) as n, any_value(duration) as d, coalesce(sum((select count(*) from trj where trj.match_id = p.match_id and trj.n = p.n and trj.type in ('back_wall', 'side_wall'))), 0) as w from pshot p group by match_id, point_id) group by match_id")
def _(s, d):
    v = V.summary(M.rally_metrics(_point_shots(s, d)))
    return v.select("match_id", "points", r("avg_rally"), r("avg_duration_s"), "wall_bounces")


@query("rally_histogram", "pshot", "select match_id, n as rally_length, count(*) as rallies from (select match_id, point_id, count(*) as n from pshot group by match_id, point_id) group by match_id, n")
def _(s, d):
    return V.rally_histogram(M.rally_metrics(_point_shots(s, d)))


@query("net_control_chart", "tf", "select match_id, team_id, round(avg(inside) * 100, 6) as pct from (select match_id, team_id, frame_id, case when coalesce(bool_or(y between 3 and 17), false) then 1.0 else 0.0 end as inside from tf group by match_id, team_id, frame_id) group by match_id, team_id")
def _(s, d):
    return V.net_control_chart(M.net_control(A.player_frames(s, d))).select("match_id", "team_id", r("pct"))


@query("animation_frames", "shot", "select e.match_id, e.frame_id, e.entity, e.x, e.y, case when e.entity = 'ball' and exists (select 1 from (select s.match_id, s.n, min(struct_pack(d := abs(b.ts - (s.ts + 17)), f := b.frame_id)).f as f from shot s join ball b on b.match_id = s.match_id group by s.match_id, s.n) h where h.match_id = e.match_id and h.f = e.frame_id) then 'star' else 'circle' end as marker, 40 as duration_ms from (select match_id, frame_id, ts, 'ball' as entity, x, y from ball where x is not null union all select match_id, frame_id, ts, player_id, x, y from players where x is not null) e")
def _(s, d):
    # times between frames, and nearer to the one before: the star is on that
    return V.animation_frames(*_all(s, d), _shots(s, d).withColumn("timestamp_ms", F.col("timestamp_ms") + 17))


@query("bounce_rings", "bnc", "select match_id, frame_id, bounce, cast(trunc(12 + 8 * p) as int) as radius, 1 - p as alpha, p < 0.5 as labelled from (select b.match_id, b.frame_id, n.idx as bounce, (b.frame_id - cast(round_even(n.ts / 40.0, 0) as bigint)) / cast(25 as double) as p from ball b join bnc n on n.match_id = b.match_id and b.frame_id - cast(round_even(n.ts / 40.0, 0) as bigint) between 0 and 24)")
def _(s, d):
    from .queries import QUERIES

    return V.bounce_rings(QUERIES["active_bounces"](s, d))


@query("trajectory_lengths", "ball", "select match_id, frame_id, least(30, row_number() over (partition by match_id order by frame_id)) as n from ball where vis = 'visible' and x is not null")
def _(s, d):
    return V.trajectory_lines(A.ball_frames(s, d)).select("match_id", "frame_id", F.size("line").cast("long").alias("n"))


@query("frame_buffer", "ball", "select match_id, frame_id, frame_id - 2 as oldest from ball where frame_id >= 2")
def _(s, d):
    b = X.frame_buffer(A.ball_frames(s, d))
    return b.where("buffer is not null").select("match_id", "frame_id", F.col("buffer")[0].alias("oldest"))


@query("court_visibility", "ev", "select match_id, frame_id, k / cast(100 as double) as court_ratio, k / cast(100 as double) >= 0.15 and k / cast(500 as double) between 0.003 and 0.15 and k % 7 >= 3 as visible from ev")
def _(s, d):
    e = A.events(s, d).select("match_id", "frame_id", (F.col("k") / 100.0).alias("court_ratio"), (F.col("k") / 500.0).alias("white_ratio"), (F.col("k") % 7).alias("lines"))
    return X.court_visible(e).select("match_id", "frame_id", "court_ratio", "visible")


@query("playable_frames", "ev", "select match_id, frame_id from ev where k * 2.0 >= 30 and k / cast(100 as double) > 0.15")
def _(s, d):
    e = A.events(s, d).select("match_id", "frame_id", (F.col("k") * 2.0).alias("brightness"), (F.col("k") / 100.0).alias("court_ratio"))
    return X.playable(e).select("match_id", "frame_id")


_TOP = "case when frame_id % 5 = 0 then 2 * k when frame_id % 5 = 1 then k when frame_id % 5 = 2 then k // 2 when frame_id % 5 = 3 then case when k = 99 then 60 else 5 end else k // 3 end"
_OLD = "case when frame_id % 5 = 2 then k else 0 end"


@query("response_summary", "ev", "select run, round(avg(top), 6) as mean_top, min(top) as min_top, max(top) as max_top, count(*) filter (top > 0) as responding, count(*) as frames, " + ", ".join(f"count(*) filter (top > {c}) as n{c}" for c in (10, 30, 50, 80, 127)) + f", count(*) filter (old > 50) as o50, case when count(*) filter (top > 127) > 0.1 * count(*) then 'keep 127' when count(*) filter (top > 50) > 0.1 * count(*) then 'lower to 50' when count(*) filter (old > 50) > count(*) filter (top > 50) then 'oldest first' when count(*) filter (top > 50) > 0 then 'weak' else 'none' end as advice from (select frame_id % 5 as run, {_TOP} as top, {_OLD} as old from ev) group by run")
def _(s, d):
    cuts = (10, 30, 50, 80, 127)
    e = A.events(s, d).selectExpr("frame_id % 5 as run", f"{_TOP.replace('//', 'div')} as top", f"{_OLD} as old")
    blobs = lambda c: F.map_from_arrays(F.array(*(F.lit(t) for t in cuts)), F.array(*((F.col(c) > t).cast("int") for t in cuts)))
    return X.response_summary(e.withColumn("blobs", blobs("top")).withColumn("old_blobs", blobs("old")), cuts).withColumn("mean_top", F.round("mean_top", R))


def _hists(s, d):
    ev = A.events(s, d)
    bars = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("k") * (i + 3) * (i + 3)) % 11).cast("double"))
    return ev.select("match_id", "frame_id", bars.alias("hist"))


CTES["bars"] = "select k, i, cast((k * (i + 3) * (i + 3)) % 11 as double) as v from (select unnest(range(100)) as k), (select unnest(range(8)) as i)"
CTES["alike"] = "select k1, k2, c from (select p.k as k1, q.k as k2, corr(p.v, q.v) as c from bars p join bars q using (i) group by p.k, q.k) where c > 0.93 and not isnan(c)"
CTES["looks"] = "select match_id, frame_id, k, row_number() over (partition by match_id order by frame_id) as rn, (select list(k2) from alike where k1 = k) as near from ev"
CTES["first_looks"] = "select match_id, rn, frame_id, [k] as kept, true as new from looks where rn = 1 union all select l.match_id, l.rn, l.frame_id, case when list_has_any(f.kept, coalesce(l.near, cast([] as bigint[]))) then f.kept else list_append(f.kept, l.k) end, not list_has_any(f.kept, coalesce(l.near, cast([] as bigint[]))) from first_looks f join looks l on l.match_id = f.match_id and l.rn = f.rn + 1"


@query("similar_frames", "alike", "select p.match_id, p.frame_id as a, q.frame_id as b, round(c, 6) as corr from ev p join alike on k1 = p.k join ev q on q.match_id = p.match_id and q.k = k2 and q.frame_id > p.frame_id")
def _(s, d):
    return X.similar_pairs(_hists(s, d)).withColumn("corr", F.round("corr", R))


@query("distinct_frames", "first_looks", "select match_id, frame_id from first_looks where new")
def _(s, d):
    return X.distinct_frames(_hists(s, d))


def _segments(s, d):
    return A.events(s, d).selectExpr("match_id", "frame_id", "cast(k * 3 as double) as x1", "cast((k * 7) % 90 as double) as y1", "cast(k * 3 + if(frame_id % 2 = 0, 200, 5) as double) as x2", "cast((k * 7) % 90 + if(frame_id % 2 = 0, 3, 300) as double) as y2")


_SEG = "(select match_id, frame_id, cast(k * 3 as double) as x1, cast((k * 7) % 90 as double) as y1, cast(k * 3 + case when frame_id % 2 = 0 then 200 else 5 end as double) as x2, cast((k * 7) % 90 + case when frame_id % 2 = 0 then 3 else 300 end as double) as y2 from ev)"


@query("line_directions", "ev", f"select match_id, frame_id, case when frame_id % 2 = 0 then 'across' else 'along' end as direction, case when frame_id % 2 = 0 then (y1 + y2) / 2 else (x1 + x2) / 2 end as mid from {_SEG}")
def _(s, d):
    return C.directions(_segments(s, d)).select("match_id", "frame_id", "direction", "mid")


CTES["aligned"] = f"select *, row_number() over (partition by match_id, direction order by mid, x1, y1, x2, y2) as rn from (select *, case when frame_id % 2 = 0 then 'across' else 'along' end as direction, case when frame_id % 2 = 0 then (y1 + y2) / 2 else (x1 + x2) / 2 end as mid from {_SEG})"
CTES["bundle"] = "select match_id, direction, rn, cast(0 as bigint) as cluster, cast(1 as bigint) as n, mid as sm, x1, y1, x2, y2 from aligned where rn = 1 union all select l.match_id, l.direction, l.rn, case when near then b.cluster else b.cluster + 1 end, case when near then b.n + 1 else 1 end, " + ", ".join(f"case when near then b.{c} + l.{d} else l.{d} end" for c, d in (("sm", "mid"), ("x1", "x1"), ("y1", "y1"), ("x2", "x2"), ("y2", "y2"))) + " from bundle b join aligned l on l.match_id = b.match_id and l.direction = b.direction and l.rn = b.rn + 1, lateral (select abs(l.mid - b.sm / b.n) < 25 as near)"


@query("line_clusters", "bundle", "select match_id, direction, cast(cluster as int) as cluster, max(n) as lines, " + ", ".join(f"round(arg_max({c} / n, n), 6) as {c}" for c in ("x1", "y1", "x2", "y2")) + " from bundle group by match_id, direction, cluster")
def _(s, d):
    return C.line_clusters(C.directions(_segments(s, d))).select("match_id", "direction", "cluster", "lines", *(r(c) for c in ("x1", "y1", "x2", "y2")))


@query("point_rows", "ev", f"select match_id, frame_id, sum(case when y1 - py >= 5 then 1 else 0 end) over (partition by match_id order by y1, x1, frame_id) as row from (select *, lag(y1) over (partition by match_id order by y1, x1, frame_id) as py from {_SEG})")
def _(s, d):
    p = _segments(s, d).select("match_id", "frame_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return C.rows_by_gap(p, 5.0).select("match_id", "frame_id", F.col("row").cast("double").alias("row"))


@query("bounce_count_by_match", "bnc", "select match_id, count(*) as n, count(*) filter (type = 'ground') as ground from bnc group by match_id")
def _(s, d):
    return E.bounces(A.ball_frames(s, d)).groupBy("match_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "ground").alias("ground"))


@query("velocity_around", "idx", "select match_id, frame_id, coalesce(case when nb >= 2 then list_last(xb) - list_first(xb) end, 0) as vx_before, coalesce(case when nb >= 2 then list_last(yb) - list_first(yb) end, 0) as vy_before, coalesce(case when na >= 2 then list_last(xa) - list_first(xa) end, 0) as vx_after, coalesce(case when na >= 2 then list_last(ya) - list_first(ya) end, 0) as vy_after from (select match_id, frame_id, count(kx) over b as nb, list(kx) filter (kx is not null) over b as xb, list(ky) filter (kx is not null) over b as yb, count(kx) over a as na, list(kx) filter (kx is not null) over a as xa, list(ky) filter (kx is not null) over a as ya from (select *, case when vis <> 'inferred' then x end as kx, case when vis <> 'inferred' then y end as ky from idx) window b as (partition by match_id order by idx rows between 3 preceding and 1 preceding), a as (partition by match_id order by idx rows between 1 following and 3 following))")
def _(s, d):
    return E.velocity_around(A.ball_frames(s, d))


@query("moving_average", "seen", "select match_id, frame_id, round(case when count(*) over w = 5 then avg(x) over w else x end, 6) as x from seen window w as (partition by match_id order by frame_id rows between 2 preceding and 2 following)")
def _(s, d):
    b = E.visible_ball(A.ball_frames(s, d)).select("match_id", "frame_id", F.col("position.x").alias("x"))
    return E.moving_average(b, "x").select("match_id", "frame_id", r("x"))


@query("best_ball_detection", "ev", "select match_id, frame_id, cast(greatest(k, case when k % 3 = 0 then 70 else 0 end) as double) / 100 as confidence from ev")
def _(s, d):
    from ..operators import tracking as T

    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))
    e = A.events(s, d)
    row = lambda df, o, c, kind: df.select("match_id", "frame_id", F.lit(o).alias("ord"), (c / 100.0).alias("confidence"), F.lit(kind).alias("class_id"), box.alias("bbox"))
    found = row(e, 1, F.col("k"), 32).unionByName(row(e.where("k % 3 = 0"), 2, F.lit(70), 32)).unionByName(row(e, 3, F.lit(99), 0))
    return T.best_ball(found).select("match_id", "frame_id", "confidence")


@query("class_accuracy", "ev", "select k % 4 as label, count(*) as n, round(avg(case when k % 4 = (k * 3) % 4 then 1.0 else 0.0 end), 6) as accuracy from ev group by 1")
def _(s, d):
    from ..operators.features import class_accuracy

    p = A.events(s, d).select((F.col("k") % 4).alias("label"), ((F.col("k") * 3) % 4).alias("pred"))
    return class_accuracy(p).withColumn("accuracy", F.round("accuracy", R))


CTES["sure"] = "select match_id, frame_id, kind, row_number() over (partition by match_id, kind order by frame_id) as rn from (select match_id, frame_id, 'bounce' as kind from ev where k / cast(100 as double) > 0.5 union all select match_id, frame_id, 'hit' from ev where 1 - k / cast(100 as double) > 0.5)"
CTES["spaced"] = "select match_id, kind, rn, frame_id, frame_id as last, true as kept from sure where rn = 1 union all select s.match_id, s.kind, s.rn, s.frame_id, case when s.frame_id - p.last >= 8 then s.frame_id else p.last end, s.frame_id - p.last >= 8 from spaced p join sure s on s.match_id = p.match_id and s.kind = p.kind and s.rn = p.rn + 1"


@query("detected_events", "spaced", "select match_id, frame_id, kind from spaced where kept")
def _(s, d):
    from ..operators.features import detect_events

    e = A.events(s, d).select("match_id", "frame_id", (F.col("k") / 100.0).alias("p1"), (1 - F.col("k") / 100.0).alias("p2"))
    return detect_events(e)


@query("ball_before_contact", "con", "select c.match_id, c.n, i.idx - c.idx as o, i.x, i.y from con c join idx i on i.match_id = c.match_id and i.idx between c.idx - 29 and c.idx where c.prev_ts is null or i.ts > c.prev_ts")
def _(s, d):
    ball, pl = _all(s, d)
    return E.frames_before(E.spans(E.contacts(ball, pl)), ball)


@query("shot_type_chart", "pshot", "select match_id, player_id, shot_type, count(*) as shots from pshot group by all")
def _(s, d):
    return V.shot_type_chart(M.player_metrics(_point_shots(s, d), A.player_frames(s, d)))


@query("outcome_chart", "pshot", "select match_id, player_id, count(*) filter (outcome = 'winner') as winners, count(*) filter (outcome = 'error') as errors from pshot group by all")
def _(s, d):
    return V.outcome_chart(M.player_metrics(_point_shots(s, d), A.player_frames(s, d)))


@query("best_calibration_frame", "ev", "select match_id, min(struct_pack(e := k / cast(100 as double), f := frame_id)).f as frame_id, min(k / cast(100 as double)) as reprojection_error from ev where frame_id % 300 = 0 and k >= 5 group by match_id")
def _(s, d):
    e = A.events(s, d).select("match_id", "frame_id", F.when(F.col("k") >= 5, F.col("k") / 100.0).alias("reprojection_error"))
    return C.best_calibration(e)


@query("parquet_roundtrip", "players", "select match_id, frame_id, 'ball' as who, x, y, z, vis as visibility, cast(null as varchar) as team_id, cast(0 as bigint) as points from ball union all select match_id, frame_id, player_id, x, y, null, null, team_id, 0 from players")
def _(s, d):
    from ..session import work_dir
    from ..sources import files as S

    at, (ball, pl) = work_dir(s, "roundtrip"), _all(s, d)
    S.write_ball_frames(ball, f"{at}/ball")
    S.write_player_frames(pl, f"{at}/players")
    null, flat = F.lit(None).cast("string"), ("match_id", "frame_id")
    b = S.read_ball_frames(s, f"{at}/ball").select(*flat, F.lit("ball").alias("who"), "position.x", "position.y", "position.z", "visibility", null.alias("team_id"), F.lit(0).cast("long").alias("points"))
    p = S.read_player_frames(s, f"{at}/players")
    return b.unionByName(p.select(*flat, F.col("player_id").alias("who"), "position.x", "position.y", F.lit(None).cast("double").alias("z"), null.alias("visibility"), "team_id", F.size("keypoints").cast("long").alias("points")))


@query("jsonl_roundtrip", "bnc", "select match_id, idx, type, x, y, z from bnc")
def _(s, d):
    from ..session import work_dir
    from ..sources import files as S

    at, b = work_dir(s, "roundtrip"), E.bounces(A.ball_frames(s, d)).select("match_id", "idx", "type", "x", "y", "z")
    S.write_jsonl(b, f"{at}/bounces")
    return S.read_jsonl(s, f"{at}/bounces", b.schema.simpleString()[7:-1].replace(":", " "))


@query("team_warm_up", "ev", "select match_id, frame_id, sum(case when k % 2 = 0 then 1 else 0 end) over (partition by match_id order by frame_id) >= 10 as ready from ev")
def _(s, d):
    from ..operators import tracking as T

    f = A.events(s, d).select("match_id", "frame_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), F.when(F.col("k") % 2 == 0, F.array(F.lit(1.0))).alias("vec"))
    return T.warm_up(f).where("ord = 1").select("match_id", "frame_id", "ready")


@query("frame_ids", "players", "select match_id, frame_id from ball where x is not null union select match_id, frame_id from players where x is not null")
def _(s, d):
    ball, pl = _all(s, d)
    place = lambda df: df.where("position is not null").select("match_id", "frame_id")
    return place(ball).union(place(pl)).distinct()
