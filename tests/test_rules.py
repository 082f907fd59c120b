"""Small hand-made cases of the single rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflow.functions.court import surface
from courtflow.functions.sequence import as_of, suppress
from courtflow.operators import calibrating as C
from courtflow.operators import events as E
from courtflow.operators import heatmap as H
from courtflow.operators import metrics as M
from courtflow.operators import pictures as X
from courtflow.operators import points as P
from courtflow.operators import tracking as T
from courtflow.schema import BALL_FRAMES, PLAYER_FRAMES

STEP = 33.3


def ball(spark, ys, xs=None, vis=None):
    rows = [(1, i, i * STEP, None, None if y is None else (5.0 if xs is None else xs[i], y, 0.0), 0.9, (vis or {}).get(i, "visible")) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, BALL_FRAMES)


def players(spark, places, n, pid="P_001", team="T_1"):
    return spark.createDataFrame([(1, i, i * STEP, pid, 1, team, (0.0, 0.0, 1.0, 1.0), places, 0.9, []) for i in range(n)], PLAYER_FRAMES)


def test_surfaces(spark):
    cases = [(5, 5, 0, "ground"), (5, 10, 0, "net"), (5, 0.3, 0, "back_fence"), (5, 19.8, 0, "back_fence"), (5, 0.3, 2, "back_wall"), (0.3, 10, 0, "net"), (0.3, 5, 0, "side_fence"), (9.8, 5, 2, "side_wall"), (0.5, 0.5, 0, "corner"), (5, 5, None, "ground")]
    df = spark.createDataFrame([(float(x), float(y), None if z is None else float(z), t) for x, y, z, t in cases], "x double, y double, z double, t string")
    assert all(r[0] == r[1] for r in df.select("t", surface(F.col("x"), F.col("y"), F.col("z"))).collect())


def test_reversals(spark):
    turn = [10 - 0.5 * i for i in range(5)] + [7.5 + 0.5 * i for i in range(7)]
    assert E.bounces(ball(spark, turn), apart=3, window=3, threshold=0.2).count() >= 1
    assert E.bounces(ball(spark, [2 + 0.5 * i for i in range(15)])).count() == 0
    assert E.bounces(ball(spark, [])).count() == 0
    hidden = turn[:5] + [None] * 3 + turn[5:]
    assert E.bounces(ball(spark, hidden, vis=dict.fromkeys((5, 6, 7), "occluded")), apart=3, window=3, threshold=0.2).count() >= 1


def test_suppression_keeps_far_ones(spark):
    df = spark.createDataFrame([(1, i) for i in (10, 11, 12, 25, 26)] + [(2, 3)], "match_id long, idx long")
    assert sorted(tuple(r) for r in suppress(df, "idx", 5).collect()) == [(1, 10), (1, 25), (2, 3)]


def test_contacts(spark):
    xs = [3 + 0.5 * i for i in range(5)] + [5.5 - 0.5 * i for i in range(6)]
    b = ball(spark, [5.0] * len(xs), xs)
    got = E.contacts(b, players(spark, (5.0, 5.0), len(xs))).collect()
    assert len(got) >= 1 and {r["player_id"] for r in got} == {"P_001"} and all(0 < r["confidence"] <= 1 for r in got)
    assert E.contacts(b, players(spark, (0.0, 0.0), len(xs))).count() == 0
    s = E.shots(b, players(spark, (5.0, 5.0), len(xs))).collect()
    assert s[0]["shot_id"] == "S_001_01_01_001" and s[0]["outcome"] is None and s[0]["shot_type"] in ("volley", "drop_shot")


def test_pauses_and_points(spark):
    ts = [i * STEP for i in range(50)] + [5000 + i * STEP for i in range(50)]
    b = spark.createDataFrame([(1, i, t, None, None, 0.9, "visible") for i, t in enumerate(ts)], BALL_FRAMES)
    bounds = P.boundaries(b)
    assert bounds.count() == 2
    one = spark.createDataFrame([(1, i, float(t), None, None, 0.9, "visible") for i, t in enumerate([0, 100, 5000, 5033.3, 6000])], BALL_FRAMES)
    assert [(r["start_ms"], r["point"]) for r in P.boundaries(one).collect()] == [(5000.0, 1)]
    kind = "match_id long, n int, timestamp_ms double, player_id string, team_id string, shot_type string"
    shots = spark.createDataFrame([(1, i + 1, float(t), "P", f"T_{i}", "unknown" if i == 0 else "volley") for i, t in enumerate([100, 500, 5100, 5500])], kind)
    shots = shots.select("*", F.struct(F.lit(1.0).alias("x"), F.lit(8.0).alias("y")).alias("position"), F.array().cast("array<struct<type:string,position:struct<x:double,y:double,z:double>,timestamp_ms:double>>").alias("trajectory"), F.lit(0.5).alias("confidence"))
    got = P.point_shots(shots, bounds).orderBy("timestamp_ms").collect()
    assert [(r["point_id"], r["shot_id"][-3:], r["outcome"], r["shot_type"]) for r in got] == [("S_001_01_01", "001", "next_shot", "serve"), ("S_001_01_01", "002", "winner", "volley"), ("S_001_01_02", "001", "next_shot", "volley"), ("S_001_01_02", "002", "winner", "volley")]
    whole = P.points(P.point_shots(shots, bounds.limit(0))).collect()
    assert [(r["duration_ms"], r["rally_length"], r["winner_team_id"]) for r in whole] == [(5400.0, 4, "T_3")]


def shots_of(spark, kinds):
    return spark.createDataFrame([(1, "S", f"{i:03d}", float(i), "P", k, "next_shot") for i, k in enumerate(kinds)], "match_id long, point_id string, shot_id string, timestamp_ms double, player_id string, shot_type string, outcome string")


def test_metrics(spark):
    assert M.switches(shots_of(spark, ["smash", "lob", "volley"]), "match_id").first()["switches"] == 2
    assert M.switches(shots_of(spark, ["smash", "serve", "volley"]), "match_id").first()["switches"] == 0
    assert M.player_shots(shots_of(spark, ["serve", "volley", "serve", "lob"])).first()["serve_percentage"] == 0.5
    move = spark.createDataFrame([(1, 0, 0.0, "P", 1, "T_1", None, (0.0, 0.0), 0.9, []), (1, 1, 1.0, "P", 1, "T_1", None, None, 0.9, []), (1, 2, 2.0, "P", 1, "T_1", None, (3.0, 4.0), 0.9, [])], PLAYER_FRAMES)
    assert M.distance(move).first()["distance"] == 5.0
    assert M.distance(move.limit(1)).first()["distance"] is None
    f = lambda frame, pid, o, x, y: (1, frame, 0.0, pid, o, "T_1", None, (x, y), 0.9, [])
    two = spark.createDataFrame([f(0, "A", 1, 2.0, 10.0), f(0, "B", 2, 8.0, 10.0), f(1, "A", 1, 8.0, 2.0), f(1, "B", 2, 2.0, 3.0), f(2, "A", 1, 2.0, 2.0), f(2, "B", 2, 8.0, 2.0)], PLAYER_FRAMES)
    assert M.formation_switches(two).first()["formation_switches"] == 2
    assert M.pair_distance(two.where("frame_id = 0")).first()["avg_pair_distance"] == 6.0
    assert M.net_control(two.where("frame_id < 2")).first()["net_control_pct"] == 1.0


@pytest.mark.parametrize("places", [[(5, 5)], [(5, 5), (5, 5), (1, 1)], [(0, 0), (10, 20), (0, 20), (12, -3)]])
def test_heatmap(spark, places):
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in places] + [(1, None, 2.0)], "match_id long, x double, y double")
    got = H.smooth(H.bins(df, 20, 40), 20, 40, 1.0).collect()
    v = [r["value"] for r in got]
    assert max(v) == 1 and min(v) >= 0 and all(0 <= r["ix"] < 20 and 0 <= r["iy"] < 40 for r in got)
    grid = np.zeros((40, 20))
    for x, y in places:
        grid[max(0, min(39, int(y / 20 * 39))), max(0, min(19, int(x / 10 * 19)))] += 1
    k = np.array(H.kernel(1.0))
    for axis in (0, 1):
        pad = [(4, 4) if a == axis else (0, 0) for a in (0, 1)]
        grid = np.apply_along_axis(lambda c: np.convolve(c, k, "valid"), axis, np.pad(grid, pad, mode="symmetric"))
    grid /= grid.max()
    mine = np.zeros_like(grid)
    for r in got:
        mine[r["iy"], r["ix"]] = r["value"]
    assert mine == pytest.approx(grid)


def test_tracker():
    state, at, seen = T.kalman_step(None, 5.0, 10.0)
    assert (at, seen) == ((5.0, 10.0), "visible")
    gated = T.kalman_step(state, 0.0, 0.0)
    assert gated[2] == "inferred" and T.kalman_step(None, None, None)[1:] == (None, "occluded")
    for i in range(11):
        state, at, seen = T.kalman_step(state, None, None)
        assert seen == ("occluded" if i == 10 else "inferred")
    assert state is None and at is None


def test_tracker_equals_the_full_filter():
    g = np.random.default_rng(0)
    f = np.eye(4) + np.eye(4, k=2)
    h = np.eye(2, 4)
    x, p = None, np.eye(4)
    state = None
    for i in range(60):
        z = np.array([5 + 0.05 * i, 10 - 0.03 * i]) + g.normal(0, 0.05, 2)
        state, at, _ = T.kalman_step(state, *z)
        if x is None:
            x = np.array([*z, 0, 0])
        else:
            x, p = f @ x, f @ p @ f.T + 0.25 * np.eye(4)
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 0.09 * np.eye(2))
            x, p = x + k @ (z - h @ x), (np.eye(4) - k @ h) @ p
        assert at == pytest.approx(tuple(x[:2]))


def test_track_ball_clamps_and_survives_gaps(spark):
    raw = spark.createDataFrame([(1, i, 9.5 + 0.4 * i if i < 5 else None, 10.0 if i < 5 else None) for i in range(20)], "match_id long, frame_id long, x double, y double")
    got = T.track_ball(raw).orderBy("frame_id").collect()
    assert all(r["x"] is None or r["x"] <= 10 for r in got) and got[-1]["visibility"] == "occluded"


def test_homography():
    src = np.array([[0, 0], [1000, 0], [1000, 2000], [0, 2000]], float)
    h, err = T.fit_homography(src, src / 100)
    assert h == pytest.approx(np.diag([0.01, 0.01, 1]), abs=1e-9) and err < 1e-9
    trap = np.array([[300, 200], [700, 200], [900, 800], [100, 800]], float)
    h, _ = T.fit_homography(trap, np.array([[0, 20], [10, 20], [10, 0], [0, 0]], float))
    back = np.linalg.inv(h) @ (h @ np.array([400, 500, 1.0]))
    assert back[:2] / back[2] == pytest.approx([400, 500], abs=0.5)
    with pytest.raises(ValueError, match="homography"):
        T.fit_homography(np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float), np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float))
    named = dict(zip(("top_left", "top_right", "bottom_right", "bottom_left"), map(tuple, trap), strict=True))
    got = C.calibrate(named, 1000, 1000)
    assert got["reprojection_error"] < 1e-6 and C.calibrate({}, 1000, 1000) is None
    every = C.project_model(named)
    assert every["top_left"] == pytest.approx((300, 200)) and len(every) == 12


def test_points_and_rows():
    assert C.merge_points([(0, 0), (5, 5), (100, 100)]) == [(2.5, 2.5), (100.0, 100.0)]
    assert C.row_places(1, 0.0) is None and C.row_places(3, 3.0) == [0.0, 5.0, 10.0] and C.row_places(4, 0.0) == [0.0, 10.0]
    rows = [[(100 + 40 * x, 900 - 40 * y) for x in ((0, 5, 10) if y in (3.0, 17.0) else (0, 10))] for y in reversed(C.ROWS_Y)]
    src, dst = C.assign_rows(rows)
    assert len(src) == 12 and C.score(src, dst) > 100


def test_line_clusters(spark):
    segs = [(1, 0.0, y, 100.0, y) for y in (10.0, 20.0, 60.0, 200.0)] + [(1, x, 0.0, x + 1, 300.0) for x in (5.0, 400.0)] + [(1, 0.0, 0.0, 100.0, 100.0)]
    df = spark.createDataFrame(segs, "match_id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["direction"], r["lines"], r["y1"] if r["direction"] == "across" else r["x1"]) for r in C.line_clusters(C.directions(df)).collect())
    # the diagonal is 45 degrees steep and counts as along; its midpoint stands apart
    assert got == [("across", 1, 60.0), ("across", 1, 200.0), ("across", 2, 15.0), ("along", 1, 0.0), ("along", 1, 5.0), ("along", 1, 400.0)]


def test_matching_and_teams(spark):
    box = lambda x: (x, 0.0, x + 10.0, 10.0)
    kind = "match_id long, frame_id long, ord long, bbox struct<x1:double,y1:double,x2:double,y2:double>"
    a = spark.createDataFrame([(1, 0, 1, box(0.0)), (1, 0, 2, box(20.0)), (1, 0, 3, box(100.0))], kind)
    b = spark.createDataFrame([(1, 0, 1, box(21.0)), (1, 0, 2, box(1.0))], kind)
    assert sorted((r["a"], r["b"]) for r in T.match_boxes(T.iou_pairs(a, b)).collect()) == [(1, 2), (2, 1)]
    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(10, 1, (20, 4)), g.normal(-10, 1, (20, 4))])
    c = T.kmeans_2(x)
    assert (c[0] > 5).all() and (c[1] < -5).all()


def test_responses():
    r = np.zeros((20, 30))
    r[4:6, 10:12] = 0.9
    r[15, 1] = 0.95
    assert X.ball_in_response(r, (2.0, 3.0)) == pytest.approx((21.0, 13.5, 0.9))
    assert X.ball_in_response(np.zeros((4, 4)), (1, 1), rescale=True) is None and X.ball_in_response(np.ones((20, 20)), (1, 1)) is None


def test_distinct_frames(spark):
    h = [[1.0, 0, 0, 5], [1.0, 0, 0, 5.01], [0, 4.0, 1, 0], [1.0, 0, 0.01, 5]]
    df = spark.createDataFrame([(1, i, [float(v) for v in x]) for i, x in enumerate(h)], "match_id long, frame_id long, hist array<double>")
    assert sorted(r["frame_id"] for r in X.distinct_frames(df).collect()) == [0, 2]
    assert sorted((r["a"], r["b"]) for r in X.similar_pairs(df).collect()) == [(0, 1), (0, 3), (1, 3)]


def test_as_of(spark):
    left = spark.createDataFrame([(1, t) for t in (0.0, 10.0, 20.0, 40.0)], "match_id long, t double")
    right = spark.createDataFrame([(1, 10.0, "a"), (1, 15.0, "b")], "match_id long, s double, v string")
    assert [(r["t"], r["v"]) for r in as_of(left, right, "t", "s", 10.0).orderBy("t").collect()] == [(0.0, None), (10.0, "a"), (20.0, "b"), (40.0, None)]


def test_files(spark, tmp_path):
    from courtflow.sources import files as S

    b = ball(spark, [1.0, None, 3.0])
    assert S.write_ball_frames(b, f"{tmp_path}/b") and not S.write_ball_frames(b.limit(0), f"{tmp_path}/none")
    got = S.read_ball_frames(spark, f"{tmp_path}/b").orderBy("frame_id").collect()
    assert [r["position"] and r["position"]["y"] for r in got] == [1.0, None, 3.0] and got[0]["bbox"] is None
    p = players(spark, (1.0, 2.0), 2)
    S.write_player_frames(p, f"{tmp_path}/p")
    assert S.read_player_frames(spark, f"{tmp_path}/p").first()["keypoints"] == []
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r["a"] for r in S.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "urls").write_text("# no\n\n http://a \nhttp://b\n")
    assert [r["url"] for r in S.read_urls(spark, f"{tmp_path}/urls").collect()] == ["http://a", "http://b"]
    assert [r["frame_id"] for r in S.frame_range(b, 0, 3, 2).orderBy("frame_id").collect()] == [0, 2]
    task = [{"id": 7, "annotations": [], "completions": [{"result": [{"type": "keypointlabels", "value": {"x": 1.0, "y": 2.0, "keypointlabels": ["net_left"]}}, {"type": "other", "value": {"x": 0.0, "y": 0.0, "keypointlabels": []}}]}]}]
    (tmp_path / "ann.json").write_text(json.dumps(task))
    assert [tuple(r) for r in S.read_annotations(spark, f"{tmp_path}/ann.json").collect()] == [(7, "net_left", 1.0, 2.0)]


def test_live_tracker_equals_batch(spark, tmp_path):
    from courtflow.streaming import live

    raw = spark.createDataFrame([(m, i, 5 + 0.01 * i if i % 7 else None, 10.0 if i % 7 else None) for m in (1, 2) for i in range(40)], "match_id long, frame_id long, x double, y double")
    for k in range(2):
        raw.where(F.floor(F.col("frame_id") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.track_ball(feed).writeStream.format("memory").queryName("live_ball").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("live_ball").collect())
    assert got == sorted(tuple(r) for r in T.track_ball(raw).collect())


def test_cli(tmp_path):
    from courtflow import cli

    (tmp_path / "p.json").write_text(json.dumps({"top_left": [300, 200], "top_right": [700, 200], "bottom_right": [900, 800], "bottom_left": [100, 800]}))
    assert cli.main(["calibrate", f"{tmp_path}/p.json", f"{tmp_path}/out/c.json"]) == 0
    assert json.loads((tmp_path / "out" / "c.json").read_text())["reprojection_error"] < 1e-6


def test_cache_and_annotations(spark, tmp_path):
    from courtflow.operators.features import split
    from courtflow.sources import files as S

    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert S.cached(spark, make, f"{tmp_path}/cache", settings).count() == 3
    assert len(made) == 2
    rows = [(1, "net_left", 104.0, 50.126, True), (1, "far", 120.0, 0.0, False), (1, "top", -2.0, 10.0, False)]
    S.write_annotations(spark.createDataFrame(rows, "id long, label string, x double, y double, by_hand boolean"), f"{tmp_path}/ann")
    (task,) = [json.loads(line) for f in (tmp_path / "ann").glob("*.json") for line in f.read_text().splitlines()]
    got = [(r["value"]["keypointlabels"][0], r["value"]["x"], r["value"]["y"], r["visibility"]) for r in task["annotations"][0]["result"]]
    assert got == [("net_left", 100.0, 50.13, "visible"), ("top", 0.0, 10.0, "occluded")]
    train, val = split(spark.range(2000).toDF("id"), "id")
    assert train.count() + val.count() == 2000 and 200 < val.count() < 400


def _pose(wrist=200.0, shoulder=250.0, lateral=20.0, weak=()):
    at = {"shoulder": (400.0, 500.0, shoulder), "wrist": (380.0, 520.0, wrist), "elbow": (390.0 - lateral, 510.0 + lateral, (wrist + shoulder) / 2), "hip": (420.0, 480.0, 350.0)}
    return [(f"{side}_{part}", xs[i], xs[2], 0.1 if f"{side}_{part}" in weak else 0.9) for part, xs in at.items() for i, side in enumerate(("left", "right"))]


_LINE = lambda y, step, n=10: [(5.0, y + i * step) for i in range(n)]
_OUT = [(5.0, min(19.8, 10.0 + i * 0.8)) for i in range(15)] + [(9.8, 19.8)] * 5
#: (key points, the player's y, ball path, ground bounce, wall bounce, type)
SHOTS = {
    "smash": (_pose(150.0), 10.0, [(5.0, 10.0)] * 5, False, False, "smash"),
    "smash out of the court": (_pose(150.0), 10.0, _OUT, False, False, "smash_x3"),
    "overhead": (_pose(220.0), 10.0, [(5.0, 10.0)] * 5, False, False, "bandeja"),
    "overhead with side spin": (_pose(220.0, lateral=60.0), 10.0, [(5.0, 10.0)] * 5, False, False, "vibora"),
    "low at the net": (_pose(280.0), 10.0, _LINE(10.0, 0.5), False, False, "volley"),
    "short": (_pose(280.0), 10.0, _LINE(10.0, 0.1), False, False, "drop_shot"),
    "off a side wall": (_pose(280.0), 5.0, _LINE(5.0, 0.3), True, True, "wall_return"),
    "off the back wall, deep": (_pose(280.0), 1.5, _LINE(1.5, 0.3), True, True, "contra_pared"),
    "overhead, long arc": (_pose(200.0), 2.0, _LINE(2.0, 1.0, 15), True, False, "lob"),
    "overhead, no arc": (_pose(200.0), 2.0, _LINE(2.0, 0.1, 5), True, False, "bajada"),
    "towards the net": (_pose(280.0), 4.0, _LINE(4.0, 0.8), True, False, "chiquita"),
    "along the net": (_pose(280.0), 4.0, [(5.0 + i * 0.3, 4.0) for i in range(10)], True, False, "groundstroke_bh"),
    "shoulder and wrist not known well": (_pose(200.0, weak=("left_shoulder", "left_wrist")), 5.0, [], True, False, "groundstroke_fh"),
    "no key points": ([], 5.0, [], True, False, "groundstroke_fh"),
}


def test_shot_scenarios(spark):
    """Each branch of the rule, from key points to the type."""
    from courtflow.operators.events import by_pose, pose, serve_only

    kp = "array<struct<name:string,x:double,y:double,confidence:double>>"
    names = list(SHOTS)
    players = spark.createDataFrame([(i, 0, 1, "P_001", "T_1", (5.0, SHOTS[n][1]), SHOTS[n][0]) for i, n in enumerate(names)], f"match_id long, frame_id long, ord long, player_id string, team_id string, position struct<x:double,y:double>, keypoints {kp}")
    played = spark.createDataFrame([(i, [(k, *p) for k, p in enumerate(SHOTS[n][2])], SHOTS[n][3], SHOTS[n][4], SHOTS[n][1]) for i, n in enumerate(names)], "match_id long, after array<struct<idx:long,x:double,y:double>>, ground boolean, wall boolean, y double")
    rows = pose(players).join(played, "match_id").select("match_id", by_pose().alias("k"), serve_only().alias("s")).collect()
    assert {names[r["match_id"]]: r["k"]["type"] for r in rows} == {n: s[5] for n, s in SHOTS.items()}
    assert {(r["s"]["type"], r["s"]["c"]) for r in rows} == {("unknown", 0.3)}


def test_a_keypoint_listed_twice_counts_as_last_known(spark):
    from courtflow.operators.events import pose

    twice = [*_pose(280.0), ("left_wrist", 380.0, 100.0, 0.9), ("right_wrist", 520.0, 90.0, 0.1)]
    df = spark.createDataFrame([(1, 0, 1, "P_001", None, None, twice)], "match_id long, frame_id long, ord long, player_id string, team_id string, position struct<x:double,y:double>, keypoints array<struct<name:string,x:double,y:double,confidence:double>>")
    assert pose(df).first()["lift"] == 150.0


def test_shots_from_one_scan_and_one_shuffle(spark):
    """The plan that rallies rest on: both tables are read once and meet in one exchange."""
    from courtflow.operators import events as E
    from courtflow.operators import metrics as M
    from courtflow.operators import points as P
    from courtflow.sources import adapter as A

    d = "/root/testdata/sf0.001"
    rallies = M.rally_metrics(P.in_points(E.play_shots(E.match_play(A.ball_frames(spark, d), A.player_frames(spark, d)))))
    plan = rallies._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1 and "Join" not in plan


def test_given_bounces_contacts_and_numbers(spark):
    from courtflow.operators import events as E
    from courtflow.sources import adapter as A

    d = "/root/testdata/sf0.001"
    ball, players = A.ball_frames(spark, d), A.player_frames(spark, d)
    own = {(r["match_id"], r["n"], r["shot_type"], r["shot_id"][12:]) for r in E.shots(ball, players).collect()}
    again = E.shots(ball, players, contacts_=E.contacts(ball, players), bounces_=E.bounces(ball), match_set=2, game=3, point=4).collect()
    assert {(r["match_id"], r["n"], r["shot_type"], r["shot_id"][12:]) for r in again} == own
    assert all(r["shot_id"].startswith("S_002_03_04_") for r in again)
    none = E.shots(ball, players, classify=E.serve_only, bounces_=E.bounces(ball).limit(0)).collect()
    assert len(none) == len(own) and {r["shot_type"] for r in none} == {"unknown"} and not any(r["trajectory"] for r in none)
    at = E.bounces(ball, indices=spark.createDataFrame([(0, 40), (1, 17)], "match_id long, idx long")).collect()
    assert {(r["match_id"], r["idx"]) for r in at} <= {(0, 40), (1, 17)} and at
    assert E.bounces(ball, detect=lambda b: E.bounce_candidates(b).limit(3)).count() == 3


def test_assignment_against_search():
    from itertools import permutations

    import numpy as np

    from courtflow.operators.tracking import assignment

    g = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 4), (4, 4), (5, 6)):
        for _ in range(20):
            cost = g.uniform(size=(n, m)).round(1)
            got = assignment(cost)
            assert len(set(got.tolist())) == n
            want = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))
            assert abs(cost[range(n), got].sum() - want) < 1e-9
