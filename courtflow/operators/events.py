"""Bounces, contacts and shots from ball and player frames.

``match_play`` is the one pass that shots, points and rally metrics rest on: ball
and player rows meet in one shuffle and one sort by match, windows over that
order mark candidates, and the few kept ones come out as arrays, a row a match.
What follows (trajectories, points, rallies) groups by the match first, so it
needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import surface
from ..functions.sequence import greedy_apart, in_match, suppress
from ..schema import COURT_L, NET_Y, SERVICE_NEAR, WALLS

Detector = Callable[..., DataFrame]


def indexed(ball: DataFrame) -> DataFrame:
    """Ball frames with their place in the match, from 0, and flat coordinates."""
    idx = F.row_number().over(in_match("frame_id")) - 1
    return ball.select("match_id", "frame_id", "timestamp_ms", idx.cast("long").alias("idx"), F.col("position.x").alias("x"), F.col("position.y").alias("y"), F.col("position.z").alias("z"), "confidence", "visibility")


def visible_ball(ball: DataFrame, confidence: float = 0.1) -> DataFrame:
    return ball.where((F.col("visibility") == "visible") & F.col("position").isNotNull() & (F.col("confidence") >= confidence))


def velocity(ball: DataFrame) -> DataFrame:
    """Difference to the row before, over visible rows."""
    w = in_match("frame_id")
    rows = visible_ball(ball).select("match_id", "frame_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"))
    return rows.select("match_id", "frame_id", (F.col("x") - F.lag("x").over(w)).alias("vx"), (F.col("y") - F.lag("y").over(w)).alias("vy"))


def bounce_candidates(ball: DataFrame, window: int = 5, threshold: float = 0.3, confidence: float = 0.1) -> DataFrame:
    """Rows where the mean velocity of half a window before and after reverses, on either axis."""
    half = max(1, window // 2)
    w, whole = in_match("idx"), Window.partitionBy("match_id")
    seen = indexed(ball).where((F.col("visibility") == "visible") & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("confidence") >= confidence))
    seen = seen.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole))
    flags = F.lit(False)
    for c in ("x", "y"):
        before = (F.col(c) - F.lag(c, half).over(w)) / half
        after = (F.lead(c, half).over(w) - F.col(c)) / half
        seen = seen.withColumn(f"{c}_before", before).withColumn(f"{c}_after", after)
        b, a = F.col(f"{c}_before"), F.col(f"{c}_after")
        flags = flags | ((F.signum(b) != F.signum(a)) & (F.abs(b) > threshold) & (F.abs(a) > threshold))
    inside = F.col("k").between(half, F.col("n") - 2 - half) & (F.col("n") >= window + 2)
    return seen.where(inside & flags).select("match_id", "idx", "frame_id", "timestamp_ms", "x", "y", "z")


def velocity_reversals(ball: DataFrame, apart: int = 8, **options) -> DataFrame:
    """Candidates kept ``apart`` frames or more from the last kept."""
    return suppress(bounce_candidates(ball, **options), "idx", apart)


def bounces(ball: DataFrame, detect: Detector = velocity_reversals, classify: Callable[[Column, Column, Column], Column] = surface, indices: DataFrame | None = None, **options) -> DataFrame:
    """Bounces with the surface they hit; ``options`` go to ``detect``.

    ``detect`` gives the rows (match_id, idx, frame_id, timestamp_ms, x, y, z) of the
    bounces in ball frames; ``classify`` a type from x, y and z. Where ``indices``
    (match_id, idx) are given, they are the bounces, save those without a place.
    """
    if indices is None:
        kept = detect(ball, **options)
    else:
        kept = indexed(ball).join(indices.select("match_id", "idx").distinct(), ["match_id", "idx"]).where("x is not null and y is not null")
        kept = kept.select("match_id", "idx", "frame_id", "timestamp_ms", "x", "y", "z")
    return kept.withColumn("type", classify(F.col("x"), F.col("y"), F.col("z")))


def contact_candidates(ball: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose second difference of position is large; inferred rows don't count."""
    w = in_match("idx")
    rows = indexed(ball).where((F.col("visibility") != "inferred") & F.col("x").isNotNull() & F.col("y").isNotNull())
    turn = lambda c: (F.lead(c).over(w) - F.col(c)) - (F.col(c) - F.lag(c).over(w))
    rows = rows.withColumn("ax", turn("x")).withColumn("ay", turn("y"))
    rows = rows.withColumn("dv", F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")))
    return rows.where(F.col("dv") >= threshold).select("match_id", "idx", "frame_id", "timestamp_ms", "x", "y", "dv")


def flat_players(players: DataFrame) -> DataFrame:
    return players.select("match_id", "frame_id", "player_id", "ord", "team_id", F.col("position.x").alias("px"), F.col("position.y").alias("py"))


def pose(players: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Players flat, with what their key points of ``min_conf`` or more tell.

    lift is how far the higher wrist is above the higher shoulder (0 unless both of
    each are known), forehand whether the right wrist is farther from the body than
    the left (true unless known), spin whether a wrist is far beside its elbow.
    """
    # plain lookups by name; only where a name is listed twice, the last of those known well enough is searched for
    base = ("match_id", "frame_id", "ord", "player_id", "team_id")
    parts = [f"{side}_{part}" for side in ("left", "right") for part in ("shoulder", "wrist", "elbow", "hip")]
    s = players.selectExpr(*base, "position.x as px", "position.y as py", "keypoints as k", "keypoints.name as names", "keypoints.x as xs", "keypoints.y as ys", "keypoints.confidence as cs")
    s = s.selectExpr(*base, "px", "py", "names", "xs", "ys", "cs", "if(size(array_distinct(names)) < size(names), transform(k, (p, i) -> if(p.confidence >= {c} and not exists(slice(k, i + 2, size(k)), q -> q.name = p.name and q.confidence >= {c}), p.name, null)), names) as last".format(c=min_conf))
    s = s.selectExpr(*base, "px", "py", "xs", "ys", "cs", *(f"cast(array_position(last, '{n}') as int) - 1 as {n}" for n in parts))
    known = lambda *names: " and ".join(f"coalesce(get(cs, {side}_{n}) >= {min_conf}, false)" for n in names for side in ("left", "right"))
    return s.selectExpr(
        *base, "px", "py",
        f"if({known('shoulder', 'wrist')}, least(get(ys, left_shoulder), get(ys, right_shoulder)) - least(get(ys, left_wrist), get(ys, right_wrist)), 0.0D) as lift",
        f"if({known('wrist', 'hip')}, abs(get(xs, right_wrist) - (get(xs, left_hip) + get(xs, right_hip)) / 2) > abs(get(xs, left_wrist) - (get(xs, left_hip) + get(xs, right_hip)) / 2), true) as forehand",
        f"{known('elbow', 'wrist')} and greatest(abs(get(xs, left_wrist) - get(xs, left_elbow)), abs(get(xs, right_wrist) - get(xs, right_elbow))) > 40 as spin",
    )


def _frames_with_players(ball: DataFrame, players: DataFrame, min_conf: float) -> DataFrame:
    """Ball rows with their place in the match and the players of their frame: one shuffle, one sort."""
    b = F.struct("timestamp_ms", F.col("position.x").alias("x"), F.col("position.y").alias("y"), F.col("position.z").alias("z"), "confidence", "visibility").alias("b")
    who = pose(players, min_conf).select("match_id", "frame_id", F.struct("ord", "player_id", "team_id", "px", "py", "lift", "forehand", "spin").alias("p"))
    left = ball.select("match_id", "frame_id", b)
    left = left.withColumn("p", F.lit(None).cast(who.schema["p"].dataType))
    both = left.unionByName(who.select("match_id", "frame_id", F.lit(None).cast(left.schema["b"].dataType).alias("b"), "p"))
    both = both.withColumn("players", F.collect_list("p").over(in_match("frame_id").rangeBetween(0, 0))).where("b is not null")
    return both.select("match_id", "frame_id", "b.*", "players").withColumn("idx", (F.row_number().over(in_match("frame_id")) - 1).cast("long"))


def match_play(ball: DataFrame, players: DataFrame, bounce_window: int = 5, reversal: float = 0.3, confidence: float = 0.1, apart: int = 8, turn: float = 0.5, radius: float = 2.0, apart_ms: float = 300.0, gap_ms: float = 3000.0, least_ms: float = 500.0, path: int = 30, min_conf: float = 0.3, classify: Callable[[Column, Column, Column], Column] = surface) -> DataFrame:
    """One row for each match: its bounces, contacts and sessions of play, as arrays in time order.

    A contact holds the nearest player of the frame within ``radius`` (ties: first
    listed), that player's pose, and the ``path`` ball frames from it on. Sessions
    are runs of visible frames without a pause of ``gap_ms``, ``least_ms`` long at
    least, numbered from 1. Frames are taken to be in time order.
    """
    half = max(1, bounce_window // 2)
    over = "(partition by match_id order by frame_id)"
    seen, moving = f"visibility = 'visible' and x is not null and y is not null and confidence >= {confidence}", "visibility <> 'inferred' and x is not null and y is not null"
    rows = _frames_with_players(ball, players, min_conf)
    rows = rows.selectExpr("*", *(f"if({when}, {c}, null) as {k}{c}" for k, when in (("s", seen), ("m", moving)) for c in "xy"), "if(visibility = 'visible', timestamp_ms, null) as st")
    # neighbours among the rows of one kind only: lag and lead that pass over nulls
    at = [f"{f}({k}{c}, {n}) ignore nulls over {over} as {f}_{k}{c}" for k, n in (("s", half), ("m", 1)) for c in "xy" for f in ("lag", "lead")]
    rows = rows.selectExpr("*", "count(sx) over (partition by match_id order by frame_id rows unbounded preceding) - 1 as k", "count(sx) over (partition by match_id order by frame_id rows between unbounded preceding and unbounded following) as n", *at, *(f"{f}(st) ignore nulls over {over} as {f}_st" for f in ("lag", "lead")))
    turned = " or ".join(f"(signum({c} - lag_{c}) <> signum(lead_{c} - {c}) and abs(({c} - lag_{c}) / {half}) > {reversal} and abs((lead_{c} - {c}) / {half}) > {reversal})" for c in ("sx", "sy"))
    rows = rows.selectExpr(
        "*", f"sx is not null and k between {half} and n - {2 + half} and n >= {bounce_window + 2} and coalesce({turned}, false) as bounce",
        "sqrt(pow((lead_mx - mx) - (mx - lag_mx), 2) + pow((lead_my - my) - (my - lag_my), 2)) as dv",
        f"st is not null and (lag_st is null or st - lag_st >= {gap_ms}) as fresh", f"st is not null and (lead_st is null or lead_st - st >= {gap_ms}) as done",
    )
    reach = "transform(players, q -> struct(sqrt((x - q.px) * (x - q.px) + (y - q.py) * (y - q.py)) as dist, q.ord, q.player_id, q.team_id, q.px, q.py))"
    rows = rows.selectExpr("*", f"if(dv >= {turn}, array_min(filter({reach}, s -> s.dist <= {radius})), null) as near")
    # a player listed twice in a frame has the pose of the first row
    rows = rows.selectExpr("*", "if(near is null, null, array_min(transform(filter(players, q -> q.player_id = near.player_id), q -> struct(q.ord, q.lift, q.forehand, q.spin)))) as own")
    contact = f"struct(timestamp_ms, idx, frame_id, near.player_id, near.team_id, x, y, near.px, near.py, near.dist, least(1.0D, dv / {turn * 3}D) as confidence, own.lift, own.forehand, own.spin)"
    listing = lambda when, what, name: F.expr(f"sort_array(collect_list(if({when}, {what}, null)))").alias(name)
    m = rows.groupBy("match_id").agg(
        listing("bounce", "struct(idx, frame_id, timestamp_ms, x, y, z)", "b"), listing("near is not null", contact, "c"),
        F.expr("sort_array(collect_list(struct(idx, x, y)))").alias("ball"), listing("fresh", "st", "starts"), listing("done", "st", "ends"),
    )
    m = m.select("match_id", greedy_apart(F.col("b"), lambda x: x["idx"], apart).alias("b"), greedy_apart(F.col("c"), lambda x: x["timestamp_ms"], apart_ms).alias("c"), "ball", "starts", "ends")
    fields = ", ".join(f"x.{f}" for f in _CONTACT)
    after = f"filter(transform(sequence(0, {path - 1}), o -> get(ball, cast(x.idx as int) + o)), f -> f is not null)"
    return m.select(
        "match_id", F.transform("b", lambda x: F.struct(*(x[f].alias(f) for f in ("idx", "frame_id", "timestamp_ms", "x", "y", "z")), classify(x["x"], x["y"], x["z"]).alias("type"))).alias("bounces"),
        F.expr(f"transform(c, (x, i) -> struct({fields}, i + 1 as n, if(i > 0, get(c, i - 1).timestamp_ms, null) as prev_ms, {after} as after))").alias("contacts"),
        F.expr(f"transform(filter(zip_with(starts, ends, (a, z) -> struct(a as start_ms, z as end_ms)), r -> r.end_ms - r.start_ms >= {least_ms}), (r, i) -> struct(i + 1 as point, r.start_ms, r.end_ms))").alias("sessions"),
    )


_CONTACT = ("timestamp_ms", "idx", "frame_id", "player_id", "team_id", "x", "y", "px", "py", "dist", "confidence", "lift", "forehand", "spin")


def contacts(ball: DataFrame, players: DataFrame, radius: float = 2.0, apart_ms: float = 300.0, threshold: float = 0.5) -> DataFrame:
    """Sharp turns of the ball with the nearest player of the frame within ``radius`` (ties: first listed), greedily ``apart_ms`` apart."""
    m = match_play(ball, players, radius=radius, apart_ms=apart_ms, turn=threshold).select("match_id", F.explode("contacts").alias("c"))
    return m.select("match_id", *(F.col(f"c.{f}").alias(f) for f in ("timestamp_ms", "idx", "frame_id", "player_id", "team_id", "x", "y", "px", "py", "dist", "confidence")))


def nearest_player_distance(ball: DataFrame, players: DataFrame, cap: float = 99.0) -> DataFrame:
    b = indexed(ball).where("x is not null").select("match_id", "frame_id", "x", "y")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    d = b.join(flat_players(players), ["match_id", "frame_id"], "left").groupBy("match_id", "frame_id").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("d"))
    return d.select("match_id", "frame_id", F.least(F.lit(cap), F.coalesce("d", F.lit(cap))).alias("distance"))


def spans(contacts_: DataFrame) -> DataFrame:
    """Contacts in order, numbered from 1, with the times of the one before and the one after."""
    w = in_match("timestamp_ms", "idx")
    return contacts_.select("*", F.row_number().over(w).alias("n"), F.lag("timestamp_ms").over(w).alias("prev_ms"), F.lead("timestamp_ms").over(w).alias("next_ms"))


def trajectories(spans_: DataFrame, bounces_: DataFrame) -> DataFrame:
    """(match_id, n, bounce...) for the bounces from each contact up to the next; the match is the equal key."""
    b = bounces_.select("match_id", F.coalesce("timestamp_ms", F.lit(0.0)).alias("b_ms"), "type", F.col("x").alias("bx"), F.col("y").alias("by"))
    c = spans_.select("match_id", "n", F.col("timestamp_ms").alias("c_ms"), "next_ms")
    # each bounce belongs to the latest contact at or before it: an as-of join
    w = in_match("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = c.select("match_id", F.col("c_ms").alias("at"), F.lit(0).alias("side"), "n", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("bx"), F.lit(None).cast("double").alias("by"))
    both = both.unionByName(b.select("match_id", F.col("b_ms").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("n"), "type", "bx", "by"))
    return both.withColumn("n", F.last("n", ignorenulls=True).over(w)).where("side = 1 and n is not null").select("match_id", "n", F.col("at").alias("b_ms"), "type", "bx", "by")


def bounces_before(spans_: DataFrame, bounces_: DataFrame) -> DataFrame:
    """The bounces strictly between the contact before and each contact."""
    w = in_match("at", "side").rowsBetween(0, Window.unboundedFollowing)
    c = spans_.select("match_id", F.col("timestamp_ms").alias("at"), F.lit(0).alias("side"), F.struct("n", F.coalesce("prev_ms", F.lit(float("-inf"))).alias("prev")).alias("next"), F.lit(None).cast("string").alias("type"))
    b = bounces_.select("match_id", F.coalesce("timestamp_ms", F.lit(0.0)).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(c.schema["next"].dataType).alias("next"), "type")
    both = c.unionByName(b).withColumn("next", F.first("next", ignorenulls=True).over(w))
    return both.where("side = 1 and next is not null and at > next.prev").select("match_id", F.col("next.n").alias("n"), F.col("at").alias("b_ms"), "type")


def frames_after(spans_: DataFrame, ball: DataFrame, most: int = 30) -> DataFrame:
    """(match_id, n, o, x, y): the ``most`` frames from each contact on; keyed by place, so linear in contacts."""
    c = spans_.select("match_id", "n", F.col("idx").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("o")).withColumn("idx", F.col("c") + F.col("o"))
    return c.join(indexed(ball).select("match_id", "idx", "x", "y"), ["match_id", "idx"]).select("match_id", "n", "o", "x", "y")


def frames_before(spans_: DataFrame, ball: DataFrame, most: int = 30) -> DataFrame:
    """(match_id, n, o, x, y): the last ``most`` frames up to each contact that come after the contact before; o is 0 at the contact."""
    c = spans_.select("match_id", "n", "prev_ms", F.col("idx").alias("c"), F.explode(F.sequence(F.lit(1 - most).cast("long"), F.lit(0).cast("long"))).alias("o")).withColumn("idx", F.col("c") + F.col("o"))
    b = indexed(ball).select("match_id", "idx", F.col("timestamp_ms").alias("t"), "x", "y")
    return c.join(b, ["match_id", "idx"]).where("prev_ms is null or t > prev_ms").select("match_id", "n", "o", "x", "y")


def _kind(name: str, c: float) -> str:
    return f"named_struct('type', '{name}', 'c', {c}D)"


def serve_only() -> Column:
    """Every shot unknown, so that the first of a point becomes its serve."""
    return F.expr(_kind("unknown", 0.3))


def by_pose() -> Column:
    """(type, c) of shots by pose, ball path and the bounces before; reads ground, wall, lift, forehand, spin, after, y and py."""
    known = lambda n: f"filter(slice(after, 1, {n}), p -> p.x is not null and p.y is not null)"
    p10, p15, p20 = known(10), known(15), known(20)
    last = lambda c: f"try_element_at({c}, -1).y"
    length = f"aggregate({p10}, named_struct('n', 0.0D, 'x', cast(null as double), 'y', cast(null as double)), (a, p) -> named_struct('n', a.n + if(a.x is null, 0.0D, sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2))), 'x', p.x, 'y', p.y), a -> a.n)"
    where = "coalesce(py, y)"
    short, lob = f"(size({p10}) >= 2 and {length} < 2.0D)", f"(size({p15}) >= 3 and abs({last(p15)} - get({p15}, 0).y) > 3.0D)"
    leaves = f"exists({p20}, p -> p.y < 0.5D or p.y > 19.5D or p.x < 0.5D or p.x > 9.5D)"
    chiquita = f"(size({p10}) >= 2 and abs({last(p10)} - {NET_Y}D) < abs({where} - {NET_Y}D))"
    return F.expr(f"""case
        when not ground and lift > 50 then if({leaves}, {_kind("smash_x3", 0.7)}, {_kind("smash", 0.75)})
        when not ground and lift > 0 then if(spin, {_kind("vibora", 0.65)}, {_kind("bandeja", 0.7)})
        when not ground then if({short}, {_kind("drop_shot", 0.65)}, {_kind("volley", 0.7)})
        when wall and ({where} < {SERVICE_NEAR}D or {where} > {COURT_L - SERVICE_NEAR}D) then if({lob}, {_kind("lob", 0.65)}, {_kind("contra_pared", 0.6)})
        when wall then {_kind("wall_return", 0.6)}
        when lift > 0 then if({lob}, {_kind("lob", 0.6)}, {_kind("bajada", 0.6)})
        when {chiquita} then {_kind("chiquita", 0.6)}
        when forehand then {_kind("groundstroke_fh", 0.65)} else {_kind("groundstroke_bh", 0.65)} end""")


def play_with(play: DataFrame, contacts_: DataFrame | None = None, bounces_: DataFrame | None = None) -> DataFrame:
    """``play`` with other contacts (as ``contacts`` gives them) or bounces (as ``bounces`` does) in place of its own.

    Given contacts are matched to the frame's path and pose by their idx: those that
    ``play`` has no contact at have neither.
    """
    if bounces_ is not None:
        fields = [f for f in play.schema["bounces"].dataType.elementType.names]
        typed = lambda f: F.col(f) if f in bounces_.columns else F.lit(None).cast("long" if f in ("idx", "frame_id") else "double")
        own = bounces_.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*(typed(f).alias(f) for f in fields)))).alias("_own"))
        play = play.join(own, "match_id", "left").withColumn("bounces", F.coalesce(F.col("_own").cast(play.schema["bounces"].dataType), F.filter("bounces", lambda _: F.lit(False)))).drop("_own")
    if contacts_ is not None:
        after = play.schema["contacts"].dataType.elementType["after"].dataType.simpleString()
        own = contacts_.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(*(F.col(f) for f in _CONTACT[:11])))).alias("_own"))
        held = "get(filter(contacts, c -> c.idx = x.idx), 0)"
        fields = ", ".join(f"x.{f} as {f}" for f in _CONTACT[:11])
        given = f"""transform(_own, (x, i) -> struct({fields}, coalesce({held}.lift, 0.0D) as lift, coalesce({held}.forehand, true) as forehand, coalesce({held}.spin, false) as spin,
            i + 1 as n, if(i > 0, get(_own, i - 1).timestamp_ms, null) as prev_ms, coalesce({held}.after, cast(array() as {after})) as after))"""
        play = play.join(own, "match_id", "left").withColumn("contacts", F.expr(f"coalesce({given}, slice(contacts, 1, 0))")).drop("_own")
    return play


def play_shots(play: DataFrame, classify: Callable[[], Column] = by_pose, match_set: int = 1, game: int = 1, point: int = 1) -> DataFrame:
    """Shots of ``match_play`` rows, their trajectories in arrays, with the match's sessions; all within the match's partition.

    ``classify`` gives a struct of type and c (how sure) over the columns that
    ``by_pose`` reads. A bounce belongs to the latest contact at or before it, and to
    the next one's "before" if it lies strictly between the two: two running lookups
    over one order.
    """
    kinds = {n: play.schema[n].dataType.elementType.simpleString() for n in ("contacts", "bounces")}
    event = lambda at, side, c, b: f"struct(coalesce({at}, 0.0D) as at, {side} as side, cast({c} as {kinds['contacts']}) as c, cast({b} as {kinds['bounces']}) as bn)"
    both = f"concat(transform(contacts, c -> {event('c.timestamp_ms', 0, 'c', 'null')}), transform(bounces, b -> {event('b.timestamp_ms', 1, 'null', 'b')}))"
    e = play.selectExpr("match_id", "sessions", f"explode({both}) as e").selectExpr("match_id", "sessions", "e.*")
    e = e.selectExpr(
        "*", "last(c.n, true) over (partition by match_id order by at, side rows unbounded preceding) as owner",
        "first(if(side = 0, struct(c.n, coalesce(c.prev_ms, cast('-infinity' as double)) as prev), null), true) over (partition by match_id order by at, side rows between current row and unbounded following) as next",
    )
    e = e.selectExpr("*", "explode(if(side = 0, array(struct(owner as n, 0 as role)), array(struct(owner as n, 1 as role), struct(if(at > next.prev, next.n, null) as n, 2 as role)))) as t").where("t.n is not null")
    walls = ", ".join(f"'{w}'" for w in WALLS)
    s = e.groupBy("match_id", F.expr("t.n").alias("n")).agg(
        F.expr("first(c, true)").alias("c"), F.first("sessions").alias("sessions"), F.expr("sort_array(collect_list(if(t.role = 1, struct(at, bn.type, bn.x, bn.y), null)))").alias("path"),
        F.expr("coalesce(bool_or(t.role = 2 and bn.type = 'ground'), false)").alias("ground"), F.expr(f"coalesce(bool_or(t.role = 2 and bn.type in ({walls})), false)").alias("wall"),
    )
    s = s.selectExpr("match_id", "n", "sessions", "path", "ground", "wall", *(f"c.{f} as {f}" for f in (*_CONTACT, "after")))
    return s.select("*", classify().alias("kind")).selectExpr(
        "match_id", "n", f"format_string('S_{match_set:03d}_{game:02d}_{point:02d}_%03d', n) as shot_id", "timestamp_ms", "player_id", "coalesce(team_id, 'T_UNKNOWN') as team_id", "struct(x, y) as position", "kind.type as shot_type",
        "transform(path, t -> struct(t.type as type, struct(t.x as x, t.y as y, cast(null as double) as z) as position, t.at as timestamp_ms)) as trajectory", "cast(null as string) as outcome", "confidence * kind.c as confidence", "sessions",
    )


def shots(ball: DataFrame, players: DataFrame, classify: Callable[[], Column] = by_pose, contacts_: DataFrame | None = None, bounces_: DataFrame | None = None, match_set: int = 1, game: int = 1, point: int = 1, **options) -> DataFrame:
    """Contacts as shots, classified; one row each. ``contacts_`` and ``bounces_`` replace those found, ``options`` go to ``match_play``."""
    play = play_with(match_play(ball, players, **options), contacts_, bounces_)
    return play_shots(play, classify, match_set, game, point).drop("sessions")


def without_contacts(bounces_: DataFrame, contacts_: DataFrame, within_ms: float = 200.0) -> DataFrame:
    """Bounces that have no contact strictly within ``within_ms``; those without a time stay."""
    c = contacts_.select(F.col("match_id").alias("m"), F.col("timestamp_ms").alias("c_ms"))
    return bounces_.join(c, (F.col("match_id") == F.col("m")) & (F.abs(F.col("timestamp_ms") - F.col("c_ms")) < within_ms), "left_anti")


def velocity_around(ball: DataFrame, reach: int = 3) -> DataFrame:
    """Displacement between the first and last known place of the ``reach`` frames before, and after, each frame; 0 under two."""
    rows = indexed(ball)
    known = (F.col("visibility") != "inferred") & F.col("x").isNotNull()
    rows = rows.withColumn("p", F.when(known, F.struct("x", "y")))
    out = ["match_id", "frame_id"]
    for name, lo, hi in (("before", -reach, -1), ("after", 1, reach)):
        w = in_match("idx").rowsBetween(lo, hi)
        a, b = F.first("p", ignorenulls=True).over(w), F.last("p", ignorenulls=True).over(w)
        n = F.count("p").over(w)
        rows = rows.withColumn(f"vx_{name}", F.when(n >= 2, b["x"] - a["x"]).otherwise(0.0)).withColumn(f"vy_{name}", F.when(n >= 2, b["y"] - a["y"]).otherwise(0.0))
        out += [f"vx_{name}", f"vy_{name}"]
    return rows.select(*out)


def moving_average(rows: DataFrame, column: str, window: int = 5) -> DataFrame:
    """Centered mean over ``window`` rows; the ends stay as they are."""
    half = window // 2
    w = in_match("frame_id").rowsBetween(-half, half)
    full = F.count("*").over(w) == 2 * half + 1
    return rows.withColumn(column, F.when(full, F.avg(column).over(w)).otherwise(F.col(column)))
