"""Record types of the three layers, as Spark DDL, and the constants they use."""

POSITION2 = "struct<x:double,y:double>"
POSITION3 = "struct<x:double,y:double,z:double>"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
KEYPOINTS = "array<struct<name:string,x:double,y:double,confidence:double>>"
BOUNCES = f"array<struct<type:string,position:{POSITION3},timestamp_ms:double>>"

PLAYER_FRAMES = f"match_id long, frame_id long, timestamp_ms double, player_id string, ord long, team_id string, bbox {BOX}, position {POSITION2}, confidence double, keypoints {KEYPOINTS}"
BALL_FRAMES = f"match_id long, frame_id long, timestamp_ms double, bbox {BOX}, position {POSITION3}, confidence double, visibility string"
SHOTS = f"match_id long, shot_id string, timestamp_ms double, player_id string, team_id string, position {POSITION2}, shot_type string, trajectory {BOUNCES}, outcome string, confidence double"

# The court in metres, its zones, and the names of classes.
COURT_W, COURT_L, NET_Y = 10.0, 20.0, 10.0
NET_BAND, FENCE, WALL_Z = 0.5, 0.8, 1.0
SERVICE_NEAR, SERVICE_FAR = 3.0, 17.0
VISIBILITY = ("visible", "occluded", "inferred")
BOUNCE_TYPES = ("ground", "back_wall", "side_wall", "back_fence", "side_fence", "corner", "net")
WALLS = ("back_wall", "side_wall", "back_fence", "side_fence", "corner")
SHOT_TYPES = (
    "serve", "groundstroke_fh", "groundstroke_bh", "volley", "bandeja", "vibora", "smash", "smash_x3", "smash_x4",
    "lob", "chiquita", "bajada", "contra_pared", "wall_return", "drop_shot", "unknown",
)
OUTCOMES = ("winner", "error", "forced_error", "next_shot", "let")
SHOT_ID = r"^S_\d{3}_\d{2}_\d{2}_\d{3}$"
POINT_ID = r"^S_\d{3}_\d{2}_\d{2}$"
