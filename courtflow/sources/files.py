"""Frames, records and annotations in files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BOX, VISIBILITY

_PLAYER = "frame_id long, timestamp_ms double, player_id string, team_id string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, position_x double, position_y double, confidence double"
_BALL = "frame_id long, timestamp_ms double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, position_x double, position_y double, position_z double, confidence double, visibility string"


def _flat(df: DataFrame, names: str) -> DataFrame:
    cols = []
    for n in [c.split()[0] for c in names.split(",")]:
        group, _, part = n.partition("_")
        cols.append(F.col(f"{group}.{part}").alias(n) if group in ("bbox", "position") else F.col(n))
    return df.select(*(["match_id"] if "match_id" in df.columns else []), *cols)


def write_frames(df: DataFrame, path: str, names: str) -> bool:
    """Flat scalar columns; keypoints are not kept. Nothing is written for no rows."""
    flat = _flat(df, names)
    if flat.isEmpty():
        return False
    flat.write.mode("overwrite").parquet(path)
    return True


def write_player_frames(df: DataFrame, path: str) -> bool:
    return write_frames(df, path, _PLAYER)


def write_ball_frames(df: DataFrame, path: str) -> bool:
    return write_frames(df, path, _BALL)


def _box():
    return F.struct(*(F.col(f"bbox_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


def read_player_frames(spark: SparkSession, path: str) -> DataFrame:
    """A position only where both coordinates are known; no keypoints."""
    df = spark.read.parquet(path)
    at = F.when(F.col("position_x").isNotNull() & F.col("position_y").isNotNull(), F.struct(F.col("position_x").alias("x"), F.col("position_y").alias("y")))
    keep = [c for c in df.columns if not c.startswith(("bbox_", "position_"))]
    return df.select(*keep, _box().alias("bbox"), at.alias("position"), F.array().cast("array<struct<name:string,x:double,y:double,confidence:double>>").alias("keypoints"))


def read_ball_frames(spark: SparkSession, path: str) -> DataFrame:
    """A box where it has a left edge, a position where it has an x; unknown heights are 0 and unknown visibilities an error."""
    df = spark.read.parquet(path)
    at = F.when(F.col("position_x").isNotNull(), F.struct(F.col("position_x").alias("x"), F.col("position_y").alias("y"), F.coalesce("position_z", F.lit(0.0)).alias("z")))
    box = F.when(F.col("bbox_x1").isNotNull(), _box()).otherwise(F.lit(None).cast(BOX))
    seen = F.when(F.col("visibility").isin(*VISIBILITY), F.col("visibility")).otherwise(F.raise_error(F.concat(F.lit("no such visibility: "), F.coalesce("visibility", F.lit("null")))))
    keep = [c for c in df.columns if not c.startswith(("bbox_", "position_")) and c != "visibility"]
    return df.select(*keep, box.alias("bbox"), at.alias("position"), seen.alias("visibility"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record a line; blank and malformed lines are skipped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def frame_range(frames: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Every ``step``-th frame from ``start``, ``end`` excluded; plain predicates, so a scan can skip the rest."""
    keep = (F.col("frame_id") >= start) & ((F.col("frame_id") - start) % step == 0)
    return frames.where(keep if end is None else keep & (F.col("frame_id") < end))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_calibration(rows: DataFrame, path: str) -> None:
    """Indented JSON of one calibration row, on the driver."""
    with open(path, "w") as f:
        json.dump(json.loads(rows.limit(1).toJSON().first()), f, indent=2)


_TASKS = "id long, annotations array<struct<result:array<struct<type:string,value:struct<x:double,y:double,keypointlabels:array<string>>>>>>, completions array<struct<result:array<struct<type:string,value:struct<x:double,y:double,keypointlabels:array<string>>>>>>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, x, y): labelled key points of the first annotation, else the first completion."""
    tasks = spark.read.schema(_TASKS).option("multiLine", True).json(path)
    result = F.coalesce(F.try_element_at("annotations", F.lit(1))["result"], F.try_element_at("completions", F.lit(1))["result"])
    got = tasks.select("id", F.explode(result).alias("r")).where((F.col("r.type") == "keypointlabels") & (F.size("r.value.keypointlabels") >= 1))
    return got.select("id", F.col("r.value.keypointlabels")[0].alias("label"), F.col("r.value.x").alias("x"), F.col("r.value.y").alias("y"))


def cached(spark: SparkSession, make, folder: str, settings: dict) -> DataFrame:
    """The table that ``make()`` gives, written once for each set of settings."""
    import hashlib

    key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_annotations(points: DataFrame, path: str) -> None:
    """(id, label, x, y, by_hand) in per cent to one JSON task a line: points within -5..105, clamped and rounded."""
    p = points.where(F.col("x").between(-5, 105) & F.col("y").between(-5, 105))
    fit = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(c))), 2).alias(c)
    value = F.struct(fit("x"), fit("y"), F.array("label").alias("keypointlabels"))
    seen = F.when(F.col("by_hand"), "visible").otherwise("occluded").alias("visibility")
    tasks = p.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", F.struct(F.lit("keypointlabels").alias("type"), value.alias("value"), seen).alias("r")))).alias("l"))
    tasks.select("id", F.array(F.struct(F.transform("l", lambda x: x["r"]).alias("result"))).alias("annotations")).write.mode("overwrite").json(path)
