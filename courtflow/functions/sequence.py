"""Sequence rules over ordered rows of a match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_match(*order: str):
    return Window.partitionBy("match_id").orderBy(*(order or ("frame_id",)))


def greedy_apart(items: Column, at: Callable[[Column], Column], apart: float) -> Column:
    """Of a sorted array, the first item and each that lies ``apart`` or more after the last one kept."""
    empty = F.filter(items, lambda _: F.lit(False))
    keep = lambda kept, x: (F.size(kept) == 0) | (at(x) - at(F.try_element_at(kept, F.lit(-1))) >= apart)
    return F.aggregate(items, empty, lambda kept, x: F.when(keep(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def suppress(rows: DataFrame, at: str, apart: float) -> DataFrame:
    """Greedy suppression within each match by the column ``at``; ties in the order of the other columns.

    Only candidates are gathered, a few in a hundred rows of one match.
    """
    cols = [at, *(c for c in rows.columns if c not in ("match_id", at))]
    kept = rows.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))
    kept = kept.select("match_id", F.explode(greedy_apart(F.col("items"), lambda x: x[at], apart)).alias("i"))
    return kept.select("match_id", *(F.col(f"i.{c}").alias(c) for c in rows.columns if c != "match_id"))


def sessions(rows: DataFrame, at: str, gap: float, least: float) -> DataFrame:
    """(match_id, point, start_ms, end_ms): runs of rows under ``gap`` apart that last ``least`` or more, numbered from 1."""
    w = in_match(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(0))
    runs = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    runs = runs.groupBy("match_id", "session").agg(F.min(at).alias("start_ms"), F.max(at).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least)
    return runs.select("match_id", F.row_number().over(in_match("start_ms")).alias("point"), "start_ms", "end_ms")


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tolerance: float) -> DataFrame:
    """Each left row with the latest right row at or before it, within ``tolerance``: one sort, no pair of rows is made."""
    names = [c for c in right.columns if c != "match_id"]
    pack = F.struct(*names)
    both = left.select("match_id", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(pack.alias("s")).schema["s"].dataType).alias("_r"))
    other = right.select("match_id", F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), pack.alias("_r"))
    w = in_match("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.unionByName(other).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    near = F.col("_at") <= F.col(f"_last.{right_at}") + tolerance
    return both.select("_row.*", *(F.when(near, F.col(f"_last.{c}")).alias(c) for c in names))


def nearest(left: DataFrame, right: DataFrame, left_at: str, right_at: str, key: str) -> DataFrame:
    """Each left row with the right row nearest to it (ties to the one before) as ``key``: two running lookups over one sorted union."""
    pack = F.struct(F.col(right_at).alias("t"), F.col(key).alias("f"))
    row = F.struct(*left.columns)
    kinds = {"_row": left.select(row.alias("s")).schema["s"].dataType, "_r": right.select(pack.alias("s")).schema["s"].dataType}
    null = lambda n: F.lit(None).cast(kinds[n]).alias(n)
    both = left.select("match_id", F.col(left_at).alias("_at"), row.alias("_row"), null("_r")).unionByName(right.select("match_id", F.col(right_at).alias("_at"), null("_row"), pack.alias("_r")))
    back, ahead = in_match("_at").rangeBetween(Window.unboundedPreceding, 0), in_match("_at").rangeBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_p", F.last("_r", True).over(back)).withColumn("_q", F.first("_r", True).over(ahead)).where("_row is not null")
    near = F.when(F.col("_q").isNull() | (F.col("_at") - F.col("_p.t") <= F.col("_q.t") - F.col("_at")), F.col("_p.f")).otherwise(F.col("_q.f"))
    return both.select("_row.*", near.alias(key))
