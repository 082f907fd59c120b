"""Command line: process tracked frames into reports, and fit a calibration from named points."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import events as E
from .operators import metrics as M
from .operators import points as P
from .operators.calibrating import calibrate
from .operators.reports import match_json, to_html, write_json
from .session import session


def process(ball: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """Bounces, shots, points and metrics of all matches, each lazy."""
    contacts = E.contacts(ball, players)
    shots = P.in_points(E.play_shots(E.match_play(ball, players)))
    return {
        "bounces": E.without_contacts(E.bounces(ball), contacts), "contacts": contacts, "shots": shots, "points": P.points(shots),
        "rallies": M.rally_metrics(shots), "players": M.player_metrics(shots, players), "teams": M.team_metrics(shots, players),
    }


def export(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> None:
    """Every table as Parquet under ``out``, one after the other, dealt by match."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("match_id").parquet(f"{out}/{name}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="courtflow")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("process", help="from ball and player frames (Parquet) to tables and one match's report")
    run.add_argument("ball")
    run.add_argument("players")
    run.add_argument("out")
    run.add_argument("--match", type=int)
    fit = sub.add_parser("calibrate", help="from a JSON file of named pixel points to a calibration")
    fit.add_argument("points")
    fit.add_argument("out")
    fit.add_argument("--width", type=int, default=1920)
    fit.add_argument("--height", type=int, default=1080)
    a = p.parse_args(argv)
    if a.command == "calibrate":
        got = calibrate({k: tuple(v) for k, v in json.loads(Path(a.points).read_text()).items()}, a.width, a.height)
        if got is None:
            print("the points don't give a valid court")
            return 1
        write_json(got, a.out)
        return 0
    spark = session()
    tables = process(spark.read.parquet(a.ball), spark.read.parquet(a.players))
    export(spark, tables, a.out)
    if a.match is not None:
        one = lambda n: spark.read.parquet(f"{a.out}/{n}").where(F.col("match_id") == a.match)
        report = match_json(f"M_{a.match:03d}", one("rallies"), one("players"), one("teams"))
        write_json(report, f"{a.out}/report.json")
        Path(f"{a.out}/report.html").write_text(to_html(report))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
