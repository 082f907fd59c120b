"""Times the headline queries: median of three warm runs each, one JSON line."""

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
from pyspark.sql import SparkSession  # noqa: E402

from courtflow.plans.queries import QUERIES, player_report  # noqa: E402

HEADLINE = ("bounces", "contacts", "shots_classified", "points", "rally_metrics", "player_distance", "team_net_control", "team_pair_distance", "heatmap_smoothed", "active_shot_asof", "kalman_ball")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, f in ({n: QUERIES[n] for n in HEADLINE} | {"player_report": player_report}).items():
        runs = []
        for _ in range(4):
            t = time.time()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, summed medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
