import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflow.llm.quality import FEATURES, fit, score_quality, statistics


def test_statistics_of_odd_texts():
    for t in (None, b"", b" \n\t", b"one", "é\n\né".encode(), b"x" * 300_000, b"a b " * 60_000, b"\xff\xfe", b"!!! ??? %%%"):
        x = statistics(t)
        assert len(x) == len(FEATURES) and np.isfinite(x).all()
    assert statistics(None) == statistics(b"")


def test_score_is_the_density_ratio():
    g = np.random.default_rng(0)
    a, b = g.normal(0, 1, (400, 3)), g.normal(1, 2, (600, 3))
    m = fit(np.array([400.0, 600.0]), np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b]), shrink=0.0, ridge=0.0)
    x = g.normal(0, 2, (50, 3))
    z = (x - m.center) / m.scale
    logs = []
    pool = np.concatenate([a, b])
    covs = [np.cov(((c - pool.mean(0)) / pool.std(0)).T, bias=True) for c in (a, b)]
    pooled = 0.4 * covs[0] + 0.6 * covs[1]
    for c, cov, n in ((a, covs[0], 400), (b, covs[1], 600)):
        w = n / (n + 6)
        cov = w * cov + (1 - w) * pooled
        d = z - (c.mean(0) - pool.mean(0)) / pool.std(0)
        logs.append(np.log((n + 1) / 1002) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def docs(spark):
    r = random.Random(2)
    words = ["the", "river", "house", "of", "and", "slow", "green", "window", "table."]
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        rows.append((i, " ".join(w) if good else " | ".join(x + "$$" for x in w[:20]) * 2, i, "x"))
        labels.append((i, int(good)))
    rows += [(500, None, 0, ""), (501, "", 0, ""), (None, "the river", 0, ""), (502, "y" * 100_000, 0, ""), rows[0], rows[1]]
    labels += [(500, None), (None, 1), (7, 5), labels[0], labels[1], (9999, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, score string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_rows(spark):
    d, lab = docs(spark)
    got = score_quality(spark, d, lab, F.col("id") % 5 != 0).collect()
    assert len(got) == d.count()
    truth = {r["doc_id"]: r["quality"] for r in lab.collect() if r["quality"] in (0, 1) and r["doc_id"] is not None}
    held = [(r["predicted"], truth[r["id"]]) for r in got if r["id"] in truth and r["id"] % 5 == 0]
    assert len(held) > 70 and np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    # the labels that are held out change nothing
    flipped = lab.withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = score_quality(spark, d, flipped, F.col("id") % 5 != 0).collect()
    assert sorted((r["id"] or -1, round(r["score"], 9)) for r in again) == sorted((r["id"] or -1, round(r["score"], 9)) for r in got)


def test_no_labels_and_no_rows(spark):
    d, lab = docs(spark)
    got = score_quality(spark, d, lab.limit(0), F.lit(True)).collect()
    assert {round(r["score"], 9) for r in got} == {0.5}
    assert score_quality(spark, d.limit(0), lab, F.lit(True)).collect() == []
