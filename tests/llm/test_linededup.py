import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from courtflow.llm.common import Scratch
from courtflow.llm.linededup import dedup_lines, maximal_runs, refine, windows


def brute(docs, min_words):
    """docs: (id, text) in order. A line goes if some run of enough words around it ends somewhere before it starts."""
    text, where = [], []
    for d, (_, t) in enumerate(docs):
        if t is not None:
            lines = [x.strip() for x in t.split("\n")]
            where.append((d, len(text), len(lines)))
            text += lines
            text.append(("end", d))
    gone = {d: set() for d in range(len(docs))}
    first = {}
    for d, start, n in where:
        for i in range(n):
            for j in range(i + 1, n + 1):
                run = tuple(text[start + i : start + j])
                at = first.setdefault(run, start + i)
                if at + j - i <= start + i and sum(len(x.split()) for x in run) >= min_words:
                    gone[d].update(range(i, j))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, (_, t) in enumerate(docs)]


def test_windows():
    for seed in range(50):
        r = np.random.default_rng(seed)
        w = r.integers(0, 5, r.integers(1, 30))
        want = set()
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j].sum() >= 7 and (w[i : j - 1].sum() < 7 or w[i + 1 : j].sum() < 7):
                    want.add((i, j - i))
        got = {tuple(x) for x in windows(w, 7).tolist()}
        assert got <= want
        for i in range(len(w)):  # the shortest from each line, and to each line
            ahead = [n for s, n in want if s == i]
            assert not ahead or (i, min(ahead)) in got
            back = [n for s, n in want if s + n == i + 1]
            assert not back or (i + 1 - min(back), min(back)) in got


def corpus(seed):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcd") * 2 for _ in range(r.randint(0, 6))) for _ in range(12)] + [""]
    passages = [[r.choice(lines) for _ in range(r.randint(2, 9))] for _ in range(4)]
    docs = []
    for i in range(40):
        body = []
        for _ in range(r.randint(0, 4)):
            body += r.choice(passages) if r.random() < 0.5 else [f"own {i} {r.random()}"] * r.choice([1, 1, 3])
        docs.append((i, "\n".join(body)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_every_run(spark, seed):
    docs = corpus(seed) + [(50, None), (51, ""), (52, "\n\n"), (53, "hot " * 20_000 + "\n end"), (54, "hot " * 20_000)]
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    rows = [(docs[i][0], docs[i][1], "x", i, docs[i][0]) for i in order]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, lines_removed int, id long").repartition(4)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark, df, min_words=8).collect()}
    assert got == {i: t for (i, _), t in zip(docs, brute(docs, 8), strict=True)}


def test_a_run_of_equal_lines_keeps_its_first_copy(spark):
    line, pair = "w " * 20, "a " * 30 + "\n" + "b " * 30
    texts = ["\n".join([line] * 6), "\n".join([line] * 7), "\n".join([pair] * 4), "x\n" + "\n".join([line] * 3)]
    want = ["\n".join([line] * 3), "", pair, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in dedup_lines(spark, df).orderBy("doc_id").collect()] == want
    runs = sorted((r["id"], r["at"], r["len"]) for r in maximal_runs(spark, df).collect())
    assert runs == [(0, 3, 3), (1, 0, 7), (2, 2, 6), (3, 1, 3)]


def test_suffixes_are_ranked_in_order(spark):
    """Ranks of each round are the left ends of intervals of the sorted suffixes that repeat."""
    r = random.Random(2)
    text = [r.choice([3, 5, 8]) for _ in range(200)]
    s, span = Scratch(spark, "t"), 1
    rows = spark.createDataFrame([(i, 200, c, 0) for i, c in enumerate(text)], "pos long, end long, a long, b long")
    while span <= 8:
        suffixes = refine(s, rows)
        got = {x["pos"]: x["rank"] for x in suffixes.collect()}
        keys = {i: tuple(text[i : i + span]) for i in range(200 - span + 1)}
        repeat = sorted((k, i) for i, k in keys.items() if list(keys.values()).count(k) > 1)
        left = {}
        for rank, (k, _) in enumerate(repeat):
            left.setdefault(k, rank)
        assert got == {i: left[k] for k, i in repeat}
        b = suffixes.select(F.col("pos").alias("tail"), F.col("rank").alias("b"))
        rows = suffixes.where(F.col("pos") + 2 * span <= 200).select("pos", "end", F.col("rank").alias("a"), (F.col("pos") + span).alias("tail")).join(b, "tail").drop("tail")
        span *= 2


def test_repeated_rows_and_null_ids(spark):
    line = "w " * 60
    rows = [(None, line + "\nx", 1), (1, "y\n" + line, 2), (1, "y\n" + line, 3), (2, line, 4)]
    got = sorted((r["doc_id"] or 0, r["text"], r["k"], r["lines_removed"]) for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, k int")).collect())
    assert got == [(0, line + "\nx", 1, 0), (1, "y", 2, 1), (1, "y", 3, 1), (2, "", 4, 1)]
    assert dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
