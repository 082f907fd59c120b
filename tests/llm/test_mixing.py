import random

import numpy as np
import pytest

from courtflow.llm.mixing import capped_targets, code_point_order, mix_copies, round_rates


def test_targets():
    assert capped_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = capped_targets([1000, 10, 0], [1, 2, 3])
    assert got == pytest.approx([980, 30, 0])
    assert capped_targets([], []) == [] and capped_targets([0], [1]) == [0]
    sizes = [5, 100, 3000, 7, 1, 900]
    got = capped_targets(sizes, [1, 2, 3, 1, 2, 3])
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert code_point_order(["b", None, "B", "é", "a"]) == ["B", "a", "b", "é", None]


def test_rounding_ends_near_the_target():
    r = np.random.default_rng(0)
    size = np.sort(r.integers(1, 2000, 500))
    rate = np.minimum(3, np.exp(r.normal(0, 0.5, 500)))
    copies = round_rates(size, rate, float((size * rate).sum()), 3)
    assert abs((copies * size).sum() - (size * rate).sum()) <= size[:5].max() + 1
    assert ((copies == np.floor(rate)) | (copies == np.ceil(rate))).mean() > 0.99 and copies.min() >= 0 and copies.max() <= 3


def rows():
    r = random.Random(1)
    out = [(i, " ".join(["w"] * r.choice([1, 5, 80, 300])), r.choice(["a", "a", "a", "b", "C", None, ""]), i) for i in range(1500)]
    out += [(9001, None, "a", 0), (9002, "", "b", 0), (None, "some words here", "b", 0), (9003, "\t\n x  y \r", "tiny", 1), (9004, "z " * 30_000, "a", 2), (9005, " ", "none", 1)]
    return out + out[3:6]


@pytest.mark.parametrize("shard_rows", [100, 20_000])
def test_mix(spark, shard_rows):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int").repartition(7)
    run = lambda d: sorted((r["id"] or -1, r["size"], r["source"] or "~", r["copies"], r["taken"], r["target"], r["source_size"]) for r in mix_copies(spark, d, shard_rows=shard_rows).collect())
    got = run(df)
    assert len(got) == len(data)
    words = lambda t: len((t or "").split())
    assert sorted((g[0], g[1], g[2]) for g in got) == sorted((i or -1, words(t), "~" if s is None else s or "~") for i, t, s, _ in data)
    assert got == run(df.repartition(3))
    by = {}
    for _, size, _, copies, taken, target, total in got:
        assert 0 <= copies <= 3 and taken == copies * size
        by.setdefault((target, total), []).append((size, taken))
    assert sum(t for t, _ in by) == pytest.approx(sum(n for _, n in by))
    for (target, total), xs in by.items():
        assert sum(s for s, _ in xs) == total
        if total > 1000:
            assert sum(t for _, t in xs) == pytest.approx(target, rel=0.02)


def test_rates_solve_the_dual(spark):
    """The tilt found by Newton steps is the root found by plain bisection."""
    from courtflow.llm import mixing

    r = random.Random(5)
    data = [(i, "w " * r.randint(1, 60), r.choice("abc")) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    seen = {}
    real = mixing.solve

    def spy(sp, h, mix):
        seen["mix"], seen["lam"] = mix, real(sp, h, mix)
        return seen["lam"]

    mixing.solve = spy
    try:
        mix_copies(spark, df).collect()
    finally:
        mixing.solve = real
    mix = seen["mix"]
    for k, name in enumerate(mix.names):
        sizes = np.array([len(t.split()) for _, t, s in data if s == name], float)
        f = lambda x, sizes=sizes, k=k: (sizes * np.minimum(3, np.exp(np.minimum(x * sizes / mix.means[k], 50)))).sum()
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < mix.targets[k] else (lo, mid)
        assert seen["lam"][k] == pytest.approx(lo, abs=1e-6)


def test_empty(spark):
    assert mix_copies(spark, spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
