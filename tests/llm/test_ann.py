import numpy as np
import pytest

from courtflow.llm.ann import Tree, fit_tree, search


def brute(vecs, k=20, every=20):
    ok = {}
    for i, v in vecs:
        if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0].tolist():
        s = (x * ok[i]).sum(1)
        keep = ids != i
        order = np.lexsort((ids[keep], -np.round(s[keep], 12)))[:k]
        out[i] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def data(n=1500, seed=0):
    g = np.random.default_rng(seed)
    base = g.normal(size=(30, 8)) * g.uniform(0.2, 3, (30, 1))
    rows = [(i, (base[i % 30] + 0.3 * g.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(600)]  # one vector, over and over
    bad = [None, [], [0.0] * 8, [1.0, None] + [1.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 5]
    rows += [(10_000 + 20 * j, v) for j, v in enumerate(bad)] + [(None, rows[3][1]), rows[5]]
    return rows


@pytest.mark.parametrize("cell_rows", [50, 4096])
def test_against_brute_force(spark, cell_rows):
    rows = data()
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, rank string, leaf int").repartition(5)
    out, info = search(spark, df, leaf_rows=40, sample_rows=900, cell_rows=cell_rows, part_rows=5 * cell_rows, query_rows=cell_rows // 2, deep_sample=120)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows)
    assert set(got) == set(want) and info["recall"] >= 0.9 and 0 < info["visits"] <= info["leaves"]
    found = total = 0
    for q, hits in want.items():
        mine = [got[q][j] for j in range(1, 21)]
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        assert q not in [i for i, _ in mine]
        found += len({i for i, _ in mine} & {i for i, _ in hits})
        total += len(hits)
    assert found / total >= 0.9
    # copies tie, and the smallest ids win: the first 20 of the repeated vector, the query's own left out
    copies = sorted([40, *range(1500, 2100)])
    hot = [q for q in want if q in copies]
    top = {q: [i for i, _ in want[q]] for q in hot}
    assert all([i for i, _ in (got[q][j] for j in range(1, 21))] == top[q] for q in hot)


def test_all_leaves_give_exact_results(spark):
    rows = data(300, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out, info = search(spark, df, leaf_rows=30, recall=1.0)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert info["recall"] == 1.0
    same = np.mean([got[q] == [i for i, _ in hits] for q, hits in brute(rows).items()])
    assert same > 0.95


def test_many_copy_groups_leave_ordinary_queries_calibrated(spark):
    """More repeated queries than are drawn: their neighbours are their copies, those of the others are not."""
    g = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist()
    rows = [(i, unit(v)) for i, v in enumerate(g.normal(size=(3000, 8)))]
    for c in range(60):  # 42 copies each, of which two or three are asked
        v = unit(g.normal(size=8))
        rows += [(len(rows) + j, v) for j in range(42)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out, info = search(spark, df, leaf_rows=40, sample_rows=3000, calibrate=50)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {i for i, _ in hits} for q, hits in brute(rows).items() if q < 3000}
    found = sum(len(got[q] & hits) for q, hits in want.items()) / sum(map(len, want.values()))
    assert found >= 0.93 and info["recall"] >= 0.97


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    out, _ = search(spark, spark.createDataFrame([], schema))
    assert out.collect() == []
    out, _ = search(spark, spark.createDataFrame([(20, [1.0, 2.0]), (3, [0.5, 1.0])], schema))
    assert [tuple(r) for r in out.collect()] == [(20, 1, 3, 2.5)]
    out, _ = search(spark, spark.createDataFrame([(20, [1.0, 2.0])], schema))
    assert out.collect() == []


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 4))
    t = fit_tree(x, 500, leaf_rows=20)
    assert isinstance(t, Tree)
    seen = list(t.visits(x[0]))
    assert sorted(seen) == list(range(t.leaves))
    assert set(t.assign(x).tolist()) <= set(range(t.leaves))


def test_subtrees_take_the_place_of_leaves():
    g = np.random.default_rng(2)
    x = g.normal(size=(4000, 6))
    tree = fit_tree(x[:200], 4000, leaf_rows=400)
    of, n = tree.assign(x), tree.leaves
    subs = {}
    for leaf in range(0, n, 2):
        subs[leaf] = Tree()
        subs[leaf].grow(x[of == leaf], 4, 50, g)
    tree.graft(subs)
    new = tree.assign(x)
    assert tree.leaves == n + sum(s.leaves - 1 for s in subs.values()) and set(new.tolist()) <= set(range(tree.leaves))
    assert sorted(tree.visits(x[0])) == list(range(tree.leaves)) and len(tree.radii) == len(tree.leaf) == len(tree.children)
    for leaf in range(n):
        inside = new[of == leaf]
        assert set(inside.tolist()) == {leaf} if leaf % 2 or subs[leaf].leaves == 1 else len(set(inside.tolist())) > 1
    for leaf in set(new.tolist()):
        assert len(set(of[new == leaf].tolist())) == 1
