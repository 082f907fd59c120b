import numpy as np
import pytest

from courtflow.llm.common import Scratch
from courtflow.llm.nndescent import audit, cell_bits, classes_of, first_lists, near_duplicates, rounds_for, spread


def data(seed=0, n=700):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = g.normal(size=16)
        rows.append((v, i % 3))
    for base in range(0, 60, 2):  # groups of near copies, from two to many, some beside the threshold
        v, lab = rows[base]
        for _ in range([1, 2, 5, 30][base % 4 if base else 3]):
            rows.append((v + g.choice([0.02, 0.1, 0.18]) * g.normal(size=16), lab))
    rows += [(3.0 * rows[7][0], rows[7][1]), (rows[8][0], rows[8][1] + 1)]  # scaled; another label
    out = [(i, v.astype(np.float32).tolist(), int(lab)) for i, (v, lab) in enumerate(rows)]
    n = len(out)
    out += [(n + i, out[4][1], out[4][2]) for i in range(300)]  # copies
    bad = [None, [], [0.0] * 16, [1.0, None] + [1.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3]
    out += [(5000 + i, v, 0) for i, v in enumerate(bad + bad)]
    out += [(6000, out[1][1], None), (None, out[1][1], out[1][2])]
    return out


def brute(rows, threshold=0.98):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for lab in {x[2] for x in ok}:
        for d in {len(x[1]) for x in ok}:
            own = [x for x in ok if x[2] == lab and len(x[1]) == d]
            if not own:
                continue
            x = np.array([v for _, v, _ in own])
            u = x / np.linalg.norm(x, axis=1)[:, None]
            hit = u @ u.T >= threshold
            np.fill_diagonal(hit, False)
            for a, b in np.argwhere(hit):
                i, j = own[a][0], own[b][0]
                links[i] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    rows = data(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(5)
    out, info = near_duplicates(spark, df)
    got = out.collect()
    assert len(got) == len(rows) and info["recall"] >= 0.99
    want = brute(rows)
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in got if r["id"] is not None} == {i: w for i, w in want.items() if i is not None}
    assert all(r["kept"] == (r["id"] == r["component_id"] or r["id"] is None) for r in got)


def test_dense_group_in_blocks(spark, monkeypatch):
    """A group over several blocks: every link counted, one component."""
    from courtflow.llm import nndescent

    real = nndescent.count_links
    monkeypatch.setattr(nndescent, "count_links", lambda *a: real(*a, block=40))
    g = np.random.default_rng(3)
    base = g.normal(size=8)
    rows = [(i, (base + 0.03 * g.normal(size=8)).astype(np.float32).tolist(), 1) for i in range(300)]
    out, _ = near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == brute(rows)


def test_links_between_saturated_clusters(spark):
    """Two clusters of more members than a list holds, linked to each other: no list has a cross link."""
    g = np.random.default_rng(4)
    a, b = np.linalg.qr(g.normal(size=(64, 2)))[0].T
    angle = np.arccos(0.9855)
    rows = []
    for c in (a, np.cos(angle) * a + np.sin(angle) * b):
        for _ in range(40):
            e = g.normal(size=64)
            rows.append((len(rows), (c + 0.015 * e / np.linalg.norm(e)).astype(np.float32).tolist(), 1))
    out, _ = near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    want = brute(rows)
    assert {w for w in want.values()} == {(79, 0)}
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == want


def test_lone_pairs_in_a_dense_cone(spark, monkeypatch):
    """Near pairs among many vectors of cosine 0.9 to each other, in cells of many parts."""
    from courtflow.llm import nndescent

    real = nndescent.first_lists
    monkeypatch.setattr(nndescent, "first_lists", lambda *a: real(*a, cell=30))
    g = np.random.default_rng(6)
    axis = np.eye(64)[0]
    side = g.normal(size=(1200, 64)) * (1 - axis)
    side /= np.linalg.norm(side, axis=1)[:, None]
    side[:40] = side[40:80] + 0.3 * side[:40]
    side[:40] /= np.linalg.norm(side[:40], axis=1)[:, None]
    x = np.sqrt(0.9) * axis + np.sqrt(0.1) * side
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    out, info = near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    want = brute(rows)
    assert sum(n for n, _ in want.values()) >= 80 and info["recall"] >= 0.99
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == want


def sparse(n=3000, pairs=30, seed=5):
    """Vectors without a link, and lone pairs of cosine 0.983."""
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e = g.normal(size=(pairs, 64))
    e -= (e * x[:pairs]).sum(1)[:, None] * x[:pairs]
    e /= np.linalg.norm(e, axis=1)[:, None]
    x[-pairs:] = 0.983 * x[:pairs] + np.sqrt(1 - 0.983**2) * e
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


def test_audit_sees_what_a_graph_lacks(spark):
    """An empty link table has no recall, though few of the vectors drawn at large have a link."""
    rows = sparse()
    s = Scratch(spark, "t")
    classes = s.table(classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label"), "classes")
    counts = lambda r: spark.createDataFrame(r, "node long, links long")
    assert audit(spark, classes, counts([]), 0.98) == 0
    whole = [(i, 1) for i in [*range(30), *range(2970, 3000)]]
    assert audit(spark, classes, counts(whole), 0.98) == 1
    assert 0.3 < audit(spark, classes, counts(whole[:30]), 0.98) < 0.7


def test_lone_pairs_are_found_at_any_size(spark):
    """The cuts that a table of a billion vectors gets leave hardly a pair apart, though its cells are far smaller."""
    rows = sparse()
    s = Scratch(spark, "t")
    classes = s.table(classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label"), "classes")
    n = 10**9
    assert cell_bits(n) == 23
    found = first_lists(classes, n, range(rounds_for(n, 0.98)), 12, 0.95, 0.98).where("span").select("u", "v").distinct().collect()
    assert len({tuple(sorted((r["u"], r["v"]))) for r in found} & {(i, 2970 + i) for i in range(30)}) >= 29
    out, info = near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == brute(rows)
    assert info["recall"] == 1


def test_vectors_of_doubles_are_not_narrowed(spark):
    """A cosine just under the threshold in double, over it in float."""
    t = 0.98 - 1e-9
    rows = [(1, [1.0, 0.0], 0), (2, [t, float(np.sqrt(1 - t * t))], 0)]
    out, _ = near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r["id"], r["n_links"]) for r in out.collect()) == [(1, 0), (2, 0)]


def test_spread():
    hit = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        hit[a, b] = hit[b, a] = True
    assert spread(hit).tolist() == [0, 1, 1, 0, 4, 0]


def test_empty(spark):
    out, _ = near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert out.collect() == []
