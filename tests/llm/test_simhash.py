import random

import numpy as np
import pytest
import xxhash

from courtflow.llm.common import Scratch, components
from courtflow.llm.simhash import BKTree, fingerprint, simhash_components, spanning_links


def slow_print(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(pairs, radius=4):
    """pairs: (id, fp). Every pair compared."""
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def texts(n=120):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "epsé", "zeta", "eta", "theta"] + [f"w{i}" for i in range(300)]
    out = [None, "", " \t\n", "one", "one two three", "ONE two Three", "x" * 200_000, " ".join(["hot"] * 30_000)]
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([3, 30, 300]))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            if r.random() < 0.7:
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return out


def test_fingerprint_against_bits():
    for t in texts():
        if t and len(t) > 50_000:
            continue
        assert fingerprint(t and t.encode()) & (2**64 - 1) == slow_print(t), t


@pytest.mark.parametrize("leaf", [1, 8])
def test_tree_finds_every_pair(leaf):
    g = np.random.default_rng(1)
    f = g.integers(0, 2**63, 300).astype(np.uint64)
    f = np.unique(np.concatenate([f, f[:90] ^ np.uint64(5), f[:90] ^ np.uint64(1 << 40)]))
    want = {(i, j) for i in range(len(f)) for j in range(len(f)) if int(f[i] ^ f[j]).bit_count() <= 4}
    f = f[:, None]
    got = {(e, int(q)) for e, qs in BKTree(f, leaf).search(f, 4) for q in qs}
    assert got == want


def test_spanning_links_of_dense_shard():
    g = np.random.default_rng(2)
    f = np.unique(np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 40, (400, 5)).astype(np.uint64), axis=1))
    half, f = len(f) // 2, f[:, None]
    for a, b in (spanning_links(f, None, 4), spanning_links(f[:half], f[half:], 4)):
        assert len(a) <= len(f)
        assert all(x != y for x, y in zip(a, b, strict=True))


def test_components_of_documents(spark):
    rows = [(i * 3, t, "x", i) for i, t in enumerate(texts())]
    rows += rows[5:8]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, shard int").repartition(5)
    got = simhash_components(spark, df).collect()
    assert len(got) == len(rows)
    want = slow_components([(i, slow_print(t)) for i, t in {r[0]: r[1] for r in rows}.items()])
    assert {r["id"]: r["component_id"] for r in got} == want


def test_hot_shards_are_cut(spark):
    from courtflow.llm.simhash import near_links

    r = random.Random(5)
    fps = sorted({sum(1 << r.randrange(30) for _ in range(3)) for _ in range(300)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    s = Scratch(spark, "t")
    roots = {x["node"]: x["root"] for x in components(s, near_links(df, 4, hot=40)).collect()}
    want = slow_components([(f, f) for f in fps])
    by = {}
    for f in fps:
        by.setdefault(roots.get(f, f), set()).add(want[f])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(spark, df).collect() == []


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 180)] + [(7, 7)]
    s = Scratch(spark, "t")
    got = {r["node"]: r["root"] for r in components(s, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {j: 100 for j in range(101, 180)}


def test_near_duplicates_keep_one_of_each_group(spark):
    from courtflow.llm.simhash import near_duplicates

    r = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(40):
        base = [r.choice(vocab) for _ in range(r.choice([120, 400]))]
        ids = []
        for c in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            if c:
                copy[r.randrange(len(copy))] = r.choice(vocab)
            ids.append(len(rows))
            rows.append((len(rows), " ".join(copy), g))
        groups.append(ids)
    n = len(rows)
    rows += [rows[0], (n, None, 0), (n + 1, "", 0), (None, "  ", 0), (n + 2, "word " * 40_000, 0)]
    groups += [[n, n + 1], [n + 2]]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(4)).collect()
    assert sum(x["copies"] for x in got) == len(rows)
    kept = {x["id"] for x in got if x["keep"]}
    assert kept == {min(g) for g in groups}
    assert near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_duplicates_against_all_pairs(spark):
    """Pairs from a Jaccard similarity of 0.6 to 0.9, long and short: just those of 0.8 or more go."""
    from courtflow.llm.simhash import near_duplicates

    r = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    rows, kept = [], set()
    for share in (0.6, 0.65, 0.7, 0.75, 0.79, 0.81, 0.85, 0.9):
        for n in [200] * 12 + [40] * 4:
            a = [r.choice(vocab) for _ in range(n)]
            same = round(n * 2 * share / (1 + share))
            b = a[:same] + [r.choice(vocab) for _ in range(n - same)]
            x, y = shingles(a), shingles(b)
            kept |= {len(rows)} | ({len(rows) + 1} if len(x & y) < 0.8 * len(x | y) else set())
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x["id"] for x in got if x["keep"]} == kept


def test_short_texts_and_members_unlike_the_root(spark, monkeypatch):
    """Texts of four to twelve shingles that differ by a word at the end; chains whose members aren't all like their root, in blocks of three."""
    from courtflow.llm import simhash

    real = simhash.verified_links
    monkeypatch.setattr(simhash, "verified_links", lambda *a: real(*a, block=3))
    r = random.Random(12)
    vocab = [f"v{i}" for i in range(5000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    rows = []
    for n in [*range(4, 17)] * 3:
        a = [r.choice(vocab) for _ in range(n)]
        rows += [a, [*a, "end"], [*a, "other", "end"]]
    for _ in range(6):  # a chain: each is like the next two, the last not like the first
        a = [r.choice(vocab) for _ in range(150)]
        for k in range(12):
            rows.append(a[k * 7 :] + [f"{k}x{j}" for j in range(k * 7)])
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    order = list(range(len(rows)))
    r.shuffle(order)
    df = spark.createDataFrame([(i, " ".join(rows[i])) for i in order], "doc_id long, text string")
    got = simhash.near_duplicates(spark, df).collect()
    assert {x["id"] for x in got if x["keep"]} == {find(i) for i in range(len(rows))}


def test_bands_leave_few_pairs_apart():
    from courtflow.llm.simhash import Sketch, band_count

    assert (1 - 0.8**4) ** band_count(0.8, 4) <= 1e-3
    g, sketch, met = np.random.default_rng(3), Sketch(0.8), 0
    for _ in range(400):
        x = g.integers(0, 1 << 62, 110)
        a, b = np.unique(x[:100]), np.unique(np.append(x[:89], x[100:]))  # 89 of 110
        met += bool(set(sketch.of(a)[1]) & set(sketch.of(b)[1]))
    assert met >= 397
