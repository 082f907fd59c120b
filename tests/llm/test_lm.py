import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflow.llm.lm import _SPACE, LongWord, _log, lattices, load_vocabulary, make_vocabulary, score_documents

MARK = _SPACE.decode()


def small():
    pieces = [MARK, MARK + "a", "a", "ab", "b", "bab", MARK + "ab", "é", "éa", "ba"]
    return make_vocabulary([(p.encode(), -float(i)) for i, p in enumerate(pieces)])


def ways(v, word):
    """Every segmentation, by recursion: a list of piece-id tuples."""
    text = _SPACE + word
    ids = {p: i for i, p in enumerate(v.pieces)}

    def rec(at):
        if at == len(text):
            return [()]
        out = []
        for end in range(at + 1, len(text) + 1):
            p = text[at:end]
            if p in ids and not (at and p.startswith(_SPACE)):
                out += [(ids[p], *rest) for rest in rec(end)]
        return out

    return rec(0)


def test_marginal_and_expected_counts():
    v = small()
    logp = _log(v.prior)
    words = [w.encode() for w in ("a", "ab", "abab", "bé", "éaba", "c", "é", "babab", MARK)]
    counts = np.arange(1.0, len(words) + 1)
    want, got = np.zeros(len(v.prior)), np.zeros(len(v.prior))
    for w, c in zip(words, counts, strict=True):
        p = [math.exp(sum(logp[i] for i in s)) for s in ways(v, w)]
        for s, x in zip(ways(v, w), p, strict=True):
            for i in s:
                want[i] += c * x / sum(p)
    for at, lat in lattices(v, words):
        for k, x in zip(at, lat.forward(logp)[:, -1], strict=True):
            assert x == pytest.approx(math.log(sum(math.exp(sum(logp[i] for i in s)) for s in ways(v, words[k]))))
        lat.expected(logp, counts[at], got)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("window", [1, 2, 7, 1000])
def test_long_words_in_windows(window):
    v, r = small(), random.Random(8)
    logp = _log(v.prior)
    for word in ["a", "ab" * 40, MARK + "a" + MARK, "".join(r.choice(["a", "b", "é", "c", MARK]) for _ in range(90))]:
        ((_, plain),) = lattices(v, [word.encode()])
        long = LongWord(v, word.encode(), window)
        assert long.forward(logp) == pytest.approx(plain.forward(logp))
        want, got = np.zeros(len(v.prior)), np.zeros(len(v.prior))
        plain.expected(logp, np.array([3.0]), want)
        long.expected(logp, np.array([3.0]), got)
        assert got == pytest.approx(want)
    assert [type(lat).__name__ for _, lat in lattices(v, [b"ab" * 20, b"b"], 30)] == ["LongWord", "Lattice"]


def test_vocabulary_file():
    P = pytest.importorskip("public_tokenizers")
    v = load_vocabulary(P.path("piece_bpe_32k.model"))
    assert v.prior.sum() == pytest.approx(1) and len(v.pieces) > 10_000
    assert all(sorted(h) == list(h) and len(set(h.tolist())) == len(h) for h, _ in v.tables.values())


def rows():
    r = random.Random(4)
    words = ["a", "ab", "Bab", "é", "x" * 60, "baba"] + [r.choice("ab") * r.randint(1, 9) + r.choice(["", "é", "q"]) for _ in range(60)]
    out = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 20, 200]))), i) for i in range(80)]
    return [*out, (200, None, 1), (201, "", 2), (202, "  \n", 3), (None, "a ab", 4), (5, "only here", 5), (5, "only here", 5), (300, "hot " * 20_000, 1)]


@pytest.mark.parametrize("head", [3, 1000])
def test_scores_against_plain_python(spark, head):
    v, data = small(), rows()
    df = spark.createDataFrame(data, "doc_id long, text string, score int").repartition(4)
    got = score_documents(spark, df, v, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, head=head, rounds=2).collect()
    assert len(got) == len(data)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: (t or "").encode().lower().split()
    train = {}
    for i, t, _ in data:
        if not held(i):
            for w in [*toks(t), None]:
                train[w] = train.get(w, 0) + 1
    n, vocab = sum(train.values()), len(train)
    p = v.prior
    for _ in range(2):
        uses = v.prior * 1000
        uses[v.stop] += train[None]
        for w, c in train.items():
            if w is not None:
                for _, lat in lattices(v, [w]):
                    lat.expected(_log(p), np.array([float(c)]), uses)
                uses[v.stop] += c
        p = uses / uses.sum()
    # marginals by every segmentation where they can be listed, by the recursion else
    lattice = {}
    for w in {w for _, t, _ in data for w in toks(t)}:
        for k, q in enumerate((p, v.prior)):
            if len(w) < 12:
                total = math.log(sum(math.exp(sum(math.log(q[i]) for i in s)) for s in ways(v, w)))
            else:
                total = next(lat.forward(_log(q))[0, -1] for _, lat in lattices(v, [w]))
            lattice[w, k] = (total + math.log(q[v.stop])) / math.log(10)
    ends = [math.log10(q[v.stop]) for q in (p, v.prior)]
    want = []
    for i, t, _ in data:
        ts = [*toks(t), None]
        base = sum(math.log10((train.get(w, 0) + 0.5) / (n + 0.5 * (vocab + 1))) for w in ts)
        want.append((-1 if i is None else i, held(i), len(ts), sum(w in train for w in ts), n, base, *(sum(lattice[w, k] for w in ts[:-1]) + ends[k] for k in (0, 1))))
    got = sorted((-1 if r["id"] is None else r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["own_score"]) for r in got)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_long_word(spark):
    df = spark.createDataFrame([(1, "x" * 30_000), (2, "ab")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in score_documents(spark, df, small(), F.col("doc_id") == 1).collect()}
    assert -1e6 < got[1] < -1e4 < got[2] < 0


def test_no_rows_and_no_training(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(spark, df, small(), F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (r,) = score_documents(spark, one, small(), F.lit(True)).collect()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 2) and -100 < r["score"] == r["own_score"] < 0


def test_scores_weigh_pieces():
    """Log probabilities are taken as they are; whole-numbered scores are ranks."""
    v = make_vocabulary([(b"a", math.log(0.6)), (b"b", math.log(0.3))])
    at = {p: i for i, p in enumerate(v.pieces)}
    assert v.prior[at[b"a"]] / v.prior[at[b"b"]] == pytest.approx(2) and v.prior[at[b"c"]] == v.prior[at[b"b"]]
    v = small()
    at = {p: i for i, p in enumerate(v.pieces)}
    assert v.prior[at[b"a"]] / v.prior[at[b"b"]] == pytest.approx((4 + 2.7) / (2 + 2.7))
    assert v.prior.sum() == pytest.approx(1)
