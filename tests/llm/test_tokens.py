import random
import zlib

import numpy as np
import pytest

from courtflow.llm.tokenio import decode_ranks, encode_ranks, read_tokens, write_tokens
from courtflow.llm.tokens import WordIds, default_tokenizer

ODD = [
    "a\x0bb\x0cc\rd", "don't 'tis it's. 's.'s foo'.", "<|endoftext|> <|ENDOFTEXT|>x a<|endoftext|>.", "É É. 3rd 4.5 ab12.  y \u0085z é. Ⅷ. ß$$$ ...!!! a.b.c.",
    "x_y_ \x1cq \x00z w", "", "  ", "İstanbul Σς'", "foo<|endoftext|>.", None, "z" * 50_000, "tail.\n\n",
]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers") and default_tokenizer()


def texts():
    r = random.Random(1)
    marks = "aZé'.,!?<|>$ \n\t́Σς1Ⅷ² "
    return ODD + ["".join(r.choice(marks) for _ in range(r.choice([5, 40, 400]))) for _ in range(300)]


@pytest.mark.parametrize("limit", [7, 100_000])
def test_word_ids_equal_whole_text(path, limit):
    w = WordIds(path, limit)
    for t in texts():
        assert w.ids((t or "").encode()).tolist() == w.tok.encode(t or "", add_special_tokens=False).ids, t
    assert len(w.words) <= max(limit, 400)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_codes_round_trip(n):
    g = np.random.default_rng(n)
    r = (g.random(n) * 2.0 ** g.integers(1, 33, n)).astype("<u4")
    control, data = encode_ranks(r)
    assert len(control) == -(-n // 4)
    assert decode_ranks(control, data, n).tolist() == r.tolist()


def test_files_round_trip(spark, path, tmp_path):
    rows = [(None if i == 4 else 1000 - i, t, i, "x") for i, t in enumerate(texts())]
    rows += [rows[0], rows[3], (1000, "another text of the same id", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(5)
    manifest = write_tokens(spark, df, f"file://{tmp_path}/out", path, shard_rows=40, block_tokens=500)
    assert len(manifest) > 3
    got = sorted(read_tokens(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    assert [r["id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    tok, want = WordIds(path).tok, {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids in want[r["id"]]
        want[r["id"]].remove(ids)
        at += len(ids)
    digest = {(r["id"], r["start"]): r["ids_crc32"] for r in read_tokens(spark, f"file://{tmp_path}/out", digest_only=True).collect()}
    assert digest == {(r["id"], r["start"]): zlib.crc32(r["ids"]) for r in got}


def test_no_documents(spark, path, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert write_tokens(spark, df, f"file://{tmp_path}/none", path) == []
    assert read_tokens(spark, f"file://{tmp_path}/none").collect() == []
