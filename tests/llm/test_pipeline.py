"""The stages of corpus_pipeline.py over a small corpus, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(6)
    vocab = [f"term{i}" for i in range(2500)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    docs, labels = [], []
    for i in range(240):
        lines = [" ".join(r.choice(vocab) for _ in range(r.randint(8, 14))) + "." for _ in range(12)]
        bad = i % 6 == 0
        if bad:
            lines = [" | ".join(x.split()) + " $$$ !!!" for x in lines]
        if i % 20 == 7:
            lines[4] = passage
        docs.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, int(not bad), 0))
    for c in range(4):  # near copies, one word of each line changed in the first five lines
        lines = docs[11][1].split("\n")
        docs.append((300 + c, "\n".join([" ".join([f"new{c}", *x.split()[1:]]) if k == c else x for k, x in enumerate(lines)]).replace("\n", " "), "en", "s1", 0))
    docs.append((310, docs[13][1], "en", "s2", 0))
    docs += [(320, None, None, None, None), docs[14]]
    return docs, labels, passage


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    docs, labels, _ = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, table):
    import corpus_pipeline as p

    docs, labels, passage = corpus()
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "line dedup", "near dedup", "mixing", "packing"] and p.ORACLE_SQL is None
    got = spark.read.parquet(f"{table}/documents.parquet")
    after = {}
    for name, f in p.STAGES[:-1]:
        before = got.columns
        got = spark.createDataFrame(f(spark, got, table).collect(), COLUMNS)
        assert got.columns == before
        after[name] = got.collect()
    bad = {i for i, q, _ in labels if not q}
    kept = {r["doc_id"] for r in after["quality"]}
    assert not kept & bad and len(kept) >= len({d[0] for d in docs} - bad) - 3  # the empty text may go
    lined = {r["doc_id"]: r["text"] for r in after["line dedup"]}
    assert sum(passage in (t or "") for t in lined.values()) == 1 and passage in lined[7]
    assert 310 not in lined  # nothing but a copy
    near = [r["doc_id"] for r in after["near dedup"]]
    assert len(set(near)) == len(near)
    assert len({11, 300, 301, 302, 303} & set(near)) == 1
    clean = {i for i in kept if i < 300}
    assert clean <= set(near) | {i for i in clean if i not in lined}
    mixed = [r["doc_id"] for r in after["mixing"]]
    assert max(mixed.count(i) for i in set(mixed)) <= 3 and set(mixed) <= set(near)


def test_run_packs_every_copy(spark, table):
    import corpus_pipeline as p

    out = p.run(spark, table)
    bins = out.groupBy("bin").agg(F.sum("length").alias("used"), F.max("capacity").alias("c"), F.min("capacity").alias("d")).collect()
    assert bins and all(b["used"] <= b["c"] == b["d"] for b in bins)


def test_empty_documents(spark, table, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{table}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
