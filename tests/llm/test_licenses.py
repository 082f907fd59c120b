import random
import re

import duckdb

from courtflow.llm.licenses import TEMPLATES, akin, bands_for, oracle, scan, shingles, template_words

LONG = "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"
MORE = TEMPLATES | {"long": LONG, "six": "one two three four five six"}
SOME = {n: t for n, t in MORE.items() if n in ("long", "six") or n.startswith(("all-", "cc-", "mit/n", "apache-2.0/n", "gpl-3.0/n", "mpl", "mit/t"))}


def brute(text, templates, containment=0.8):
    w = re.split(r"[\W_]+", (text or "").lower())
    out = {}
    for name, t in templates.items():
        tw = template_words(t)
        width = min(5, len(tw))
        sought = set(shingles(tw, width))
        got = len(sought & set(shingles(w, width)))
        if got >= containment * len(sought):
            out[name] = (got / len(sought), len(sought), got)
    kin = {(a, b): alike for a, b, alike in akin(templates, containment)}
    beats = lambda b, a: out[b][:2] > out[a][:2] or (out[b][:2] == out[a][:2] and b < a)
    return {a: out[a][2] for a in out if not any((a, b) in kin and (not kin[a, b] or beats(b, a)) for b in out)}


def texts():
    r = random.Random(0)
    vocab = [f"w{i}" for i in range(80)] + ["licensed", "under", "the", "license", "version"]
    fill = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    out = [None, "", " ", "...", "All rights", "ALL -- RIGHTS\nreserved", "x" * 100_000]
    for t in SOME.values():
        out += [t, t.upper(), f"{fill(3)}\n{t}\n{fill(40)}", f"{fill(20_000)} {t}", f"{fill(1)} {t} {fill(2)} {t}"]
        words = t.split()
        for drop in (0, len(words) // 2, len(words) - 1):
            out.append(f"{fill(7)} {' '.join(words[:drop] + words[drop + 1 :])} {fill(9)}")
    return out + [fill(300) for _ in range(20)]


def test_whole_texts_against_shingle_sets(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())] + [(3, "All rights reserved.", "x", 0), (None, TEMPLATES["mit/notice"], "x", 0)]
    rows.append(rows[12])
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, word int").repartition(4)
    got = scan(spark, df, SOME).collect()
    want = {(i, n, m) for i, t, *_ in rows for n, m in brute(t, SOME).items()}
    assert {(r["id"], r["template"], r["matched"]) for r in got} == want
    assert len(got) == len({(r["id"], r["tie"], r["template"]) for r in got})
    for r in got:
        assert 0.8 <= r["containment"] == r["matched"] / r["shingles"] <= 1
    place = {(r["id"], r["template"]): r["word"] for r in got}
    for (i, name), word in place.items():
        if i == 3 or i is None:
            continue
        w = re.split(r"[\W_]+", rows[i][1].lower())
        width = min(5, len(template_words(MORE[name])))
        assert " ".join(w[word : word + width]) in shingles(template_words(MORE[name]), width)


def test_sql_agrees(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = df.toPandas()
    want = duckdb.connect()
    want.register("documents", documents)
    sql = sorted(x[:5] for x in want.execute(oracle()).fetchall())
    assert sql == sorted((r["id"], r["tie"], r["license"], r["template"], r["matched"]) for r in scan(spark, df).collect())


def test_whole_licenses(spark):
    """Files that carry a license are found to carry that one, at a changed word or two, and no notice within it beside."""
    rows = []
    for n, t in TEMPLATES.items():
        words = ("Copyright (c) 2020, Someone. " + t + " And more text follows here.").split()
        rows.append((n, " ".join(words)))
        if n.endswith(("text", "header")):
            rows.append((n, "\n * ".join([*words[:20], "extra", *words[20:]])))
    got = {}
    for r in scan(spark, spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect():
        got.setdefault(r["id"], set()).add(r["template"])
    assert got == {i: {n} for i, (n, _) in enumerate(rows)}


def test_bands_guarantee():
    for parts in (1, 2, 3):
        n = bands_for(parts)
        assert (1 - min(parts / 3, 1)) ** n <= 1e-3
    assert bands_for(1) == 18


def test_nothing(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert scan(spark, df, {}).collect() == [] == scan(spark, df.limit(0)).collect()
