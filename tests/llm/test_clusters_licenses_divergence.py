"""Centroids, license scans and source divergence against plain Python, on the small tables and on awkward rows."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpso.llm import centroids, divergence, licenses

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
DOCS = "doc_id long, text string, lang string, source string"
FOLD = str.maketrans(licenses.UPPER, licenses.LOWER)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000)) + " released under the MIT license"
ODD = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, " \n\t", None, None), (4, "Under the MIT\nlicense, under the mit license", "en", "t"), (4, "Under the MIT\nlicense, under the mit license", "en", "t"),
    (None, "Apache License, version 2.0; CC BY-NC", "en", "t"), (6, LONG, "en", "u"), (7, "x" * 200_000, "fr", "s"), (8, "ÄÖ ñ é 日本 \U0001f600 K KELVIN Under THE mit LICENSE", "", ""),
    (9, "Copyright me. All rights\nreserved!", "de", "only"), (10, "reserved are the rights of all", "de", "only"), (11, "rights reserved", "de", "only"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("row", "words", "blocks", "places", "id", "term", "n", "block", "lang_n", "found", "share", "reach")})


# ---- op11 --------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * 256) < 1 << 62 for x in v):
            kept.append((i, [math.floor(256 * float(x)) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c[n] for n in range(len(c))]
    found = [(i, *near(v)) for i, v in kept]
    total = defaultdict(int)
    for _, d, n in found:
        total[n] += d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(str((i, n, fits(d), fits(total[n]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())) for i, d, n in found)


def clusters(df, **more):
    return sorted(str(tuple(r)) for r in centroids.cluster(df, **more).collect())


def test_clusters_of_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    assert clusters(df, rounds=2) == brute_clusters([tuple(r) for r in df.collect()], 40, 2, 64)


def test_clusters_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 12) / 256]) for i in range(150)]  # many ties
    rows += [(3, rows[3][1])] * 40 + [(None, rows[0][1]), (None, rows[1][1]), (500, None), (501, []), (502, [1.0] * 11), (503, [None] + [0.0] * 11), (504, [float("nan")] + [0.0] * 11), (505, [float("-inf")] + [0.0] * 11), (506, [-1e-9] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("q", F.lit(0)).withColumn("id", F.lit(0))
    assert clusters(df, k=9, rounds=3, dims=12) == brute_clusters(rows, 9, 3, 12)
    assert clusters(df.limit(4), k=9, rounds=1, dims=12) == brute_clusters(rows[:4], 9, 1, 12)  # fewer vectors than centroids
    assert clusters(df.limit(0)) == []
    large = [(i, [float(v) for v in rng.integers(-3, 4, 12) * 10.0**8]) for i in range(20)] + [(90, [1e12] + [0.0] * 11), (91, [1e300] + [0.0] * 11)]
    assert clusters(spark.createDataFrame(large, "vec_id long, embedding array<double>"), k=3, rounds=2, dims=12) == brute_clusters(large, 3, 2, 12)


def test_partial_distances_lose_no_tie():
    rng = np.random.default_rng(1)
    for _ in range(200):
        dims, k, n = int(rng.integers(1, 20)), int(rng.integers(1, 9)), int(rng.integers(1, 30))
        x, c = rng.integers(-2, 3, (n, dims)), rng.integers(-2, 3, (k, dims))
        whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own, distance = centroids.nearest(x, c, rng.permutation(dims), block=int(rng.integers(1, 9)))
        assert (own == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


# ---- op12 --------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_licenses(text, templates=licenses.TEMPLATES, percent=80):
    w = words(text)
    at, base, found, share = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += own
        base |= {label} if own else set()
    for label, t in templates:
        own = words(t)
        if not own:
            continue
        reach, s = 2, set(own)
        while reach < len(own):
            reach *= 2
        for b in range(0, len(w), reach):
            both = len(s & set(w[b : b + 2 * reach]))
            if 100 * both >= percent * len(s):
                found.add(label)
                share = max(share, both / len(s))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else share


def scanned(df, **more):
    return sorted((str(r.row.doc_id), *map(str, tuple(r)[1:])) for r in licenses.scan(df, **more).collect())


def expected_licenses(df, **more):
    return sorted((str(r.doc_id), *map(str, brute_licenses(r.text, **more))) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_license_scan(request, table):
    df = request.getfixturevalue(table)
    got = licenses.scan(df)
    assert got.select("row.*").columns == df.columns
    assert scanned(df) == expected_licenses(df)


def test_filters_lose_no_block(spark):
    """Random texts over a small alphabet and templates of many sizes, with words left out, moved and repeated."""
    rng = np.random.default_rng(8)
    alphabet = [f"t{i}" for i in range(30)]
    draw = lambda n: " ".join(rng.choice(alphabet, n))
    templates = [(f"l{k % 9}", draw(int(n))) for k, n in enumerate(rng.integers(1, 40, 25))] + [("none", "-- ..")]
    rows = [(k, draw(int(rng.integers(0, 90)))) for k in range(120)]
    for k in range(80):  # planted, with some words lost
        own = templates[k % 25][1].split()
        keep = [w for w in own if rng.random() > 0.15]
        rng.shuffle(keep)
        rows.append((1000 + k, " ".join(["q"] * int(rng.integers(0, 60)) + keep + ["q"] * int(rng.integers(0, 60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 80, 100):
        assert scanned(df, templates=templates, percent=percent) == expected_licenses(df, templates=templates, percent=percent)
    assert scanned(df, templates=[]) == expected_licenses(df, templates=[])


def test_license_labels_of_the_usual_notices(spark):
    texts = {
        "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "apache-2": "Licensed under the Apache License, Version 2.0.",
        "mit": "// Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software and associated documentation files (the Software), to deal\n// in the Software without restriction, including", "all-rights-reserved": "(c) 2020 Some One. All rights reserved.",
    }
    got = {r.row.label: r.labels for r in licenses.scan(spark.createDataFrame(list(texts.items()), "label string, text string")).collect()}
    assert all(label in found.split(",") for label, found in got.items()), got


# ---- op13 --------------------------------------------------------------------------------------


def brute_audit(rows, min_docs):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        own = Counter(t.translate(FOLD) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source] += own
        n[lang] += own
        docs[lang] += Counter(own.keys())
    kept = {lang: [t for t, c in docs[lang].items() if c >= min_docs] for lang, _ in groups}

    def p(counts, lang, t):
        return 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts[x] for x in kept[lang]) + 5 * len(kept[lang]))

    out = []
    for lang, source in groups:
        own = n[lang, source]
        mine = {t: p(own, lang, t) for t in kept[lang]}
        pairs = [(-sum(abs(mine[t] - p(n[lang, s], lang, t)) for t in kept[lang]), s.encode(), s) for g, s in groups if g == lang and s != source]
        terms = [(p(n[lang], lang, t) - mine[t], t.encode(), t) for t in kept[lang] if own[t] and mine[t] > p(n[lang], lang, t)]
        out += [(lang, source, "pair", s, -v, k) for k, (v, _, s) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:50], 1)]
    return sorted(out)


def audited(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).collect())


@pytest.mark.parametrize("min_docs,terms,groups", [(30, 1024, 64), (2, 16, 3), (10**9, 1024, 64)])
def test_divergence_of_the_small_table(docs, min_docs, terms, groups):
    some = docs.filter("doc_id % 2 = 0")  # brute force is slow
    assert audited(some, min_docs=min_docs, terms=terms, groups=groups) == brute_audit([tuple(r) for r in some.select("text", "lang", "source").collect()], min_docs)


@pytest.mark.parametrize("min_docs,terms,groups", [(1, 7, 2), (2, 1024, 64)])
def test_divergence_of_awkward_rows(odd, min_docs, terms, groups):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    assert audited(odd, min_docs=min_docs, terms=terms, groups=groups) == brute_audit(rows, min_docs)
    assert audited(odd.limit(0)) == []


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    for top in (10, 10**6, 9 * 10**15):
        total = rng.integers(1, top, 500)
        count = (total * rng.random(500)).astype(np.int64)
        assert divergence.shares(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_texts_are_cut_between_terms(monkeypatch):
    text = ("Übung macht; den MEISTER " * 40 + "x" * 100 + " ende").encode()
    whole = divergence.terms_of(text)
    for stretch in (1, 7, 64):
        monkeypatch.setattr(divergence, "STRETCH", stretch)
        assert divergence.terms_of(text) == whole
