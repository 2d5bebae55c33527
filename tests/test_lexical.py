"""The lexical index against counting and scoring by hand."""

import math
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpso.operators import lexical as L

DAY = date(2020, 1, 1)


def corpus(n=160, seed=3):
    rng = np.random.default_rng(seed)
    names = [f"t{i}" for i in range(60)]
    draw = lambda k: " ".join(names[min(59, int(x))] for x in rng.exponential(9, k))
    rows = []
    for i in range(n):
        start = None if i % 11 == 0 else DAY + timedelta(int(rng.integers(0, 90)))
        end = None if i % 4 == 0 else (start or DAY) + timedelta(int(rng.integers(0, 60)))
        rows.append((i, draw(int(rng.integers(0, 30))), start, end))
    rows += [(1000, rows[5][1], *rows[5][2:]), (1001, rows[5][1], *rows[5][2:]), (1002, None, DAY, None), (1003, "", None, None)]  # ties, nothing to read
    return rows, [(q, draw(8) + " t0 t0 unseen") for q in range(12)] + [(99, "never there"), (98, ""), (97, None)]


def held(rows, scope):
    low, high = scope
    return [r for r in rows if not (r[3] and r[3] <= (r[2] or date(1, 1, 1))) and (r[2] or date(1, 1, 1)) <= high and (r[3] is None or r[3] > low)]


def counts(rows):
    words = {r[0]: (r[1] or "").split() for r in rows}
    df = Counter(t for w in words.values() for t in set(w))
    n = len(words)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    return words, df, {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}, sum(map(len, words.values())) / n if n else None


def best(rows, text, k):
    words, _, idf, avgdl = counts(rows)
    asked, found = Counter((text or "").split()), []
    for d, w in words.items():
        tf = Counter(w)
        if any(t in tf for t in asked):
            s = sum(c * idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t, c in asked.items() if t in tf)
            found.append((-round(s, 9), d))
    return [(d, -s) for s, d in sorted(found)[:k] if s < 0]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    return out




@pytest.mark.parametrize("k", [1, 5, 40])
def test_pruned_search_is_exact(spark, k):
    rows, queries = corpus()
    index = L.build(spark.createDataFrame(rows, "doc_id long, text string, valid_from date, valid_to date").select("doc_id", "text").repartition(5))
    weights = L.query_weights(index, spark.createDataFrame(queries, "query_id long, text string"))
    found = ranked(L.search(index, weights, k))
    assert found == {q: b for q, t in queries if (b := best(rows, t, k))}


def test_queries_in_lots_give_the_same(spark, monkeypatch):
    rows, queries = corpus()
    index = L.build(spark.createDataFrame(rows, "doc_id long, text string, valid_from date, valid_to date").select("doc_id", "text"))
    weights = L.query_weights(index, spark.createDataFrame(queries, "query_id long, text string"))
    whole = ranked(L.search(index, weights, 6))
    monkeypatch.setattr(L, "LOT_TERMS", 20)
    assert ranked(L.search(index, weights, 6)) == whole


@pytest.mark.parametrize("lot", [L.LOT_SCOPES, 3])
def test_every_scope_as_if_counted_alone(spark, monkeypatch, lot):
    monkeypatch.setattr(L, "LOT_SCOPES", lot)
    rows, queries = corpus()
    scopes = [(i, DAY + timedelta(9 * i - 20), DAY + timedelta(9 * i - 20 + i % 3 * 15)) for i in range(14)] + [(14, date(1, 1, 1), date(9999, 12, 31)), (15, date(1990, 1, 1), date(1990, 1, 2)), (16, DAY, DAY), (17, DAY, DAY)]
    own = dict((i, (a, b)) for i, a, b in scopes)
    index = L.build(spark.createDataFrame(rows, "doc_id long, text string, valid_from date, valid_to date"))
    asked = [(q, t, i) for i in own for q, t in [(100 * i + k, t) for k, (_, t) in enumerate(queries[:3])]]
    qs = spark.createDataFrame(asked, "query_id long, text string, scope_id long")
    table = spark.createDataFrame(scopes, "scope_id long, low date, high date")
    idf, size = L.scoped_statistics(index, table, L.asked_terms(qs).select("scope_id", "term"))
    got, sizes = {(r.scope_id, r.term): (r.df, round(r.idf, 9)) for r in idf.collect()}, {r.scope_id: (r.n, r.avgdl) for r in size.collect()}
    for i, scope in own.items():
        _, df, weights, avgdl = counts(held(rows, scope))
        assert sizes[i][0] == len(held(rows, scope)) and (avgdl is None or abs(sizes[i][1] - avgdl) < 1e-9)
        terms = {t for _, text, k in asked if k == i for t in (text or "").split()}
        assert {t: v for (k, t), v in got.items() if k == i} == {t: (df[t], round(weights[t], 9)) for t in terms if t in df}
    found = ranked(L.search(index, L.scoped_weights(index, qs, table), 5))
    assert found == {q: b for q, t, i in asked if (b := best(held(rows, own[i]), t, 5))}


def test_blocks_are_bounded_and_pruning_saves_work(spark):
    """One document by itself is longer than a block may be; few pairs are scored to the end."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 500)) for i in range(4_000)] + [(9_000, "w1 " * (L.BLOCK_WORDS + 5)), (9_001, "w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = L.build(df)
    sizes = index.select(F.size("ids").alias("n"), F.aggregate("dls", F.lit(0), lambda a, x: a + x).alias("words")).collect()
    assert sum(r.n for r in sizes) == len(rows) and all(r.n <= L.BLOCK_DOCS and (r.words <= L.BLOCK_WORDS or r.n == 1) for r in sizes)
    queries = spark.createDataFrame([(k, rows[k][1]) for k in range(20)], "query_id long, text string")
    report = L.search(index, L.query_weights(index, queries), 10, report=True).agg(F.sum("shared").alias("shared"), F.sum("scored").alias("scored")).first()
    assert report.shared > 20_000 and 10 * report.scored < report.shared


def test_an_empty_index(spark):
    index = L.build(spark.createDataFrame([], "doc_id long, text string, valid_from date, valid_to date"))
    queries = spark.createDataFrame([(1, "a b", 1)], "query_id long, text string, scope_id long")
    assert L.search(index, L.query_weights(index, queries)).count() == 0
    assert L.search(index, L.scoped_weights(index, queries, spark.createDataFrame([(1, DAY, DAY)], "scope_id long, low date, high date"))).count() == 0


def test_blocks_are_gathered_one_by_one(spark, monkeypatch):
    """No task takes a second block in before the first is dealt with, and a file's row groups are cut between blocks."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(L, "BLOCK_DOCS", 16)
    monkeypatch.setitem(L.SMALL_GROUPS, "parquet.block.size", "4096")
    rows = [(k, " ".join(f"w{(k * j) % 997}" for j in range(1, 60))) for k in range(640)]
    index = L.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in index.inputFiles()]
    assert sum(g.num_rows for g in groups) == 40 and max(g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)) < 10
    seen = spark.sparkContext.accumulator(0)
    whole = L._rows

    def counted(batches):
        def each():
            for b in batches:
                if b.num_rows > 1:
                    seen.add(1)
                yield b

        return whole(each())

    monkeypatch.setattr(L, "_rows", counted)
    before = spark.conf.get(L.BATCH)
    queries = spark.createDataFrame([(1, "w5 w7 w11")], "query_id long, text string")
    assert L.search(index, L.query_weights(index, queries)).count() == 20
    assert seen.value == 0 and spark.conf.get(L.BATCH) == before
