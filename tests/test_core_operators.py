import math
import os
import re
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpso.functions.lineage import shared_dir
from palimpso.operators import documents as D
from palimpso.operators import evaluate as E
from palimpso.operators import pipelines as P
from palimpso.operators import retrieval as R
from palimpso.operators import verify as C
from palimpso.operators import versions as V
from palimpso.plans import prose, runs, search

SMALL = "/root/testdata/sf0.001"
OPS = "operation_id string,target_document_id string,source_document_id string,source_location string,target_location string,target_level string,change string,effective_date date,source_issued_date date,target_component string,replacement_text string,old_text string,new_text string,targets array<string>"


def version(loc, text):
    key = "D|" + V.identity(loc)
    return (key, 1, key + "|V1", "D", loc, text, date(2020, 1, 1), None, True, None, None, [], None)


def op(i, loc, level, change, day, **more):
    row = dict(operation_id=i, target_document_id="D", source_document_id="S", source_location="Điều 9", target_location=loc, target_level=level, change=change, effective_date=day) | more
    return tuple(row.get(c.split()[0]) for c in OPS.split(","))


def amended(spark, ops, versions=None):
    rows = [version("Điều 1", "## Điều 1. A\nmở đầu"), version("Điều 1 > Khoản 1", "### Khoản 1. x\na) một\nb) hai\ne) năm"), version("Điều 1 > Khoản 2", "### Khoản 2. cụm từ cũ"), version("Điều 2", "## Điều 2. B\nnội dung")]
    before = versions if versions is not None else spark.createDataFrame(rows, V.VERSIONS.replace(", error string", ""))
    return V.apply_operations(before, spark.createDataFrame(ops, OPS))


def test_every_kind_of_amendment(spark):
    ops = [
        op("1", "Điều 1 > Khoản 1 > Điểm đ", "diem", "bo_sung", date(2021, 1, 1), replacement_text="đ) mới"),
        op("2", "Điều 1 > Khoản 2", "khoan", "sua_doi_cum_tu", date(2021, 2, 1), old_text="cũ", new_text="mới cũ"),
        op("3", "Điều 2", "dieu", "bai_bo", date(2022, 1, 1)),
        op("4", "Điều 7 > Khoản 1", "khoan", "sua_doi", date(2022, 1, 1), replacement_text="x"),
        op("5", "Điều 1", "dieu", "sua_doi", date(2023, 1, 1), replacement_text="“Điều 1. Mới\n1. một\n3. Ba”."),
        op("6", "Điều 1", "dieu", "sua_doi", date(2023, 6, 1), target_component="title", replacement_text="Điều 1. Tên khác"),
    ]
    out = amended(spark, ops).cache()
    rows = {r.version_id: r for r in out.filter("error is null").collect()}
    assert rows["D|DIEU_1|KHOAN_1|V2"].provision_content.split("\n\n") == ["### Khoản 1. x\na) một\nb) hai", "đ) mới", "e) năm"]
    assert rows["D|DIEU_1|KHOAN_2|V2"].provision_content.endswith("mới cũ") and rows["D|DIEU_1|KHOAN_2|V2"].valid_to == date(2023, 1, 1)
    assert "[Đã bãi bỏ theo Điều 9 S" in rows["D|DIEU_2|V2"].provision_content
    assert rows["D|DIEU_1|KHOAN_3|V1"].valid_from == date(2023, 1, 1)
    assert rows["D|DIEU_1|V3"].provision_content == "## Điều 1. Tên khác"
    assert [r.version_id for r in out.filter("error is not null").collect()] == ["4"]
    # intervals of a key never overlap, and applying once more changes nothing
    for r in rows.values():
        if r.superseded_by_version_id in rows:
            assert r.valid_to == rows[r.superseded_by_version_id].valid_from or r.provision_key not in r.superseded_by_version_id
    again = amended(spark, ops, out.filter("error is null").drop("error"))
    assert {r.version_id for r in again.filter("error is null").collect()} == set(rows)


def test_many_scopes_equal_few(spark):
    versions = spark.createDataFrame([("k", v, date(2020 + v, 3, 1), date(2021 + v, 3, 1) if v < 3 else None) for v in range(4)] + [("e", 1, date(2021, 5, 5), date(2021, 5, 5))], "provision_key string, version int, valid_from date, valid_to date")
    scopes = spark.createDataFrame([(1, "exact_date", date(2021, 6, 1), date(2021, 6, 1)), (2, "date_range", date(2020, 1, 1), date(2022, 12, 31)), (3, "year", date(2019, 1, 1), date(2019, 12, 31))], "scope_id int, kind string, low date, high date")
    few = sorted((r.scope_id, r.version) for r in V.select_versions(versions, scopes).collect())
    many = sorted((r.scope_id, r.version) for r in V.newest_in_points(V.join_scopes(versions, scopes, broadcast_rows=0)).collect())
    assert few == many == [(1, 1), (2, 0), (2, 1), (2, 2)]


def test_provisions_and_points(spark):
    docs = spark.createDataFrame([("D", "Điều 1. A\nmở\n1. Một\n2. " + "Hai. " * 200)], "document_id string, text string")
    rows = D.provisions(D.from_plain_text(docs)).collect()
    assert {r.location_label for r in rows} == {"Điều 1", "Điều 1 > Khoản 1", "Điều 1 > Khoản 2"}
    own = spark.createDataFrame([("D|1", "D", None, "x"), ("D|2", "D", date(2020, 1, 1), "y " * 600)], "version_id string, document_id string, valid_from date, provision_content string")
    points = D.points(own).collect()
    assert [p.sub_chunk_index for p in points if p.version_id == "D|1"] == [None]
    assert all(p.chunk_size <= 500 for p in points) and len({p.point_id for p in points}) == len(points)


def test_search_loop_and_evidence(spark):
    facts = spark.createDataFrame([("T1", "F1"), ("T1", "F2")], "task_id string, fact_id string")
    evaluations = spark.createDataFrame([("F1", "covered", 1), ("F1", "missing_evidence", 2), ("F2", "covered", 3), ("F9", "covered", 4)], "fact_id string, status string, position int")
    candidates = C.labelled(spark.createDataFrame([("T1", 1, "một hai ba")], "task_id string, position int, text string"))
    evidence = C.supported(spark.createDataFrame([("T1", "F1", "C1", "MỘT hai"), ("T1", "F2", "C7", "một")], "task_id string, fact_id string, label string, support_span string"), candidates)
    assert [(r.fact_id, r.support_span) for r in evidence.collect()] == [("F1", "một hai")]
    out = C.evaluate_facts(facts, evaluations, evidence)
    assert {r.fact_id: r.status for r in out.collect()} == {"F1": "covered", "F2": "missing_evidence"}
    assert C.next_round(facts.withColumn("status", F.lit("missing_evidence")), out, 1).first().decision == "retry_progress"
    assert C.next_round(out, out, 3).first().decision == "stop_rounds"


def test_structured_retrieval_finds_the_right_article(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for a in range(1, 9):
        for k in range(0, 4):
            words = f"thuế điều{a} khoản{k} nội dung riêng a{a}k{k}"
            rows.append((a * 10 + k, f"D|{a}|{k}|V1", "D", f"Điều {a}" + (f" > Khoản {k}" if k else ""), None, words, words, rng.standard_normal(4).tolist()))
    points = spark.createDataFrame(rows, "point_id long, version_id string, document_id string, location_label string, sub_chunk_index int, content string, provision_content string, embedding array<double>")
    queries = spark.createDataFrame([(1, "điều3 khoản2 a3k2", rows[10][-1])], "query_id long, text string, embedding array<double>")
    facts = spark.createDataFrame([(1, "a3k2")], "query_id long, fact string")
    out = R.structured_retrieve(points, queries, facts).orderBy("position").collect()
    assert out[0].location_label == "Điều 3 > Khoản 2"
    assert "Điều 3" in {r.location_label for r in out} and len({r.version_id for r in out}) == len(out)


def test_a_documents_text_is_stored_once_for_all_its_pieces(spark, monkeypatch):
    texts = [(d, " ".join(f"w{(i * 7919 + d) % 4001}" for i in range(12_000))) for d in (1, 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(k, f"w{k} w{k + 9} w{k + 70}. And w{k + 3}!") for k in range(5)], "item_id long, text string")
    monkeypatch.setattr(search, "read", lambda spark, sf_dir, name: {"benchmark": items}[name])
    monkeypatch.setattr(search, "_documents", lambda spark, sf_dir: docs)
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_dir(spark).removeprefix("file://")) for f in files)
    before = size()
    rows = search.retrieval_invariants(spark, "").collect()
    assert len(rows) == 5 and all(r.gapless and r.once and r.located for r in rows)
    assert size() - before < 40 * sum(len(t) for _, t in texts)  # five queries reach both; before: 1,114 times


def test_provisions_texts_may_be_given_once(spark):
    rows = [(d * 10 + k, f"D{d}|V1", f"D{d}", f"Điều {d}", k, f"phần{k} của d{d}", f"toàn văn d{d} thuế t{d}", [float(d), float(k)]) for d in range(1, 5) for k in range(3)]
    full = spark.createDataFrame(rows, "point_id long, version_id string, document_id string, location_label string, sub_chunk_index int, content string, provision_content string, embedding array<double>")
    once = full.withColumn("provision_content", F.when(F.col("sub_chunk_index") == 0, F.col("provision_content")))
    queries = spark.createDataFrame([(1, "phần2 của t3", [1.0, 0.0]), (2, "d1 t4", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    facts = spark.createDataFrame([(1, "thuế t2"), (2, "văn")], "query_id long, fact string")
    got = [sorted((r.query_id, r.position, r.version_id, r.provision_content, r.location_score) for r in R.structured_retrieve(p, queries, facts).collect()) for p in (full, once)]
    assert got[0] == got[1] and all(r[3].startswith("toàn văn") and r[4] for r in got[1])


def test_metrics(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "case_id string, ident string, position int")
    qrels = spark.createDataFrame([("a", "y", 2), ("a", "z", 1)], "case_id string, ident string, relevance int")
    got = {r.case_id: r for r in E.ranking_metrics(cases, ranked, qrels).collect()}
    assert (got["a"].recall, got["a"].precision) == (0.5, 0.5) and 0 < got["a"].ndcg < 1
    assert (got["b"].recall, got["b"].precision, got["b"].ndcg) == (0, 0, 0)


def test_metrics_of_gold_that_all_cases_share(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "x", 2), ("b", "w", 3), ("b", "y", 4)], "case_id string, ident string, position int")
    shared = spark.createDataFrame([("y", 2), ("z", 1), ("y", 1), ("v", 1), ("x", 0), ("u", 3)], "ident string, relevance int")
    rounded = lambda rows: {r.case_id: tuple(round(x, 9) for x in (r.recall, r.precision, r.ndcg)) for r in rows.collect()}
    got = rounded(E.ranking_metrics(cases, ranked, shared))
    assert got == rounded(E.ranking_metrics(cases, ranked, shared.crossJoin(cases))) and got["b"][0] == 0.5 and got["c"] == (0, 0, 0)
    assert rounded(E.ranking_metrics(cases, ranked, shared.filter("relevance < 0")))["a"] == (0, 0, 0)


def test_every_item_is_scored_against_the_labels(spark, monkeypatch):
    four = spark.createDataFrame([("bm25", q, d, r) for q in (3, 9, 10, 4000) for r, d in enumerate((7, 8), 1)], "method string, query_id long, doc_id long, rank int")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    monkeypatch.setattr(runs, "read", lambda spark, sf_dir, name: {"labels": labels}[name])
    monkeypatch.setattr(runs, "_lists", lambda spark, sf_dir: ())
    monkeypatch.setattr(P, "configurations", lambda: four)
    got = {r.case_id: (r.recall, r.precision, r.ndcg) for r in runs.configuration_scores(spark, "").collect()}
    assert sorted(got) == [3, 9, 10, 4000] and set(got.values()) == {(0.5, 0.5, round(1 / math.log2(3) / (1 + 1 / math.log2(3)), 6))}


def test_temporal_off_keeps_every_scope(spark):
    scopes = spark.range(V.BROADCAST_SCOPES + 50).select(F.col("id").alias("scope_id"))
    versions = spark.createDataFrame([("k|V1",), ("k|V2",)], "version_id string")
    for n in (V.BROADCAST_SCOPES + 50, 7):
        rows = V.select_versions(versions, scopes.filter(F.col("scope_id") < n), temporal_off=True)
        assert rows.count() == 2 * n and rows.select("scope_id").distinct().count() == n


def test_facts_cover_the_whole_text(spark, monkeypatch):
    long = "word " * 30 + "ends here. Then the second! And a third, far beyond sixty characters"
    monkeypatch.setattr(search, "read", lambda spark, sf_dir, name: {"benchmark": spark.createDataFrame([(1, long), (2, "one"), (3, "")], "item_id long, text string")}[name])
    monkeypatch.setattr(search, "_documents", lambda spark, sf_dir: spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string"))
    monkeypatch.setattr(R, "structured_retrieve", lambda points, queries, facts: facts.select("query_id", F.col("fact").alias("version_id"), F.lit("").alias("location_label"), F.lit(1).alias("position")))
    got = {}
    for r in search.structured_retrieval(spark, "").collect():
        got.setdefault(r.query_id, []).append(r.version_id)
    assert got == {1: ["word " * 30 + "ends here.", "Then the second!", "And a third, far beyond sixty characters"], 2: ["one"]}


def test_merge_candidates_has_no_cap(spark):
    rows = spark.range(5000).select(F.lit(1).alias("query_id"), (F.col("id") % 4000).alias("point_id"), F.col("id").cast("double").alias("score"), F.array(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("sources"), F.col("id").alias("input_pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("content"))
    got = {r.point_id: r for r in R.merge_candidates(rows).collect()}
    assert len(got) == 4000
    for k, r in got.items():
        places = [k, k + 4000] if k < 1000 else [k]
        assert (r.input_pos, r.score, r.content, r.sources) == (k, float(places[-1]), f"t{k}", list(dict.fromkeys(f"s{p % 3}" for p in places)))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_provisions_of_every_document(spark):
    expected = Counter()
    for doc in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        at, own, chapter, article, clause = None, [], None, None, None
        for i, line in enumerate([*re.split(r"\r\n|\r|\n", doc.text), None]):
            if line is not None:
                line = f"# Chương {i // 24 + 1}: {line}" if i % 24 == 0 else f"## Điều {i // 8 + 1}. {line}" if i % 8 == 1 else f"### Khoản {i // 3 + 1}. {line}" if i % 8 in (2, 5) else line
            head = re.match(r"(#{1,3})\s+(\S.*)", line) if line else None
            if head or line is None:
                if at:
                    expected[str(doc.doc_id), at, "\n".join(own).strip(" \n\t\r")] += 1
                own = []
            if head:
                level, title = len(head[1]), head[2]
                chapter, article, clause = (title, None, None) if level == 1 else (chapter, title, None) if level == 2 else (chapter, article, title)
                found = [(w, re.search(w + r"\s+(\d+)", t or "")) for w, t in (("Chương", chapter), ("Điều", article), ("Khoản", clause))]
                at = " > ".join(f"{w} {m[1]}" for w, m in found if m)
            own.append(line)
    got = Counter((r.provision_key.split("|")[0], r.location_label, r.provision_content) for r in prose.provisions(spark, SMALL).collect())
    assert got == expected and len({d for d, _, _ in got}) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_spans_anywhere_in_a_text(spark):
    """Short spans, spans that begin inside a word or hold one another, in one block and in many."""
    texts = spark.createDataFrame([(1, "Người  nộp\nthuế kê khai"), (2, "ab abc"), (3, None), (4, ""), (4, "ab")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "nộp THUẾ"), (2, "b a"), (3, "abc"), (4, "bc"), (5, "…"), (6, ""), (7, None), (8, "i"), (9, "abc")], "item_id long, span string")
    expected = {(1, 1), (1, 8), (2, 2), (2, 3), (2, 4), (2, 9)}
    for block in (C.SPAN_BYTES, 20):
        got = C.contained_spans(texts, spans, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert C.contained_spans(texts, spans.limit(0)).count() == 0


def test_dense_search_in_blocks(spark):
    """Small blocks of queries and many ties, against sorting everything."""
    import numpy as np

    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, (300, 3)).astype(float)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "doc_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors[:11])], "query_id long, embedding array<double>")
    expected = {(q, d, r + 1) for q in range(11) for r, d in enumerate(sorted(range(300), key=lambda d, q=q: (-vectors[q] @ vectors[d], d))[:7])}
    for block in (4096, 3):
        assert {(r.query_id, r.doc_id, r["rank"]) for r in R.dense(points, queries, 7, block).collect()} == expected


def test_many_scopes_in_lots(spark):
    """More scopes of a year than a lot: every version meets each scope that it overlaps, once."""
    versions_ = spark.createDataFrame([(k, date(2020 + k % 3, 1 + k % 12, 1), date(2022, 6, 1) if k % 2 else None) for k in range(12)], "k int, valid_from date, valid_to date")
    scopes = spark.createDataFrame([(k, "date_range", date(2021, 1 + k % 12, 5), date(2021 + k % 2, 12, 5)) for k in range(40)], "scope_id long, kind string, low date, high date")
    key = lambda rows: sorted((r.k, r.scope_id) for r in rows.collect())
    whole = key(V.join_scopes(versions_, scopes))
    assert whole and all(key(V.join_scopes(versions_, scopes, lot)) == whole for lot in (0, 3, 7))


def test_every_scope_gets_through_without_time(spark):
    many = spark.range(10_001).select(F.col("id").alias("scope_id"))
    assert V.select_versions(spark.createDataFrame([(1,)], "k int"), many, temporal_off=True).count() == 10_001
