"""The fold of amendments: how its work grows with a document, and what a failed operation leaves."""

import os
from datetime import date

import pytest

from pyspark.sql import functions as F

from palimpso.functions import locations
from palimpso.operators import versions as V
from palimpso.plans import amend

SMALL = "/root/testdata/sf0.001"


def row(n, label=None):
    label = label or f"Điều 1 > Khoản {n}"
    key = "D|" + V.identity(label)
    return dict(zip(V.VERSION_FIELDS, (key, 1, key + "|V1", "D", label, f"### Khoản {n}. cũ", date(2020, 1, 1), None, True, None, None, [], None), strict=True))


def op(n, location, **more):
    return dict(operation_id=f"{n:06d}", target_document_id="D", source_document_id="S", source_location="Điều 9", target_location=location, target_level="khoan", change="sua_doi", effective_date=date(2021, 1, 1), replacement_text="mới") | more


def test_an_operation_touches_what_it_aims_at(monkeypatch):
    seen = []
    known = V.place
    monkeypatch.setattr(V, "place", lambda location: seen.append(location) or known(location))
    calls = []
    for size in (50, 50, 400):  # the first fills what is kept of locations
        document = V.Document([row(n) for n in range(size)])
        seen.clear()
        for n in range(40):
            document.changed.clear()
            document.apply(op(n, f"Điều 1 > Khoản {n}"))
            document.apply(op(1000 + n, f"Điều 1 > Khoản {1000 + n}", change="bo_sung"))
        assert len(document.rows) == size + 80
        calls.append(len(seen))
    assert calls[1] == calls[2]


def test_a_failed_operation_leaves_nothing():
    document = V.Document([row(1), row(2), row(0, "Điều 1")])
    before = [dict(r) for r in document.rows]
    first = op(1, "Điều 1", target_level="dieu", change="bai_bo")
    document.apply(first)
    assert sum(r["valid_to"] is None for r in document.rows) == 1
    document.undo(first)
    assert document.rows == before and not document.applied
    assert {k: v for k, v in document.by_key.items() if v} == {r["provision_key"]: [i] for i, r in enumerate(before)}
    document.changed.clear()
    with pytest.raises(V.AmendmentError):
        document.apply(op(2, "Điều 1 > Khoản 7"))
    document.apply(first)
    assert sum(r["valid_to"] is None for r in document.rows) == 1


def test_documents_of_several_batches_and_without_versions(spark):
    names = ", ".join(f for f in V.VERSIONS.split(", ") if not f.startswith("error"))
    rows = [row(n) | {"document_id": f"D{n % 7}", "provision_key": f"D{n % 7}|DIEU_1|KHOAN_{n}", "version_id": f"D{n % 7}|DIEU_1|KHOAN_{n}|V1"} for n in range(300)]
    ops = [op(n, f"Điều 1 > Khoản {n}", target_document_id=f"D{n % 7}") for n in range(300)] + [op(900, "Điều 1", target_document_id="X"), op(901, "Điều 1", target_document_id=None)]
    columns = "operation_id string, target_document_id string, source_document_id string, source_location string, target_location string, target_level string, change string, effective_date date, source_issued_date date, replacement_text string"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        out = V.apply_operations(spark.createDataFrame([tuple(r[c] for c in V.VERSION_FIELDS) for r in rows], names), spark.createDataFrame([tuple(o.get(c.split()[0]) for c in columns.split(", ")) for o in ops], columns)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.version_id for r in out if r.error is None) == sorted(f"D{n % 7}|DIEU_1|KHOAN_{n}|V{v}" for n in range(300) for v in (1, 2))
    assert sorted((r.version_id, r.document_id) for r in out if r.error) == [("000900", "X"), ("000901", None)]


def test_affected_points_by_an_equality_join(spark):
    places = ["Điều 1", "Điều 1 > Khoản 2", "Điều 1 > Khoản 2 > Điểm a", "Điều 11 > Khoản 2", "Phụ lục I > Điều 1 > Khoản 2", "Chương II", "Chương II > Điều 1", "Khoản 2", "", "không", None, "Phụ lục I > Mục 2 > Điều 1"]
    points = spark.createDataFrame([(d, p) for d in ("Số 1/2019/NĐ-CP", "2/2019/NĐ-CP", None) for p in places], "document_id string, location_label string")
    ops = spark.createDataFrame([(k, "1 / 2019/nđ-CP", p) for k, p in enumerate(places)], "operation_id int, target_document_id string, target_location string")
    got = V.affected_points(ops, points)
    assert got.columns == ["document_id", "location_label", "operation_id", "target_location"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "contains(" not in plan
    same = locations.canonical_document(F.col("document_id")) == locations.canonical_document(F.col("target_document_id"))
    known = points.join(ops, same & locations.within(F.col("location_label"), F.col("target_location"))).select(*got.columns)
    assert known.count() > 12 and sorted(map(str, got.collect())) == sorted(map(str, known.collect()))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_corpus_build_reads_what_it_has_stored(spark):
    rows = amend.corpus_build(spark, SMALL)
    assert {os.path.basename(os.path.dirname(f)).split("-")[0] for f in rows.inputFiles()} == {"versions", "documents"}  # before: the tables themselves, once more for each use
