"""Effects in loose JSON to typed rows."""

import json
from datetime import date

import pytest

from palimpso.operators import effects as E

SECTIONS = {
    "Điều 1": "## Điều 1. Sửa đổi, bổ sung một số điều\n“Điều 5. Tên mới\n1. Một\n2. Hai”",
    "Điều 2": "## Điều 2. Sửa đổi điểm a, điểm b khoản 1 Điều 7\n“a) Nội dung a;\nb) Nội dung b.”",
    "Điều 3": "## Điều 3. Thay cụm từ\nThay cụm từ “cơ quan thuế” bằng cụm từ “cơ quan quản lý”",
    "Điều 4": "## Điều 4. Thay thế khoản 2 Điều 9\n“2. Khoản hai mới.”",
    "Điều 5": "## Điều 5. Quy định khác\nkhông có gì",
}


def tables(spark, *docs):
    raw = spark.createDataFrame([(f"D{k}", d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in enumerate(docs)], "document_id string, effects string")
    sections = spark.createDataFrame([(f"D{k}", p, t) for k in range(len(docs)) for p, t in SECTIONS.items()], "document_id string, location string, section string")
    return raw, sections


def test_relations(spark):
    good = {"target_document_id": " T1 ", "relation_types": ["sua_doi", "other", 7], "impact_scope": "whole", "effective_date": "2024-1-5"}
    raw, _ = tables(spark, {"effective_date": "2023-02-01", "document_relations": [good, {**good, "effective_date": "soon"}, good, {"target_document_id": 12, "relation_types": "bai_bo", "impact_scope": "whole_document"}, {"target_document_id": "T2", "relation_types": []}, {"relation_types": ["sua_doi"]}, "text", None, 5]}, "no json", None, {"document_relations": {"a": 1}}, [])
    got = sorted((r.document_id, r.position, r.target_document_id, r.relation_types, r.impact_scope, r.effective_date) for r in E.relations(raw).collect())
    assert got == [("D0", 0, "T1", ["sua_doi"], "partial", date(2024, 1, 5)), ("D0", 1, "T1", ["sua_doi"], "partial", date(2023, 2, 1)), ("D0", 3, "12", ["bai_bo"], "whole_document", date(2023, 2, 1))]


def amendment(**more):
    return {"van_ban_bi_sua": "T1", "loai_thay_doi": "sua_doi", "target_component": "all", "dieu_khoan_sua": "Điều 1", "dieu_khoan_bi_sua": ["Điều 5"], **more}


RELATION = {"target_document_id": "T1", "relation_types": ["sua_doi"], "effective_date": "2024-07-01"}


def run(spark, *items):
    raw, sections = tables(spark, {"effective_date": "2023-02-01", "document_relations": [RELATION], "amendment_relations": list(items)})
    good, bad = E.operations(raw, sections)
    return sorted(good.collect(), key=lambda r: r.position), sorted((r.position // 10_000, r.problem) for r in bad.collect())


def test_operations(spark):
    good, bad = run(
        spark,
        amendment(),
        amendment(dieu_khoan_sua="điều  2", dieu_khoan_bi_sua=["Điều 7 > Khoản 1 > Điểm a", "Điều 7 > Khoản 1 > Điểm b"], effective_date="2025-01-01"),
        amendment(loai_thay_doi="sua_doi_cum_tu", target_component=None, dieu_khoan_sua="Điều 3", dieu_khoan_bi_sua="Điều 8", text_operation="replace", anchor_text="cơ quan thuế", operand_text="cơ quan quản lý"),
        amendment(loai_thay_doi="thay_the", dieu_khoan_sua="Điều 4", dieu_khoan_bi_sua=["Điều 9 > Khoản 2"]),
        amendment(loai_thay_doi="thay_the"),
        amendment(target_component="TITLE"),
        amendment(loai_thay_doi="bai_bo", dieu_khoan_bi_sua=["Điều 10", "Điều 11 > Khoản 3"]),
        amendment(loai_thay_doi="sua_doi_cum_tu", target_component="", dieu_khoan_sua="Điều 3", text_operation="delete", operand_text="cơ quan thuế"),
        amendment(),
        amendment(van_ban_bi_sua="T9"),
        amendment(loai_thay_doi="other"),
    )
    assert bad == []
    got = [(r.position, r.target_location, r.change, r.old_text, r.new_text, str(r.effective_date)) for r in good]
    assert got == [
        (0, "Điều 5", "sua_doi", None, "Điều 5. Tên mới\n1. Một\n2. Hai", "2024-07-01"),
        (10_000, "Điều 7 > Khoản 1 > Điểm a", "sua_doi", None, "a) Nội dung a;\n\nb) Nội dung b.", "2025-01-01"),
        (20_000, "Điều 8", "sua_doi_cum_tu", "cơ quan thuế", "cơ quan quản lý", "2024-07-01"),
        (30_000, "Điều 9 > Khoản 2", "thay_the", None, "2. Khoản hai mới.", "2024-07-01"),
        (50_000, "Điều 5", "sua_doi", None, "Điều 5. Tên mới", "2024-07-01"),
        (60_000, "Điều 10", "bai_bo", None, None, "2024-07-01"),
        (60_001, "Điều 11 > Khoản 3", "bai_bo", None, None, "2024-07-01"),
        (70_000, "Điều 5", "sua_doi_cum_tu", "cơ quan thuế", "", "2024-07-01"),
    ]  # the fifth says "thay_the" under a heading that amends, and is then the first once more; so is the ninth
    assert good[1].targets == ["Điều 7 > Khoản 1 > Điểm a", "Điều 7 > Khoản 1 > Điểm b"] and good[1].target_level == "diem"
    assert len({r.operation_id for r in good}) == len(good)


def test_problems(spark):
    phrase = {"loai_thay_doi": "sua_doi_cum_tu", "target_component": None, "dieu_khoan_sua": "Điều 3", "operand_text": "cơ quan quản lý", "anchor_text": "cơ quan thuế", "text_operation": "replace"}
    good, bad = run(
        spark, amendment(**{**phrase, "target_component": "all"}), amendment(target_component="chapter"), amendment(dieu_khoan_bi_sua=[" "]), amendment(dieu_khoan_sua=None), amendment(dieu_khoan_sua="Điều 99"), amendment(loai_thay_doi="thay_the", dieu_khoan_sua="Điều 5"),
        amendment(**{**phrase, "text_operation": "swap"}), amendment(**{**phrase, "anchor_text": " "}), amendment(**{**phrase, "operand_text": "khác"}), amendment(target_component="title", dieu_khoan_bi_sua=["Điều 5 > Khoản 1"]), amendment(dieu_khoan_sua="Điều 5"),
    )
    assert good == [] and bad == list(enumerate(["a phrase has no component", "no such component", "no target place", "no source place", "no such section", "the heading replaces nothing", "no text operation", "no anchor", "the section doesn't say so", "the component is an article's, and amended", "no new text"]))
    raw, sections = tables(spark, {"document_relations": [RELATION], "amendment_relations": [amendment(target_component="chapter")]})
    with pytest.raises(Exception, match="no such component"):
        E.operations(raw, sections, strict=True)[0].collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relations_are_dealt_before_they_are_counted(spark):
    """A task holds its share of a document's relations, and sorts none of them."""
    raw, _ = tables(spark, {"document_relations": [RELATION, {**RELATION, "quoted": 1}, RELATION]})
    said = plan(E.relations(raw))
    assert "SortAggregate" not in said and said.rindex("HashAggregate") < said.index("Exchange")
    assert [r.position for r in E.relations(raw).collect()] == [0]


def test_operations_are_worked_out_once(spark):
    """Operations and problems are read from one table, and places are cut within their item's row."""
    raw, sections = tables(spark, {"document_relations": [RELATION], "amendment_relations": [amendment(), amendment(dieu_khoan_sua=None)]})
    good, bad = E.operations(raw, sections)
    assert all("Generate" not in plan(x) and "Join" not in plan(x) for x in (good, bad))
    assert [r.target_location for r in good.collect()] == ["Điều 5"] and [r.position for r in bad.collect()] == [10_000]
