from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpso import schemas
from palimpso.functions import calc, locations, temporal, text


def scope_range(spark, scope, as_of="2024-02-10"):
    row = spark.createDataFrame([(scope, as_of)], "j string, d string").select(temporal.scope_range(F.from_json("j", schemas.SCOPE), F.to_date("d")).alias("r")).first()["r"]
    return row["from"], row["to"]


@pytest.mark.parametrize(
    "scope, low, high",
    [
        ('{"type":"current"}', date(2024, 2, 10), date(2024, 2, 10)),
        ('{"type":"exact_date","date":"2020-05-06"}', date(2020, 5, 6), date(2020, 5, 6)),
        ('{"type":"month","month":2,"year":2024}', date(2024, 2, 1), date(2024, 2, 29)),
        ('{"type":"year","year":2023}', date(2023, 1, 1), date(2023, 12, 31)),
        ('{"type":"date_range","from":{"granularity":"year","value":"2020"},"to":{"granularity":"month","value":"2021-02"}}', date(2020, 1, 1), date(2021, 2, 28)),
        ('{"type":"date_range","from":{"granularity":"day","value":"2020-03-04"},"to":{"granularity":"current","value":"current"}}', date(2020, 3, 4), date(2024, 2, 10)),
    ],
)
def test_scopes(spark, scope, low, high):
    assert scope_range(spark, scope) == (low, high)


@pytest.mark.parametrize("scope", ['{"type":"exact_date","date":"2023-02-30"}', '{"type":"month","month":13,"year":2024}', '{"type":"date_range","from":{"granularity":"year","value":"2022"},"to":{"granularity":"year","value":"2021"}}', '{"type":"other"}'])
def test_bad_scopes(spark, scope):
    with pytest.raises(Exception):
        scope_range(spark, scope)


def test_nested_comparison_is_an_error(spark):
    j = '{"type":"comparison","comparison_scopes":[{"type":"comparison"},{"type":"current"}]}'
    rows = spark.createDataFrame([(j,)], "j string").select(F.from_json("j", schemas.SCOPE).alias("scope"), F.lit("2024-01-01").cast("date").alias("as_of"))
    with pytest.raises(Exception):
        temporal.expand_scopes(rows).collect()


def test_overlap(spark):
    d = lambda s: F.lit(s).cast("date")
    rows = [("2024-01-01", None, True), ("2024-01-01", "2024-01-15", False), ("2024-01-15", "2024-01-15", False), ("2024-01-16", None, False), ("2024-01-15", "2024-01-16", True), ("2024-02-01", "2024-01-01", False)]
    df = spark.createDataFrame(rows, "s string, e string, hit boolean")
    got = df.select("hit", temporal.overlaps(F.to_date("s"), F.to_date("e"), d("2024-01-15"), d("2024-01-15")).alias("got")).collect()
    assert all(r.hit == r.got for r in got)


def test_locations(spark):
    rows = spark.createDataFrame([("Điều 5a > Khoản 2 > Điểm b.3",), ("Chương IV",), ("Phụ lục I > Mục II",), (None,)], "p string")
    got = [r[0] for r in rows.select(locations.canonical(F.col("p"))).collect()]
    assert got == ["DIEU_5A|KHOAN_2|DIEM_B.3", "CHUONG_IV", "PHU_LUC_I|MUC_II", ""]
    points = spark.createDataFrame([(x,) for x in ["e", "d", "đ", "b.10", "b.2", "đ1"]], "p string")
    assert [r.p for r in points.orderBy(locations.point_order(F.col("p"))).collect()] == ["b.2", "b.10", "d", "đ", "đ1", "e"]
    n = spark.range(1).select(locations.hex_number(F.lit("f" * 16)).alias("n")).first().n
    assert int(n) == 2**64 - 1


def test_markdown():
    source = "Chương I\n\nQUY ĐỊNH\nĐiều 1. Phạm vi\n1. Một\na) điểm\n“1. trích\n2. trích”\n51. quá lớn\n<!-- TABLE START -->\nĐiều 9\n<!-- TABLE END -->\nPhụ lục I\nBiểu\nI. Phần\n1. mục"
    assert text.to_markdown(source).split("\n") == [
        "# Chương I: QUY ĐỊNH", "## Điều 1. Phạm vi", "### Khoản 1. Một", "a) điểm", "“1. trích", "2. trích”", "51. quá lớn", "<!-- TABLE START -->", "Điều 9", "<!-- TABLE END -->", "# Phụ lục I: Biểu", "## Mục I. Phần", "1. mục",
    ]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400))
def test_split_pieces_fit_and_lose_nothing(source):
    pieces = text.split_text(source, 50, 10)
    assert all(0 < len(p) <= 50 for p in pieces)
    for word in set(w for w in source.replace(".", " ").split() if len(w) < 10):
        assert any(word in p for p in pieces)


def test_spans():
    source = "Người nộp thuế phải kê khai trong thời hạn 10 ngày kể từ ngày phát sinh nghĩa vụ."
    assert text.match_span("kê khai", source)[1] == "exact"
    assert text.match_span("NGƯỜI  nộp\nthuế", source)[:2] == ("Người nộp thuế", "whitespace_normalized")
    near = "phải kê khai trong thời hạn 10 ngày kể từ ngày phát sinh nghĩa vụ;"
    assert text.match_span(near, source)[1] == "fuzzy"
    assert text.match_span(near.replace("10", "15"), source) is None
    assert text.match_span(near.replace("phải", "không phải"), source) is None
    assert text.match_span("phát sinh nghĩa vu", source) is None


def test_calculations():
    assert calc.numbers("1,5% của 2 tỷ và 1.250.000 đồng") == [Decimal("0.015"), Decimal(2 * 10**9), Decimal(1250000)]
    assert calc.as_text(calc.evaluate("(a + 1) / 4 - -b", {"a": Decimal(1), "b": Decimal(2)})) == "2.5"
    for bad in ("a / 0", "__import__('os')", "a ** 2", "a if a else 1", "", "a b"):
        with pytest.raises(calc.CalculationError):
            calc.evaluate(bad, {"a": Decimal(1)})


def test_guards(spark):
    cases = [
        ("Thuế 10% năm nay chưa áp dụng", "Thuế 12% áp dụng", {"numbers", "present", "qualifiers"}),
        ("Cá nhân cư trú nộp 5 triệu", "Cá nhân không cư trú nộp 5 triệu", {"residency", "phrases"}),
        ("Nộp trước ngày 5", "Nộp sau ngày 5", {"time:trước", "time:sau"}),
        ("Hộ kinh doanh nộp gì", "Doanh nghiệp nộp gì hiện nay", {"phrases", "present"}),
        ("toàn bộ chỉ toàn bộ", "toàn bộ chỉ", {"qualifiers"}),
        ("Thuế 5.000", "Thuế  5.000", set()),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: set(r.v) for r in rows.select("k", text.keeps_query(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == {k: v for k, (*_, v) in enumerate(cases)}
    said = rows.limit(1).select(text.keeps_query(F.lit("Nộp gì"), F.lit("Nộp 5 hiện nay"), F.lit("hiện nay 5\nNộp gì")).alias("v")).first().v
    assert said == []


def test_text_predicates(spark):
    cases = [
        ("Cá nhân cư trú năm 2024 nộp tờ khai gì?", False, False, None), ("Thuế phải nộp năm 2024?", True, False, None), ("Tính thuế", False, False, None), ("chưa có quy định", False, True, None),
        ("mã số 123456", False, False, None), ("thu nhập 500 một tháng", False, False, "500"), ("lương 20 triệu", False, False, None), ("tiền là khoảng 1.500,5 và giá 7%", False, False, "1.500,5"),
        ("Doanh thu  mức 12 nghìn; lãi gần 3", False, False, "3"), ("tiền 50 phần trăm", False, False, None), (None, False, False, None),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(cases)], "k int, t string")
    t = F.col("t")
    got = {r.k: (r.a, r.b, r.c) for r in rows.select("k", text.needs_calculation(t).alias("a"), text.says_failure(t).alias("b"), text.bare_money(t).alias("c")).collect()}
    assert got == {k: tuple(v) for k, (_, *v) in enumerate(cases)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("không chưa ngoại trừ, trừ. 12 12% % 3,5 a1 thuế nộp phải kê khai hạn".split()), min_size=8, max_size=24), st.integers(0, 6), st.integers(7, 14), st.integers(0, 3))
def test_near_spans_equal_a_search_of_all_windows(words, first, count, change):
    """Against every window of every size, without bounds or running counts."""
    import difflib

    source = "  ".join(words)
    own = words[first : first + count]
    if change < len(own):
        own = [*own[:change], own[change] + "x", *own[change + 1 :]]
    span = " ".join(own)
    got = text.match_span(span, source)
    if got and got[1] != "fuzzy" or len(span) < 32 or len(own) < 6:
        return
    slack, best = max(2, min(8, round(len(own) * 0.15))), None
    for a in range(len(words)):
        for n in range(max(1, len(own) - slack), len(own) + slack + 1):
            run = " ".join(words[a : a + n])
            if a + n <= len(words) and text._marks(run) == text._marks(span):
                score = difflib.SequenceMatcher(None, span.casefold(), run.casefold(), autojunk=False).ratio()
                if score >= 0.95 and (best is None or score > best[1]):
                    best = "  ".join(words[a : a + n]), score
    assert (got and (got[0], got[2])) == best


def test_guards_read_a_text_once(spark):
    """Every pattern of the guards stands once for each text in the plan, not once for each use."""
    rows = spark.createDataFrame([("Nộp trước ngày 5", "Nộp sau ngày 5")], "a string, b string")
    said = rows.select(text.keeps_query(F.col("a"), F.col("b")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert said.count(text.TIME_RELATIONS["trước"]) == 2


def test_a_sentence_is_parsed_once_for_all_its_numbers(spark):
    from palimpso.functions import calc

    rows = spark.createDataFrame([("5 triệu, 2,5% của 1.000 đồng",), (None,)], "t string")
    assert [r.v for r in rows.select(calc.parse_numbers(F.col("t")).alias("v")).collect()] == [["5000000", "0.025", "1000"], []]
    got = rows.select(*[calc.parse_number(F.col("t"), F.lit(k)).alias(f"n{k}") for k in (0, 1, 3, 4)]).collect()
    assert [tuple(r) for r in got] == [(None, "5000000", "1000", None), (None,) * 4]


def test_texts_are_split_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "SPLIT_ROWS", 2)
    rows = spark.createDataFrame([(k, None if k == 3 else "ab " * k * 10) for k in range(7)], "k long, t string").coalesce(1)
    got = {r.k: r._pieces for r in text.with_pieces(rows, "t", size=50, overlap=10).collect()}
    assert got == {k: None if k == 3 else ["ab " * k * 10] if k * 30 <= 50 else text.split_text("ab " * k * 10, 50, 10) for k in range(7)}
