"""Queries about wording: guards, predicates, clean-up, headers, scopes as models write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locations, temporal, text as T
from ..functions.lineage import settle
from ..operators import dictionary, documents as D, retrieval as R
from .tables import read

QUERIES, ORACLES = {}, {}


def pick(values, at):
    """One of the values, by number."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def pick_sql(values, at: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({at}) + 1]"


QUESTIONS = (
    "Thuế phải nộp năm 2024 là bao nhiêu?", "Cá nhân cư trú năm 2024 nộp tờ khai gì?", "Tính thuế", "Số thuế của 5 người?", "nhân tính 7", "chia đều 9 phần", "Tổng số", "Chênh lệch 3%",
    "Không tìm thấy gì", "Chưa có quy định", "không có dữ liệu", "Không có thông tin nào", "chưa được quy định", "Thu nhập 500 một tháng", "Lương 20 triệu", "tiền là khoảng 1.500,5 và giá 7%", "mã số 123456", "doanh thu  mức 12 nghìn, lãi gần 3",
)
_AT = "(conv_id * 5 + turn) % 18"
_TALK = f"talk AS (SELECT conv_id, turn, {pick_sql(QUESTIONS, _AT)} || ' ' || regexp_replace(coalesce(text, ''), '[0-9]', '', 'g') AS t FROM conversations)"


def _talk(spark, sf_dir):
    """Every turn of the conversations behind one of some questions and answers; digits of the turn are taken out."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.concat_ws(" ", pick(QUESTIONS, (F.col("conv_id") * 5 + F.col("turn")) % 18), F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", "")).alias("t"))


def needs_calculation(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.needs_calculation(F.col("t")).alias("calculates"))


QUERIES["needs_calculation"] = needs_calculation
ORACLES["needs_calculation"] = rf"""WITH {_TALK} SELECT conv_id, turn,
regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_])(tính|bao nhiêu|số thuế|thuế phải nộp|nghĩa vụ thuế|chênh lệch|tổng số)($|[^\p{{L}}\p{{N}}_])') AND regexp_matches(t, '[0-9]') AS calculates FROM talk"""


def failure_phrase(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.says_failure(F.col("t")).alias("failed"))


QUERIES["failure_phrase"] = failure_phrase
ORACLES["failure_phrase"] = f"""WITH {_TALK} SELECT conv_id, turn, len(list_filter(['không tìm thấy', 'chưa có quy định', 'không có quy định', 'không có thông tin', 'không tìm được', 'chưa được quy định'], lambda p: contains(lower(t), p))) > 0 AS failed FROM talk"""


def bare_money(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", T.bare_money(F.col("t")).alias("number"))


QUERIES["bare_money"] = bare_money
_MONEY = r"(^|[^\p{L}\p{N}_])(?:lãi|lương|doanh\s+thu|thu\s+nhập|tiền|giá|trị\s+giá)(?:\s+(?:là|mức|khoảng|tầm|gần|hơn|được|nhận|phát\s+sinh))*\s+([0-9]+(?:[.,][0-9]+)*)(\s*(?:%|(?:phần\s+trăm|đồng|nghìn|ngàn|triệu|tỷ|usd|eur)(?:$|[^\p{L}\p{N}_])))?"
ORACLES["bare_money"] = f"""WITH {_TALK}, m AS (SELECT conv_id, turn, t, regexp_extract_all(lower(t), '{_MONEY}', 2) AS n, regexp_extract_all(lower(t), '{_MONEY}', 3) AS u FROM talk)
SELECT conv_id, turn, list_filter(list_transform(n, lambda x, i: CASE WHEN coalesce(u[i], '') = '' THEN x END), lambda x: x IS NOT NULL)[1] AS number FROM m"""

BEFORE = ("Cá nhân cư trú nộp 5 triệu hiện nay", "Cá nhân không cư trú nộp chưa đủ", "Hộ kinh doanh nộp trước ngày 5 tháng này", "toàn bộ chỉ toàn bộ 7%", "Nộp gì đến ngày 9?", "Doanh nghiệp nộp sau năm 2020 tối đa 3 lần", "Thuế")
AFTER = ("Cá nhân cư trú nộp 5 triệu", "Cá nhân không cư trú nộp 5 triệu hiện nay", "Hộ kinh doanh nộp sau ngày 5", "toàn bộ chỉ 7%", "Cá nhân cư trú chưa nộp kể từ năm 2020 tới ngày 9")


def query_guards(spark, sf_dir):
    """What a rewriting of a question, before every document's text without digits, violates."""
    rest = F.concat(F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", ""))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(pick(BEFORE, F.col("doc_id") % 7), rest).alias("b"), F.concat(pick(AFTER, F.col("doc_id") % 5), rest).alias("a"))
    return rows.select("doc_id", F.array_join(F.array_sort(T.keeps_query(F.col("b"), F.col("a"))), ",").alias("violated"), F.array_join(T.lost_phrases(F.col("b"), F.col("a")), ",").alias("phrases"), F.array_join(T.lost_qualifiers(F.col("b"), F.col("a")), ",").alias("qualifiers"))


QUERIES["query_guards"] = query_guards
_W = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"
_REL = {"trước": r"trước\s+(ngày|tháng|năm|thời điểm|khi)", "sau": r"sau\s+(ngày|tháng|năm|thời điểm|khi)", "kể từ": r"(kể\s+từ|từ\s+ngày)", "đến": r"(đến|tới)\s+ngày"}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NOW = lambda c: f"len(list_filter({_LIST(T.CURRENT_TIME_CUES)}, lambda p: contains({c}, p))) > 0"
_NUM = lambda c: rf"list_filter(regexp_split_to_array({c}, '[^0-9A-Za-zÀ-ỹ_.,]+'), lambda x: regexp_full_match(x, '[0-9]+([.,][0-9]+)*'))"
_RELS = ", ".join(f"CASE WHEN regexp_matches(b, '{_W}{r}{_E}') <> regexp_matches(a, '{_W}{r}{_E}') THEN 'time:{n}' END" for n, r in _REL.items())
_COUNT = lambda c, w: f"((length({c}) - length(replace({c}, {w}, ''))) // length({w}))"
ORACLES["query_guards"] = f"""WITH q AS (SELECT doc_id, lower({pick_sql(BEFORE, "doc_id % 7")}) AS b0, lower({pick_sql(AFTER, "doc_id % 5")}) AS a0, ' ' || lower(regexp_replace(coalesce(text, ''), '[0-9]', '', 'g')) AS rest FROM documents),
t AS (SELECT doc_id, b0 || rest AS b, a0 || rest AS a, b0, a0 FROM q),
f AS (SELECT doc_id, b, a, list_filter({_LIST(T.PROTECTED_PHRASES)}, lambda p: contains(b, p) AND NOT contains(a, p)) AS phrases, list_filter({_LIST(T.PROTECTED_QUALIFIERS)}, lambda w: {_COUNT("b", "w")} > {_COUNT("a", "w")}) AS qualifiers, {_NUM("b0")} AS nb, {_NUM("a0")} AS na FROM t)
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN NOT list_has_all(na, nb) OR NOT list_has_all(nb, na) THEN 'numbers' END, CASE WHEN ({_NOW("b")}) <> ({_NOW("a")}) THEN 'present' END, {_RELS},
  CASE WHEN contains(b, 'cá nhân không cư trú') THEN CASE WHEN contains(a, 'cá nhân cư trú') AND NOT contains(a, 'cá nhân không cư trú') THEN 'residency' END WHEN contains(b, 'cá nhân cư trú') AND contains(a, 'cá nhân không cư trú') THEN 'residency' END,
  CASE WHEN len(phrases) > 0 THEN 'phrases' END, CASE WHEN len(qualifiers) > 0 THEN 'qualifiers' END], lambda x: x IS NOT NULL)), ',') AS violated, array_to_string(phrases, ',') AS phrases, array_to_string(qualifiers, ',') AS qualifiers FROM f"""


def dictionary_fold(spark, sf_dir):
    """Every document behind misspelled names, folded for the dictionary."""
    return read(spark, sf_dir, "documents").select("doc_id", dictionary.fold(F.concat(F.lit("Shoppe, TIK TOKshop! Lazadaa Đồng "), F.coalesce("text", F.lit("")))).alias("folded"))


QUERIES["dictionary_fold"] = dictionary_fold
ORACLES["dictionary_fold"] = "SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(lower('Shoppe, TIK TOKshop! Lazadaa Đồng ' || coalesce(text, '')), 'shoppe', 'shopee'), 'tik tok', 'tiktok'), 'tiktokshop', 'tiktok shop'), 'lazadaa', 'lazada'), '[^0-9a-zA-ZÀ-ɏḀ-ỿ]+', ' ', 'g')) AS folded FROM documents"


def quoted_parts(spark, sf_dir):
    """Order comments in quotation marks of several kinds: the outer pair is taken off, and quoted blocks are listed."""
    name = F.concat(F.lit("số "), F.col("o_orderkey").cast("string"))
    kinds = F.array(F.concat(F.lit("“"), name, F.lit("”.")), F.concat(F.lit('"'), name, F.lit('"')), F.concat(F.lit(" a “ "), name, F.lit(" ” và “b”")), name)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("t"))
    return rows.select("o_orderkey", T.strip_quotes(F.col("t")).alias("inner"), F.array_join(T.quoted_blocks(F.col("t")), "|").alias("blocks"))


QUERIES["quoted_parts"] = quoted_parts
ORACLES["quoted_parts"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'a “ số ' || o_orderkey || ' ” và “b”' ELSE 'số ' || o_orderkey END AS "inner",
CASE o_orderkey % 4 WHEN 0 THEN 'số ' || o_orderkey WHEN 2 THEN 'số ' || o_orderkey || '|b' ELSE '' END AS blocks FROM orders"""


def cited_labels(spark, sf_dir):
    t = F.concat(F.lit("theo C"), (F.col("o_custkey") % 12).cast("string"), F.lit(", C2 và (C"), (F.col("o_orderkey") % 9).cast("string"), F.lit("); DC3, C0x, C2"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.cited_ids(t), ",").alias("cited"))


QUERIES["cited_labels"] = cited_labels
ORACLES["cited_labels"] = """WITH c AS (SELECT o_orderkey, list_filter(['C' || (o_custkey % 12), 'C2', 'C' || (o_orderkey % 9)], lambda x: x <> 'C0') AS l FROM orders)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cited FROM c"""


def retry_hints(spark, sf_dir):
    """A hint for another search: used if it is safe, else the fact."""
    hints = ("tìm mức thuế suất của hộ", "hai chữ", "xem C3 về mức thuế", "theo Điều 7 về mức thuế", "theo Điều 5 về mức thuế")
    h = pick(hints, F.col("o_orderkey") % 5)
    long = F.when(F.col("o_orderkey") % 10 == 0, F.concat(h, F.lit(" "), F.repeat(F.lit("dài "), 120))).otherwise(h)
    hint = T.retry_hint(long, F.lit("Điều 5 quy định gì"), F.concat(F.lit("mức  thuế "), F.col("o_custkey").cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", hint.alias("hint"))


QUERIES["retry_hints"] = retry_hints
ORACLES["retry_hints"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN 'mức thuế ' || o_custkey WHEN o_orderkey % 10 = 0 THEN rtrim(substr('tìm mức thuế suất của hộ ' || trim(repeat('dài ', 120)), 1, 360))
WHEN o_orderkey % 5 = 0 THEN 'tìm mức thuế suất của hộ' ELSE 'theo Điều 5 về mức thuế' END AS hint FROM orders"""


def fenced_json(spark, sf_dir):
    """Answers of a model as JSON: in fences, behind thoughts, with words around, or broken."""
    o = F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "v": "x"}'))
    kinds = F.array(o, F.concat(F.lit("```json\n"), o, F.lit("\n```")), F.concat(F.lit("<think>a {b</think>\n"), o), F.concat(F.lit("Đây: "), o, F.lit(" xong")), F.lit("{không"), F.lit("không có"))
    rows = read(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("t"))
    got = T.json_object(F.col("t"), "k long, v string")
    return rows.select("event_id", got["k"].alias("k"), got["v"].alias("v"))


QUERIES["fenced_json"] = fenced_json
ORACLES["fenced_json"] = "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN event_id END AS k, CASE WHEN event_id % 6 < 4 THEN 'x' END AS v FROM events"

_TYPES = (("LUẬT", "luat"), ("Nghị định", "nghi_dinh"), ("THÔNG TƯ", "thong_tu"), ("Nghị quyết", "nghi_quyet"), ("Quyết định", "quyet_dinh"))


def header_fields(spark, sf_dir):
    """Headers of documents made of orders, each before the whole text of a document; what follows a heading is not read."""
    o = read(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_orderkey") % 200).join(read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.first("text").alias("text")), "doc_id")
    date = F.concat(F.lit("Hà Nội, ngày "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" tháng "), F.month("o_orderdate").cast("string"), F.lit(" năm "), F.year("o_orderdate").cast("string"))
    t = F.concat(F.lit("Số: "), F.col("o_custkey").cast("string"), F.lit("/2019/NĐ-CP\n"), date, F.lit("\n"), pick([n for n, _ in _TYPES], F.col("o_orderkey") % 5), F.lit("\n\nVề việc "), F.col("o_orderpriority"), F.lit("\n# Chương I\nSố: 9/2000/X\n"), F.coalesce("text", F.lit("")))
    return D.header_metadata(o.select("o_orderkey", t.alias("text"))).select("o_orderkey", "document_id", "document_type", "title", "issued_date")


QUERIES["header_fields"] = header_fields
ORACLES["header_fields"] = f"""SELECT o_orderkey, o_custkey || '/2019/NĐ-CP' AS document_id, {pick_sql([c for _, c in _TYPES], "o_orderkey % 5")} AS document_type, 'Về việc ' || o_orderpriority AS title, CAST(o_orderdate AS DATE) AS issued_date
FROM orders WHERE o_orderkey % 200 IN (SELECT doc_id FROM documents)"""


def word_dates(spark, sf_dir):
    """Dates in words; the thirty-first of a short month is none."""
    d = F.dayofmonth("o_orderdate")
    day = F.when(F.col("o_orderkey") % 3 == 0, F.lit(31)).otherwise(d).cast("string")
    kinds = F.array(F.concat(F.lit("ngày "), day, F.lit(" tháng "), F.month("o_orderdate").cast("string"), F.lit(" năm "), F.year("o_orderdate").cast("string")), F.concat(day, F.lit("/"), F.month("o_orderdate").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string")), F.lit("không rõ"))
    t = F.get(kinds, (F.col("o_custkey") % 3).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", temporal.words_to_date(t).alias("day"), temporal.lenient_date(F.concat(F.date_format("o_orderdate", "yyyy-MM-"), day)).alias("iso"))


QUERIES["word_dates"] = word_dates
ORACLES["word_dates"] = """WITH d AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '31' ELSE strftime(o_orderdate, '%d') END AS day, strftime(o_orderdate, '%Y-%m-') AS month FROM orders)
SELECT o_orderkey, CASE WHEN o_custkey % 3 < 2 THEN try_cast(month || day AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 OR day >= '10' THEN try_cast(month || day AS DATE) END AS iso FROM d"""


def verbatim_text(spark, sf_dir):
    t = F.concat(F.lit("“A”  ‘b’ "), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.verbatim(t).cast("binary"), 256).alias("digest"))


QUERIES["verbatim_text"] = verbatim_text
ORACLES["verbatim_text"] = "SELECT doc_id, sha256(lower(trim(regexp_replace('\"A\"  ''b'' ' || translate(coalesce(text, ''), '“”‘’', '\"\"' || chr(39) || chr(39)), '\\s+', ' ', 'g')))) AS digest FROM documents"


def query_labels(spark, sf_dir):
    """The line of a prompt that names its question."""
    kinds = F.array(F.concat(F.lit("\n  Bối cảnh\nSemantic query:  số "), F.col("o_orderkey").cast("string"), F.lit("\nx")), F.concat(F.lit("a\nSEMANTIC QUERY GỢI Ý: b\n")), F.concat(F.lit("\r\n\n  c"), F.col("o_custkey").cast("string"), F.lit("\nd")), F.lit("\n \n"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.query_label(F.get(kinds, (F.col("o_orderkey") % 4).cast("int"))).alias("label"))


QUERIES["query_labels"] = query_labels
ORACLES["query_labels"] = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'số ' || o_orderkey WHEN 1 THEN 'b' WHEN 2 THEN 'c' || o_custkey ELSE '' END AS label FROM orders"


def rerank_documents(spark, sf_dir):
    """What a reranker reads of every line item."""
    row = {"document_id": F.col("l_orderkey"), "location_label": F.concat(F.lit("Điều "), F.col("l_linenumber").cast("string")), "status": F.col("l_linestatus"), "version": F.lit(1), "valid_from": F.to_date("l_shipdate"), "content": F.col("l_returnflag"), "change_type": F.when(F.col("l_returnflag") == "R", "sua_doi")}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.md5(R.rerank_text(row).cast("binary")).alias("digest"), F.length(R.rerank_text(row)).cast("long").alias("n"))


QUERIES["rerank_documents"] = rerank_documents
ORACLES["rerank_documents"] = """WITH t AS (SELECT l_orderkey, l_linenumber, 'Văn bản: ' || l_orderkey || chr(10) || 'Loại văn bản: ' || chr(10) || 'Cấp hiệu lực: ' || chr(10) || 'Vị trí: Điều ' || l_linenumber || chr(10) || 'Tình trạng: ' || l_linestatus || chr(10) || 'Phiên bản: 1' || chr(10)
|| 'Có hiệu lực từ: ' || strftime(l_shipdate, '%Y-%m-%d') || chr(10) || 'Có hiệu lực đến: ' || chr(10) || 'Nội dung gốc: ' || l_returnflag || chr(10) || 'Được sửa bởi văn bản: ' || chr(10) || 'Vị trí sửa đổi: ' || chr(10) || 'Loại thay đổi: ' || CASE WHEN l_returnflag = 'R' THEN 'sua_doi' ELSE '' END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, md5(t) AS digest, length(t) AS n FROM t"""


def legacy_locations(spark, sf_dir):
    """Labels and identities in the older form, of headings made of line items."""
    n = lambda c: F.col(c).cast("string")
    chapter = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Phụ lục "), n("l_linenumber"), F.lit(": x"))).when(F.col("l_linenumber") % 3 == 1, F.lit("Chương IV: y"))
    article = F.when(F.col("l_linenumber") % 3 == 0, F.lit("Mục II. z")).when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Điều "), n("l_suppkey"), F.lit("a. t")))
    clause = F.when(F.col("l_linenumber") > 4, F.concat(F.lit("Khoản "), n("l_partkey"), F.lit(". u")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", locations.legacy_label(chapter, article, clause).alias("label"))
    return rows.select("*", locations.legacy_canonical(F.col("label")).alias("canonical"))


QUERIES["legacy_locations"] = legacy_locations
ORACLES["legacy_locations"] = """WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Phụ lục ' || l_linenumber WHEN 1 THEN 'Chương IV' END AS c, CASE WHEN l_linenumber % 3 = 0 THEN 'Mục II' WHEN l_suppkey % 2 = 0 THEN 'Điều ' || l_suppkey END AS a, CASE WHEN l_linenumber > 4 THEN 'Khoản ' || l_partkey END AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(' > ', c, a, k), ''), 'Không xác định') AS label, concat_ws(' > ', CASE WHEN c LIKE 'Ch%' THEN 'chương IV' END, CASE WHEN a LIKE 'Đ%' THEN replace(a, 'Đ', 'đ') END, replace(k, 'K', 'k')) AS canonical FROM p"""


def scope_text(spark, sf_dir):
    """Key and description of a range of every order."""
    low = F.to_date("o_orderdate")
    kind = pick(("exact_date", "month", "year", "date_range", "current"), F.col("o_orderkey") % 5)
    r = F.struct(kind.alias("type"), low.alias("from"), F.date_add(low, 3).alias("to"))
    return read(spark, sf_dir, "orders").select("o_orderkey", temporal.scope_key(r).alias("scope_key"), temporal.describe(r).alias("description"))


QUERIES["scope_text"] = scope_text
ORACLES["scope_text"] = """WITH d AS (SELECT o_orderkey, ['exact_date', 'month', 'year', 'date_range', 'current'][o_orderkey % 5 + 1] AS kind, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS b FROM orders)
SELECT o_orderkey, kind || '|' || a || '|' || b AS scope_key, CASE kind WHEN 'exact_date' THEN 'on ' || a WHEN 'month' THEN 'in ' || substr(a, 1, 7) WHEN 'year' THEN 'in ' || substr(a, 1, 4) WHEN 'current' THEN 'in force on ' || a ELSE 'from ' || a || ' to ' || b END AS description FROM d"""


def month_precision(spark, sf_dir):
    """Exact dates, of which a question names the month, the day, or neither."""
    m, y = F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    kinds = F.array(F.concat(F.lit("Tháng "), m, F.lit(" năm "), y, F.lit(" nộp gì")), F.concat(F.lit("ngày 5 tháng "), m, F.lit(" năm "), y), F.concat(F.lit("trong tháng "), m, F.lit("/"), y), F.lit("năm ngoái"))
    scope = F.struct(F.lit("exact_date").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("year"))
    out = temporal.preserve_month(scope, F.get(kinds, (F.col("o_orderkey") % 4).cast("int")))
    return read(spark, sf_dir, "orders").select("o_orderkey", out["type"].alias("type"), out["date"].alias("date"), out["month"].cast("long").alias("month"), out["year"].cast("long").alias("year"))


QUERIES["month_precision"] = month_precision
ORACLES["month_precision"] = """WITH d AS (SELECT *, o_orderkey % 4 IN (0, 2) AS m FROM orders)
SELECT o_orderkey, CASE WHEN m THEN 'month' ELSE 'exact_date' END AS type, CASE WHEN NOT m THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN m THEN month(o_orderdate) END AS month, CASE WHEN m THEN year(o_orderdate) END AS year FROM d"""


def _raw_scopes(spark, sf_dir):
    """A scope of every order as a model might write it."""
    y, ym, ymd = (F.date_format("o_orderdate", f) for f in ("yyyy", "yyyy-MM", "yyyy-MM-dd"))
    j = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    kinds = F.array(
        j('{"type":"Year","value":"', y, '"}'),
        j('{"type":"month","value":"', ym, '"}'),
        j('{"type":"exact_date","value":"', ymd, '"}'),
        j('{"type":"date_range","from":{"value":"', ym, '"},"to":{"value":"current"}}'),
        j('{"type":"date_range","from":{"date":"', ymd, '"},"to":{"granularity":"year","value":"', y, '"}}'),
        j('{"type":"comparison","comparison_scopes":[{"type":"current","label":"Ngày ', F.dayofmonth("o_orderdate").cast("string"), "/", F.month("o_orderdate").cast("string"), "/", y, '"},{"label":"năm ', y, '"},{"type":"month","label":"tháng 3 năm ', y, '"}]}'),
    )
    raw = F.from_json(F.get(kinds, (F.col("o_orderkey") % 6).cast("int")), temporal.RAW_SCOPE)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return settle(rows.select("o_orderkey", temporal.coerce_scope(F.col("raw")).alias("scope"), F.lit("2024-01-20").cast("date").alias("as_of")))


def scope_coercion(spark, sf_dir):
    """Those scopes in the form that is compiled, expanded and compiled."""
    r = F.col("range")
    return temporal.expand_scopes(_raw_scopes(spark, sf_dir)).select("o_orderkey", F.col("branch").cast("int").alias("branch"), "label", r["type"].alias("type"), r["from"].alias("low"), r["to"].alias("high"))


QUERIES["scope_coercion"] = scope_coercion
_COERCED = """d AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS ye, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS dmy FROM orders),
c AS (SELECT o_orderkey, 1 AS branch, NULL AS label, 'year' AS type, y AS low, ye AS high FROM d WHERE k = 0
UNION ALL SELECT o_orderkey, 1, NULL, 'month', m, last_day(m) FROM d WHERE k = 1
UNION ALL SELECT o_orderkey, 1, NULL, 'exact_date', day, day FROM d WHERE k = 2
UNION ALL SELECT o_orderkey, 1, NULL, 'date_range', m, DATE '2024-01-20' FROM d WHERE k = 3
UNION ALL SELECT o_orderkey, 1, NULL, 'date_range', day, ye FROM d WHERE k = 4
UNION ALL SELECT o_orderkey, 1, 'Ngày ' || dmy, 'exact_date', day, day FROM d WHERE k = 5
UNION ALL SELECT o_orderkey, 2, 'năm ' || year(day), 'year', y, ye FROM d WHERE k = 5
UNION ALL SELECT o_orderkey, 3, 'tháng 3 năm ' || year(day), 'month', CAST(y + INTERVAL 2 MONTH AS DATE), last_day(y + INTERVAL 2 MONTH) FROM d WHERE k = 5)"""
ORACLES["scope_coercion"] = f"WITH {_COERCED} SELECT * FROM c"


def gold_branches(spark, sf_dir):
    """How many branches every case is retrieved for, and when they begin and end; labels play no part."""
    rows = temporal.branches(_raw_scopes(spark, sf_dir))
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("range.from").alias("low"), F.max("range.to").alias("high"))


QUERIES["gold_branches"] = gold_branches
ORACLES["gold_branches"] = f"WITH {_COERCED} SELECT o_orderkey, count(*) AS n, min(low) AS low, max(high) AS high FROM c GROUP BY o_orderkey"
