r"""Queries about amendments: the fold over operations, its parts, and the upkeep of a corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calc, locations
from ..functions.lineage import stored
from ..operators import documents as D, pipelines as P, versions as V
from .tables import read
from .wording import pick

QUERIES, ORACLES = {}, {}

ITEMS_SQL = """
items AS (SELECT 'C' || o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, l_partkey AS part, l_suppkey AS supp, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _items(spark, sf_dir):
    """Line items as numbered parts of their customer's document."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("doc"), n.alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.to_date("o_orderdate").alias("day"))


def _first(location, content):
    """Version 1 of a provision of each item."""
    key = locations.provision_key(F.col("doc"), location)
    none = F.lit(None).cast("string")
    return (
        key.alias("provision_key"), F.lit(1).alias("version"), locations.version_id(key, F.lit(1)).alias("version_id"), F.col("doc").alias("document_id"), location.alias("location_label"), content.alias("provision_content"),
        F.col("day").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_latest"), none.alias("previous_version_id"), none.alias("superseded_by_version_id"), F.array().cast("array<string>").alias("applied_operation_ids"), none.alias("change_type"),
    )


def _operation(location, level, change, **more):
    """An operation of each item, a year after its order."""
    text = lambda name: more.get(name, F.lit(None)).cast("string").alias(name)
    return (
        F.concat_ws("|", "doc", F.lpad(F.col("n").cast("string"), 6, "0")).alias("operation_id"), F.col("doc").alias("target_document_id"), F.lit("S").alias("source_document_id"), F.lit("Điều 9").alias("source_location"), location.alias("target_location"),
        level.alias("target_level"), change.alias("change"), F.add_months("day", 12).alias("effective_date"), F.col("day").alias("source_issued_date"), text("target_component"), text("replacement_text"), text("old_text"), text("new_text"), F.lit(None).cast("array<string>").alias("targets"),
    )


def _result(rows):
    return rows.select("provision_key", F.col("version").cast("int").alias("version"), "version_id", "document_id", "provision_content", "valid_from", "valid_to", "is_latest", "previous_version_id", "superseded_by_version_id", F.array_join("applied_operation_ids", ",").alias("applied"), "change_type", F.col("error").isNotNull().alias("failed"))


_ERROR_SQL = "SELECT NULL AS provision_key, NULL AS version, op AS version_id, doc AS document_id, NULL AS provision_content, NULL AS valid_from, NULL AS valid_to, NULL AS is_latest, NULL AS previous_version_id, NULL AS superseded_by_version_id, NULL AS applied, NULL AS change_type, true AS failed"
_TAIL_SQL = """o AS (SELECT *, doc || '|' || lpad(CAST(n AS VARCHAR), 6, '0') AS op, CAST(day + INTERVAL 12 MONTH AS DATE) AS eff FROM t)
SELECT key AS provision_key, 1 AS version, key || '|V1' AS version_id, doc AS document_id, old AS provision_content, day AS valid_from, CASE WHEN new IS NOT NULL THEN eff END AS valid_to, new IS NULL AS is_latest, NULL AS previous_version_id, CASE WHEN new IS NOT NULL THEN key || '|V2' END AS superseded_by_version_id, '' AS applied, NULL AS change_type, false AS failed FROM o
UNION ALL SELECT key, 2, key || '|V2', doc, new, eff, NULL, true, key || '|V1', NULL, op, change, false FROM o WHERE new IS NOT NULL
UNION ALL SELECT added, 1, added || '|V1', doc, fresh, eff, NULL, true, NULL, NULL, op, change, false FROM o WHERE added IS NOT NULL"""


def amend_articles(spark, sf_dir):
    """Articles that are rewritten, repealed, given other words or added, or whose addition fails as they are there."""
    items = _items(spark, sf_dir)
    n, k = F.col("n").cast("string"), F.col("n") % 6
    place = F.concat(F.lit("Điều "), n)
    versions = items.select(*_first(place, F.concat(F.lit("## Điều "), n, F.lit(". Gốc\nphần cũ "), F.col("part").cast("string"))))
    target = F.when(k == 5, F.concat(F.lit("Điều "), (F.col("n") + 10_000).cast("string"))).otherwise(place)
    change = pick(("", "sua_doi", "bai_bo", "sua_doi_cum_tu", "bo_sung", "bo_sung"), k)
    text = F.when(k == 1, F.concat(F.lit("“Điều "), n, F.lit(". Tên\nnội dung "), F.col("supp").cast("string"), F.lit("”"))).when(k >= 4, F.concat(target, F.lit(". Thêm")))
    ops = items.filter(k != 0).select(*_operation(target, F.lit("dieu"), change, replacement_text=text, old_text=F.when(k == 3, "cũ"), new_text=F.when(k == 3, "mới")))
    return _result(V.apply_operations(versions, ops))


QUERIES["amend_articles"] = amend_articles
ORACLES["amend_articles"] = f"""WITH {ITEMS_SQL},
t AS (SELECT doc, n, day, doc || '|DIEU_' || n AS key, '## Điều ' || n || '. Gốc' || chr(10) || 'phần cũ ' || part AS old,
  ['', 'sua_doi', 'bai_bo', 'sua_doi_cum_tu', 'bo_sung', 'bo_sung'][n % 6 + 1] AS change,
  CASE n % 6 WHEN 1 THEN '## Điều ' || n || '. Tên' || chr(10) || 'nội dung ' || supp WHEN 2 THEN '## Điều ' || n || '. [Đã bãi bỏ theo Điều 9 S, hiệu lực từ ngày ' || strftime(day + INTERVAL 12 MONTH, '%Y-%m-%d') || '].' WHEN 3 THEN '## Điều ' || n || '. Gốc' || chr(10) || 'phần mới ' || part END AS new,
  CASE WHEN n % 6 = 5 THEN doc || '|DIEU_' || (n + 10000) END AS added, '## Điều ' || (n + 10000) || '. Thêm' AS fresh FROM items),
{_TAIL_SQL}
UNION ALL {_ERROR_SQL} FROM o WHERE n % 6 = 4"""


def amend_clauses(spark, sf_dir):
    """Clauses that are rewritten, repealed or added, points that are inserted or repealed inside them, and additions that fail."""
    items = _items(spark, sf_dir)
    n, k = F.col("n").cast("string"), F.col("n") % 7
    place = F.concat(F.lit("Điều 1 > Khoản "), n)
    versions = items.select(*_first(place, F.concat(F.lit("### Khoản "), n, F.lit(". gốc "), F.col("part").cast("string"), F.lit("\na) một\nb) hai\nd) bốn"))))
    beyond = F.concat(F.lit("Điều 1 > Khoản "), (F.col("n") + 5_000).cast("string"))
    target = F.when(k == 4, beyond).when(k == 5, F.concat(place, F.lit(" > Điểm c"))).when(k == 6, F.concat(place, F.lit(" > Điểm b"))).otherwise(place)
    change = pick(("", "sua_doi", "bai_bo", "bo_sung", "bo_sung", "bo_sung", "bai_bo"), k)
    text = F.when(k == 1, F.concat(F.lit("Khoản "), n, F.lit(". mới "), F.col("supp").cast("string"))).when(k == 3, F.lit("x")).when(k == 4, F.lit("thêm")).when(k == 5, F.lit("c) ba"))
    ops = items.filter(k != 0).select(*_operation(target, F.when(k >= 5, "diem").otherwise("khoan"), change, replacement_text=text))
    return _result(V.apply_operations(versions, ops))


QUERIES["amend_clauses"] = amend_clauses
ORACLES["amend_clauses"] = f"""WITH {ITEMS_SQL},
t AS (SELECT doc, n, day, doc || '|DIEU_1|KHOAN_' || n AS key, '### Khoản ' || n || '. gốc ' || part || chr(10) || 'a) một' || chr(10) || 'b) hai' || chr(10) || 'd) bốn' AS old,
  ['', 'sua_doi', 'bai_bo', 'bo_sung', 'bo_sung', 'bo_sung', 'bai_bo'][n % 7 + 1] AS change, '[Đã bãi bỏ theo Điều 9 S, hiệu lực từ ngày ' || strftime(day + INTERVAL 12 MONTH, '%Y-%m-%d') || '].' AS gone,
  CASE n % 7 WHEN 1 THEN '### Khoản ' || n || '. mới ' || supp WHEN 2 THEN '### Khoản ' || n || '. ' || gone
    WHEN 5 THEN '### Khoản ' || n || '. gốc ' || part || chr(10) || 'a) một' || chr(10) || 'b) hai' || chr(10) || chr(10) || 'c) ba' || chr(10) || chr(10) || 'd) bốn'
    WHEN 6 THEN '### Khoản ' || n || '. gốc ' || part || chr(10) || 'a) một' || chr(10) || 'b) ' || gone || chr(10) || chr(10) || 'd) bốn' END AS new,
  CASE WHEN n % 7 = 4 THEN doc || '|DIEU_1|KHOAN_' || (n + 5000) END AS added, '### Khoản ' || (n + 5000) || '. thêm' AS fresh FROM items),
{_TAIL_SQL}
UNION ALL {_ERROR_SQL} FROM o WHERE n % 7 = 3"""


def rewrite_articles(spark, sf_dir):
    """Articles rewritten with other clauses: matched ones are succeeded, new ones begin, missing ones are closed."""
    items = _items(spark, sf_dir)
    n = F.col("n").cast("string")
    parts = items.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    place = F.when(F.col("c") == 0, F.concat(F.lit("Điều "), n)).otherwise(F.concat(F.lit("Điều "), n, F.lit(" > Khoản "), F.col("c").cast("string")))
    content = F.when(F.col("c") == 0, F.concat(F.lit("## Điều "), n, F.lit(". Gốc"))).otherwise(F.concat(F.lit("### Khoản "), F.col("c").cast("string"), F.lit(". cũ")))
    versions = parts.select(*_first(place, content))
    text = F.concat(F.lit("Điều "), n, F.lit(". Tên\n2. hai\n3. ba "), F.col("part").cast("string"))
    ops = items.filter("n % 2 = 0").select(*_operation(F.concat(F.lit("Điều "), n), F.lit("dieu"), F.lit("thay_the"), replacement_text=text))
    out = V.apply_operations(versions, ops)
    return out.select("provision_key", F.col("version").cast("int").alias("version"), "provision_content", "valid_to", "is_latest")


QUERIES["rewrite_articles"] = rewrite_articles
ORACLES["rewrite_articles"] = f"""WITH {ITEMS_SQL}, k AS (SELECT *, doc || '|DIEU_' || n AS key, n % 2 = 0 AS hit, CAST(day + INTERVAL 12 MONTH AS DATE) AS eff FROM items)
SELECT key AS provision_key, 1 AS version, '## Điều ' || n || '. Gốc' AS provision_content, CASE WHEN hit THEN eff END AS valid_to, NOT hit AS is_latest FROM k
UNION ALL SELECT key || '|KHOAN_' || c, 1, '### Khoản ' || c || '. cũ', CASE WHEN hit THEN eff END, NOT hit FROM k, (SELECT unnest([1, 2]) AS c)
UNION ALL SELECT key, 2, '## Điều ' || n || '. Tên', NULL, true FROM k WHERE hit
UNION ALL SELECT key || '|KHOAN_2', 2, '### Khoản 2. hai', NULL, true FROM k WHERE hit
UNION ALL SELECT key || '|KHOAN_3', 1, '### Khoản 3. ba ' || part, NULL, true FROM k WHERE hit"""


def affected_points(spark, sf_dir):
    """Points at or below the targets of amendments; document ids are written in other ways."""
    place = F.concat(F.lit("Điều "), (F.col("l_partkey") % 10 + 1).cast("string"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit(" > Khoản "), F.col("l_linenumber").cast("string"))).otherwise(F.lit("")))
    points = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("Số "), (F.col("l_orderkey") % 50).cast("string"), F.lit("/2019/NĐ-CP")).alias("document_id"), place.alias("location_label"), "l_orderkey", "l_linenumber")
    ops = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("operation_id"), F.concat((F.col("s_suppkey") % 50).cast("string"), F.lit(" / 2019/nđ-CP")).alias("target_document_id"), F.concat(F.lit("Điều "), (F.col("s_suppkey") % 10 + 1).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" > khoản "), (F.col("s_suppkey") % 6 + 1).cast("string"))).otherwise(F.lit(""))).alias("target_location"))
    # points of one place are affected together, so they are added up before they meet the operations
    places = points.groupBy("document_id", "location_label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sum"))
    return V.affected_points(ops, places).groupBy("operation_id").agg(F.sum("n").alias("n_points"), F.sum("sum").alias("check"))


QUERIES["affected_points"] = affected_points
ORACLES["affected_points"] = """SELECT s_suppkey AS operation_id, count(*) AS n_points, CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS "check" FROM lineitem JOIN supplier
ON l_orderkey % 50 = s_suppkey % 50 AND l_partkey % 10 = s_suppkey % 10 AND (s_suppkey % 3 <> 0 OR l_linenumber = s_suppkey % 6 + 1) GROUP BY s_suppkey"""


def replacement_blocks(spark, sf_dir):
    """The quoted block that begins with a target's own number, usable if there is just one."""
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    # what no target names, and the target that nothing is quoted of, are made from the number itself, so that they are nobody's whatever numbers there are
    source = F.concat(F.lit("Sửa: “"), n, F.lit(". nội dung mới”; “khoản "), n, F.lit("9. khác”"), F.when(k == 1, F.concat(F.lit(" “"), n, F.lit(": lần nữa”"))).otherwise(F.lit("")), F.lit(" “Điều "), n, F.lit(". Tên”"))
    target = F.when(k == 3, F.concat(F.lit("Điều "), n)).otherwise(F.concat(F.lit("Điều 2 > Khoản "), F.when(k == 2, F.concat(n, F.lit("7"))).otherwise(n)))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", source.alias("s"), target.alias("t"))
    return rows.select("o_orderkey", D.replacement_for(F.col("s"), F.col("t")).alias("r"), D.target_level(F.col("t")).alias("level")).select("o_orderkey", F.col("r.text").alias("text"), F.col("r.n").cast("int").alias("n"), "level")


QUERIES["replacement_blocks"] = replacement_blocks
ORACLES["replacement_blocks"] = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '. nội dung mới' WHEN 3 THEN 'Điều ' || o_custkey || '. Tên' END AS text, CASE o_orderkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n, CASE WHEN o_orderkey % 4 = 3 THEN 'dieu' ELSE 'khoan' END AS level FROM orders"""


def phrase_operations(spark, sf_dir):
    """Replace, insert and delete phrases; operands that the section does not have give nothing."""
    kind = pick(("replace", "insert_before", "insert_after", "delete", "replace"), F.col("o_orderkey") % 5)
    anchor, operand = F.concat(F.lit("cụm "), F.col("o_custkey").cast("string")), F.when(F.col("o_orderkey") % 5 == 4, "vắng").otherwise(F.lit("mới"))
    out = D.phrase_operation(kind, anchor, operand, F.concat(F.lit("thay "), anchor, F.lit(" bằng mới")))
    return read(spark, sf_dir, "orders").select("o_orderkey", out["old"].alias("old"), out["new"].alias("new"))


QUERIES["phrase_operations"] = phrase_operations
ORACLES["phrase_operations"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN 'cụm ' || o_custkey END AS old, CASE o_orderkey % 5 WHEN 0 THEN 'mới' WHEN 1 THEN 'mới cụm ' || o_custkey WHEN 2 THEN 'cụm ' || o_custkey || ' mới' WHEN 3 THEN '' END AS new FROM orders"""


def aligned_headings(spark, sf_dir):
    """Headings of provisions whose article has gained or lost clauses."""
    n, k = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 4
    place = F.when(k < 2, F.concat(F.lit("Điều "), n)).otherwise(F.concat(F.lit("Điều "), n, F.lit(" > Khoản 2")))
    content = F.when(k == 0, F.concat(F.lit("## Điều "), n, F.lit(". Mới\nx"))).when(k == 2, F.lit("### Khoản 2. hai\ny")).otherwise(F.lit("z"))
    article = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Điều "), n, F.lit(". Cũ"))).otherwise(F.lit("Điều 0. Khác"))
    out = locations.align_headings(place, content, article, F.lit("Khoản 9. gì"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", out["article"].alias("article"), out["clause"].alias("clause"))


QUERIES["aligned_headings"] = aligned_headings
ORACLES["aligned_headings"] = """SELECT l_orderkey, l_linenumber, 'Điều ' || l_partkey || CASE WHEN l_linenumber % 4 = 0 THEN '. Mới' WHEN l_suppkey % 2 = 0 THEN '. Cũ' WHEN l_partkey = 0 THEN '. Khác' ELSE '' END AS article, CASE l_linenumber % 4 WHEN 2 THEN 'Khoản 2. hai' WHEN 3 THEN 'Khoản 2' END AS clause FROM lineitem"""


def applied_amendments(spark, sf_dir):
    """What amended an order's provision, as one block of text."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.col("l_suppkey").cast("string").alias("source_document_id"), F.concat(F.lit("Điều "), F.col("l_linenumber").cast("string")).alias("source_location"), F.when(F.col("l_returnflag") != "N", "sua_doi").alias("change"), F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("effective_date"), F.when(F.col("l_returnflag") == "A", "  mới ").alias("new_text"))
    rows = rows.withColumn("position", F.struct("l_linenumber", "source_document_id", "change", "effective_date", "new_text"))
    return D.amendment_blocks(rows, "key").select(F.col("key").alias("l_orderkey"), F.md5(F.col("block").cast("binary")).alias("digest"))


QUERIES["applied_amendments"] = applied_amendments
ORACLES["applied_amendments"] = """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS s, CASE WHEN l_returnflag <> 'N' THEN 'sua_doi' END AS c, CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y-%m-%d') END AS e, CASE WHEN l_returnflag = 'A' THEN '  mới ' END AS t FROM lineitem),
t AS (SELECT *, 'Nguồn: ' || s || ' > Điều ' || l_linenumber || chr(10) || 'Loại thay đổi: ' || coalesce(c, '') || chr(10) || 'Hiệu lực: ' || coalesce(e, 'Không xác định') || coalesce(chr(10) || trim(t), '') AS x FROM b)
SELECT l_orderkey, md5('[CẬP NHẬT PHÁP LÝ ÁP DỤNG CHO VỊ TRÍ NÀY]' || chr(10) || string_agg(x, chr(10) || chr(10) ORDER BY l_linenumber, s, c NULLS FIRST, e NULLS FIRST, t NULLS FIRST)) AS digest FROM t GROUP BY l_orderkey"""


def substantive_points(spark, sf_dir):
    """Provisions that say something: not blank, and not an article that is only its heading."""
    n, k = F.col("l_linenumber").cast("string"), F.col("l_partkey") % 5
    content = F.when(k == 0, F.concat(F.lit("## Điều "), n, F.lit("."))).when(k == 1, F.lit(" \n ")).when(k == 2, F.concat(F.lit("## Điều "), n, F.lit("\nnội dung"))).when(k == 3, F.concat(F.lit("Điều "), n, F.lit(". Tên dài"))).otherwise(F.lit("một dòng"))
    place = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Chương I > Điều "), n)).otherwise(F.concat(F.lit("Điều "), n, F.lit(" > Khoản 1")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.substantive(content, place).alias("substantive"), locations.is_article_level(place, numeric_only=False).alias("article_level"))


QUERIES["substantive_points"] = substantive_points
ORACLES["substantive_points"] = """SELECT l_orderkey, l_linenumber, l_partkey % 5 <> 1 AND NOT (l_suppkey % 2 = 0 AND l_partkey % 5 IN (0, 3)) AS substantive, l_suppkey % 2 = 0 AS article_level FROM lineitem"""


def retrievable_points(spark, sf_dir):
    """Provisions in force on a day that say something, and their best version only."""
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("provision_key"), F.col("l_linenumber").alias("version"), F.to_date("l_shipdate").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.when(F.col("l_returnflag") == "A", "").otherwise("x").alias("content"), F.lit("Điều 1 > Khoản 1").alias("location_label"))
    scope = spark.createDataFrame([(1, "exact_date", "1998-01-01", "1998-01-01")], "scope_id long, kind string, low string, high string").select("scope_id", "kind", F.col("low").cast("date").alias("low"), F.col("high").cast("date").alias("high"))
    out = V.retrievable(rows, scope, F.col("content"), F.col("location_label"))
    return out.groupBy("provision_key").agg(F.max("version").cast("int").alias("version"), F.count(F.lit(1)).alias("n"))


QUERIES["retrievable_points"] = retrievable_points
ORACLES["retrievable_points"] = """WITH r AS (SELECT l_orderkey || '|' || l_partkey AS provision_key, l_linenumber AS version, l_returnflag FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-01-01'),
m AS (SELECT * FROM r QUALIFY version = max(version) OVER (PARTITION BY provision_key)) SELECT provision_key, version, count(*) AS n FROM m WHERE l_returnflag <> 'A' GROUP BY ALL"""


def active_points(spark, sf_dir):
    """Points of a query's active set; a query with no active point has none, as an empty set is no filter to the index."""
    points = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("point_id")).distinct()
    active = read(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("point_id"))
    return V.active_only(points, active)


QUERIES["active_points"] = active_points
ORACLES["active_points"] = "SELECT DISTINCT l_suppkey AS query_id, l_partkey AS point_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)"


def latest_versions(spark, sf_dir):
    """Open versions, of which a missing flag counts as the latest, with the group's first part."""
    rows = read(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("provision_key"), F.col("event_id").alias("point_id"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1).alias("is_latest"), F.when(F.col("event_id") % 5 == 0, F.to_date("ts")).alias("valid_to"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise("").alias("provision_content"))
    return V.latest_groups(V.latest_open(rows), order="point_id").select("provision_key", "point_id", "n_points", "provision_content")


QUERIES["latest_versions"] = latest_versions
ORACLES["latest_versions"] = """WITH r AS (SELECT user_id || '|' || event_type AS provision_key, event_id, CASE WHEN event_id % 7 > 0 THEN 'x' || event_id ELSE '' END AS c FROM events WHERE event_id % 3 <> 2 AND event_id % 5 <> 0)
SELECT provision_key, min(event_id) AS point_id, count(*) AS n_points, arg_min(c, event_id) AS provision_content FROM r GROUP BY provision_key"""


def missing_points(spark, sf_dir):
    """Locations of which an expected point is missing are built anew as a whole."""
    expected = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("location_label"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("point_id"), F.col("l_partkey"))
    there = expected.filter("l_partkey % 4 > 0").select("point_id")
    return V.missing_points(expected, there).groupBy("document_id", "location_label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["missing_points"] = missing_points
ORACLES["missing_points"] = "SELECT l_orderkey AS document_id, l_linenumber AS location_label, count(*) AS n FROM lineitem GROUP BY ALL HAVING bool_or(l_partkey % 4 = 0)"


def snapshot_patch(spark, sf_dir):
    """Orders whose status or price an update changes; what it leaves null stays."""
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Z").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(1.5)).alias("o_totalprice"))
    return V.patch(old, new, "o_orderkey")


QUERIES["snapshot_patch"] = snapshot_patch
ORACLES["snapshot_patch"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 15 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders"


def deleted_document(spark, sf_dir):
    """A snapshot without one document's points, and how many there were."""
    points = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    kept, gone = V.delete_document(points, [3, 7])
    return kept.select(F.lit("kept").alias("what")).unionByName(gone.select(F.lit("gone").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


QUERIES["deleted_document"] = deleted_document
ORACLES["deleted_document"] = "SELECT CASE WHEN l_orderkey IN (3, 7) THEN 'gone' ELSE 'kept' END AS what, count(*) AS n FROM lineitem GROUP BY ALL"


def replaced_effects(spark, sf_dir):
    """Effects on documents: those of sources that are stated anew give way, and none occurs twice."""
    effect = lambda source, kind: F.struct(source.alias("source_document_id"), F.array(kind).alias("relation_types"), F.lit("x").alias("impact_scope"), F.lit(None).cast("date").alias("effective_date"), F.lit("a").alias("status"))
    o = read(spark, sf_dir, "orders")
    doc = lambda k: F.concat(k.cast("string"), F.lit("/2020/NĐ-CP"))
    old = F.array(effect(doc(F.col("o_custkey")), F.lit("cu")), effect(doc(F.col("o_custkey") + 1), F.lit("giu")))
    new = F.array(effect(F.concat(F.lit("số "), doc(F.col("o_custkey"))), F.lit("moi")), effect(F.concat(F.lit("số "), doc(F.col("o_custkey"))), F.lit("moi")))
    got = V.replace_effects(F.when(F.col("o_orderkey") % 4 > 0, old), new)
    return o.select("o_orderkey", F.array_join(F.transform(got, lambda x: F.concat(x["source_document_id"], F.lit(":"), x["relation_types"][0])), ",").alias("effects"))


QUERIES["replaced_effects"] = replaced_effects
ORACLES["replaced_effects"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey + 1) || '/2020/NĐ-CP:giu,' ELSE '' END || 'số ' || o_custkey || '/2020/NĐ-CP:moi' AS effects FROM orders"


def corpus_report(spark, sf_dir):
    """How many documents and terms there are, and how long pieces are on average before and after they are augmented."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("original_content"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("content"))
    return D.corpus_report(docs)


QUERIES["corpus_report"] = corpus_report
ORACLES["corpus_report"] = """SELECT count(DISTINCT doc_id) AS documents, count(*) AS points, round(avg(length(text)), 6) AS avg_original, round(avg(length('[' || doc_id || '] ' || coalesce(text, ''))), 6) AS avg_augmented,
(SELECT count(DISTINCT x) FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS x FROM documents)) AS terms FROM documents"""


def json_identity(spark, sf_dir):
    """Objects by a hash that does not depend on the order of their keys; repeated ones count once."""
    a = F.concat(F.lit('{"b": "'), F.col("user_id").cast("string"), F.lit('", "a": "'), F.col("event_type"), F.lit('"}'))
    b = F.concat(F.lit('{"a":"'), F.col("event_type"), F.lit('","b":"'), F.col("user_id").cast("string"), F.lit('"}'))
    return read(spark, sf_dir, "events").select(calc.canonical_hash(F.when(F.col("event_id") % 2 == 0, a).otherwise(b)).alias("identity")).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


QUERIES["json_identity"] = json_identity
ORACLES["json_identity"] = """SELECT sha256('{"a": "' || event_type || '", "b": "' || user_id || '"}') AS identity, count(*) AS n FROM events GROUP BY ALL"""


def point_labels(spark, sf_dir):
    """Labels of points in the order of the language's alphabet, letters first and numbers behind them."""
    label = F.concat(pick(tuple(locations.POINT_ALPHABET.split()), F.col("l_partkey") % 22), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("string")).otherwise(F.lit("")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", label.alias("label")).distinct()
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(locations.point_order(F.col("label")).alias("o"), "label"))), lambda x: x["label"]), " ").alias("labels"))


QUERIES["point_labels"] = point_labels
ORACLES["point_labels"] = """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey % 22 AS a, CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE 0 END AS n FROM lineitem)
SELECT l_orderkey, string_agg(string_split('a b c d đ e g h i k l m n o p q r s t u v x', ' ')[a + 1] || CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE '' END, ' ' ORDER BY a, n) AS labels FROM p GROUP BY l_orderkey"""


def leaf_sections(spark, sf_dir):
    """Headings without one below them, of documents whose lines are marked by their position."""
    from .prose import _marked

    rows = D.leaf_sections(D.headings(D.lines(_marked(spark, sf_dir), "markdown")))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


QUERIES["leaf_sections"] = leaf_sections
ORACLES["leaf_sections"] = """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY doc_id) - 1 AS i, line FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text IS NOT NULL)),
h AS (SELECT document_id, i, CASE WHEN i % 24 = 0 THEN 1 WHEN i % 8 = 1 THEN 2 WHEN i % 8 IN (2, 5) THEN 3 END AS level FROM l),
k AS (SELECT document_id, i, level, lead(level) OVER (PARTITION BY document_id ORDER BY i) AS next FROM h WHERE level IS NOT NULL)
SELECT document_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS starts FROM k WHERE next IS NULL OR next <= level GROUP BY document_id"""


def head_texts(spark, sf_dir):
    """New titles and opening words of articles in the sections that amend them; usable if there is just one."""
    n, c = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    kinds = F.array(
        F.concat(F.lit("Sửa như sau:\n“Điều "), n, F.lit(". Tên mới\nlời dẫn "), c, F.lit("\n1. một”.\nhết")),
        F.lit("không có gì"),
        F.concat(F.lit("Điều "), n, F.lit(". A\nx\nĐiều "), n, F.lit(". B\ny")),
        F.concat(F.lit("## Điều "), n, F.lit(": Tên”\n")),
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("s"), F.concat(F.lit("Điều "), n).alias("t"))
    got = rows.select("o_orderkey", D.article_title(F.col("s"), F.col("t")).alias("a"), D.article_preamble(F.col("s"), F.col("t")).alias("b"))
    return got.select("o_orderkey", F.col("a.text").alias("title"), F.col("a.n").alias("titles"), F.col("b.text").alias("preamble"), F.col("b.n").alias("preambles"))


QUERIES["head_texts"] = head_texts
ORACLES["head_texts"] = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Điều ' || o_custkey || '. Tên mới' WHEN 3 THEN 'Điều ' || o_custkey || ': Tên' END AS title, CAST([1, 0, 2, 1][o_orderkey % 4 + 1] AS INTEGER) AS titles,
CASE o_orderkey % 4 WHEN 0 THEN 'lời dẫn ' || o_orderkey WHEN 2 THEN 'x' || chr(10) || 'Điều ' || o_custkey || '. B' || chr(10) || 'y' END AS preamble, CAST([1, 0, 1, 0][o_orderkey % 4 + 1] AS INTEGER) AS preambles FROM orders"""


def amend_heads(spark, sf_dir):
    """Articles that get another title, or other opening words, and keep the rest."""
    items = _items(spark, sf_dir)
    n, k = F.col("n").cast("string"), F.col("n") % 3
    place = F.concat(F.lit("Điều "), n)
    versions = items.select(*_first(place, F.concat(F.lit("## Điều "), n, F.lit(". Gốc\nlời "), F.col("part").cast("string"))))
    text = F.when(k == 1, F.concat(F.lit("“Điều "), n, F.lit(". Tên "), F.col("supp").cast("string"), F.lit("”"))).otherwise(F.concat(F.lit("“dẫn "), F.col("supp").cast("string"), F.lit("”")))
    ops = items.filter(k != 0).select(*_operation(place, F.lit("dieu"), F.lit("sua_doi"), target_component=F.when(k == 1, "title").otherwise("preamble"), replacement_text=text))
    return V.apply_operations(versions, ops).select("provision_key", F.col("version").cast("int").alias("version"), "provision_content", F.col("error").isNotNull().alias("failed"))


QUERIES["amend_heads"] = amend_heads
ORACLES["amend_heads"] = f"""WITH {ITEMS_SQL} SELECT doc || '|DIEU_' || n AS provision_key, 1 AS version, '## Điều ' || n || '. Gốc' || chr(10) || 'lời ' || part AS provision_content, false AS failed FROM items
UNION ALL SELECT doc || '|DIEU_' || n, 2, CASE n % 3 WHEN 1 THEN '## Điều ' || n || '. Tên ' || supp || chr(10) || 'lời ' || part ELSE '## Điều ' || n || '. Gốc' || chr(10) || 'dẫn ' || supp END, false FROM items WHERE n % 3 > 0"""


def header_chunks(spark, sf_dir):
    """Documents whose lines are marked by their position, cut the older way: how many pieces every place has, and how long they are together where it is whole."""
    from .prose import _marked

    rows = D.header_chunks(_marked(spark, sf_dir), size=100_000_000)
    return rows.groupBy("document_id", "legacy_location").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chunk_size").cast("long")).alias("chars"), F.count("sub_chunk_index").alias("cut"))


def _header_chunks_sql() -> str:
    from .prose import _MARKED_SQL

    return f"""WITH {_MARKED_SQL},
lab AS (SELECT num.doc AS document_id, trim(content, ' ' || chr(10) || chr(9) || chr(13)) AS t, coalesce(nullif(concat_ws(' > ', 'Chương ' || nullif(regexp_extract(chapter, 'Chương\\s+([IVXLCDM]+)', 1), ''), 'Điều ' || nullif(regexp_extract(article, 'Điều\\s+(\\d+)', 1), ''), 'Khoản ' || CASE WHEN level = 3 THEN nullif(regexp_extract(title, '(?i)Khoản\\s+(\\d+)', 1), '') END), ''), 'Không xác định') AS legacy_location
FROM num JOIN body ON body.doc = num.doc AND body.own = num.i WHERE coalesce(cn, an, kn) IS NOT NULL)
SELECT document_id, legacy_location, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS cut FROM lab GROUP BY ALL"""


QUERIES["header_chunks"] = header_chunks
ORACLES["header_chunks"] = _header_chunks_sql()


def corpus_build(spark, sf_dir):
    """Documents of customers from their Markdown to their versions: every second article is repealed, and every fifth document ends as a whole."""
    items = stored(_items(spark, sf_dir).drop("supp"), "items")  # read by documents and operations, which are read in turn by several steps: their shuffles go as soon as they are written
    n = F.col("n").cast("string")
    text = F.concat(F.lit("## Điều "), n, F.lit(". Gốc\nphần "), F.col("part").cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"])
    docs = items.groupBy(F.col("doc").alias("document_id")).agg(F.array_join(listed, "\n").alias("markdown"), F.min("day").alias("effective_date"))
    docs = stored(docs, "documents")
    none = F.lit(None).cast("string")
    meta = docs.select("document_id", none.alias("document_type"), F.lit(1).alias("legal_rank"), F.lit("active").alias("status"), "effective_date", F.lit(None).cast("date").alias("expiration_date"))
    place = F.concat(F.lit("Điều "), F.when(F.col("n") % 10 == 7, F.lit("99999")).otherwise(n))
    ops = items.filter("n % 2 = 1").select(*_operation(place, F.lit("dieu"), F.lit("bai_bo")))
    ends = F.expr("int(substring(document_id, 2)) % 5 = 0")
    effects = docs.filter(ends).select(F.col("document_id").alias("target_document_id"), F.array(F.lit("thay_the")).alias("relation_types"), F.lit("whole_document").alias("impact_scope"), F.lit("2003-01-01").cast("date").alias("effective_date"))
    versions, failed = P.build_corpus(docs.select("document_id", "markdown"), meta, ops, effects, F.lit("2004-01-01").cast("date"))
    bad = failed.groupBy("document_id").agg(F.count(F.lit(1)).alias("failed"))
    out = versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count_if(F.col("status") == "inactive").alias("inactive"), F.count_if("is_latest").alias("latest"), F.sum(F.datediff(F.coalesce("valid_to", F.lit("2010-01-01").cast("date")), "valid_from").cast("long")).alias("days"))
    return out.join(bad, "document_id", "left").select("document_id", "versions", "open", "inactive", "latest", "days", F.coalesce("failed", F.lit(0)).alias("failed"))


QUERIES["corpus_build"] = corpus_build
ORACLES["corpus_build"] = f"""WITH {ITEMS_SQL}, d AS (SELECT *, min(day) OVER (PARTITION BY doc) AS eff, n % 2 = 1 AND n % 10 <> 7 AS hit, n % 10 = 7 AS fails, CAST(substr(doc, 2) AS INT) % 5 = 0 AS ends, CAST(day + INTERVAL 12 MONTH AS DATE) AS gone FROM items),
v AS (SELECT doc, eff AS a, CASE WHEN hit THEN gone END AS b, ends FROM d UNION ALL SELECT doc, gone, NULL, ends FROM d WHERE hit),
e AS (SELECT doc, a, b IS NULL AS latest, b IS NULL AND ends AS inactive, CASE WHEN b IS NULL AND ends THEN DATE '2003-01-01' ELSE b END AS b FROM v),
f AS (SELECT doc, count(*) FILTER (fails) AS failed FROM d GROUP BY doc)
SELECT doc AS document_id, count(*) AS versions, count(*) FILTER (b IS NULL) AS "open", count(*) FILTER (inactive) AS inactive, count(*) FILTER (latest) AS latest, CAST(sum(coalesce(b, DATE '2010-01-01') - a) AS BIGINT) AS days, any_value(failed) AS failed FROM e JOIN f USING (doc) GROUP BY doc"""
