"""Queries about effects that come as loose JSON, made here of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as E
from .tables import read

QUERIES, ORACLES = {}, {}


def _raw(spark, sf_dir):
    """An extraction for every order: a relation with its customer's document, the same once more, one with a bare word, one without a type; two amendments, of which one may be wrong."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    scope = F.when(F.col("o_orderstatus") == "F", "whole_document").otherwise("all of it")
    first = F.concat(F.lit('{"target_document_id":"T'), customer, F.lit('","relation_types":["sua_doi","?",5],"impact_scope":"'), scope, F.lit('"}'))
    relations = F.concat_ws(",", first, F.concat(F.lit('{"target_document_id":'), customer, F.lit(',"relation_types":"bai_bo","effective_date":"2030-1-2"}')), first, F.lit('{"target_document_id":"T0","relation_types":[]},7,null'))
    component = F.when(F.col("o_orderkey") % 3 == 0, F.lit('"chapter"')).otherwise(F.lit('"ALL"'))
    amended = F.concat(F.lit('{"van_ban_bi_sua":"T'), customer, F.lit('","loai_thay_doi":"thay_the","target_component":'), component, F.lit(',"dieu_khoan_sua":"điều 1","dieu_khoan_bi_sua":["Điều 5 > Khoản '), key, F.lit('","Điều 5 > Khoản 0"]}'))
    phrase = F.concat(F.lit('{"van_ban_bi_sua":"T'), customer, F.lit('","loai_thay_doi":"sua_doi_cum_tu","dieu_khoan_sua":"Điều 2","dieu_khoan_bi_sua":"Điều 6","text_operation":"insert_after","anchor_text":"mục","operand_text":"số '), key, F.lit('"}'))
    text = F.concat(F.lit('{"effective_date":"'), day, F.lit('","document_relations":['), relations, F.lit('],"amendment_relations":['), amended, F.lit(","), phrase, F.lit("]}"))
    orders = read(spark, sf_dir, "orders")
    raw = orders.select(F.concat(F.lit("D"), key).alias("document_id"), text.alias("effects"))
    article = F.concat(F.lit("## Điều 1. Sửa đổi Điều 5\n“"), key, F.lit(". Mới\n0. Không”"))
    places = F.array(F.struct(F.lit("Điều 1").alias("location"), article.alias("section")), F.struct(F.lit("Điều 2").alias("location"), F.concat(F.lit("## Điều 2. Cụm từ\nmục được thêm “số "), key, F.lit("”")).alias("section")))
    sections = orders.select(F.concat(F.lit("D"), key).alias("document_id"), F.explode(places).alias("p")).select("document_id", "p.location", "p.section")
    return raw, sections


def effect_relations(spark, sf_dir):
    """Relations in one form, each once."""
    rows = E.relations(_raw(spark, sf_dir)[0])
    return rows.select("document_id", F.col("position").cast("long").alias("position"), "target_document_id", F.array_join("relation_types", ",").alias("relation_types"), "impact_scope", "effective_date")


QUERIES["effect_relations"] = effect_relations
ORACLES["effect_relations"] = """SELECT 'D' || o_orderkey AS document_id, CAST(0 AS BIGINT) AS position, 'T' || o_custkey AS target_document_id, 'sua_doi' AS relation_types, CASE WHEN o_orderstatus = 'F' THEN 'whole_document' ELSE 'partial' END AS impact_scope, CAST(o_orderdate AS DATE) AS effective_date FROM orders
UNION ALL SELECT 'D' || o_orderkey, 1, CAST(o_custkey AS VARCHAR), 'bai_bo', 'partial', DATE '2030-01-02' FROM orders"""


def effect_operations(spark, sf_dir):
    """Operations that can be carried out, with their new text out of the section, and what is wrong with the others."""
    good, bad = E.operations(*_raw(spark, sf_dir))
    done = good.select("document_id", F.col("position").cast("long").alias("position"), "target_location", "change", "old_text", "new_text", "effective_date", F.lit(None).cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    return done.unionByName(bad.select("document_id", F.col("position").cast("long").alias("position"), "target_location", none.alias("change"), none.alias("old_text"), none.alias("new_text"), F.lit(None).cast("date").alias("effective_date"), "problem"))


QUERIES["effect_operations"] = effect_operations
ORACLES["effect_operations"] = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS fits, CAST(o_orderdate AS DATE) AS day FROM orders),
p AS (SELECT k, fits, day, n, CASE WHEN n = 0 THEN 'Điều 5 > Khoản ' || k ELSE 'Điều 5 > Khoản 0' END AS place, CASE WHEN n = 0 THEN k || '. Mới' ELSE '0. Không' END AS new_text FROM o, (SELECT unnest([0, 1]) AS n))
SELECT 'D' || k AS document_id, CAST(n AS BIGINT) AS position, place AS target_location, CASE WHEN fits THEN 'sua_doi' END AS change, NULL::VARCHAR AS old_text, CASE WHEN fits THEN new_text END AS new_text, CASE WHEN fits THEN day END AS effective_date, CASE WHEN NOT fits THEN 'no such component' END AS problem FROM p
UNION ALL SELECT 'D' || k, 10000, 'Điều 6', 'sua_doi_cum_tu', 'mục', 'mục số ' || k, day, NULL FROM o"""
