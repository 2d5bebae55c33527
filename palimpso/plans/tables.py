"""The driver's tables in the roles of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the keys (user, event type), in order of time."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return V.chain(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], F.to_date("ts"))


VERSIONS_SQL = """
start AS (SELECT user_id || '|' || event_type AS provision_key, ts, event_id, CAST(ts AS DATE) AS valid_from FROM events),
vers AS (
  SELECT provision_key, event_id, valid_from, row_number() OVER w AS version, lead(valid_from) OVER w AS valid_to
  FROM start WINDOW w AS (PARTITION BY provision_key ORDER BY ts, event_id))"""


def points(spark: SparkSession, sf_dir: str, by_query: bool = False) -> DataFrame:
    """Line items as points of four documents for each query (supplier): ten articles of six clauses; line 7 is the article itself.

    With ``by_query`` they are dealt out by query, before ids and labels are made of them, which are larger.
    """
    rows = read(spark, sf_dir, "lineitem")
    if by_query:
        rows = rows.repartition("l_suppkey")
    article = F.concat(F.lit("Điều "), (F.col("l_partkey") % 10 + 1).cast("string"))
    ident = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.date_format("l_shipdate", "yyyy-MM-dd")).cast("binary"))
    return rows.select(
        F.col("l_suppkey").alias("query_id"),
        ident.alias("point_id"),
        F.concat(F.lit("D"), (F.col("l_orderkey") % 4).cast("string")).alias("document_id"),
        F.when(F.col("l_linenumber") == 7, article).otherwise(F.concat(article, F.lit(" > Khoản "), F.col("l_linenumber").cast("string"))).alias("location_label"),
        F.lower(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.concat(F.lit("k"), (F.col("l_partkey") % 7).cast("string")))).alias("content"),
        F.col("l_quantity").alias("rerank_score"),
        F.col("l_extendedprice").alias("price"),
    )


POINTS_SQL = """
raw AS (
  SELECT l_suppkey AS query_id,
    md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'))) AS point_id,
    'D' || (l_orderkey % 4) AS document_id, l_partkey % 10 + 1 AS article_no, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS clause_no,
    lower(concat_ws(' ', l_returnflag, l_linestatus, 'k' || (l_partkey % 7))) AS content, l_quantity AS rerank_score, l_extendedprice AS price
  FROM lineitem),
pts AS (SELECT *, 'Điều ' || article_no || coalesce(' > Khoản ' || clause_no, '') AS location_label, clause_no IS NULL AS article_level FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, point_id) AS rank FROM pts)"""
