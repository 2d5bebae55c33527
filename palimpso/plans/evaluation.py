"""Queries about scores, audits and resuming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..operators import evaluate as E
from ..operators import pipelines as P
from .tables import VERSIONS_SQL, read, versions

QUERIES, ORACLES = {}, {}


def _cases(spark, sf_dir):
    """Sources of documents as cases, documents by length as the ranking, labels as relevance."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("ident"), F.struct("n_chars", "doc_id").alias("o"))
    ranked = E.first_of_each(docs.withColumn("position", F.col("o")))
    qrels = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("ident"), (F.col("quality") + F.col("toxic")).alias("relevance"))
    return ranked.filter("position <= 20"), qrels


def retrieval_metrics(spark, sf_dir):
    ranked, qrels = _cases(spark, sf_dir)
    out = E.ranking_metrics(ranked.select("case_id"), ranked, qrels)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg")])


QUERIES["retrieval_metrics"] = retrieval_metrics
ORACLES["retrieval_metrics"] = """WITH r AS (SELECT source AS case_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS position FROM documents QUALIFY position <= 20),
g AS (SELECT source AS case_id, doc_id, max(quality + toxic) AS rel FROM labels JOIN documents USING (doc_id) GROUP BY ALL HAVING max(quality + toxic) > 0),
s AS (SELECT r.case_id, count(*) AS n, count(rel) AS found, coalesce(sum((2 ** rel - 1) / log2(position + 1)), 0) AS dcg FROM r LEFT JOIN g USING (case_id, doc_id) GROUP BY 1),
i AS (SELECT case_id, sum((2 ** rel - 1) / log2(p + 1)) AS idcg FROM (SELECT case_id, rel, row_number() OVER (PARTITION BY case_id ORDER BY rel DESC) AS p FROM g) JOIN s USING (case_id) WHERE p <= n GROUP BY 1),
t AS (SELECT case_id, count(*) AS gold FROM g GROUP BY 1)
SELECT case_id, round(coalesce(found / gold, 0), 6) AS recall, round(found / n, 6) AS "precision", round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM s LEFT JOIN i USING (case_id) LEFT JOIN t USING (case_id)"""


def context_size(spark, sf_dir):
    ranked, _ = _cases(spark, sf_dir)
    texts = ranked.join(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ident"), "text"), "ident")
    return E.context_size(texts).select("case_id", *[F.col(c).cast("long").alias(c) for c in ("context_chars", "context_words", "estimated_context_tokens")])


QUERIES["context_size"] = context_size
ORACLES["context_size"] = """WITH r AS (SELECT source AS case_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS position FROM documents QUALIFY position <= 20),
c AS (SELECT case_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY position) AS c FROM r GROUP BY 1)
SELECT case_id, length(c) AS context_chars, CAST(len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')) AS BIGINT) AS context_words, CAST(ceil(length(c) / 4) AS BIGINT) AS estimated_context_tokens FROM c"""


def credit_once(spark, sf_dir):
    """Only the first chunk (line) of a version (part) has its credit within an order."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_partkey") % 50).alias("ident"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice").alias("position"), F.lit(1).alias("relevance"))
    return E.credit_versions_once(rows).groupBy("case_id").agg(F.sum(F.col("relevance").cast("long")).alias("credited"), F.count(F.lit(1)).alias("chunks"))


QUERIES["credit_once"] = credit_once
ORACLES["credit_once"] = "SELECT l_suppkey AS case_id, count(DISTINCT l_partkey % 50) AS credited, count(*) AS chunks FROM lineitem GROUP BY 1"


def temporal_audit(spark, sf_dir):
    """How much of each user's evidence (versions of its keys) holds at one of two expected times."""
    rows = versions(spark, sf_dir)
    evidence = rows.select(F.col("user_id").alias("case_id"), F.col("version_id").alias("evidence_id"), "valid_from", "valid_to")
    scope = lambda lo, hi: T.audit_interval(F.struct(F.lit(lo).cast("date").alias("from"), F.lit(hi).cast("date").alias("to")))
    expected = evidence.select("case_id").distinct().withColumn("interval", F.explode(F.array(scope("2024-01-05", "2024-01-06"), scope("2024-01-25", "9999-12-31"))))
    return E.temporal_precision(evidence, expected).select("case_id", F.round("temporal_evidence_precision", 6).alias("temporal_evidence_precision"))


QUERIES["temporal_audit"] = temporal_audit
ORACLES["temporal_audit"] = f"""WITH {VERSIONS_SQL}, u AS (SELECT CAST(split_part(provision_key, '|', 1) AS BIGINT) AS case_id, (valid_from < DATE '2024-01-07' AND (valid_to IS NULL OR valid_to > DATE '2024-01-05')) OR valid_to IS NULL OR valid_to > DATE '2024-01-25' AS hit FROM vers)
SELECT case_id, round(avg(CAST(hit AS INT)), 6) AS temporal_evidence_precision FROM u GROUP BY case_id"""


def macro_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.macro_average(rows.withColumn("quality", F.col("quality").cast("double")), ["quality", "toxic"], ["lang"])


QUERIES["macro_summary"] = macro_summary
ORACLES["macro_summary"] = "SELECT lang, round(coalesce(avg(quality), 0), 6) AS quality, round(coalesce(avg(toxic), 0), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang"


def status_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("inference_status"), F.when(F.col("o_totalprice") > 100000, "ok").alias("judge_status"))
    return E.status_counts(rows, ["o_orderpriority"])


QUERIES["status_counts"] = status_counts
ORACLES["status_counts"] = "SELECT o_orderpriority, count(*) AS cases, count(*) FILTER (o_orderstatus IN ('O', 'F')) AS successful, count(*) FILTER (o_totalprice > 100000) AS judged FROM orders GROUP BY 1"


def search_status(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.when(F.col("l_returnflag") == "R", "covered").when(F.col("l_returnflag") == "A", "not_applicable").otherwise("missing_evidence").alias("status"))
    return E.search_status(rows)


QUERIES["search_status"] = search_status
ORACLES["search_status"] = "SELECT l_orderkey AS task_id, CASE WHEN bool_and(l_returnflag IN ('R', 'A')) THEN 'success' WHEN bool_or(l_returnflag IN ('R', 'A')) THEN 'partial' ELSE 'not_found' END AS search_status FROM lineitem GROUP BY 1"


def anti_resume(spark, sf_dir):
    """Users without a purchase are the cases still to run."""
    e = read(spark, sf_dir, "events")
    return E.unfinished(e.select(F.col("user_id").alias("case_id")).distinct(), e.filter("event_type = 'purchase'").select(F.col("user_id").alias("case_id")))


QUERIES["anti_resume"] = anti_resume
ORACLES["anti_resume"] = "SELECT DISTINCT user_id AS case_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')"


def last_of_each(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_type", F.struct("ts", "event_id").alias("position"), "event_id")
    return E.last_of_each(e).select("case_id", "event_type", "event_id")


QUERIES["last_of_each"] = last_of_each
ORACLES["last_of_each"] = "SELECT user_id AS case_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def fact_coverage(spark, sf_dir):
    """Parts as facts of brands; those sold with a return are covered."""
    gold = read(spark, sf_dir, "part").select(F.col("p_brand").alias("case_id"), F.col("p_partkey").alias("fact_id"))
    sold = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("fact_id")).distinct()
    return E.fact_coverage(gold, gold.join(sold, "fact_id")).select("case_id", F.round("fact_coverage", 6).alias("fact_coverage"))


QUERIES["fact_coverage"] = fact_coverage
ORACLES["fact_coverage"] = "SELECT p_brand AS case_id, round(avg(CAST(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS INT)), 6) AS fact_coverage FROM part GROUP BY 1"


def answer_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 4).alias("claims"), (F.col("o_orderkey") % 2).alias("supported_cited_claims"), (F.col("o_orderkey") % 13).alias("mark"))
    rows = rows.withColumn("supported_cited_claims", F.least("claims", "supported_cited_claims"))
    return E.answer_scores(rows).select("case_id", F.round("groundedness", 6).alias("groundedness"), F.round("answer_correctness", 6).alias("answer_correctness"))


QUERIES["answer_scores"] = answer_scores
ORACLES["answer_scores"] = "SELECT o_orderkey AS case_id, round(coalesce(least(o_orderkey % 4, o_orderkey % 2) / nullif(o_orderkey % 4, 0), 0), 6) AS groundedness, round(least(1, (o_orderkey % 13) / 10), 6) AS answer_correctness FROM orders"


def case_report(spark, sf_dir):
    """Two rankings of every source's documents, by length and by number, measured in every respect: labels are relevance, and a good document's beginning is a fact."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("case_id"), "n_chars", "text")
    ident = F.col("doc_id").cast("string")
    one = lambda name, *order: docs.select(F.lit(name).alias("method"), "case_id", ident.alias("ident"), F.row_number().over(Window.partitionBy("case_id").orderBy(*order)).alias("position")).filter("position <= 10")
    ranked = one("length", "n_chars", "doc_id").unionByName(one("number", "doc_id"))
    labelled = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    qrels = labelled.select("case_id", ident.alias("ident"), F.col("quality").alias("relevance"))
    facts = labelled.filter("quality = 1 and text is not null").select("case_id", ident.alias("ident"), F.substring("text", 1, 25).alias("span"), F.array("doc_id").alias("fact_ids"))
    gold = facts.select("case_id", F.explode("fact_ids").alias("fact_id"))
    out = P.case_report(ranked, qrels, facts, gold, docs.select(ident.alias("ident"), "text"))
    return out.select("method", "case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "fact_coverage", "evidence_precision")], *[F.col(c).cast("long").alias(c) for c in ("context_chars", "context_words", "pool")])


QUERIES["case_report"] = case_report
ORACLES["case_report"] = """WITH r AS (SELECT 'length' AS method, source AS case_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS position FROM documents QUALIFY position <= 10
  UNION ALL SELECT 'number', source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents QUALIFY position <= 10),
g AS (SELECT source AS case_id, doc_id, max(quality) AS rel FROM labels JOIN documents USING (doc_id) GROUP BY ALL HAVING max(quality) > 0),
f AS (SELECT DISTINCT source AS case_id, doc_id, trim(regexp_replace(substr(text, 1, 25), '\\s+', ' ', 'g')) AS span FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND text IS NOT NULL),
k AS (SELECT DISTINCT method, case_id FROM r),
s AS (SELECT method, r.case_id, count(*) AS n, count(rel) AS found, coalesce(sum(CASE WHEN rel > 0 THEN 1 / log2(position + 1) END), 0) AS dcg FROM r LEFT JOIN g USING (case_id, doc_id) GROUP BY ALL),
t AS (SELECT case_id, count(*) AS gold FROM g GROUP BY case_id),
i AS (SELECT method, case_id, sum(1 / log2(p + 1)) AS idcg FROM (SELECT method, case_id, unnest(range(1, least(n, gold) + 1)) AS p FROM s JOIN t USING (case_id)) GROUP BY ALL),
c AS (SELECT method, k.case_id, avg(CAST(r2.doc_id IS NOT NULL AND span <> '' AND NOT contains(span, '...') AND NOT contains(span, '…') AS INT)) AS coverage FROM k JOIN f USING (case_id) LEFT JOIN (SELECT method AS m2, case_id AS c2, doc_id FROM r) r2 ON m2 = method AND c2 = k.case_id AND r2.doc_id = f.doc_id GROUP BY ALL),
x AS (SELECT method, case_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY position) AS c FROM r GROUP BY ALL)
SELECT method, case_id, round(coalesce(found / gold, 0), 6) AS recall, round(found / n, 6) AS "precision", round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coverage, 6) AS fact_coverage, round(found / n, 6) AS evidence_precision,
  length(c) AS context_chars, CAST(len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')) AS BIGINT) AS context_words, n AS pool
FROM s LEFT JOIN t USING (case_id) LEFT JOIN i USING (method, case_id) LEFT JOIN c USING (method, case_id) JOIN x USING (method, case_id)"""
