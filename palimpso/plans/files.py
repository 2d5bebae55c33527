"""Queries that write and read files below the shared folder: what comes back is compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import settle, shared_dir
from ..operators import documents as D, models
from ..sources import artifacts as A, corpus
from .tables import read

QUERIES, ORACLES = {}, {}


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir):
    """Events with nested columns, written as CSV with those as JSON."""
    path = _folder(spark, "csv")
    A.write_csv(read(spark, sf_dir, "events").select("event_id", "event_type", F.struct("user_id", "props").alias("who"), F.array("event_type").alias("all")), path)
    return spark.read.schema("event_id long, event_type string, who string, all string").csv(path, header=True, escape='"', quote='"').select("event_id", "event_type", F.get_json_object("who", "$.props").alias("props"), F.get_json_object("all", "$[0]").alias("first"))


QUERIES["csv_roundtrip"] = csv_roundtrip
ORACLES["csv_roundtrip"] = "SELECT event_id, event_type, props, event_type AS first FROM events"


def csv_union(spark, sf_dir):
    """Results of two kinds in one file: the columns of either, empty where a row has none."""
    path, e = _folder(spark, "csv-union"), read(spark, sf_dir, "events")
    A.write_csv([e.filter("event_id % 2 = 0").select("event_id", "event_type"), e.filter("event_id % 2 = 1").select("user_id", "event_id", "props")], path)
    return spark.read.schema("event_id long, event_type string, user_id long, props string").csv(path, header=True, escape='"', quote='"', enforceSchema=False)


QUERIES["csv_union"] = csv_union
ORACLES["csv_union"] = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type, CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id, CASE WHEN event_id % 2 = 1 THEN props END AS props FROM events"


def jsonl_roundtrip(spark, sf_dir):
    """Documents as JSON lines; nulls are written."""
    path = _folder(spark, "jsonl")
    A.write_jsonl(read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")), path)
    return A.jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "lang")


QUERIES["jsonl_roundtrip"] = jsonl_roundtrip
ORACLES["jsonl_roundtrip"] = "SELECT doc_id, sha256(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents"


def results_roundtrip(spark, sf_dir):
    """Results of each case and their summary, side by side."""
    path = _folder(spark, "results")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("score"))
    A.write_results(rows, rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("score")), path)
    back = spark.read.schema("case_id long, score double").csv(f"{path}/results", header=True).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 2).alias("total"))
    return back.join(A.jsonl(spark, f"{path}/summary", "n long, score double"), F.lit(True))


QUERIES["results_roundtrip"] = results_roundtrip
ORACLES["results_roundtrip"] = 'SELECT count(*) AS "rows", round(sum(o_totalprice), 2) AS total, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM orders'


def checked_snapshot(spark, sf_dir):
    """A file is used only if its digest is the one expected."""
    import hashlib

    path = _folder(spark, "snapshot")
    names = [r["n_name"] for r in read(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.text(path)
    digest = hashlib.sha256("".join(n + "\n" for n in names).encode()).hexdigest()
    return A.checked_snapshot(spark, path, digest).select(F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("n_bytes"))


QUERIES["checked_snapshot"] = checked_snapshot
ORACLES["checked_snapshot"] = "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS n_bytes FROM nation"


def manifest_lookup(spark, sf_dir):
    """Documents with their entry in a manifest: a bare list is short for the locations, and what isn't listed is embedded whole."""
    path = _folder(spark, "manifest")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    entry = F.when(F.col("k").cast("int") % 3 == 0, F.concat(F.lit('"'), "k", F.lit('": ["Điều '), "k", F.lit('"]'))).when(F.col("k").cast("int") % 3 == 1, F.concat(F.lit('"'), "k", F.lit('": {"embed_in_qdrant": false}')))
    one = nation.select(entry.alias("e"), "k").filter("e is not null").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("e")), ", "), F.lit("}")).alias("value"))
    one.coalesce(1).write.text(path)
    listed = A.manifest(spark, path)
    return nation.join(listed, nation["k"] == listed["document_id"], "left").select(F.col("k").alias("document_id"), F.array_join(F.coalesce("include_locations", F.array().cast("array<string>")), ",").alias("locations"), F.coalesce("embed", F.lit(True)).alias("embed"))


QUERIES["manifest_lookup"] = manifest_lookup
ORACLES["manifest_lookup"] = "SELECT CAST(n_nationkey AS VARCHAR) AS document_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Điều ' || n_nationkey ELSE '' END AS locations, n_nationkey % 3 <> 1 AS embed FROM nation"


def dictionary_file(spark, sf_dir):
    """Entries of a dictionary file; a file that isn't there has none."""
    path = _folder(spark, "dictionary")
    entry = F.to_json(F.struct(F.col("p_name").alias("legal_term"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("definition")))
    # a dictionary is one small file by nature: here, the distinct names of parts
    one = read(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.max("p_brand").alias("p_brand"), F.max("p_type").alias("p_type"))
    one.agg(F.concat(F.lit('{"entries": ['), F.array_join(F.collect_list(entry), ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    found = A.dictionary(spark, path).unionByName(A.dictionary(spark, f"{path}-missing"))
    return found.groupBy("legal_term").agg(F.count(F.lit(1)).alias("n"), F.max(F.get("aliases", F.lit(0))).alias("alias"))


QUERIES["dictionary_file"] = dictionary_file
ORACLES["dictionary_file"] = "SELECT p_name AS legal_term, CAST(1 AS BIGINT) AS n, max(p_brand) AS alias FROM part GROUP BY p_name"


def step_outputs(spark, sf_dir):
    """Full and clean text and metadata of every document, written and joined again."""
    path = _folder(spark, "outputs")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("# "), F.coalesce("text", F.lit(""))).alias("full_markdown"), F.col("text").alias("markdown"), "lang", F.col("lang").alias("source_file"), F.col("source").alias("document_summary"))
    A.write_outputs(docs, path)
    A.write_summaries(docs, f"{path}/summaries")
    full, clean = (spark.read.parquet(f"{path}/{n}") for n in ("full", "clean"))
    meta = A.jsonl(spark, f"{path}/metadata", "document_id string, lang string")
    n = A.jsonl(spark, f"{path}/summaries", "source_file string, document_summary string").agg(F.count(F.lit(1)).alias("summaries"))
    return full.join(clean, "document_id").join(meta, "document_id").join(F.broadcast(n), F.lit(True)).select("document_id", F.length("full_markdown").cast("long").alias("full"), F.length("markdown").cast("long").alias("clean"), "lang", "summaries")


QUERIES["step_outputs"] = step_outputs
ORACLES["step_outputs"] = 'SELECT CAST(doc_id AS VARCHAR) AS document_id, length(coalesce(text, \'\')) + 2 AS "full", length(text) AS clean, lang, (SELECT count(*) FROM documents) AS summaries FROM documents'


def review_cache(spark, sf_dir):
    """Documents still to review: an empty list is a review, a missing one is none, and a cache that isn't there has none."""
    path = _folder(spark, "reviews")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), "o_orderkey")
    missing = A.load_reviews(spark, path)
    before = A.reviewed(o, missing).count()
    A.save_reviews(o.filter("o_orderkey % 3 = 0").select("document_id", F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"))).alias("operations")), path)
    return A.reviewed(o, A.load_reviews(spark, path)).select("document_id", F.lit(before).cast("long").alias("before"))


QUERIES["review_cache"] = review_cache
ORACLES["review_cache"] = "SELECT CAST(o_orderkey AS VARCHAR) AS document_id, (SELECT count(*) FROM orders) AS before FROM orders WHERE o_orderkey % 3 <> 0"


def embedding_cache(spark, sf_dir):
    """Vectors of a hosted embedder, worked out once for a set of documents and then read: their squared length, which is 1 for a text with a word."""
    path, docs = _folder(spark, "vectors"), read(spark, sf_dir, "documents").select("doc_id", "text")
    embed = models.embedder(spark)
    first = A.cached_embeddings(docs, embed, "hashed", path)[1]
    again, hit = A.cached_embeddings(docs, embed, "hashed", path)
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return again.select("doc_id", F.round(length, 6).alias("value"), F.lit(not first and hit).alias("cached"))


QUERIES["embedding_cache"] = embedding_cache
ORACLES["embedding_cache"] = "SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 1.0::DOUBLE WHEN text IS NOT NULL THEN 0.0::DOUBLE END AS value, true AS cached FROM documents"


def collection_scroll(spark, sf_dir):
    """A collection that is made once, filled by an upsert, and read whole and by document."""
    path, schema = _folder(spark, "collection"), "document_id string, point long"
    made = [A.create_collection(spark, f"{path}/0", schema) for _ in range(2)]
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).cast("string").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"))
    A.write_snapshot(A.collection(spark, f"{path}/0", schema).unionByName(rows), f"{path}/1")
    whole, part = A.collection(spark, f"{path}/1", schema), A.collection(spark, f"{path}/1", schema, "3")
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"), F.sum("point").alias("points"))
    return count(whole, "whole").unionByName(count(part, "part")).withColumn("made_once", F.lit(made == [True, False]))


QUERIES["collection_scroll"] = collection_scroll
ORACLES["collection_scroll"] = """SELECT 'whole' AS what, count(*) AS n, CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS points, true AS made_once FROM lineitem
UNION ALL SELECT 'part', count(*), CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT), true FROM lineitem WHERE l_orderkey % 10 = 3"""


def corpus_update(spark, sf_dir):
    """A corpus brought up to date three times: most documents, then all of them with some changed and some gone, then nothing new; runs and what the last one leaves."""
    path = _folder(spark, "corpus")
    docs = read(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("markdown"))
    number = F.col("document_id").cast("long")
    later = docs.filter(number % 11 != 0).withColumn("markdown", F.when(number % 7 == 0, F.concat("markdown", F.lit("\nnew"))).otherwise(F.col("markdown")))
    steps = [("lines", lambda rows: D.lines(rows, "markdown")), ("sizes", lambda rows: rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line").cast("long")).alias("letters")))]
    runs = [corpus.update(rows, path, steps) for rows in (docs.filter(number % 5 != 0), later, later)]
    counts = spark.createDataFrame([(k, r["done"], r["removed"]) for k, r in enumerate(runs)], "run long, done long, removed long")  # three rows
    left = corpus.table(spark, path, "sizes").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("lines"), F.sum("letters").alias("letters"))
    return counts.join(F.broadcast(left), F.lit(True))  # one row


QUERIES["corpus_update"] = corpus_update
ORACLES["corpus_update"] = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'new' ELSE text END AS t FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0),
s AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS lines, CAST(sum(length(x)) AS BIGINT) AS letters FROM (SELECT doc_id, unnest(string_split_regex(t, '\\r\\n|\\r|\\n')) AS x FROM d)),
r AS (SELECT 0 AS run, count(*) FILTER (doc_id % 5 <> 0) AS done, 0 AS removed FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, count(*) FILTER (doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0)), count(*) FILTER (doc_id % 11 = 0 AND doc_id % 5 <> 0) FROM documents WHERE text IS NOT NULL UNION ALL SELECT 2, 0, 0)
SELECT CAST(run AS BIGINT) AS run, CAST(done AS BIGINT) AS done, CAST(removed AS BIGINT) AS removed, documents, lines, letters FROM r, s"""


def partial_rewrite(spark, sf_dir):
    """A collection of orders in 16 buckets into which a few orders are written anew and from which one is taken: rows of each bucket, and whether its files are others."""
    path, schema = f"{_folder(spark, 'buckets')}/0", "document_id string, point_id long, status string"
    rows = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).cast("string").alias("document_id"), F.col("o_orderkey").alias("point_id"), F.col("o_orderstatus").alias("status"))
    A.write_buckets(rows, path, 16)
    before = settle(A.files_of(spark, path))
    A.upsert_buckets(rows.filter("document_id in ('3', '17')").withColumn("status", F.lit("new")), path, schema, buckets=16, removed=rows.filter("document_id = '29'"))
    changed = A.files_of(spark, path).join(before, ["bucket", "file", "written"], "left_anti").select("bucket").distinct().withColumn("rewritten", F.lit(True))
    whole = spark.read.schema(f"{schema}, bucket int").parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "new").alias("n_new"))
    return whole.join(changed, "bucket", "left").select(F.col("bucket").cast("long").alias("bucket"), "n", "n_new", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


QUERIES["partial_rewrite"] = partial_rewrite
ORACLES["partial_rewrite"] = """WITH r AS (SELECT CAST(o_orderkey % 40 AS VARCHAR) AS d FROM orders), b AS (SELECT d, CAST(('0x' || substr(md5(d), 1, 7))::BIGINT % 16 AS BIGINT) AS bucket FROM r)
SELECT bucket, count(*) FILTER (d <> '29') AS n, count(*) FILTER (d IN ('3', '17')) AS n_new, bool_or(d IN ('3', '17', '29')) AS rewritten FROM b GROUP BY bucket HAVING count(*) FILTER (d <> '29') > 0"""


def batch_inventory(spark, sf_dir):
    """Files in the order in which they are worked off: by date of issue, then by name without case."""
    rows = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 7).cast("int"))).alias("issued_date"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("a"), F.col("c_custkey").cast("string")).alias("source_file"))
    return A.inventory(rows).select("source_file", F.col("batch_order").cast("long").alias("batch_order"))


QUERIES["batch_inventory"] = batch_inventory
ORACLES["batch_inventory"] = """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'a' END || c_custkey AS source_file, row_number() OVER (ORDER BY CASE WHEN c_custkey % 5 > 0 THEN DATE '2020-01-01' + CAST(c_custkey % 7 AS INT) END NULLS LAST, 'a' || c_custkey) AS batch_order FROM customer"""
