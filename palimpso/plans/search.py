"""Queries about retrieval: rankings, fusion, expansion, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import settle, stored
from ..operators import documents as D, lexical, models, retrieval as R, vectors, verify
from .tables import POINTS_SQL, points, read

QUERIES, ORACLES = {}, {}

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
BM25_SQL = f"""
d AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM d) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
TOPK_SQL = f"""{BM25_SQL},
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc_id, term),
s AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), size GROUP BY query_id, doc_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"""


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_stats(spark, sf_dir):
    idf, size = R.bm25_statistics(_documents(spark, sf_dir))
    return idf.crossJoin(F.broadcast(size)).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


QUERIES["bm25_stats"] = bm25_stats
ORACLES["bm25_stats"] = f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM idf, size"


def bm25_topk(spark, sf_dir):
    """Every benchmark item as a query against all documents."""
    return R.bm25(_documents(spark, sf_dir), _items(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES["bm25_topk"] = bm25_topk
ORACLES["bm25_topk"] = f"WITH {TOPK_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical WHERE score > 0"


def bm25_pairs(spark, sf_dir):
    """What pruning saves: pairs of a query and a document that share a term, and whether a tenth of them at most had to be scored to the end (or, where the
    best 20 are more than that by themselves, three times as many as there are results)."""
    index = lexical.build(_documents(spark, sf_dir))
    found = lexical.search(index, lexical.query_weights(index, _items(spark, sf_dir)), report=True)
    return found.agg(F.sum("shared").alias("shared"), ((10 * F.sum("scored") <= F.sum("shared")) | (F.sum("scored") <= 3 * R.CANDIDATES * F.count(F.lit(1)))).alias("pruned"))


QUERIES["bm25_pairs"] = bm25_pairs
ORACLES["bm25_pairs"] = f"WITH {TOPK_SQL} SELECT count(*) AS shared, true AS pruned FROM s"


def _versioned(spark, sf_dir):
    """Documents with a validity each: some open, some without a day."""
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    end = F.when(F.col("doc_id") % 5 != 0, F.date_add(start, (F.col("n_chars") % 200).cast("int")))
    return read(spark, sf_dir, "documents").select("doc_id", "text", start.alias("valid_from"), end.alias("valid_to"))


def _scopes(spark, sf_dir):
    """A day or a range for each nation."""
    low = F.date_add(F.lit("2020-01-01").cast("date"), (16 * F.col("n_nationkey")).cast("int"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("scope_id"), low.alias("low"), F.date_add(low, (F.col("n_nationkey") % 3 * 20).cast("int")).alias("high"))


def _scoped_items(spark, sf_dir):
    return _items(spark, sf_dir).withColumn("scope_id", F.col("query_id") % 25)


SCOPED_SQL = f"""v AS (SELECT doc_id, {_TOKENS} AS t, DATE '2020-01-01' + CAST(doc_id % 365 AS INTEGER) AS valid_from, CASE WHEN doc_id % 5 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 365 + n_chars % 200 AS INTEGER) END AS valid_to FROM documents),
scope AS (SELECT n_nationkey AS scope_id, DATE '2020-01-01' + CAST(16 * n_nationkey AS INTEGER) AS low, DATE '2020-01-01' + CAST(16 * n_nationkey + n_nationkey % 3 * 20 AS INTEGER) AS high FROM nation),
held AS MATERIALIZED (SELECT scope_id, doc_id, t FROM v JOIN scope ON valid_from <= high AND (valid_to IS NULL OR (valid_to > low AND valid_to > valid_from))),
ssize AS (SELECT scope_id, count(*) AS n, avg(len(t)) AS avgdl FROM held GROUP BY scope_id),
sdf AS MATERIALIZED (SELECT scope_id, term, count(*) AS df FROM (SELECT scope_id, unnest(list_distinct(t)) AS term FROM held) GROUP BY ALL),
sraw AS MATERIALIZED (SELECT scope_id, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM sdf JOIN ssize USING (scope_id)),
smean AS (SELECT scope_id, avg(raw) AS mean_idf FROM sraw GROUP BY scope_id),
asked AS MATERIALIZED (SELECT item_id AS query_id, item_id % 25 AS scope_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sidf AS (SELECT scope_id, term, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM sraw JOIN smean USING (scope_id) SEMI JOIN asked USING (scope_id, term))"""


def bm25_scoped_stats(spark, sf_dir):
    """Every scope's own statistics for the terms asked in it, all scopes from one pass over the texts."""
    index = lexical.build(_versioned(spark, sf_dir))
    asked = lexical.asked_terms(_scoped_items(spark, sf_dir)).select("scope_id", "term")
    idf, size = lexical.scoped_statistics(index, _scopes(spark, sf_dir), asked)
    return idf.join(size, "scope_id").select("scope_id", "term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


QUERIES["bm25_scoped_stats"] = bm25_scoped_stats
ORACLES["bm25_scoped_stats"] = f"WITH {SCOPED_SQL} SELECT scope_id, term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM sidf JOIN ssize USING (scope_id) JOIN smean USING (scope_id)"


def bm25_scoped_topk(spark, sf_dir):
    """Every benchmark item, asked in one scope, against the documents in force there, weighed by that scope's statistics."""
    index = lexical.build(_versioned(spark, sf_dir))
    found = lexical.search(index, lexical.scoped_weights(index, _scoped_items(spark, sf_dir), _scopes(spark, sf_dir)))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES["bm25_scoped_topk"] = bm25_scoped_topk
ORACLES["bm25_scoped_topk"] = f"""WITH {SCOPED_SQL},
stf AS (SELECT scope_id, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT scope_id, doc_id, len(t) AS dl, unnest(t) AS term FROM held) GROUP BY ALL),
sscore AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM stf JOIN asked USING (scope_id, term) JOIN sidf USING (scope_id, term) JOIN ssize USING (scope_id) GROUP BY query_id, doc_id),
sbest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sscore QUALIFY rank <= 20)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sbest WHERE score > 0"""


def _vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows, rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def dense_topk(spark, sf_dir):
    """The stated query set (every twentieth vector) against all vectors."""
    return R.dense(*_vectors(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


DENSE_SQL = """s AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)"""
QUERIES["dense_topk"] = dense_topk
ORACLES["dense_topk"] = f"WITH {DENSE_SQL} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM dense"


def ivf_exact(spark, sf_dir):
    """Inverted lists, searched exactly: the same rows as without them, here among the vectors of even labels alone."""
    rows, queries = _vectors(spark, sf_dir)
    allowed = read(spark, sf_dir, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    return vectors.Lists(rows).search(queries, exact=True, allowed=allowed).select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


QUERIES["ivf_exact"] = ivf_exact
ORACLES["ivf_exact"] = """WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND p.label % 2 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)
SELECT query_id, doc_id, round(score, 5) AS score, rank FROM dense"""


def ivf_recall(spark, sf_dir):
    """How many of the best 20 the probed lists hold, measured against all vectors, and whether fewer vectors were met than there are."""
    rows, queries = _vectors(spark, sf_dir)
    index = vectors.Lists(rows)
    found, known = index.search(queries).select("query_id", "doc_id"), R.dense(rows, queries).select("query_id", "doc_id")
    hits = known.join(found, ["query_id", "doc_id"], "left_semi").count()
    probed = index.probes(queries).agg(F.count(F.lit(1)).alias("queries"), F.sum("probed").alias("probed"))
    wanted = known.agg(F.count(F.lit(1)).alias("wanted"), (F.lit(10 * hits) >= 9 * F.count(F.lit(1))).alias("recalled"))
    return probed.join(wanted, F.lit(True)).select("queries", "wanted", "recalled", (F.col("probed") < F.col("queries") * F.lit(int(index.sizes.sum()))).alias("fewer"))  # one row each


QUERIES["ivf_recall"] = ivf_recall
ORACLES["ivf_recall"] = "SELECT count(*) AS queries, count(*) * least(20, (SELECT count(*) FROM embeddings)) AS wanted, true AS recalled, true AS fewer FROM embeddings WHERE vec_id % 20 = 0"


def rrf_fusion(spark, sf_dir):
    """Two rankings of every supplier's line items, by price and by quantity, fused."""
    rows = points(spark, sf_dir).withColumnRenamed("point_id", "doc_id")
    a = R._top(rows, R.CANDIDATES, F.desc("price"), F.col("doc_id"))
    b = R._top(rows, R.CANDIDATES, F.desc("rerank_score"), F.col("doc_id"))
    return R.rrf(a, b).select("query_id", F.col("doc_id").alias("point_id"), F.round("rrf", 9).alias("rrf"), F.col("rank").cast("long").alias("rank"))


QUERIES["rrf_fusion"] = rrf_fusion
ORACLES["rrf_fusion"] = f"""WITH {POINTS_SQL}, a AS (SELECT query_id, point_id, rank AS ra FROM ranked WHERE rank <= 20),
b AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, point_id) AS rb FROM pts QUALIFY rb <= 20),
f AS (SELECT query_id, point_id, ra, rb, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS rrf FROM a FULL JOIN b USING (query_id, point_id))
SELECT query_id, point_id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM f"""


def _ranked(spark, sf_dir, several: bool = False):
    """Every point in its query's ranking; worked out once for queries that read it several times."""
    rows = R.with_keys(points(spark, sf_dir, by_query=True)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("price"), "point_id")))
    return settle(rows) if several else rows


def seed_per_location(spark, sf_dir):
    return R.seeds(_ranked(spark, sf_dir)).select("query_id", "point_id", "document_id", "location_label", F.col("seed_no").cast("long").alias("seed_no"))


SEEDS_SQL = f"""{POINTS_SQL}, firsts AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, document_id, location_label ORDER BY rank) = 1),
seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seed_no FROM firsts QUALIFY seed_no <= 5)"""
QUERIES["seed_per_location"] = seed_per_location
ORACLES["seed_per_location"] = f"WITH {SEEDS_SQL} SELECT query_id, point_id, document_id, location_label, seed_no FROM seeds"


def article_expansion(spark, sf_dir):
    ranked = _ranked(spark, sf_dir, several=True)
    return R.expand_articles(R.seeds(ranked), ranked).select("query_id", "point_id", "expanded_from")


QUERIES["article_expansion"] = article_expansion
ORACLES["article_expansion"] = f"""WITH {SEEDS_SQL}, k AS (SELECT query_id, document_id, article_no, arg_min(point_id, seed_no) AS expanded_from FROM seeds WHERE seed_no <= 3 GROUP BY ALL)
SELECT query_id, point_id, expanded_from FROM pts JOIN k USING (query_id, document_id, article_no)"""


def top_locations(spark, sf_dir):
    return R.top_locations(_ranked(spark, sf_dir, several=True)).select("query_id", "document_id", "location_label", F.col("slot").cast("long").alias("slot"), "location_score")


LOCATIONS_SQL = f"""{POINTS_SQL}, loc AS (SELECT query_id, document_id, location_label, any_value(article_level) AS article_level, min(rank) AS first_rank FROM ranked GROUP BY query_id, document_id, location_label),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY article_level, first_rank) AS slot FROM loc QUALIFY slot <= 5),
full_at AS (SELECT query_id, count(*) FILTER (NOT article_level) AS n, max(first_rank) FILTER (NOT article_level) AS last FROM chosen GROUP BY query_id),
scored AS (SELECT query_id, document_id, location_label, slot, max(rerank_score) AS location_score FROM ranked JOIN chosen c USING (query_id, document_id, location_label) JOIN full_at USING (query_id)
  WHERE CASE WHEN c.article_level THEN rank = first_rank ELSE n < 5 OR rank <= last END GROUP BY ALL)"""
QUERIES["top_locations"] = top_locations
ORACLES["top_locations"] = f"WITH {LOCATIONS_SQL} SELECT query_id, document_id, location_label, slot, location_score FROM scored"


def location_completion(spark, sf_dir):
    ranked = _ranked(spark, sf_dir, several=True)
    chosen = R.top_locations(ranked)
    own = R.complete_locations(chosen, ranked).select("query_id", "point_id", F.lit("location").alias("why"))
    return own.unionByName(R.article_context(chosen, ranked).select("query_id", "point_id", F.lit("article").alias("why")))


QUERIES["location_completion"] = location_completion
ORACLES["location_completion"] = f"""WITH {LOCATIONS_SQL}, art AS (SELECT DISTINCT query_id, document_id, article_no FROM scored JOIN pts USING (query_id, document_id, location_label))
SELECT query_id, point_id, 'location' AS why FROM pts JOIN scored USING (query_id, document_id, location_label)
UNION ALL SELECT query_id, point_id, 'article' AS why FROM pts JOIN art USING (query_id, document_id, article_no) WHERE clause_no IS NULL"""


def _probes(spark, sf_dir):
    q = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"))
    return q.select("query_id", F.lit("r f k1").alias("probe")).unionByName(q.select("query_id", F.lit("a k2").alias("probe")))


def coverage_max(spark, sf_dir):
    """Best share of words over the question and a fact, for every point."""
    rows = points(spark, sf_dir)
    return R.coverage_rerank(rows, _probes(spark, sf_dir)).select("query_id", "point_id", F.round("rerank_score", 6).alias("rerank_score"))


_OVERLAP = "greatest(len(list_intersect(['r', 'f', 'k1'], string_split(content, ' '))) / 3, len(list_intersect(['a', 'k2'], string_split(content, ' '))) / 2)"
QUERIES["coverage_max"] = coverage_max
ORACLES["coverage_max"] = f"WITH {POINTS_SQL} SELECT query_id, point_id, round({_OVERLAP}, 6) AS rerank_score FROM pts"


def sibling_caps(spark, sf_dir):
    found = R.ranked_siblings(_ranked(spark, sf_dir), _probes(spark, sf_dir))
    return found.select("query_id", "document_id", "location_label", F.col("sibling_no").cast("long").alias("sibling_no"), F.round("location_score", 6).alias("location_score"))


QUERIES["sibling_caps"] = sibling_caps
ORACLES["sibling_caps"] = f"""WITH {LOCATIONS_SQL},
src AS (SELECT DISTINCT query_id, document_id, article_no, clause_no, slot FROM scored JOIN pts USING (query_id, document_id, location_label) WHERE slot <= 2 AND clause_no IS NOT NULL),
art AS (SELECT query_id, document_id, article_no, min(slot) AS article_slot, list(DISTINCT clause_no) AS clauses FROM src GROUP BY ALL),
cand AS (SELECT query_id, document_id, article_no, location_label, clause_no, article_slot, clauses, max({_OVERLAP}) AS s FROM pts JOIN art USING (query_id, document_id, article_no) ANTI JOIN scored USING (query_id, document_id, location_label) WHERE clause_no IS NOT NULL GROUP BY ALL),
per AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, article_no ORDER BY s DESC, len(list_filter(clauses, lambda c: abs(c - clause_no) = 1)) = 0, clause_no, location_label) AS article_rank FROM cand QUALIFY article_rank <= 2)
SELECT query_id, document_id, location_label, row_number() OVER (PARTITION BY query_id ORDER BY article_slot, article_rank) AS sibling_no, round(s, 6) AS location_score FROM per QUALIFY sibling_no <= 4"""


def _provisions(spark, sf_dir):
    part = F.when(F.col("price") > 20000, (F.col("price") % 5).cast("int"))
    version = F.concat_ws("|", "document_id", "location_label")
    return _ranked(spark, sf_dir).select("query_id", version.alias("version_id"), "point_id", part.alias("sub_chunk_index"), F.col("price").alias("score"), "rerank_score", F.array(F.split("content", " ")[0]).alias("sources"), F.col("rank").cast("long").alias("input_pos"), "content")


def collapse_provisions(spark, sf_dir):
    out = R.collapse_provisions(_provisions(spark, sf_dir))
    return out.select("query_id", "version_id", "point_id", "score", "rerank_score", F.array_join("sources", ",").alias("sources"), F.array_join("part_ids", ",").alias("part_ids"), "input_pos")


QUERIES["collapse_provisions"] = collapse_provisions
ORACLES["collapse_provisions"] = f"""WITH {POINTS_SQL}, p AS (SELECT query_id, document_id || '|' || location_label AS version_id, point_id, CASE WHEN price > 20000 THEN CAST(floor(price % 5) AS INT) END AS part, price, rerank_score, string_split(content, ' ')[1] AS source, rank FROM ranked),
src AS (SELECT query_id, version_id, string_agg(source, ',' ORDER BY first) AS sources FROM (SELECT query_id, version_id, source, min(rank) AS first FROM p GROUP BY ALL) GROUP BY ALL)
SELECT query_id, version_id, (list(point_id ORDER BY coalesce(part, -1), point_id))[1] AS point_id, max(price) AS score, max(rerank_score) AS rerank_score, any_value(sources) AS sources, string_agg(point_id, ',' ORDER BY point_id) AS part_ids, min(rank) AS input_pos
FROM p JOIN src USING (query_id, version_id) GROUP BY query_id, version_id"""


def merge_candidates(spark, sf_dir):
    """Two branches' candidates, merged by id; of a point's rows the first counts and the best score."""
    rows = _provisions(spark, sf_dir).filter("input_pos <= 40")
    again = rows.filter("input_pos % 2 = 0").withColumns({"score": F.col("score") + 1, "sources": F.array(F.lit("again")), "input_pos": F.col("input_pos") + 100})
    out = R.merge_candidates(rows.unionByName(again))
    return out.select("query_id", "point_id", "score", F.array_join("sources", ",").alias("sources"), "input_pos")


QUERIES["merge_candidates"] = merge_candidates
ORACLES["merge_candidates"] = f"WITH {POINTS_SQL} SELECT query_id, point_id, price + (rank % 2 = 0)::INT AS score, string_split(content, ' ')[1] || CASE WHEN rank % 2 = 0 THEN ',again' ELSE '' END AS sources, rank AS input_pos FROM ranked WHERE rank <= 40"


def sentences(queries):
    """The sentences of every query's whole text as its facts."""
    return queries.select("query_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("fact")).filter("fact <> ''")


def structured_retrieval(spark, sf_dir):
    """The whole retrieval over pieces of the corpus: every benchmark passage is a query and each of its sentences a fact, with the default embedder for both sides."""
    vec = models.embedder(spark)
    docs = _documents(spark, sf_dir).filter("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("Điều "), (F.col("doc_id") % 5 + 1).cast("string")).alias("location_label"), F.col("text").alias("provision_content"), F.lit(None).cast("date").alias("valid_from"))
    pieces = D.points(docs.withColumn("version_id", F.concat_ws("|", "document_id", F.lit("V1"))))
    whole = F.when(F.coalesce("sub_chunk_index", F.lit(0)) == 0, F.col("provision_content"))  # once for all of a document's pieces
    rows = pieces.select(F.xxhash64("point_id").alias("point_id"), "version_id", "document_id", "location_label", "sub_chunk_index", F.col("original_content").alias("content"), whole.alias("provision_content"))
    rows = models.embedded(rows, "content")
    rows = stored(rows, "pieces")
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", vec(F.col("text")).alias("embedding"))
    return R.structured_retrieve(rows, queries, sentences(queries)).select("query_id", "version_id", "location_label", F.col("position").cast("long").alias("position"))


QUERIES["structured_retrieval"] = structured_retrieval


def retrieval_invariants(spark, sf_dir):
    """What holds of the whole retrieval's context for every query: there is one, its positions are 1 to n, and no version comes twice."""
    rows = settle(structured_retrieval(spark, sf_dir))
    of = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("places"), F.max("position").alias("last"), F.countDistinct("version_id").alias("versions"), F.countDistinct("location_label").alias("locations"))
    return of.select("query_id", ((F.col("places") == F.col("n")) & (F.col("last") == F.col("n"))).alias("gapless"), (F.col("versions") == F.col("n")).alias("once"), (F.col("locations") >= 1).alias("located"))


QUERIES["retrieval_invariants"] = retrieval_invariants
ORACLES["retrieval_invariants"] = "SELECT item_id AS query_id, true AS gapless, true AS once, true AS located FROM benchmark"


def evidence_dedupe(spark, sf_dir):
    """Events as evidence: one row a chunk (user) and scope (event type)."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("chunk_id"), F.col("event_type").alias("scope_key"), F.lit("t").alias("title"), F.lit("l").alias("location_label"), F.col("props").alias("text"), F.col("event_id").alias("position"))
    return verify.dedupe_evidence(e).select("event_id", "chunk_id", "scope_key")


QUERIES["evidence_dedupe"] = evidence_dedupe
ORACLES["evidence_dedupe"] = "SELECT min(event_id) AS event_id, CAST(user_id AS VARCHAR) AS chunk_id, event_type AS scope_key FROM events GROUP BY user_id, event_type"


def number_facts(spark, sf_dir):
    """Events as fact requirements of a user's task, six at most after repeats are dropped."""
    f = read(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("task_id"), F.col("event_type").alias("fact_type"), F.concat(F.lit("  Value "), F.floor("value").cast("string")).alias("description"), F.col("event_id").alias("position"))
    return verify.number_facts(f).select("task_id", "fact_id", "position")


QUERIES["number_facts"] = number_facts
ORACLES["number_facts"] = """WITH f AS (SELECT 'T' || user_id AS task_id, min(event_id) AS position FROM events GROUP BY user_id, event_type, CAST(floor(value) AS BIGINT)),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY position) AS n FROM f) SELECT task_id, task_id || '_F' || n AS fact_id, position FROM n WHERE n <= 6"""
