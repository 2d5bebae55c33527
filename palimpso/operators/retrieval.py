"""Hybrid retrieval over provisions, for many queries at once.

Every table carries ``query_id``; a query's temporal scope has selected its ``points`` before (see
``versions``).  Rankings are windows over a query's few candidates, never over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locations
from ..functions.lineage import settle
from . import lexical
from .ranking import CANDIDATES, tokens
from .ranking import top_rows as _top
from .vectors import dense

RRF_K = 60
SEEDS = 5
EXPANSION_SEEDS = 3
FINAL = 5
SIBLING_SOURCES, SIBLINGS_PER_ARTICLE, SIBLINGS = 2, 2, 4
#: candidates that are broadcast, at most; more are joined by a shuffle
BROADCAST_HITS = 200_000


# ---- lexical ---------------------------------------------------------------------------------


def bm25_statistics(docs: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> tuple[DataFrame, DataFrame]:
    """Document frequency of every term with its idf, and one row with ``n`` and ``avgdl``."""
    return lexical.statistics(lexical.build(docs, tokenize))


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """Top ``k`` documents a query: ``query_id``, ``doc_id``, ``score``, ``rank``; ties by id; scores of 0 or less go after the cut.

    Each occurrence of a term in the query counts.  The texts are read once, into an index (see ``lexical``), which gives the statistics as well.
    """
    index = lexical.build(docs, tokenize)
    return lexical.search(index, lexical.query_weights(index, queries, tokenize), k)


# ---- fusion and reranking --------------------------------------------------------------------


def rrf(dense_ranked: DataFrame, lexical_ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank); equal sums in the order of the dense list, then of the lexical one."""
    part = lambda rows, name: rows.select("query_id", "doc_id", F.col("rank").alias(name))
    both = part(dense_ranked, "dense_rank").join(part(lexical_ranked, "lexical_rank"), ["query_id", "doc_id"], "full_outer")
    one = lambda name: F.coalesce(F.lit(1.0) / (k + F.col(name)), F.lit(0.0))
    fused = both.withColumn("rrf", one("dense_rank") + one("lexical_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"))
    return fused.withColumn("rank", F.row_number().over(w))


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair score: the share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


#: Fixed lines of what a reranker reads, and the columns they are filled from.
RERANK_LINES = (
    ("Văn bản", "document_id"), ("Loại văn bản", "document_type"), ("Cấp hiệu lực", "legal_rank"), ("Vị trí", "location_label"), ("Tình trạng", "status"), ("Phiên bản", "version"),
    ("Có hiệu lực từ", "valid_from"), ("Có hiệu lực đến", "valid_to"), ("Nội dung gốc", "content"), ("Được sửa bởi văn bản", "amended_by_document_id"),
    ("Vị trí sửa đổi", "amended_by_source_location"), ("Loại thay đổi", "change_type"),
)


def rerank_text(row: dict[str, Column]) -> Column:
    """What a reranker reads: twelve labelled lines, empty where ``row`` has no such column or it is null."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(row[c].cast("string"), F.lit("")) if c in row else F.lit("")) for name, c in RERANK_LINES])


def coverage_rerank(candidates: DataFrame, probes: DataFrame, text: str = "content", score=overlap_score) -> DataFrame:
    """``rerank_score``: the best score over the question and each fact; ``probes`` has ``query_id`` and ``probe``."""
    scored = candidates.join(probes, "query_id").withColumn("_s", score(F.col("probe"), F.col(text)))
    best = scored.groupBy("query_id", "point_id").agg(F.max("_s").alias("rerank_score"))
    return candidates.drop("rerank_score").join(best, ["query_id", "point_id"])


def with_keys(points: DataFrame) -> DataFrame:
    """Adds ``article_no``, ``clause_no`` and ``article_level``; null numbers take no part in expansions."""
    loc = F.col("location_label")
    return points.withColumns({"article_no": locations.article_number(loc), "clause_no": locations.clause_number(loc), "article_level": locations.is_article_level(loc)})


# ---- structure-aware steps -------------------------------------------------------------------

ARTICLE = ["document_id", "article_no"]
LOCATION = ["document_id", "location_label"]


def seeds(ranked: DataFrame, limit: int = SEEDS) -> DataFrame:
    """The best row of each location (rows without one all count), the first ``limit`` of them."""
    w = Window.partitionBy("query_id", *LOCATION).orderBy("rank")
    first = ranked.withColumn("_nth", F.when(F.col("location_label").isNotNull(), F.row_number().over(w)).otherwise(1)).filter("_nth = 1").drop("_nth")
    return _top(first, limit, F.col("rank"), rank="seed_no")


def expand_articles(seed_rows: DataFrame, points: DataFrame, limit: int = EXPANSION_SEEDS) -> DataFrame:
    """All points of the articles of the first seeds, each with the seed it came from; articles of several seeds count once."""
    own = seed_rows.filter((F.col("seed_no") <= limit) & F.col("article_no").isNotNull())
    keys = own.groupBy("query_id", *ARTICLE).agg(F.min_by("point_id", "seed_no").alias("expanded_from"))
    return points.join(keys, ["query_id", *ARTICLE])


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One row a point: the best score, all provenance in order, the rest of the row that came first (``input_pos``)."""
    keep = [c for c in rows.columns if c not in ("query_id", "point_id", "score", "sources", "input_pos")]
    out = rows.groupBy("query_id", "point_id").agg(
        F.min_by(F.struct(*keep), "input_pos").alias("r"),
        F.max("score").alias("score"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "sources"))), lambda x: x["sources"]))).alias("sources"),
        F.min("input_pos").alias("input_pos"),
    )
    return out.select("query_id", "point_id", "r.*", "score", "sources", "input_pos")


def collapse_provisions(rows: DataFrame, key: str = "version_id") -> DataFrame:
    """One row a provision version: its first part speaks for it, with the best scores and all provenance of its parts.

    A part without a number comes before part 0; equal numbers go by the text of their id.
    """
    first = F.struct(F.coalesce(F.col("sub_chunk_index"), F.lit(-1)).alias("n"), F.col("point_id").cast("string").alias("id"))
    keep = [c for c in rows.columns if c not in ("query_id", key, "score", "rerank_score", "sources", "sub_chunk_index", "input_pos")]
    out = rows.groupBy("query_id", key).agg(
        F.min_by(F.struct(*keep), first).alias("r"),
        F.max("score").alias("score"),
        *([F.max("rerank_score").alias("rerank_score")] if "rerank_score" in rows.columns else []),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "sources"))), lambda x: x["sources"]))).alias("sources"),
        F.array_sort(F.collect_set(F.col("point_id").cast("string"))).alias("part_ids"),
        F.min("input_pos").alias("input_pos"),
    )
    extra = ["rerank_score"] if "rerank_score" in rows.columns else []
    return out.select("query_id", key, "r.*", F.lit(None).cast("int").alias("sub_chunk_index"), "score", *extra, "sources", "part_ids", "input_pos")


def top_locations(ranked: DataFrame, limit: int = FINAL) -> DataFrame:
    """``limit`` locations in order (``slot``): those below an article first, article-level ones in what slots are left.

    A location's ``location_score`` is its best score among the rows read until the slots were full.
    """
    rows = ranked.filter(F.col("location_label").isNotNull() & F.col("document_id").isNotNull())
    firsts = rows.groupBy("query_id", *LOCATION).agg(F.first("article_level").alias("article_level"), F.min("rank").alias("first_rank"))
    chosen = _top(firsts, limit, F.col("article_level").cast("int"), F.col("first_rank"), rank="slot")
    # clauses fill the slots up to some rank; article-level locations are taken with their first row alone
    full = chosen.groupBy("query_id").agg(F.count_if(~F.col("article_level")).alias("n"), F.max(F.when(~F.col("article_level"), F.col("first_rank"))).alias("last"))
    read = rows.join(chosen.select("query_id", *LOCATION, "slot", "first_rank"), ["query_id", *LOCATION]).join(full, "query_id")
    seen = F.when(F.col("article_level"), F.col("rank") == F.col("first_rank")).otherwise((F.col("n") < limit) | (F.col("rank") <= F.col("last")))
    return read.filter(seen).groupBy("query_id", *LOCATION, "slot").agg(F.max("rerank_score").alias("location_score"))


def complete_locations(chosen: DataFrame, points: DataFrame) -> DataFrame:
    """All points of the chosen locations, whatever their version."""
    return points.join(chosen.select("query_id", *LOCATION, "slot"), ["query_id", *LOCATION])


def article_context(chosen: DataFrame, points: DataFrame) -> DataFrame:
    """Article-level points of the articles of the chosen locations."""
    articles = chosen.select("query_id", "document_id", locations.article_number(F.col("location_label")).alias("article_no")).filter("article_no is not null").distinct()
    return points.filter("article_level").join(articles, ["query_id", *ARTICLE])


def siblings(chosen: DataFrame, points: DataFrame, probes: DataFrame, score=overlap_score, sources: int = SIBLING_SOURCES, per_article: int = SIBLINGS_PER_ARTICLE, total: int = SIBLINGS) -> DataFrame:
    """Further clauses of the articles of the first chosen locations: ``query_id``, location, ``sibling_no``, ``location_score``.

    Best score first, then neighbours of a chosen clause, then the lower number; so many an article and in all.
    """
    own = with_keys(chosen).filter(F.col("slot") <= sources).filter("article_no is not null and clause_no is not null")
    articles = own.groupBy("query_id", *ARTICLE).agg(F.min("slot").alias("article_slot"), F.collect_set("clause_no").alias("clauses"))
    open_points = points.filter("clause_no is not null").join(articles, ["query_id", *ARTICLE]).join(chosen.select("query_id", *LOCATION), ["query_id", *LOCATION], "left_anti")
    return _best_siblings(open_points, probes, score, per_article, total)


def ranked_siblings(ranked: DataFrame, probes: DataFrame, score=overlap_score, limit: int = FINAL, sources: int = SIBLING_SOURCES, per_article: int = SIBLINGS_PER_ARTICLE, total: int = SIBLINGS) -> DataFrame:
    """``siblings`` of the ``top_locations`` of the same points, without joins: all follows from a query's locations, which lie together as the ranking put them."""
    rows = ranked.filter(F.col("location_label").isNotNull() & F.col("document_id").isNotNull())
    places = with_keys(rows.groupBy("query_id", *LOCATION).agg(F.min("rank").alias("first_rank"), F.collect_set(F.struct("content")).alias("contents")))
    slots = Window.partitionBy("query_id").orderBy(F.col("article_level").cast("int"), "first_rank")
    article = Window.partitionBy("query_id", *ARTICLE)
    own = (F.col("slot") <= sources) & F.col("article_no").isNotNull() & F.col("clause_no").isNotNull()
    marked = places.withColumn("slot", F.row_number().over(slots)).withColumns(
        {"article_slot": F.min(F.when(own, F.col("slot"))).over(article), "clauses": F.collect_set(F.when(own, F.col("clause_no"))).over(article)}
    )
    open_places = marked.filter((F.col("slot") > limit) & F.col("article_slot").isNotNull() & F.col("clause_no").isNotNull())
    return _best_siblings(open_places.select("*", F.inline("contents")), probes, score, per_article, total)


def _best_siblings(open_points: DataFrame, probes: DataFrame, score, per_article: int, total: int) -> DataFrame:
    near = F.exists("clauses", lambda c: F.abs(c - F.col("clause_no")) == 1)
    scored = open_points.withColumn("near", near).join(probes, "query_id")
    by_location = scored.groupBy("query_id", *ARTICLE, "location_label", "clause_no", "article_slot", "near").agg(F.max(score(F.col("probe"), F.col("content"))).alias("location_score"))
    few = _top(by_location, per_article, F.desc("location_score"), (~F.col("near")).cast("int"), F.col("clause_no"), F.col("location_label"), rank="article_rank", by=("query_id", *ARTICLE))
    return _top(few, total, F.col("article_slot"), F.col("article_rank"), rank="sibling_no").select("query_id", *LOCATION, "sibling_no", "location_score")


def ranked_by(rows: DataFrame, score: str = "rerank_score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "input_pos")
    return rows.withColumn("rank", F.row_number().over(w))


def structured_retrieve(points: DataFrame, queries: DataFrame, facts: DataFrame, score=overlap_score, final: int = FINAL) -> DataFrame:
    """The whole retrieval: hybrid candidates, seeds, article expansion, provisions, locations, siblings, context.

    ``points`` are in force for every query (``point_id`` long, ``version_id``, ``document_id``, ``location_label``,
    ``sub_chunk_index``, ``content``, ``provision_content``, ``embedding``); ``queries`` has ``query_id``, ``text``,
    ``embedding``; ``facts`` has ``query_id``, ``fact``.  A version's ``provision_content`` may be given with one of its points only and null with the others.
    """
    docs = points.select(F.col("point_id").alias("doc_id"), F.col("content").alias("text"), "embedding")
    # candidates and what follows from them are small and read by several steps: computed once
    fused = settle(rrf(dense(docs, queries), bm25(docs, queries)).filter(F.col("rank") <= CANDIDATES))
    # points are met by candidates where they lie, and are not stored again; the provisions' texts are fetched once for each version that can be reached
    few = F.broadcast if fused.count() <= BROADCAST_HITS else (lambda rows: rows)
    keyed = with_keys(points.drop("embedding", "provision_content"))
    hits = fused.select("query_id", F.col("doc_id").alias("point_id"), F.col("rrf").alias("score"), F.col("rank").alias("input_pos"))
    semantic = settle(keyed.join(few(hits), "point_id").withColumn("sources", F.array(F.lit("semantic"))))
    question = queries.select("query_id", F.col("text").alias("probe"))
    probes = question.unionByName(facts.select("query_id", F.col("fact").alias("probe"))).distinct()

    first = settle(ranked_by(coverage_rerank(semantic, question, score=score)))
    # the points a query can reach are those of the documents it has met
    met = semantic.select("query_id", "document_id").distinct()
    reachable = settle(keyed.join(few(met), "document_id"))
    texts = settle(points.filter("provision_content is not null").select("document_id", "version_id", "provision_content").join(few(met.select("document_id").distinct()), "document_id").groupBy("version_id").agg(F.first("provision_content").alias("provision_content")))
    grown = expand_articles(seeds(first), reachable).select(*[c for c in semantic.columns if c not in ("score", "sources", "input_pos")], F.lit(0.0).alias("score"), F.array(F.lit("same_article_expansion")).alias("sources"), (F.lit(CANDIDATES) + F.col("point_id")).alias("input_pos"))
    merged = settle(merge_candidates(semantic.unionByName(grown.select(*semantic.columns))))
    provisions = collapse_provisions(merged).join(texts, "version_id", "left")
    ranked = settle(ranked_by(coverage_rerank(provisions, probes, text="provision_content", score=score)).drop("provision_content"))
    chosen = settle(top_locations(ranked, final))
    more = settle(siblings(chosen, reachable, probes, score=score))
    wanted = chosen.select("query_id", *LOCATION, "slot", "location_score").unionByName(more.select("query_id", *LOCATION, (F.lit(final) + F.col("sibling_no")).alias("slot"), "location_score"))
    own = complete_locations(wanted, reachable)
    extra = article_context(wanted, reachable).withColumn("slot", F.lit(final + SIBLINGS + 1)).join(wanted.select("query_id", *LOCATION), ["query_id", *LOCATION], "left_anti")
    context = own.unionByName(extra.select(*own.columns)).withColumns({"score": F.lit(0.0), "sources": F.array(F.lit("context")), "input_pos": F.col("slot").cast("long")})
    whole = collapse_provisions(context).join(texts, "version_id", "left").join(wanted.select("query_id", *LOCATION, "location_score"), ["query_id", *LOCATION], "left")
    w = Window.partitionBy("query_id").orderBy("slot", "location_label", "version_id")
    return whole.withColumn("position", F.row_number().over(w))
