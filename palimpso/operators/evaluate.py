"""Scores of retrieval and of answers, and audits of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity(version_id: Column, key: Column, version: Column, point_id: Column) -> Column:
    """Version id, else key and version (1 if unknown), else the point."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(full(version_id), F.concat(full(key), F.lit("|V"), F.coalesce(version, F.lit(1)).cast("string")), F.concat(F.lit("POINT|"), point_id.cast("string")))


def first_of_each(ranked: DataFrame, by: str = "case_id", ident: str = "ident", position: str = "position") -> DataFrame:
    """The first row of every identity, in order; positions are closed up."""
    w = Window.partitionBy(by, ident).orderBy(position)
    first = ranked.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.withColumn(position, F.row_number().over(Window.partitionBy(by).orderBy(position)))


def _dcg(relevance: str, position: str) -> Column:
    return F.sum((F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col(position) + 1))


def ranking_metrics(cases: DataFrame, ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """recall, precision and nDCG a case; the ideal ranking is cut to the length of the one observed; 0 where nothing can be divided.

    ``ranked`` has ``case_id``, ``ident``, ``position`` without repeats; ``qrels`` has ``case_id``, ``ident``, ``relevance``, or no ``case_id`` where
    it is the same for all cases: then it is not repeated for each.
    """
    own = [c for c in ("case_id",) if c in qrels.columns]
    gold = qrels.groupBy(*own, "ident").agg(F.max("relevance").alias("relevance")).filter("relevance > 0")
    hits = ranked.join(gold, [*own, "ident"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    seen = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevance") > 0).alias("found"), _dcg("relevance", "position").alias("dcg"))
    all_gold = gold.groupBy(*own).agg(F.count(F.lit(1)).alias("gold"))
    if own:
        ideal = gold.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("relevance"), "ident"))).join(seen.select("case_id", "n"), "case_id").filter("position <= n")
    else:
        grades = gold.groupBy("relevance").agg(F.count(F.lit(1)).alias("many"))  # few rows, each the places one after another that are its own
        places = grades.withColumn("last", F.sum("many").over(Window.orderBy(F.desc("relevance")))).withColumn("first", F.col("last") - F.col("many") + 1)
        within = seen.select("case_id", "n").join(F.broadcast(places), F.col("first") <= F.col("n"))
        ideal = within.select("case_id", "relevance", F.explode(F.sequence("first", F.least("last", "n"))).alias("position"))
    best = ideal.groupBy("case_id").agg(_dcg("relevance", "position").alias("idcg"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.coalesce(F.col(a), F.lit(0)).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0))), F.lit(0.0))
    counted = cases.select("case_id").distinct().join(seen, "case_id", "left")
    out = (counted.join(all_gold, "case_id", "left") if own else counted.join(F.broadcast(all_gold), F.lit(True), "left")).join(best, "case_id", "left")
    return out.select("case_id", ratio("found", "gold").alias("recall"), ratio("found", "n").alias("precision"), ratio("dcg", "idcg").alias("ndcg"))


def credit_versions_once(chunks: DataFrame, by: str = "case_id", ident: str = "ident", position: str = "position", relevance: str = "relevance") -> DataFrame:
    """Later chunks of a version that had its credit count as irrelevant, and stay in the denominator."""
    w = Window.partitionBy(by, ident).orderBy(position)
    return chunks.withColumn(relevance, F.when(F.row_number().over(w) == 1, F.col(relevance)).otherwise(F.lit(0)))


def fact_coverage(gold: DataFrame, covered: DataFrame) -> DataFrame:
    """Share of a case's gold facts that are covered."""
    hit = gold.select("case_id", "fact_id").distinct().join(covered.select("case_id", "fact_id").distinct().withColumn("hit", F.lit(1)), ["case_id", "fact_id"], "left")
    return hit.groupBy("case_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("fact_coverage"))


def evidence_precision(contexts: DataFrame, useful: str = "useful") -> DataFrame:
    return contexts.groupBy("case_id").agg(F.avg(F.coalesce(F.col(useful), F.lit(False)).cast("int")).alias("evidence_precision"))


def spans_found(contexts: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts of spans that their version's text says (but for blanks and case)."""
    from ..functions.text import strict_span

    return contexts.join(spans, ["case_id", "ident"]).filter(strict_span(F.col("span"), F.col("text"))).select("case_id", "ident", F.explode("fact_ids").alias("fact_id")).distinct()


def match_evidence(evidence: DataFrame, qrels: DataFrame) -> DataFrame:
    """Evidence and gold provisions of a case: by version if both name one, else by provision."""
    q = qrels.select(F.col("case_id").alias("_case"), F.col("version_id").alias("_version"), F.col("provision_key").alias("_key"), *[c for c in qrels.columns if c not in ("case_id", "version_id", "provision_key")])
    both = F.col("version_id").isNotNull() & F.col("_version").isNotNull()
    same_case = evidence.join(q, (F.col("case_id") == F.col("_case")) & ((both & (F.col("version_id") == F.col("_version"))) | (~both & (F.col("provision_key") == F.col("_key")))))
    return same_case.drop("_case", "_version", "_key")


def context_size(texts: DataFrame, by: str = "case_id", position: str = "position", text: str = "text") -> DataFrame:
    """Characters, words and estimated tokens (a quarter of the characters) of a case's context."""
    joined = texts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: F.coalesce(x[text], F.lit(""))), "\n\n").alias("c"))
    words = F.size(F.filter(F.split("c", r"(?U)\s+"), lambda w: w != ""))
    return joined.select(by, F.length("c").alias("context_chars"), words.alias("context_words"), F.ceil(F.length("c") / 4).alias("estimated_context_tokens"))


def temporal_precision(evidence: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of a case's evidence that holds at some expected time; ``expected`` has ``case_id`` and ``interval``."""
    from ..functions.temporal import audit_overlaps, start_of

    start = start_of(F.col("valid_from"))
    hit = evidence.join(expected, "case_id", "left").withColumn("_hit", F.coalesce(audit_overlaps(start, F.col("valid_to"), F.col("interval")), F.lit(False)))
    each = hit.groupBy("case_id", "evidence_id").agg(F.max("_hit").alias("_hit"))
    return each.groupBy("case_id").agg(F.avg(F.col("_hit").cast("int")).alias("temporal_evidence_precision"))


def answer_scores(judged: DataFrame) -> DataFrame:
    """Groundedness (supported claims with a valid citation) and correctness (a tenth of the mark, within 0 and 1)."""
    return judged.select("case_id", F.coalesce(F.try_divide(F.col("supported_cited_claims"), F.col("claims")), F.lit(0.0)).alias("groundedness"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mark") / 10)).alias("answer_correctness"))


def macro_average(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means to six places, 0 over nothing; missing scores are passed over."""
    grouped = rows.groupBy(*(by or []))
    return grouped.agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in metrics])


SUCCESS = ("ok", "passed", "completed")


def status_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("inference_status").isin(*SUCCESS)).alias("successful"), F.count_if(F.col("judge_status") == "ok").alias("judged"))


def pool_sizes(candidates: DataFrame, by: list[str]) -> DataFrame:
    return candidates.groupBy(*by).agg(F.countDistinct("point_id").alias("pool"), F.count(F.lit(1)).alias("listed"))


def search_status(facts: DataFrame) -> DataFrame:
    """success if every fact is accepted, partial if some are, else not_found."""
    accepted = F.count_if(F.col("status").isin("covered", "not_applicable"))
    status = F.when(accepted == F.count(F.lit(1)), "success").when(accepted > 0, "partial").otherwise("not_found")
    return facts.groupBy("task_id").agg(status.alias("search_status"))


def unfinished(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases without a result yet (resume)."""
    return cases.join(results.select("case_id").distinct(), "case_id", "left_anti")


def last_of_each(rows: DataFrame, key: str = "case_id", position: str = "position") -> DataFrame:
    """The last row of each key wins."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), position).alias("r")).select(key, "r.*")


def failed_steps(steps: DataFrame) -> DataFrame:
    return steps.filter((F.col("status") == "error") | (F.trim(F.coalesce(F.col("error"), F.lit(""))) != ""))
