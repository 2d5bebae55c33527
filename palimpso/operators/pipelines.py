"""Whole runs: standard retrieval, its four configurations, the bounded search loop, evaluation by branch, and resuming.

What models decide (evaluations of facts, choices, answers) are input tables; everything that follows from them is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import settle, stored
from . import evaluate as E
from . import retrieval as R
from . import verify

METHODS = ("dense", "bm25", "hybrid_rrf", "hybrid_rerank")
SELECTED = 5

# ---- standard retrieval ----------------------------------------------------------------------------


def rerank_passage(content: Column, original: Column) -> Column:
    """What the pair scorer reads: the augmented text, or else the original one."""
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(full(content), full(original), F.lit(""))


def configurations(dense: DataFrame, lexical: DataFrame, passages: DataFrame, queries: DataFrame, score=R.overlap_score, selected: int = SELECTED) -> DataFrame:
    """The first ``selected`` of four rankings made of one dense and one lexical one: ``method``, ``query_id``, ``doc_id``, ``rank``.

    Both have ``query_id``, ``doc_id``, ``rank``; ``passages`` has ``doc_id``, ``passage``; ``queries`` has ``query_id``,
    ``text``.  Every candidate of the fused ranking is scored; equal scores keep the fused order.  ``pool`` is how many candidates a method had.
    """
    fused = settle(R.rrf(dense, lexical).select("query_id", "doc_id", "rank"))
    known = fused.join(passages, "doc_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    scored = known.withColumn("_s", score(F.col("asked"), F.col("passage")))
    reranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "rank")))
    lists = zip(METHODS, (dense, lexical, fused, reranked), strict=True)
    out = None
    for name, rows in lists:
        one = rows.select(F.lit(name).alias("method"), "query_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("pool", F.count(F.lit(1)).over(Window.partitionBy("method", "query_id"))).filter(F.col("rank") <= selected)


def hybrid_rerank(dense: DataFrame, lexical: DataFrame, passages: DataFrame, queries: DataFrame, score=R.overlap_score, candidates: int = R.CANDIDATES, limit: int = SELECTED) -> DataFrame:
    """Standard retrieval: the first fused candidates by pair score; equal scores in fused order."""
    fused = R.rrf(dense, lexical).filter(F.col("rank") <= candidates).select("query_id", "doc_id", F.col("rank").alias("fused_rank"))
    known = fused.join(passages, "doc_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    scored = known.withColumn("rerank_score", score(F.col("asked"), F.col("passage")))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "doc_id", "rerank_score", "rank")


# ---- the search loop -------------------------------------------------------------------------------


def search_loop(facts: DataFrame, evaluations: DataFrame, evidence: DataFrame, max_rounds: int = verify.MAX_ROUNDS) -> DataFrame:
    """Each fact's last status, the rounds its task took, and the task's status.

    ``evaluations`` and ``evidence`` are what models said in each ``round``.  A round judges the facts that are still
    pending, on the evidence of all rounds so far; a task stops when none is pending or rounds are used up.  A settled fact stays settled, so a
    fact's status is that of the first round that settles it: no loop over rounds is needed.
    """
    asked = evaluations.filter(F.col("round") <= max_rounds)
    first = asked.withColumn("_n", F.row_number().over(Window.partitionBy("fact_id", "round").orderBy("position"))).filter("_n = 1").select("fact_id", "round", "status")
    since = evidence.groupBy("fact_id").agg(F.min("round").alias("since"))
    settled = first.join(since, "fact_id", "left").filter((F.col("status") == "not_applicable") | ((F.col("status") == "covered") & (F.col("since") <= F.col("round"))))
    done = settled.groupBy("fact_id").agg(F.min(F.struct("round", "status")).alias("d")).select("fact_id", F.col("d.round").alias("settled_in"), F.col("d.status").alias("settled_as"))
    every = facts.select("task_id", "fact_id").join(done, "fact_id", "left")
    by_task = every.groupBy("task_id").agg(F.max(F.coalesce("settled_in", F.lit(max_rounds))).alias("rounds"), F.count(F.lit(1)).alias("n"), F.count("settled_as").alias("accepted"))
    status = F.when(F.col("accepted") == F.col("n"), "success").when(F.col("accepted") > 0, "partial").otherwise("not_found")
    return every.join(by_task.select("task_id", "rounds", status.alias("search_status")), "task_id").select("task_id", "fact_id", F.coalesce("settled_as", F.lit("missing_evidence")).alias("status"), "settled_in", "rounds", "search_status")


def gate(facts: DataFrame, coverage: DataFrame, shown: DataFrame, temporal_issues: DataFrame, retry_count: int, max_retries: int, repaired: bool = False) -> DataFrame:
    """The other loop's decision on each task: pass, retry, reevaluate or stop.

    ``coverage`` (``task_id``, ``fact_id``, ``status``, ``chunk_id``, ``support_span``) is what the model says of a fact; ``shown`` (``task_id``,
    ``chunk_id``, ``text``, ``excluded``) what it saw.  A fact without coverage, with an unknown status, or with a span that the chunk
    doesn't say is invalid and asks for one repair; one that misses evidence asks for a retry while there are any left.
    """
    said = coverage.select("task_id", "fact_id", F.lower(F.trim("status")).alias("status"), "chunk_id", F.trim(F.coalesce("support_span", F.lit(""))).alias("span"))
    seen = shown.filter(~F.coalesce("excluded", F.lit(False))).select("task_id", "chunk_id", F.col("text").alias("source"))
    each = facts.select("task_id", "fact_id").join(said, ["task_id", "fact_id"], "left").join(seen, ["task_id", "chunk_id"], "left")
    valid = F.col("status").isin("covered", "not_applicable") & F.col("source").isNotNull() & T.strict_span(F.col("span"), F.col("source"))
    missing = F.coalesce(F.col("status") == "missing_evidence", F.lit(False))
    state = F.when(missing, "missing").when(F.coalesce(valid, F.lit(False)), "ok").otherwise("invalid")
    counts = each.groupBy("task_id").agg(F.count_if(state == "missing").alias("missing"), F.count_if(state == "invalid").alias("invalid"))
    late = temporal_issues.select("task_id").distinct().withColumn("late", F.lit(True))
    out = counts.join(late, "task_id", "left")
    decision = (
        F.when(F.col("late"), "stop")
        .when(F.col("invalid") > 0, F.lit("stop" if repaired else "reevaluate"))
        .when(F.col("missing") > 0, F.lit("stop" if retry_count >= max_retries else "retry"))
        .otherwise("pass")
    )
    return out.select("task_id", "missing", "invalid", decision.alias("decision"))


def searcher_status(attempts: DataFrame) -> DataFrame:
    """A searcher's attempt: retrieved if it ended well, partly if it failed but had captured chunks, else an error."""
    status = F.when(~F.coalesce("failed", F.lit(False)), "retrieved").when(F.coalesce("captured", F.lit(0)) > 0, "retrieved_partial").otherwise("error")
    return attempts.withColumn("search_status", status)


# ---- plans and workflow ----------------------------------------------------------------------------


def plan_or_fallback(cases: DataFrame, plans: DataFrame, schema: str = "array<struct<question:string>>") -> DataFrame:
    """The steps of every case's plan (JSON of a model, fences and all); one step with the whole question where nothing parses or no step is left."""
    raw = plans.select("case_id", F.from_json(T.strip_fences(F.col("plan")), schema, {"mode": "PERMISSIVE"}).alias("steps"))
    joined = cases.join(raw, "case_id", "left")
    usable = F.filter(F.coalesce("steps", F.array().cast(schema)), lambda s: F.trim(F.coalesce(s["question"], F.lit(""))) != "")
    steps = F.when(F.size(usable) > 0, F.transform(usable, lambda s: F.trim(s["question"]))).otherwise(F.array(F.col("question")))
    flat = joined.select("case_id", (F.size(usable) == 0).alias("fallback"), F.posexplode(steps).alias("position", "step_question"))
    return flat.withColumn("position", F.col("position") + 1)


def workflow_memory(steps: DataFrame, key: list[str] | None = None, order: str = "position") -> DataFrame:
    """Steps of a plan, of which one asked before in the same scope uses the earlier one's result: ``computed_by`` is the step that does the work."""
    key = key or ["case_id", "task", "scope_key"]
    w = Window.partitionBy(*key).orderBy(order)
    return steps.withColumn("computed_by", F.first(order).over(w)).withColumn("reused", F.col("computed_by") != F.col(order))


# ---- evaluation ------------------------------------------------------------------------------------


def branch_traces(branches: list[DataFrame]) -> DataFrame:
    """Traces of all branches one after another, each row with its branch (from 1); equal rows of several branches all stay."""
    out = None
    for n, rows in enumerate(branches, 1):
        one = rows.withColumn("branch", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_methods(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Scores of every method and case: of a case's branches the rows are read in order, each identity once.

    ``ranked`` has ``method``, ``case_id``, ``branch``, ``position``, ``ident``; ``qrels`` may be without ``case_id``, of all cases alike.
    """
    key = F.concat_ws("\u0001", "method", F.col("case_id").cast("string"))
    rows = ranked.select(key.alias("case_id"), "ident", F.struct("branch", "position").alias("position"))
    cases = ranked.select("method", F.col("case_id").alias("_case")).distinct().withColumn("case_id", F.concat_ws("\u0001", "method", F.col("_case").cast("string")))
    gold = qrels
    if "case_id" in qrels.columns:
        gold = qrels.join(cases.select(F.col("_case"), F.col("case_id").alias("_key")), qrels["case_id"] == F.col("_case")).select(F.col("_key").alias("case_id"), "ident", "relevance")
    scores = E.ranking_metrics(cases, E.first_of_each(rows), gold)
    return cases.join(scores, "case_id").select("method", F.col("_case").alias("case_id"), "recall", "precision", "ndcg")


def case_report(ranked: DataFrame, qrels: DataFrame, spans: DataFrame, gold: DataFrame, texts: DataFrame, by: tuple[str, ...] = ("method", "case_id")) -> DataFrame:
    """Everything that is measured of a retrieval, a row for each method and case: ``recall``, ``precision``, ``ndcg``, ``fact_coverage``, ``evidence_precision``, ``context_chars``, ``context_words``, ``estimated_context_tokens``, ``pool``.

    ``ranked`` has the columns ``by``, ``ident``, ``position``, an identity once in each case; ``texts`` has ``ident``, ``text``.  ``qrels`` (``ident``, ``relevance``), ``gold``
    (``fact_id``) and ``spans`` (``ident``, ``span``, ``fact_ids``) are of ``case_id``, whatever the method: a fact counts as covered if a retrieved text says a
    span of it, and a retrieved text is useful if it is relevant.  A case without gold facts has a null coverage.
    """
    key = F.to_json(F.struct(*by))
    rows = ranked.select(key.alias("_key"), *by, "ident", "position")
    cases = rows.select("_key", *by).distinct()
    own = lambda df: cases.select("_key", "case_id").join(df, "case_id").drop("case_id").withColumnRenamed("_key", "case_id")
    keyed = rows.select(F.col("_key").alias("case_id"), "ident", "position")
    relevant = own(qrels)
    metrics = E.ranking_metrics(cases.select(F.col("_key").alias("case_id")), keyed, relevant)
    contexts = keyed.join(texts.select("ident", "text"), "ident", "left")
    # one method's case has the spans of its case
    covered = E.spans_found(contexts.filter("text is not null"), own(spans))
    facts = E.fact_coverage(own(gold), covered)
    useful = keyed.join(relevant.filter("relevance > 0").select("case_id", "ident").distinct().withColumn("useful", F.lit(True)), ["case_id", "ident"], "left")
    out = cases.withColumnRenamed("_key", "_k")
    pool = keyed.groupBy("case_id").agg(F.count(F.lit(1)).alias("pool"))
    for part in (metrics, facts, E.evidence_precision(useful), E.context_size(contexts), pool):
        part = part.withColumnRenamed("case_id", "_k")
        out = out.join(part, "_k", "left")
    return out.drop("_k")


def run_evaluation(cases: DataFrame, finished: DataFrame, outputs: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outputs of a resumed run, and the cases still to do with their simulated response (null without one).

    Finished cases are not done again and the last result of a case counts; ``outputs`` adds those of this run.
    """
    done = E.last_of_each(finished.select("case_id", "status", F.struct(F.lit(0).alias("run"), "position").alias("position")).unionByName(outputs.select("case_id", "status", F.struct(F.lit(1).alias("run"), "position").alias("position"))))
    todo = E.unfinished(cases, done).join(E.last_of_each(responses).select("case_id", "response"), "case_id", "left")
    return done.select("case_id", "status"), todo


# ---- building a corpus -----------------------------------------------------------------------------


def build_corpus(docs: DataFrame, meta: DataFrame, ops: DataFrame, effects: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """From Markdown to versions: provisions, their first versions, amendments in order, and the end of documents that are replaced or repealed.

    ``docs`` has ``document_id``, ``markdown``; ``meta`` as ``base_versions`` wants it; the second table has the operations that failed.
    """
    from . import documents as D
    from . import versions as V

    base = D.base_versions(D.provisions(docs), meta).select(*V.VERSION_FIELDS)
    folded = stored(V.apply_operations(base, ops), "versions")
    live = folded.filter("error is null").drop("error").join(meta.select("document_id", "status"), "document_id", "left")
    failed = folded.filter("error is not null").select(F.col("version_id").alias("operation_id"), "document_id", "error")
    return V.expire(live, V.terminal_dates(effects), as_of), failed
