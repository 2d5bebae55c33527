"""Evidence for facts: candidates, literal support, evaluations and the search loop's decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.deploy import ship_code
from .spans import SPAN_BYTES, contained_spans, matched_spans  # noqa: F401 - part of checking evidence

MAX_ROUNDS = 3
MAX_FACTS = 6
MAX_TASKS = 3


def labelled(candidates: DataFrame, by: str = "task_id", order: str = "position") -> DataFrame:
    """Labels C1 to Cn in order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return candidates.withColumn("label", F.concat(F.lit("C"), n.cast("string")))


def candidate_block(rows: DataFrame, by: str = "task_id", text: str = "text") -> DataFrame:
    """All candidates of a task as one text, in order of their labels."""
    one = F.struct(F.substring("label", 2, 9).cast("int").alias("n"), F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col(text)).alias("t"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n\n").alias("block"))


def number_facts(facts: DataFrame, task: str = "task_id", order: str = "position", limit: int = MAX_FACTS) -> DataFrame:
    """Distinct facts of a task (type and description, but for blanks and case) numbered ``T{i}_F{j}``, six at most."""
    key = [task, F.lower(F.trim("fact_type")), F.lower(T.collapse(F.col("description")))]
    first = facts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")
    n = F.row_number().over(Window.partitionBy(task).orderBy(order))
    return first.withColumn("_n", n).filter(F.col("_n") <= limit).withColumn("fact_id", F.concat(F.col(task), F.lit("_F"), F.col("_n").cast("string"))).drop("_n")


def supported(evidence: DataFrame, candidates: DataFrame, by: str = "task_id") -> DataFrame:
    """Evidence whose label is a candidate's and whose span that candidate's text says; with the source's own words.

    Labels that a task hasn't are dropped by the join before any span is compared.
    """
    ship_code(evidence.sparkSession)
    joined = evidence.join(candidates.select(by, "label", F.col("text").alias("_source")), [by, "label"])
    found = joined.withColumn("_m", T.span_match(F.col("support_span"), F.col("_source")))
    return found.filter("_m.match_type is not null").select(*[c for c in evidence.columns if c != "support_span"], F.col("_m.support_span").alias("support_span"), F.col("_m.match_type").alias("match_type"), F.col("_m.match_score").alias("match_score"))


def evaluate_facts(facts: DataFrame, evaluations: DataFrame, evidence: DataFrame) -> DataFrame:
    """One status a fact: the first evaluation of a known fact counts; omitted facts, and covered ones without valid evidence, miss evidence."""
    first = evaluations.withColumn("_n", F.row_number().over(Window.partitionBy("fact_id").orderBy("position"))).filter("_n = 1").select("fact_id", "status")
    valid = evidence.select("fact_id").distinct().withColumn("has_evidence", F.lit(True))
    joined = facts.join(first, "fact_id", "left").join(valid, "fact_id", "left")
    status = F.when((F.col("status") == "covered") & F.col("has_evidence"), "covered").when(F.col("status") == "not_applicable", "not_applicable").otherwise("missing_evidence")
    return joined.withColumn("status", status).drop("has_evidence")


def next_round(before: DataFrame, after: DataFrame, round_no: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """What the loop does for each task: stop when all facts are settled or rounds are used up, else retry with what is pending."""
    pending = lambda df, name: df.groupBy("task_id").agg(F.count_if(F.col("status") == "missing_evidence").alias(name))
    both = pending(after, "pending").join(pending(before, "pending_before"), "task_id", "left")
    decision = F.when(F.col("pending") == 0, "stop_covered").when(F.lit(round_no) >= max_rounds, "stop_rounds").when(F.col("pending") < F.coalesce("pending_before", F.col("pending") + 1), "retry_progress").otherwise("retry")
    return both.select("task_id", "pending", decision.alias("decision"))


def accumulate(rounds: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Candidates of all rounds; of those with one key the latest round's."""
    key = key or ["task_id", "point_id"]
    names = [c for c in rounds.columns if c not in key]
    return rounds.groupBy(*key).agg(F.max_by(F.struct(*names), "round").alias("r")).select(*key, "r.*")


def dedupe(rows: DataFrame, key: list[str | Column], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_evidence(evidence: DataFrame, order: str = "position") -> DataFrame:
    """One row a chunk and scope; rows without a chunk id count as one by title, location and text."""
    blank = F.trim(F.coalesce(F.col("chunk_id"), F.lit(""))) == ""
    legacy = F.concat_ws("\u0001", "title", "location_label", "text")
    return dedupe(evidence, [blank, F.when(blank, legacy).otherwise(F.col("chunk_id")), F.when(~blank, F.coalesce("scope_key", F.lit("")))], order)


def dedupe_candidates(candidates: DataFrame, order: str = "position") -> DataFrame:
    key = F.coalesce(F.nullif(F.trim("provision_key"), F.lit("")), F.col("chunk_id"))
    return dedupe(candidates, [key, F.coalesce("version", F.lit(1))], order)


def bad_citations(answers: DataFrame, n_evidence: str = "n_evidence") -> DataFrame:
    """Answers that cite an evidence number outside 1 to n."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return answers.filter(F.exists(cited, lambda x: (x < 1) | (x > F.col(n_evidence))))


def plan_tasks(tasks: DataFrame, limit: int = MAX_TASKS) -> DataFrame:
    """The first tasks in order, after comparisons have been expanded; ``dropped`` marks the rest."""
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("position", "branch"))
    return tasks.withColumn("step", n).withColumn("dropped", F.col("step") > limit)


def same_tasks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Task ids that only one of two plans has."""
    left, right = a.select("case_id", "task_id").distinct().withColumn("_a", F.lit(1)), b.select("case_id", "task_id").distinct().withColumn("_b", F.lit(1))
    return left.join(right, ["case_id", "task_id"], "full_outer").filter("_a is null or _b is null").select("case_id", "task_id")


def recent_turns(turns: DataFrame, n: int, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation, oldest first."""
    w = Window.partitionBy(by).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(turn))).drop("_n")


# ---- how evidence is written ---------------------------------------------------------------------


def as_evidence(points: DataFrame) -> DataFrame:
    """Adds ``title``, ``text`` and identity: whole text before parts of it, a key where there is none, and no part of a chunk in a key."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    names = set(points.columns)
    texts = [full(c) for c in ("provision_content", "original_content", "content") if c in names]
    title = F.concat(F.coalesce(full("document_title"), F.col("document_id")) if "document_title" in names else F.col("document_id"), F.lit(" ("), F.col("document_id"), F.lit(")"))
    key = F.split_part(F.coalesce(full("provision_key"), F.concat_ws("|", "document_id", "location_label")), F.lit("|SUBCHUNK|"), F.lit(1))
    own = full("version_id") if "version_id" in names else F.lit(None).cast("string")
    version = F.coalesce(own, F.concat(key, F.lit("|V"), F.col("version").cast("string")))
    return points.withColumns({"title": title, "text": F.coalesce(*texts, F.lit("")), "version_id": version, "provision_key": key})


def evidence_order(rows: DataFrame, by: str = "case_id") -> DataFrame:
    """``position`` of a case's evidence: by the step that first saw it, then title, then place."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("first_seen_step", "title", "location_label")))


def context_block(rows: DataFrame, lines: list[tuple[str, str]], by: str = "case_id", order: str = "position") -> DataFrame:
    """``block``: a case's rows in order, each numbered and written as ``name: value`` lines, empty where the value is null."""
    text = F.concat_ws("\n", F.concat(F.lit("["), F.col(order).cast("string"), F.lit("]")), *[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in lines])
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))


def required_facts(steps: DataFrame, by: str = "case_id", order: str = "position", facts: str = "facts") -> DataFrame:
    """Facts of all steps of a case in order, each once."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(facts).alias("f")))), lambda x: x["f"])
    return steps.filter(F.col(facts).isNotNull()).groupBy(by).agg(F.array_distinct(F.array_compact(F.flatten(listed))).alias("facts"))
