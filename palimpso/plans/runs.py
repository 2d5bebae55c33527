r"""Queries about evidence, decisions and whole runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from ..functions.lineage import settle
from ..operators import evaluate as E, pipelines as P, retrieval as R, verify as C
from .search import DENSE_SQL, TOPK_SQL, _documents, _items, _vectors
from .tables import read
from .wording import pick

QUERIES, ORACLES = {}, {}


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events")


def evidence_validity(spark, sf_dir):
    """Spans of every event's text, of which only those count that the labelled candidate says; labels that a task hasn't are dropped."""
    ship_code(spark)
    task = (F.col("event_id") / 4).cast("long")
    rows = _events(spark, sf_dir).select(task.alias("task_id"), F.col("event_id").alias("position"), F.concat(F.lit("Người dùng "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" "), F.col("props")).alias("text"))
    candidates = C.labelled(rows)
    label = F.concat(F.lit("C"), (F.col("event_id") % 6).cast("string"))
    span = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("NGƯỜI  dùng "), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Người dùng "), F.col("user_id").cast("string"))).otherwise("không nói")
    evidence = _events(spark, sf_dir).select(task.alias("task_id"), F.col("event_id").alias("evidence_id"), label.alias("label"), span.alias("support_span"))
    return C.supported(evidence, candidates).select("evidence_id", "label", "support_span", "match_type")


QUERIES["evidence_validity"] = evidence_validity
ORACLES["evidence_validity"] = """WITH c AS (SELECT event_id // 4 AS task_id, 'C' || row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS label, 'Người dùng ' || user_id || ' ' || event_type || ' ' || props AS text FROM events),
e AS (SELECT event_id // 4 AS task_id, event_id AS evidence_id, 'C' || (event_id % 6) AS label, 'Người dùng ' || user_id AS span, event_id % 3 AS k FROM events WHERE event_id % 3 < 2)
SELECT evidence_id, label, span AS support_span, CASE k WHEN 0 THEN 'whitespace_normalized' ELSE 'exact' END AS match_type FROM e JOIN c USING (task_id, label) WHERE contains(text, span)"""


def candidate_blocks(spark, sf_dir):
    """All candidates of a task as one text, under their labels."""
    rows = _events(spark, sf_dir).select((F.col("event_id") / 13).cast("long").alias("task_id"), F.col("event_id").alias("position"), F.col("props").alias("text"))
    return C.candidate_block(C.labelled(rows)).select("task_id", F.md5(F.col("block").cast("binary")).alias("digest"))


QUERIES["candidate_blocks"] = candidate_blocks
ORACLES["candidate_blocks"] = """WITH n AS (SELECT event_id // 13 AS task_id, props, row_number() OVER (PARTITION BY event_id // 13 ORDER BY event_id) AS n FROM events)
SELECT task_id, md5(string_agg('[C' || n || '] ' || props, chr(10) || chr(10) ORDER BY n)) AS digest FROM n GROUP BY task_id"""


def bad_citations(spark, sf_dir):
    """Answers that cite evidence there isn't."""
    answer = F.concat(F.lit("Theo ["), (F.col("o_custkey") % 9).cast("string"), F.lit("] và [2], [x], mức ["), (F.col("o_orderkey") % 7).cast("string"), F.lit("]"))
    return C.bad_citations(read(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer"), (F.col("o_orderkey") % 5 + 1).alias("n_evidence"))).select("o_orderkey")


QUERIES["bad_citations"] = bad_citations
ORACLES["bad_citations"] = "SELECT o_orderkey FROM orders WHERE len(list_filter([o_custkey % 9, 2, o_orderkey % 7], lambda x: x < 1 OR x > o_orderkey % 5 + 1)) > 0"


def _facts(spark, sf_dir):
    return _events(spark, sf_dir).select((F.col("event_id") / 5).cast("long").alias("task_id"), F.col("event_id").alias("fact_id"))


def _said(status_at):
    return pick(("covered", "missing_evidence", "not_applicable", "covered", "odd"), status_at)


def fact_evaluation(spark, sf_dir):
    """One status a fact: the first evaluation counts, unknown facts are passed over, omitted ones and covered ones without evidence miss it."""
    e = _events(spark, sf_dir)
    first = e.filter("event_id % 6 <> 0").select(F.col("event_id").alias("fact_id"), _said(F.col("event_id") % 5).alias("status"), F.col("event_id").alias("position"))
    again = e.select(F.col("event_id").alias("fact_id"), F.lit("not_applicable").alias("status"), (F.col("event_id") + 10**9).alias("position")).filter("fact_id % 7 = 0")
    unknown = e.select((-F.col("event_id") - 1).alias("fact_id"), F.lit("covered").alias("status"), F.col("event_id").alias("position"))
    evidence = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("fact_id"))
    return C.evaluate_facts(_facts(spark, sf_dir), first.unionByName(again).unionByName(unknown), evidence)


QUERIES["fact_evaluation"] = fact_evaluation
_STATUS = "CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'not_applicable' END ELSE ['covered', 'missing_evidence', 'not_applicable', 'covered', 'odd'][event_id % 5 + 1] END"
ORACLES["fact_evaluation"] = f"""WITH s AS (SELECT event_id, {_STATUS} AS s FROM events) SELECT event_id // 5 AS task_id, event_id AS fact_id, CASE WHEN s = 'covered' AND event_id % 2 = 0 THEN 'covered' WHEN s = 'not_applicable' THEN s ELSE 'missing_evidence' END AS status FROM s"""


def _rounds(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("round", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    evaluations = e.select(F.col("event_id").alias("fact_id"), "round", _said((F.col("event_id") + F.col("round")) % 5).alias("status"), F.col("event_id").alias("position"))
    evidence = e.filter("(event_id + round) % 4 = 0").select(F.col("event_id").alias("fact_id"), "round")
    return evaluations, evidence


def search_loop(spark, sf_dir):
    """The bounded loop: three rounds at most, a settled fact stays settled, a task stops when nothing is pending."""
    out = P.search_loop(_facts(spark, sf_dir), *_rounds(spark, sf_dir))
    return out.select("task_id", "fact_id", "status", F.col("settled_in").cast("int").alias("settled_in"), F.col("rounds").cast("int").alias("rounds"), "search_status")


QUERIES["search_loop"] = search_loop
ORACLES["search_loop"] = """WITH r AS (SELECT event_id, round, ['covered', 'missing_evidence', 'not_applicable', 'covered', 'odd'][(event_id + round) % 5 + 1] AS s, bool_or((event_id + round) % 4 = 0) OVER (PARTITION BY event_id ORDER BY round) AS has FROM events, (SELECT unnest([1, 2, 3, 4]) AS round)),
d AS (SELECT event_id, min(round) AS settled_in, arg_min(s, round) AS s FROM r WHERE round <= 3 AND (s = 'not_applicable' OR (s = 'covered' AND has)) GROUP BY event_id),
f AS (SELECT event_id // 5 AS task_id, event_id AS fact_id, coalesce(s, 'missing_evidence') AS status, settled_in FROM events LEFT JOIN d USING (event_id))
SELECT *, max(coalesce(settled_in, 3)) OVER w AS rounds, CASE WHEN count(settled_in) OVER w = count(*) OVER w THEN 'success' WHEN count(settled_in) OVER w > 0 THEN 'partial' ELSE 'not_found' END AS search_status FROM f WINDOW w AS (PARTITION BY task_id)"""


def next_rounds(spark, sf_dir):
    """What the loop does after its second round."""
    e = _events(spark, sf_dir)
    status = lambda k: e.select((F.col("event_id") / 5).cast("long").alias("task_id"), F.when(F.col("event_id") % k == 0, "missing_evidence").otherwise("covered").alias("status"))
    return C.next_round(status(3), status(4), 2)


QUERIES["next_rounds"] = next_rounds
ORACLES["next_rounds"] = """WITH p AS (SELECT event_id // 5 AS task_id, count(*) FILTER (event_id % 4 = 0) AS pending, count(*) FILTER (event_id % 3 = 0) AS before FROM events GROUP BY ALL)
SELECT task_id, pending, CASE WHEN pending = 0 THEN 'stop_covered' WHEN pending < before THEN 'retry_progress' ELSE 'retry' END AS decision FROM p"""


def decision_gate(spark, sf_dir):
    """The other loop's decision on each task."""
    e = _events(spark, sf_dir)
    task, chunk = (F.col("event_id") / 3).cast("long").alias("task_id"), F.concat(F.lit("K"), F.col("event_id").cast("string")).alias("chunk_id")
    span = F.when(F.col("event_id") % 8 == 1, F.lit("…")).otherwise(F.col("event_type"))
    coverage = e.filter("event_id % 10 <> 0").select(task, F.col("event_id").alias("fact_id"), F.when(F.col("event_id") % 4 == 0, " Missing_Evidence").otherwise("covered").alias("status"), chunk, span.alias("support_span"))
    shown = e.select(task, chunk, F.concat(F.lit("Sự kiện "), F.upper("event_type")).alias("text"), (F.col("event_id") % 9 == 2).alias("excluded"))
    late = e.filter("event_id % 50 = 0").select(task)
    facts = e.select(task, F.col("event_id").alias("fact_id"))
    return P.gate(facts, coverage, shown, late, retry_count=1, max_retries=2)


QUERIES["decision_gate"] = decision_gate
ORACLES["decision_gate"] = """WITH s AS (SELECT event_id // 3 AS task_id, event_id % 50 = 0 AS late, event_id % 10 <> 0 AND event_id % 4 = 0 AS missing, event_id % 10 = 0 OR (event_id % 4 <> 0 AND (event_id % 8 = 1 OR event_id % 9 = 2)) AS invalid FROM events),
c AS (SELECT task_id, bool_or(late) AS late, count(*) FILTER (missing) AS missing, count(*) FILTER (invalid) AS invalid FROM s GROUP BY task_id)
SELECT task_id, missing, invalid, CASE WHEN late THEN 'stop' WHEN invalid > 0 THEN 'reevaluate' WHEN missing > 0 THEN 'retry' ELSE 'pass' END AS decision FROM c"""


def searcher_statuses(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1).alias("failed"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 2).alias("captured"))
    return P.searcher_status(rows).select("event_id", "search_status")


QUERIES["searcher_statuses"] = searcher_statuses
ORACLES["searcher_statuses"] = "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN 'retrieved' WHEN event_id % 2 = 1 THEN 'retrieved_partial' ELSE 'error' END AS search_status FROM events"


def accumulated_candidates(spark, sf_dir):
    """Candidates of all rounds, of which a later one takes the place of an earlier one."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_type").alias("point_id"), F.col("event_id").alias("round"), "value")
    return C.accumulate(rows).select("task_id", "point_id", "round", "value")


QUERIES["accumulated_candidates"] = accumulated_candidates
ORACLES["accumulated_candidates"] = "SELECT user_id AS task_id, event_type AS point_id, max(event_id) AS round, arg_max(value, event_id) AS value FROM events GROUP BY ALL"


def deduped_candidates(spark, sf_dir):
    """Candidates by provision and version; without a key by their chunk."""
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("user_id") % 4 > 0, F.col("user_id").cast("string")).otherwise(" ").alias("provision_key"), F.col("event_type").alias("chunk_id"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 2).cast("int")).alias("version"), F.col("event_id").alias("position"))
    return C.dedupe_candidates(rows).select("event_id")


QUERIES["deduped_candidates"] = deduped_candidates
ORACLES["deduped_candidates"] = "SELECT min(event_id) AS event_id FROM events GROUP BY CASE WHEN user_id % 4 > 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END, CASE WHEN event_id % 3 > 0 THEN event_id % 2 ELSE 1 END"


def plan_differences(spark, sf_dir):
    """Task ids that only one of two plans of a case has; and which tasks of a plan are kept."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), (F.col("event_id") % 11).alias("task_id"))
    return C.same_tasks(e.filter("task_id % 2 = 0"), e.filter("task_id % 3 = 0"))


QUERIES["plan_differences"] = plan_differences
ORACLES["plan_differences"] = "SELECT DISTINCT user_id AS case_id, event_id % 11 AS task_id FROM events WHERE (event_id % 11 % 2 = 0) <> (event_id % 11 % 3 = 0)"


def planned_tasks(spark, sf_dir):
    """The first three tasks of a case, after comparisons have been expanded."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), (F.col("event_id") / 2).cast("long").alias("position"), (F.col("event_id") % 2).alias("branch"))
    return C.plan_tasks(rows).filter("not dropped").select("case_id", "position", "branch", F.col("step").cast("long").alias("step"))


QUERIES["planned_tasks"] = planned_tasks
ORACLES["planned_tasks"] = "SELECT user_id AS case_id, event_id // 2 AS position, event_id % 2 AS branch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events QUALIFY step <= 3"


def plan_fallback(spark, sf_dir):
    """Plans as JSON, in fences, broken or empty; a question without a usable plan is its own only step."""
    o = read(spark, sf_dir, "orders")
    question = F.concat(F.lit("câu "), F.col("o_orderkey").cast("string")).alias("question")
    kinds = F.array(F.lit('[{"question": " a "}, {"question": "b"}]'), F.lit('```json\n[{"question": "c"}, {"question": " "}]\n```'), F.lit("không"), F.lit("[]"))
    plans = o.filter("o_orderkey % 5 < 4").select(F.col("o_orderkey").alias("case_id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("plan"))
    out = P.plan_or_fallback(o.select(F.col("o_orderkey").alias("case_id"), question), plans)
    return out.select("case_id", "fallback", F.col("position").cast("int").alias("position"), "step_question")


QUERIES["plan_fallback"] = plan_fallback
ORACLES["plan_fallback"] = """SELECT o_orderkey AS case_id, o_orderkey % 5 > 1 AS fallback, position, CASE WHEN o_orderkey % 5 > 1 THEN 'câu ' || o_orderkey WHEN o_orderkey % 5 = 1 THEN 'c' ELSE ['a', 'b'][position] END AS step_question
FROM orders, (SELECT unnest([1, 2]) AS position) WHERE position = 1 OR o_orderkey % 5 = 0"""


def workflow_memory(spark, sf_dir):
    """Steps of users' plans; one asked before in the same scope uses the earlier result."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), F.col("event_type").alias("task"), F.to_date("ts").cast("string").alias("scope_key"), F.col("event_id").alias("position"))
    return P.workflow_memory(rows).select("position", "computed_by", "reused")


QUERIES["workflow_memory"] = workflow_memory
ORACLES["workflow_memory"] = "SELECT event_id AS position, min(event_id) OVER w AS computed_by, event_id > min(event_id) OVER w AS reused FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(ts AS DATE))"

# ---- projections ------------------------------------------------------------------------------------


def chunk_projection(spark, sf_dir):
    """Points as chunks and as evidence: whole text where there is one, title with its id, key built where it is missing, identity without parts."""
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("document_id"), F.concat(F.lit("Điều "), F.col("l_linenumber").cast("string")).alias("location_label"), F.col("l_shipdate").cast("date").alias("valid_from"),
        F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "R", "toàn văn").alias("provision_content"), F.lit("một phần").alias("original_content"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("K|SUBCHUNK|"), F.col("l_partkey").cast("string"))).when(F.col("l_partkey") % 3 == 1, "K").alias("provision_key"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(4)).alias("version"),
    )
    return C.as_evidence(rows).select("l_orderkey", "l_linenumber", "title", "text", "provision_key", "version_id")


QUERIES["chunk_projection"] = chunk_projection
ORACLES["chunk_projection"] = """SELECT l_orderkey, l_linenumber, l_orderkey || ' (' || l_orderkey || ')' AS title, CASE WHEN l_returnflag = 'R' THEN 'toàn văn' ELSE 'một phần' END AS text,
CASE WHEN l_partkey % 3 = 2 THEN l_orderkey || '|Điều ' || l_linenumber ELSE 'K' END AS provision_key, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_partkey % 3 = 2 THEN l_orderkey || '|Điều ' || l_linenumber ELSE 'K' END || '|V4' END AS version_id FROM lineitem"""


def evidence_order(spark, sf_dir):
    """Evidence in the order of the step that first saw it, then title, then place."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("first_seen_step"), F.col("l_returnflag").alias("title"), F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("location_label"))
    return C.evidence_order(rows).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "location_label"))), lambda x: x["location_label"]), ",").alias("places"))


QUERIES["evidence_order"] = evidence_order
ORACLES["evidence_order"] = "SELECT l_orderkey AS case_id, string_agg(l_partkey || '|' || l_suppkey, ',' ORDER BY l_linenumber, l_returnflag, l_partkey || '|' || l_suppkey) AS places FROM lineitem GROUP BY l_orderkey"


def evidence_blocks(spark, sf_dir):
    """Chunks as labelled lines, in order, as one context a case."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("position"), F.col("l_partkey").cast("string").alias("chunk_id"), F.col("l_returnflag").alias("text"))
    return C.context_block(rows, [("chunk_id", "chunk_id"), ("nội dung", "text")]).select("case_id", F.md5(F.col("block").cast("binary")).alias("digest"))


QUERIES["evidence_blocks"] = evidence_blocks
ORACLES["evidence_blocks"] = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey AS case_id, md5(string_agg('[' || n || ']' || chr(10) || 'chunk_id: ' || l_partkey || chr(10) || 'nội dung: ' || l_returnflag, chr(10) || chr(10) ORDER BY n)) AS digest FROM n GROUP BY l_orderkey"""


def json_rows(spark, sf_dir):
    """Rows as JSON with all their fields, nulls and nested ones included."""
    row = F.struct("event_id", F.struct("event_type", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user")).alias("who"), F.array("user_id").alias("all"))
    return _events(spark, sf_dir).select("event_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("j"))


QUERIES["json_rows"] = json_rows
ORACLES["json_rows"] = """SELECT event_id, '{"event_id":' || event_id || ',"who":{"event_type":"' || event_type || '","user":' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'null' END || '},"all":[' || user_id || ']}' AS j FROM events"""


def required_facts(spark, sf_dir):
    """Facts of all steps of a plan, in order, each once."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), F.col("event_id").alias("position"), F.array("event_type", F.when(F.col("event_id") % 4 == 0, "thêm")).alias("facts"))
    return C.required_facts(rows).select("case_id", F.array_join("facts", ",").alias("facts"))


QUERIES["required_facts"] = required_facts
ORACLES["required_facts"] = """WITH f AS (SELECT user_id AS case_id, event_id * 2 AS p, event_type AS f FROM events UNION ALL SELECT user_id, event_id * 2 + 1, 'thêm' FROM events WHERE event_id % 4 = 0), m AS (SELECT case_id, f, min(p) AS p FROM f GROUP BY ALL)
SELECT case_id, string_agg(f, ',' ORDER BY p) AS facts FROM m GROUP BY case_id"""

# ---- evaluation --------------------------------------------------------------------------------------


def evidence_scores(spark, sf_dir):
    """Share of useful contexts, and how many gold provisions the evidence meets: by version where both name one, else by provision."""
    e = _events(spark, sf_dir)
    contexts = e.select(F.col("user_id").alias("case_id"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5 == 1).alias("useful"))
    evidence = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("provision_key"), F.when(F.col("event_id") % 2 == 0, F.concat_ws("|", "event_type", (F.col("event_id") % 3).cast("string"))).alias("version_id"))
    gold = read(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("provision_key"), F.when(F.col("event_id") % 20 == 0, F.concat_ws("|", "event_type", F.lit("1"))).alias("version_id"), F.col("event_id").alias("gold_id"))
    met = E.match_evidence(evidence, gold).groupBy("case_id").agg(F.countDistinct("gold_id").alias("met"), F.count(F.lit(1)).alias("pairs"))
    return E.evidence_precision(contexts).join(met, "case_id", "left").select("case_id", F.round("evidence_precision", 6).alias("evidence_precision"), F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


QUERIES["evidence_scores"] = evidence_scores
ORACLES["evidence_scores"] = """WITH p AS (SELECT user_id AS case_id, avg((event_id % 5 = 1)::INT) AS ep FROM events GROUP BY ALL),
ev AS (SELECT user_id AS case_id, event_type AS k, CASE WHEN event_id % 2 = 0 THEN event_type || '|' || (event_id % 3) END AS v FROM events),
g AS (SELECT user_id AS case_id, event_type AS k, CASE WHEN event_id % 20 = 0 THEN event_type || '|1' END AS v, event_id FROM events WHERE event_id % 10 = 0),
m AS (SELECT case_id, count(DISTINCT g.event_id) AS met, count(*) AS pairs FROM ev JOIN g USING (case_id) WHERE CASE WHEN ev.v IS NOT NULL AND g.v IS NOT NULL THEN ev.v = g.v ELSE ev.k = g.k END GROUP BY case_id)
SELECT case_id, round(ep, 6) AS evidence_precision, coalesce(met, 0) AS met, coalesce(pairs, 0) AS pairs FROM p LEFT JOIN m USING (case_id)"""


def pools_and_failures(spark, sf_dir):
    """Candidates of a method over all branches, and steps that failed."""
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("method"), F.col("user_id").alias("point_id"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 11 == 0, "hỏng").alias("error"))
    failed = E.failed_steps(rows).groupBy("method").agg(F.count(F.lit(1)).alias("failed"))
    return E.pool_sizes(rows, ["method"]).join(failed, "method", "left").select("method", "pool", "listed", F.coalesce("failed", F.lit(0)).alias("failed"))


QUERIES["pools_and_failures"] = pools_and_failures
ORACLES["pools_and_failures"] = "SELECT event_type AS method, count(DISTINCT user_id) AS pool, count(*) AS listed, count(*) FILTER (event_id % 9 = 0 OR (event_id % 11 = 0 AND event_id % 7 <> 0)) AS failed FROM events GROUP BY event_type"


def _lists(spark, sf_dir):
    """A lexical and a dense ranking for every benchmark item: of all documents, and of those that have a vector; the item's own vector is that of its number."""
    queries = settle(_items(spark, sf_dir))
    docs = _documents(spark, sf_dir)
    lexical = settle(R.bm25(docs, queries).select("query_id", "doc_id", "rank"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    points = docs.select("doc_id").join(vectors, F.col("doc_id") == F.col("vec_id")).select("doc_id", "embedding")
    asked = queries.select("query_id").join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    dense = settle(R.dense(points, asked).select("query_id", "doc_id", "rank"))
    passages = docs.select("doc_id", P.rerank_passage(F.col("text"), F.lit("")).alias("passage"))
    return dense, lexical, passages, queries


_LISTS_SQL = f"""{TOPK_SQL},
lex AS (SELECT query_id, doc_id, rank FROM lexical WHERE score > 0),
den AS (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) DESC, p.vec_id) AS rank
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings p JOIN documents ON doc_id = p.vec_id QUALIFY rank <= 20),
fus AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) DESC, d.rank NULLS LAST, l.rank NULLS LAST) AS rank FROM den d FULL JOIN lex l USING (query_id, doc_id)),
qt AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS q FROM benchmark),
sc AS (SELECT query_id, doc_id, rank, len(list_intersect(q, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''))) / greatest(len(q), 1) AS s FROM fus JOIN documents USING (doc_id) JOIN qt USING (query_id)),
rer AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM sc)"""


def four_configurations(spark, sf_dir):
    """The first five of four rankings, made of one dense and one lexical retrieval."""
    out = P.configurations(*_lists(spark, sf_dir))
    return out.select("method", "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "pool")


QUERIES["four_configurations"] = four_configurations
_FOUR_SQL = f"""{_LISTS_SQL}, al AS (SELECT 'dense' AS method, query_id, doc_id, rank FROM den UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM lex UNION ALL SELECT 'hybrid_rrf', query_id, doc_id, rank FROM fus UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, rank FROM rer),
four AS (SELECT *, count(*) OVER (PARTITION BY method, query_id) AS pool FROM al QUALIFY rank <= 5)"""
ORACLES["four_configurations"] = f"WITH {_FOUR_SQL} SELECT * FROM four"


def hybrid_rerank(spark, sf_dir):
    """Standard retrieval: fused candidates by pair score."""
    out = P.hybrid_rerank(*_lists(spark, sf_dir))
    return out.select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


QUERIES["hybrid_rerank"] = hybrid_rerank
ORACLES["hybrid_rerank"] = f"WITH {_LISTS_SQL} SELECT query_id, doc_id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM sc WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) <= 5"


def vector_only(spark, sf_dir):
    """Dense retrieval alone, of the first five."""
    return R.dense(*_vectors(spark, sf_dir), k=5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


QUERIES["vector_only"] = vector_only
ORACLES["vector_only"] = f"WITH {DENSE_SQL} SELECT query_id, doc_id, rank FROM dense WHERE rank <= 5"


def configuration_scores(spark, sf_dir):
    """The four configurations' scores on every item, whose documents of a good label are relevant; two branches of a case are read one after another."""
    four = P.configurations(*_lists(spark, sf_dir))
    ranked = four.select("method", F.col("query_id").alias("case_id"), (F.col("doc_id") % 2).alias("branch"), F.col("rank").alias("position"), F.col("doc_id").cast("string").alias("ident"))
    qrels = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("ident"), F.col("quality").alias("relevance"))
    out = P.evaluate_methods(ranked, qrels)
    return out.select("method", "case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg")])


QUERIES["configuration_scores"] = configuration_scores
ORACLES["configuration_scores"] = f"""WITH {_FOUR_SQL},
rk AS (SELECT method, query_id AS case_id, doc_id, row_number() OVER (PARTITION BY method, query_id ORDER BY doc_id % 2, rank) AS p FROM four),
gold AS (SELECT c.case_id, doc_id, max(quality) AS rel FROM labels, (SELECT item_id AS case_id FROM benchmark) c GROUP BY ALL HAVING max(quality) > 0),
hit AS (SELECT method, rk.case_id, p, coalesce(rel, 0) AS rel FROM rk LEFT JOIN gold USING (case_id, doc_id)),
seen AS (SELECT method, case_id, count(*) AS n, count(*) FILTER (rel > 0) AS found, sum((2 ** rel - 1) / log2(p + 1)) AS dcg FROM hit GROUP BY ALL),
many AS (SELECT case_id, count(*) AS gold FROM gold GROUP BY case_id),
best AS (SELECT method, case_id, sum(1 / log2(k + 1)) AS idcg FROM (SELECT method, case_id, unnest(range(1, least(n, gold) + 1)) AS k FROM seen JOIN many USING (case_id)) GROUP BY ALL)
SELECT method, case_id, round(coalesce(found / gold, 0), 6) AS recall, round(found / n, 6) AS precision, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM seen LEFT JOIN many USING (case_id) LEFT JOIN best USING (method, case_id)"""


def branch_traces(spark, sf_dir):
    """Traces of two branches as one bag, and their sizes."""
    e = _events(spark, sf_dir).select("user_id", "event_type")
    return P.branch_traces([e.filter("user_id % 2 = 0"), e]).groupBy("branch", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("branch").cast("int").alias("branch"), "event_type", "n")


QUERIES["branch_traces"] = branch_traces
ORACLES["branch_traces"] = "SELECT 1 AS branch, event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY ALL UNION ALL SELECT 2, event_type, count(*) FROM events GROUP BY ALL"


def resumed_run(spark, sf_dir):
    """A run that goes on where an earlier one stopped: finished cases, and those to do with their simulated response."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("position"))
    finished, outputs = o.filter("case_id % 4 = 0"), o.filter("case_id % 6 = 0").withColumn("status", F.lit("new"))
    responses = o.filter("case_id % 5 = 0").select("case_id", F.concat(F.lit("r"), F.col("case_id").cast("string")).alias("response"), "position")
    done, todo = P.run_evaluation(o.select("case_id"), finished, outputs, responses)
    return done.select("case_id", F.lit("done").alias("what"), F.col("status").alias("value")).unionByName(todo.select("case_id", F.lit("todo").alias("what"), F.col("response").alias("value")))


QUERIES["resumed_run"] = resumed_run
ORACLES["resumed_run"] = """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 THEN 'done' ELSE 'todo' END AS what, CASE WHEN o_orderkey % 6 = 0 THEN 'new' WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN 'r' || o_orderkey END AS value FROM orders"""
