"""Queries about time: selection, chains, amendments' bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import temporal as T
from ..operators import versions as V
from .tables import VERSIONS_SQL, read, versions

AS_OF = "2024-01-20"


def _scopes(spark, *scopes: str):
    """Compiled scopes from JSON objects, numbered from 1."""
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(scopes, 1)], "scope_id long, j string")
    parsed = rows.select("scope_id", F.from_json("j", schemas.SCOPE).alias("scope"), F.lit(AS_OF).cast("date").alias("as_of"))
    flat = T.expand_scopes(parsed)
    return flat.select("scope_id", "branch", "label", F.col("range.type").alias("kind"), F.col("range.from").alias("low"), F.col("range.to").alias("high"))


def _selected(scope: str):
    def query(spark, sf_dir):
        rows = V.select_versions(versions(spark, sf_dir), _scopes(spark, scope))
        return rows.select("provision_key", F.col("version").cast("long").alias("version"), "valid_from", "valid_to")

    return query


def _selected_sql(low: str, high: str, point: bool) -> str:
    hit = f"SELECT * FROM vers WHERE (valid_to IS NULL OR valid_to > valid_from) AND valid_from <= DATE '{high}' AND (valid_to IS NULL OR valid_to > DATE '{low}')"
    newest = "QUALIFY version = max(version) OVER (PARTITION BY provision_key)" if point else ""
    return f"WITH {VERSIONS_SQL}, hit AS ({hit}) SELECT provision_key, version, valid_from, valid_to FROM hit {newest}"


SCOPES = {
    "asof_versions": ('{"type":"exact_date","date":"2024-01-15"}', "2024-01-15", "2024-01-15", True),
    "current_versions": ('{"type":"current"}', AS_OF, AS_OF, True),
    "range_versions": ('{"type":"date_range","from":{"granularity":"day","value":"2024-01-10"},"to":{"granularity":"day","value":"2024-01-12"}}', "2024-01-10", "2024-01-12", False),
    "open_range_versions": ('{"type":"date_range","from":{"granularity":"month","value":"2023-12"},"to":{"granularity":"current","value":"current"}}', "2023-12-01", AS_OF, False),
    "month_scope": ('{"type":"month","month":1,"year":2024}', "2024-01-01", "2024-01-31", False),
    "year_scope": ('{"type":"year","year":2024}', "2024-01-01", "2024-12-31", False),
}
QUERIES = {name: _selected(v[0]) for name, v in SCOPES.items()}
ORACLES = {name: _selected_sql(*v[1:]) for name, v in SCOPES.items()}


def comparison_expand(spark, sf_dir):
    both = '{"type":"comparison","comparison_scopes":[{"type":"exact_date","date":"2024-01-05","label":"first"},{"type":"year","year":2024}]}'
    rows = V.select_versions(versions(spark, sf_dir), _scopes(spark, both).withColumn("scope_id", F.col("branch").cast("long")))
    key = T.scope_key(F.struct(F.col("kind").alias("type"), F.col("low").alias("from"), F.col("high").alias("to")))
    return rows.groupBy(F.col("branch").cast("long").alias("branch"), "label", key.alias("scope_key")).agg(F.count(F.lit(1)).alias("n_versions"))


QUERIES["comparison_expand"] = comparison_expand
ORACLES["comparison_expand"] = f"""WITH {VERSIONS_SQL},
scopes AS (SELECT unnest([1, 2]) AS branch, unnest(['first', 'Mốc 2']) AS label, unnest(['exact_date', 'year']) AS kind, unnest([DATE '2024-01-05', DATE '2024-01-01']) AS low, unnest([DATE '2024-01-05', DATE '2024-12-31']) AS high),
hit AS (SELECT * FROM vers JOIN scopes ON (valid_to IS NULL OR valid_to > valid_from) AND valid_from <= high AND (valid_to IS NULL OR valid_to > low)
  QUALIFY kind = 'year' OR version = max(version) OVER (PARTITION BY branch, provision_key))
SELECT CAST(branch AS BIGINT) AS branch, label, kind || '|' || low || '|' || high AS scope_key, count(*) AS n_versions FROM hit GROUP BY ALL"""


def many_scopes(spark, sf_dir):
    """One day of every event as a scope of its own: too many scopes to be sent around, so years are matched."""
    days = read(spark, sf_dir, "events").select(F.col("event_id").alias("scope_id"), F.lit("exact_date").alias("kind"), F.to_date("ts").alias("low"), F.to_date("ts").alias("high"), "user_id")
    own = days.groupBy("low").agg(F.min("scope_id").alias("scope_id")).select("scope_id", F.lit("exact_date").alias("kind"), "low", F.col("low").alias("high"))
    rows = V.newest_in_points(V.join_scopes(versions(spark, sf_dir), own, broadcast_rows=0))
    return rows.groupBy("low").agg(F.count(F.lit(1)).alias("in_force"), F.sum(F.col("version").cast("long")).alias("versions"))


QUERIES["many_scopes"] = many_scopes
ORACLES["many_scopes"] = f"""WITH {VERSIONS_SQL}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS low FROM events),
hit AS (SELECT * FROM vers JOIN days ON (valid_to IS NULL OR valid_to > valid_from) AND valid_from <= low AND (valid_to IS NULL OR valid_to > low) QUALIFY version = max(version) OVER (PARTITION BY low, provision_key))
SELECT low, count(*) AS in_force, CAST(sum(version) AS BIGINT) AS versions FROM hit GROUP BY low"""


def empty_intervals_excluded(spark, sf_dir):
    rows = versions(spark, sf_dir)
    found = V.join_scopes(rows, _scopes(spark, SCOPES["year_scope"][0]))
    return rows.join(found.select("version_id"), "version_id", "left_anti").select("provision_key", F.col("version").cast("long").alias("version"), "valid_from", "valid_to")


QUERIES["empty_intervals_excluded"] = empty_intervals_excluded
ORACLES["empty_intervals_excluded"] = f"WITH {VERSIONS_SQL} SELECT provision_key, version, valid_from, valid_to FROM vers WHERE valid_to <= valid_from"


def multi_version_audit(spark, sf_dir):
    """With ends taken away, every earlier version of a key seems to be in force: the audit has to find them."""
    open_ended = versions(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("date"))
    rows = V.join_scopes(open_ended, _scopes(spark, SCOPES["asof_versions"][0]))
    return V.scope_violations(rows).select("provision_key", "problem")


QUERIES["multi_version_audit"] = multi_version_audit
ORACLES["multi_version_audit"] = f"WITH {VERSIONS_SQL} SELECT provision_key, 'several' AS problem FROM vers WHERE valid_from <= DATE '2024-01-15' GROUP BY provision_key HAVING count(DISTINCT version) > 1"


def version_chain(spark, sf_dir):
    return versions(spark, sf_dir).select("event_id", "version_id", "previous_version_id", "superseded_by_version_id", "is_latest", "valid_to")


QUERIES["version_chain"] = version_chain
ORACLES["version_chain"] = f"""WITH {VERSIONS_SQL}, ids AS (SELECT *, provision_key || '|V' || version AS version_id FROM vers)
SELECT event_id, version_id, lag(version_id) OVER w AS previous_version_id, lead(version_id) OVER w AS superseded_by_version_id, lead(version_id) OVER w IS NULL AS is_latest, valid_to
FROM ids WINDOW w AS (PARTITION BY provision_key ORDER BY version)"""


def snapshot_upsert(spark, sf_dir):
    """Open versions closed on one day and written over the old rows; idempotent by id."""
    rows = versions(spark, sf_dir).select("version_id", "valid_to", "is_latest")
    closed = rows.filter("is_latest").select("version_id", F.lit("2024-02-01").cast("date").alias("valid_to"), F.lit(False).alias("is_latest"))
    return V.upsert(V.patch(rows, closed, "version_id"), closed, "version_id")


QUERIES["snapshot_upsert"] = snapshot_upsert
ORACLES["snapshot_upsert"] = f"WITH {VERSIONS_SQL} SELECT provision_key || '|V' || version AS version_id, coalesce(valid_to, DATE '2024-02-01') AS valid_to, false AS is_latest FROM (SELECT *, lead(version) OVER (PARTITION BY provision_key ORDER BY version) AS nxt FROM vers)"


def ops_replay_order(spark, sf_dir):
    from pyspark.sql import Window

    ops = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("operation_id"), "o_custkey", F.to_date("o_orderdate").alias("effective_date"), F.when(F.col("o_orderstatus") == "O", F.to_date("o_orderdate")).alias("source_issued_date"))
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*V.replay_order(ops)))
    return ops.select("operation_id", F.col("o_custkey").alias("document"), order.cast("long").alias("replay_no"))


QUERIES["ops_replay_order"] = ops_replay_order
ORACLES["ops_replay_order"] = """SELECT CAST(o_orderkey AS VARCHAR) AS operation_id, o_custkey AS document,
row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) ELSE DATE '9999-12-31' END, CAST(o_orderkey AS VARCHAR)) AS replay_no FROM orders"""


def ops_not_applied(spark, sf_dir):
    ops = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("operation_id"), "o_custkey")
    done = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("applied_operation_ids"))
    return V.not_applied(ops, done)


QUERIES["ops_not_applied"] = ops_not_applied
ORACLES["ops_not_applied"] = "SELECT o_orderkey AS operation_id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def _effects(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("target_document_id"),
        F.col("l_suppkey").cast("string").alias("source"),
        F.when(F.col("l_returnflag") == "R", "whole_document").otherwise("partial").alias("impact_scope"),
        F.array(F.when(F.col("l_linestatus") == "F", "thay_the").otherwise("sua_doi")).alias("relation_types"),
        F.to_date("l_shipdate").alias("effective_date"),
    )


def whole_document_expiry(spark, sf_dir):
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_latest"), F.lit("active").alias("status"))
    return V.expire(docs, V.terminal_dates(_effects(spark, sf_dir)), F.lit("1995-01-01").cast("date")).select("document_id", "valid_to", "status", "is_latest")


QUERIES["whole_document_expiry"] = whole_document_expiry
ORACLES["whole_document_expiry"] = """WITH e AS (SELECT CAST(l_partkey AS VARCHAR) AS document_id, min(CAST(l_shipdate AS DATE)) AS ends_on FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS document_id, ends_on AS valid_to, CASE WHEN ends_on <= DATE '1995-01-01' THEN 'inactive' ELSE 'active' END AS status, true AS is_latest FROM part LEFT JOIN e ON e.document_id = CAST(p_partkey AS VARCHAR)"""


def inverse_relations(spark, sf_dir):
    e = _effects(spark, sf_dir)
    docs = e.groupBy(F.col("source").alias("document_id")).agg(F.collect_list(F.struct("target_document_id", "relation_types", "impact_scope", "effective_date", F.lit(None).cast("string").alias("status"))).alias("affects_documents"))
    sources = F.array_join(F.array_sort(F.array_distinct(F.transform("affected_by_documents", lambda x: x["source_document_id"]))), ",")
    return V.inverse_effects(docs).select("document_id", sources.alias("sources"), F.size("affected_by_documents").cast("long").alias("n_effects"))


QUERIES["inverse_relations"] = inverse_relations
ORACLES["inverse_relations"] = """WITH e AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS document_id, CAST(l_suppkey AS VARCHAR) AS s, l_returnflag = 'R' AS w, l_linestatus = 'F' AS f, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT document_id, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT s FROM e e2 WHERE e2.document_id = e.document_id)) AS sources, count(*) AS n_effects FROM e GROUP BY document_id"""


def temporal_off(spark, sf_dir):
    """The ablation: every version, whatever the scope."""
    rows = V.select_versions(versions(spark, sf_dir), _scopes(spark, SCOPES["asof_versions"][0]), temporal_off=True)
    return rows.groupBy("provision_key").agg(F.count(F.lit(1)).alias("n_versions"))


QUERIES["temporal_off"] = temporal_off
ORACLES["temporal_off"] = "SELECT user_id || '|' || event_type AS provision_key, count(*) AS n_versions FROM events GROUP BY 1"
