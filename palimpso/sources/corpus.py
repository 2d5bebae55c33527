"""A corpus that is kept up by steps: only new and changed documents are worked on, and a run that broke off goes on where it stopped.

Below the corpus's folder every run has one of its own: ``todo``, the documents it has to work on with their fingerprints, and a table for each step.  A
step is finished when Spark has committed its table, and a run when it has its ``finished`` table.  A run that isn't finished is taken up again with its own ``todo``
and the steps it has; only then a new one begins.  A document's rows are those of the last finished run that had it.  Nothing is ever overwritten, so readers
of an older run aren't disturbed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import settle
from .artifacts import _exists

STATE = "document_id string, fingerprint string, removed boolean"
Step = tuple[str, Callable[[DataFrame], DataFrame]]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``document_id`` and a digest of all columns; a missing value differs from an empty one."""
    return docs.select("document_id", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(docs.columns)]), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def _runs(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return sorted(int(s.getPath().getName().removeprefix("run=")) for s in system.listStatus(where) if s.getPath().getName().startswith("run="))


def _done(spark: SparkSession, folder: str) -> bool:
    return _exists(spark, f"{folder}/_SUCCESS")


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last finished run of every document: ``document_id``, ``fingerprint``, ``removed``, ``run``."""
    rows = None
    for run in _runs(spark, path):
        if _done(spark, f"{path}/run={run}/finished"):
            one = spark.read.schema(STATE).parquet(f"{path}/run={run}/todo").withColumn("run", F.lit(run))
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], f"{STATE}, run int")
    return rows.groupBy("document_id").agg(F.max_by(F.struct("fingerprint", "removed", "run"), "run").alias("r")).select("document_id", "r.*")


def pending(docs: DataFrame, path: str) -> DataFrame:
    """Documents that are new or changed, and (``removed``) those that are there no more."""
    spark = docs.sparkSession
    known = state(spark, path).filter("not removed")
    now = fingerprints(docs)
    changed = now.join(known.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti").withColumn("removed", F.lit(False))
    gone = known.join(now.select("document_id"), "document_id", "left_anti").select("document_id", "fingerprint", F.lit(True).alias("removed"))
    return changed.unionByName(gone)


def update(docs: DataFrame, path: str, steps: list[Step]) -> dict[str, int]:
    """Work off what is pending: the number of documents done and removed (0 and 0 if nothing changed).

    ``docs`` has ``document_id``, once each.  The first step gets the documents, each other one the table of the step before; every table has ``document_id``.
    """
    spark = docs.sparkSession
    runs = _runs(spark, path)
    open_run = runs[-1] if runs and not _done(spark, f"{path}/run={runs[-1]}/finished") else None
    if open_run is not None and _done(spark, f"{path}/run={open_run}/todo"):
        run = open_run  # documents that have changed since then are the next run's
    else:
        todo = settle(pending(docs, path))
        if todo.isEmpty():
            return {"done": 0, "removed": 0}
        run = runs[-1] + 1 if runs else 0
        todo.write.mode("overwrite").parquet(f"{path}/run={run}/todo")
    todo = spark.read.schema(STATE).parquet(f"{path}/run={run}/todo")
    # what the run set out to do and still is so
    now = fingerprints(docs).join(todo.filter("not removed").select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_semi").select("document_id")
    rows = docs.join(now, "document_id", "left_semi")
    for name, step in steps:
        folder = f"{path}/run={run}/{name}"
        if not _done(spark, folder):
            step(rows).write.mode("overwrite").parquet(folder)
        rows = spark.read.parquet(folder)
    counts = todo.agg(F.count_if(~F.col("removed")).alias("done"), F.count_if("removed").alias("removed"))
    counts.write.mode("overwrite").parquet(f"{path}/run={run}/finished")
    return spark.read.parquet(f"{path}/run={run}/finished").first().asDict()


def table(spark: SparkSession, path: str, step: str) -> DataFrame:
    """A step's rows of all documents that are there, each of its last run."""
    last = state(spark, path).filter("not removed")
    out = None
    for run in _runs(spark, path):
        if _done(spark, f"{path}/run={run}/finished"):
            rows = spark.read.parquet(f"{path}/run={run}/{step}").join(last.filter(F.col("run") == run).select("document_id"), "document_id", "left_semi")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no run of {path} is finished")
    return out
