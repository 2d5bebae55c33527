"""Shared-folder tables and session settings for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir

ROWS_A_FILE = 5_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; nothing is reused between calls."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders written by ``materialize`` and not yet discarded, by the application that wrote them and whom they belong to.
_written: dict[tuple[str, str], list[str]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


@contextlib.contextmanager
def owned(by: str):
    """Tables written in this block belong to ``by``, and only ``discard_all(spark, by)`` deletes them all."""
    token = _owner.set(by)
    try:
        yield
    finally:
        _owner.reset(token)


def materialize(df: DataFrame, name: str, at_most: int | None = None, by: str | None = None, level: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    With a bound on its rows, a small table is written in few files; with ``by``, in a folder for each value of that column; with a ``level`` of zstd whole texts are packed tighter.
    """
    spark = df.sparkSession
    if at_most is not None and (n := max(1, -(-at_most // ROWS_A_FILE))) < shuffle_width(spark):
        df = df.coalesce(n)
    path = work_dir(spark, name)
    # nothing reads this query's shuffles again; and small batches keep Python workers small
    wanted = {CLEANUP: "true", BATCH: str(BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level) if level else df.write
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    at = spark.sparkContext.applicationId, _owner.get()
    _written.setdefault(at, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to, out._owned_by = path, at
    return out


def carry(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``row``: the columns to keep (all, by default) as one struct, so that their names can't clash with others; and ``text``, unless the row has it."""
    names = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    return docs.select(row) if text in names else docs.select(row, F.col(text).alias("text"))


def text_of(batch, text: str):
    """The text column of a batch made by ``carry``; it crosses to Python once."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later result reads."""
    for t in tables:
        own = _written.get(getattr(t, "_owned_by", None), [])
        if (path := getattr(t, "_written_to", None)) in own:
            own.remove(path)
            remove(path, t.sparkSession)


def discard_all(spark: SparkSession, owner: str = "") -> None:
    """Delete every table of this application that belongs to ``owner``; only between steps whose results have been written elsewhere."""
    for path in _written.pop((spark.sparkContext.applicationId, owner), []):
        remove(path, spark)


def remove(path: str, spark: SparkSession) -> None:
    """Delete a folder below the shared one through the file system that Spark itself uses."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
