"""Cuts a plan where it would otherwise be computed, and planned, again and again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the setting is absent and everything runs on one machine (tests);
    on a cluster its absence is an error, as every executor would write to a disk of its own.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="palimpso-")
        spark.conf.set(CHECKPOINT_DIR, path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the folder that driver and executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for what is computed in this block, and as they were after it."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Compute ``df`` once and keep it as Parquet in the shared folder: for tables of some size, packed and read by column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, {CLEANUP: "true"}):  # nothing reads this query's shuffles again
        df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
