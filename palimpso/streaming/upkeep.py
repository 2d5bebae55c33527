"""Amendments as a stream: each micro-batch makes the next snapshot of the versions (an extension; the batch form is ``apply_operations``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import apply_operations


def keep_versions(ops: DataFrame, snapshot: Callable[[int], DataFrame], commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``snapshot(n)`` reads the versions before batch ``n``, ``commit(df, n)`` writes those after it.

    Operations that are applied already are passed over, so a batch that is run again changes nothing.
    """

    def step(batch: DataFrame, n: int) -> None:
        commit(apply_operations(snapshot(n), batch), n)

    return ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
