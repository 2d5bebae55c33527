"""Registry of the engine's queries on the driver's tables, each with its SQL oracle where SQL can say it.

The tables stand in for the corpus: ``events`` are versions of provisions (a key is a user and an event
type, a version ends where the next begins), ``lineitem`` rows are points of a document, ``documents`` and
``benchmark`` are texts and spans, ``embeddings`` the dense index, ``conversations`` the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import amend, evaluation, files, normalised, prose, runs, search, time, wording

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (time, amend, prose, wording, search, evaluation, runs, files, normalised):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
