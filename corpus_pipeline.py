"""A corpus pipeline: language ID, near duplicates, long repeats, benchmark passages, packing.

Each stage is a function of (spark, docs, sf_dir).  It works its result out in batches of few rows, writes it below the shared
folder and deletes the tables it worked with.  The caller writes that result as Parquet and reads it again as the next stage's
``docs``, so a stage begins by deleting the result of the stage before (tables of other queries stay).  All but the last
return the columns of ``documents``; other columns of its table, whatever their names, are not read.

* ``language_id`` drops documents without a letter and those too unlike every learned language;
* ``near_dedup`` keeps one document (the least id) of every group of texts that share 80 % of their
  five-word shingles, directly or through others;
* ``substring_dedup`` takes every sequence of 35 words or more that occurs elsewhere out of all texts, and
  drops documents of which nothing is left; texts without such a sequence stay as they are;
* ``decontaminate`` drops documents that share ten words in a row with a benchmark item (or hold a whole shorter one);
* ``pack`` returns the pieces of the packed sequences.

Null and empty texts go in the first stage; documents with a null id are judged by their text and kept by
``near_dedup``; rows that repeat an id stay together or go together; texts of any length are judged whole; an empty
table, or one of which a stage leaves nothing, gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpso.llm import decontaminate as contamination
from palimpso.llm import language_id as languages
from palimpso.llm import minhash, packing, substring
from palimpso.llm.common import discard_all, materialize, owned, work_dir

OWNER, WORKING = "pipeline", "pipeline at work"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_COSINE = 0.1


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage: its result is written here, as the caller's session would send Python all rows of a task at once; it and the tables worked with are the pipeline's."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_all(spark, OWNER)
        discard_all(spark, WORKING)  # of a stage that failed
        with owned(WORKING):
            found = work(spark, docs, sf_dir)
        with owned(OWNER):
            result = materialize(found, work.__name__)
        discard_all(spark, WORKING)
        return result

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = languages.fit(docs)
    found = languages.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("found.lang_pred") != languages.UND) & (F.col("found.score") >= MIN_COSINE)).select("row.*")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = minhash.NearDuplicates(docs, shingle=5, percent=80).groups()
    dropped = groups.filter("component_id is not null and doc_id != component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(docs, keep=list(COLUMNS))
    cut = F.col("rest.n_removed") > 0
    text = F.when(cut, F.col("rest.kept_text")).otherwise(F.col("row.text"))
    left = found.filter((F.col("rest.n_words") == 0) | (F.col("rest.n_removed") < F.col("rest.n_words")))
    n_chars = F.when(cut, F.length("rest.kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return left.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.find_contamination(docs.select(*COLUMNS), items)
    return found.filter(F.size("found.spans") == 0).select("row.*")


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: No SQL can express the stages; tests/llm holds them against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for name, work in STAGES[:-1]:
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
