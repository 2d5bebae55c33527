"""Inverted lists against all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpso.operators import retrieval as R
from palimpso.operators import vectors as V


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id) for r in df.select("query_id", "rank", "doc_id").collect())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 4
    x = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=16)]) for i in range(1_500)]
    x += [(5_000 + i, x[3][1]) for i in range(5)] + [(9_000, None)]  # ties, and a vector that isn't there
    return spark.createDataFrame(x, "doc_id long, embedding array<double>").repartition(6)


@pytest.fixture(scope="module")
def index(table):
    return V.Lists(table, n_lists=24)


@pytest.fixture(scope="module")
def queries(table):
    return table.filter("doc_id % 40 = 3 and embedding is not null").select(F.col("doc_id").alias("query_id"), "embedding")


def test_every_vector_is_indexed_once(table, index):
    assert index.table.count() == table.filter("embedding is not null").count() == index.sizes.sum()
    assert index.table.select("doc_id").distinct().count() == index.sizes.sum()


@pytest.mark.parametrize("block", [V.BLOCK_QUERIES, 7])
def test_exact_search_is_that_of_all_vectors(table, index, queries, block):
    known = rows(R.dense(table.filter("embedding is not null"), queries, 9))
    assert rows(index.search(queries, 9, exact=True, block=block)) == known
    assert rows(index.search(queries, 9, n_probes=24, block=block)) == known


def test_calibrated_probes_reach_the_recall_and_read_few_lists(table, index, queries):
    known = {(q, d) for q, _, d in rows(R.dense(table.filter("embedding is not null"), queries, 10))}
    n = index.calibrate(10)
    found = {(q, d) for q, _, d in rows(index.search(queries, 10))}
    assert len(known & found) >= 0.9 * len(known) and n <= 12
    plan = index.search(queries.limit(1), 10, n_probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]  # other lists' folders aren't read


def test_only_allowed_ids_are_found(spark, table, index, queries):
    allowed = table.filter("doc_id % 7 = 0").select("doc_id")
    known = rows(R.dense(table.filter("embedding is not null and doc_id % 7 = 0"), queries, 5))
    assert rows(index.search(queries, 5, exact=True, allowed=allowed)) == known
    assert rows(index.search(queries, 5, exact=True, allowed=allowed.limit(0))) == []


def test_few_and_no_vectors(spark, table, queries):
    one = V.Lists(table.filter("doc_id = 1"))
    assert rows(one.search(queries, 3, exact=True)) == rows(R.dense(table.filter("doc_id = 1"), queries, 3))
    none = V.Lists(table.limit(0))
    assert rows(none.search(queries, 3)) == rows(none.search(queries, 3, exact=True)) == []


def test_scores_worked_out_at_a_time_are_bounded(spark, monkeypatch):
    """Whatever the numbers of queries and vectors; and the rows are the same."""
    from palimpso.operators import vectors as W

    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(600)]
    points = spark.createDataFrame(rows, "doc_id long, embedding array<float>").coalesce(1)
    queries = points.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    found = lambda: sorted((r.query_id, r["rank"], r.doc_id) for r in W.dense(points, queries, 5).collect())
    probed = lambda index: sorted((r.query_id, r["rank"], r.doc_id) for r in index.search(queries, 5, n_probes=4).collect())
    index = W.Lists(points, 8)
    before = found(), probed(index)
    most = spark.sparkContext.accumulator(0)
    add = W.Best.add

    def counted(self, own, ids, scores):
        if scores.size > 2_000:
            most.add(1)
        return add(self, own, ids, scores)

    monkeypatch.setattr(W, "SCORES", 2_000)
    monkeypatch.setattr(W, "Best", type("Best", (W.Best,), {"add": counted}))
    assert (found(), probed(index)) == before and most.value == 0
    assert [s.stop - s.start for s in W.parts(25, 200, 2_000)] == [10, 10, 10] and list(W.parts(3, 10_000, 2_000)) == [slice(0, 1), slice(1, 2), slice(2, 3)]
