"""Runs over a corpus that changes, and runs that break off."""

import os

import pytest
from pyspark.sql import functions as F

from palimpso.operators import documents as D
from palimpso.sources import corpus as C


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "document_id string, markdown string")


def lines(rows):
    return D.lines(rows, "markdown")


def sizes(rows):
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


STEPS = [("lines", lines), ("sizes", sizes)]


def held(spark, path):
    return {r.document_id: r.n for r in C.table(spark, path, "sizes").collect()}


def test_only_changes_are_worked_on(spark, tmp_path):
    path, texts = str(tmp_path / "c"), {f"d{k}": "a\n" * k + "b" for k in range(12)}
    assert C.update(docs(spark, texts), path, STEPS) == {"done": 12, "removed": 0}
    assert C.update(docs(spark, texts), path, STEPS) == {"done": 0, "removed": 0} and not os.path.exists(f"{path}/run=1")
    texts["d3"] += "\nc\nd"
    assert C.update(docs(spark, texts), path, STEPS) == {"done": 1, "removed": 0}
    assert spark.read.parquet(f"{path}/run=1/sizes").count() == 1
    del texts["d5"]
    texts["new"] = None
    assert C.update(docs(spark, texts), path, STEPS) == {"done": 1, "removed": 1}
    assert held(spark, path) == {k: len(t.split("\n")) for k, t in texts.items() if t is not None}
    texts["d5"] = "again"
    assert C.update(docs(spark, texts), path, STEPS) == {"done": 1, "removed": 0} and held(spark, path)["d5"] == 1


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    path, texts = str(tmp_path / "c"), {f"d{k}": "a\nb" for k in range(5)}

    def broken(rows):
        return rows.groupBy("document_id").agg(F.raise_error(F.lit("stop")).cast("long").alias("n"))

    with pytest.raises(Exception, match="stop"):
        C.update(docs(spark, texts), path, [STEPS[0], ("sizes", broken)])
    with pytest.raises(ValueError, match="no run"):
        C.table(spark, path, "sizes")
    before = sorted(os.listdir(f"{path}/run=0/lines"))

    def never(rows):
        raise AssertionError("this step is done")

    assert C.update(docs(spark, texts), path, [("lines", never), STEPS[1]]) == {"done": 5, "removed": 0}
    assert sorted(os.listdir(f"{path}/run=0/lines")) == before and held(spark, path) == dict.fromkeys(texts, 2)
    assert C.update(docs(spark, texts), path, STEPS) == {"done": 0, "removed": 0}
