"""Siblings of a ranking's own points: the same as by joins, and the points are shuffled once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from palimpso.operators import retrieval as R
from palimpso.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_ranked_siblings(spark):
    """Odd points among them: without a place, a document or a text, several at one place, places of no clause or no article."""
    rng = random.Random(4)
    labels = [f"Điều {a}" + (f" > Khoản {c}" if c else "") for a in (1, 2, 3) for c in range(7)] + [None, "Khoản 2", "Chương I", ""]
    rows = [(q, f"p{q}x{k}", rng.choice(["D1", "D2", None]), rng.choice(labels), rng.choice(["a k1", "r f k1", "n", "", None]), rng.random(), k + 1) for q in [*range(30), None] for k in range(rng.choice([3, 12, 60]))]
    ranked = R.with_keys(spark.createDataFrame(rows, "query_id long, point_id string, document_id string, location_label string, content string, rerank_score double, rank int"))
    probes = spark.createDataFrame([(q, p) for q in range(29) for p in ("r f k1", "a k2")], "query_id long, probe string")
    known = sorted(map(tuple, R.siblings(R.top_locations(ranked), ranked.drop("rerank_score"), probes).collect()))
    assert len(known) > 20 and sorted(map(tuple, R.ranked_siblings(ranked, probes).collect())) == known


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_sibling_caps_shuffles_points_once(spark):
    """One exchange of the line items, of what is read and before ids and labels are made; nothing is written in between."""
    df = catalog.QUERIES["sibling_caps"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Scan ExistingRDD" not in plan
    assert df.filter(F.col("sibling_no") > 4).isEmpty()
