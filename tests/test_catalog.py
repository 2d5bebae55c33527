"""Every query with an oracle gives the rows that SQL gives on the small tables."""

import math
import os

import duckdb
import pytest

from palimpso.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"structured_retrieval", "retrieval_invariants"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert df.columns
        return
    cols = sorted(df.columns)
    found = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    expected = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == expected
