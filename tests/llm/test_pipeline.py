"""Each stage of the pipeline against plain Python, on what its predecessor kept."""

import os
from collections import defaultdict

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_groups, brute_hits, brute_rest, pairs

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def stage(spark, name, docs, tmp_path):
    dict(P.STAGES)[name](spark, docs, SMALL).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("awkward", [False, True])
def test_stages(spark, tmp_path, awkward):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if awkward:
        docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema))
    columns = docs.columns

    one = stage(spark, "language_id", docs, tmp_path)
    kept, before = pairs(one), pairs(docs)
    assert one.columns == columns and set(kept) <= set(before)
    assert all(any(c.isalpha() for c in t) for _, t in kept)
    # real texts stay; the made-up rows are in no language and may go
    made_up = {t for _, t, *_ in ODD}
    real = [x for x in before if x[1] not in made_up and any(c.isalpha() for c in x[1])]
    assert len(set(real) - set(kept)) <= 0.01 * len(real)

    two = stage(spark, "near_dedup", one, tmp_path)
    root = {d: c for d, _, c in brute_groups(pairs(one), 5, 80)}
    assert sorted(str(d) for d, _ in pairs(two)) == sorted(str(d) for d, _ in pairs(one) if d is None or root[str(d)] == str(d))

    three = stage(spark, "substring_dedup", two, tmp_path)
    import hashlib

    expected = defaultdict(list)
    for d, n, gone, digest in brute_rest(pairs(two)):
        if n == 0 or gone < n:
            expected[d].append(digest)
    got = defaultdict(list)
    for d, t in pairs(three):
        got[str(d)].append(hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}

    four = stage(spark, "decontaminate", three, tmp_path)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = sorted(d for d, _, hit, _ in brute_hits(pairs(three), items) if hit == 0)
    assert sorted(str(d) for d, _ in pairs(four)) == clean and four.columns == columns

    five = stage(spark, "pack", four, tmp_path).collect()
    ends = defaultdict(int)
    for p in five:
        ends[str(p.doc_id)] += p.length
    assert sorted(ends) == sorted({str(d) for d, _ in pairs(four)})


def test_run_gives_the_same_as_the_stages(spark):
    from palimpso.llm import catalog  # noqa: F401  (the pipeline is registered beside it)
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, SMALL).collect()
    assert out and all(0 <= p.offset < 4096 and p.offset + p.length <= 4096 for p in out)


def test_empty_tables(spark, tmp_path):
    """An empty table gives no rows, stage by stage and as a whole; a table of nothing but letterless texts is empty after the first stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, rows in (("empty", docs.limit(0)), ("marks", spark.createDataFrame([(1, "###", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0)], docs.schema))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
        assert P.run(spark, folder).count() == 0


def test_other_columns_are_not_read(spark, tmp_path):
    """Columns with names that the stages use themselves, and a very long text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = spark.createDataFrame([(10_001, " ".join(f"la{i} des{i % 7} maison{i * 31 % 1009}" for i in range(20_000)), "fr", "s", 1)], docs.schema)
    clashing = docs.unionByName(long)
    for name in ("key", "row", "found", "rest", "places", "band", "component_id"):
        clashing = clashing.withColumn(name, F.lit(1))
    folder = str(tmp_path / "clash")
    clashing.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, work in P.STAGES[:-1]:
        work(spark, rows, folder).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        assert rows.columns == docs.columns, name
    assert rows.filter("doc_id = 10001").count() == 1
    assert P.STAGES[-1][1](spark, rows, folder).filter("doc_id = 10001").count() > 1


def test_a_stage_sends_python_few_rows_at_once(spark):
    """Whatever the session's batches, a stage's result is worked out in small ones; the tables it worked with are gone then, its result stays."""
    from palimpso.llm import common

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    made = []

    @P.stage
    def counted(spark, docs, sf_dir):
        made.append(common.materialize(docs, "worked-with"))
        return made[0].coalesce(1).mapInArrow(sizes, "n long")

    out = counted(spark, spark.range(3 * common.BATCH_ROWS).coalesce(1), SMALL)
    rows = [r.n for r in out.collect()]
    assert sum(rows) == 3 * common.BATCH_ROWS and max(rows) <= common.BATCH_ROWS
    app = spark.sparkContext.applicationId
    assert common._written.get((app, P.OWNER)) == [out._written_to] and not common._written.get((app, P.WORKING))


def test_workers_that_cut_hold_no_tokenizer():
    from types import SimpleNamespace

    from palimpso.llm import packing, tokens

    tokens.encoder(tokens.vocabulary())
    assert list(packing._cut(SimpleNamespace(value=[0]), 4096, False)(iter([]))) == []
    assert not tokens._encoders
