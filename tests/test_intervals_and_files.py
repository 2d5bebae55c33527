"""Overlap joins against all pairs; collections in buckets; digests of large files."""

import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpso.operators import intervals as I
from palimpso.operators import versions as V
from palimpso.sources import artifacts as A


@pytest.mark.parametrize("leaves", [1, 2, 8, 256])
def test_overlaps_are_those_of_all_pairs(spark, leaves):
    rng = np.random.default_rng(leaves)
    draw = lambda n, hot: [(k, a := int(rng.integers(0, 100)) if k % 3 else hot, a + int(rng.integers(-3, 40)) if k % 5 else 10**6) for k in range(n)]
    left, right = draw(150, 50), draw(120, 55)
    got = I.overlap_join(spark.createDataFrame([*left, (900, None, 5), (901, 5, None)], "l int, _from int, _last int"), spark.createDataFrame([*right, (900, None, 5)], "r int, _low int, _high int"), leaves).select("l", "r").collect()
    known = sorted((i, j) for i, a, b in left for j, c, d in right if a <= b and c <= d and a <= d and c <= b)
    assert sorted((x.l, x.r) for x in got) == known
    levels = 0 if leaves == 1 else int(np.ceil(np.log2(leaves)))
    for x in I.overlap_join(spark.createDataFrame(left, "l int, _from int, _last int"), spark.createDataFrame(right, "r int, _low int, _high int"), leaves, report=True).collect():
        assert x.copies <= x.rows * (3 * levels + 3)


def test_open_ends_and_a_scope_to_the_end_of_time(spark):
    day = date(2020, 1, 1)
    versions = spark.createDataFrame([(f"k{v}", 1, day + timedelta(v), None if v % 2 else day + timedelta(v + 5)) for v in range(60)] + [("e", 1, day, day), ("n", 1, None, day)], "provision_key string, version int, valid_from date, valid_to date")
    scopes = spark.createDataFrame([(k, "date_range", day + timedelta(k), day + timedelta(k + 3)) for k in range(50)] + [(99, "date_range", day, date(9999, 12, 31)), (98, "date_range", date(1, 1, 1), date(1, 1, 2))], "scope_id int, kind string, low date, high date")
    few, many = (sorted((r.scope_id, r.provision_key) for r in V.join_scopes(versions, scopes, n).collect()) for n in (10_000, 0))
    assert few == many and len(few) > 900
    left, right = V.scope_sides(versions, scopes)
    assert all(r.copies < 30 * r.rows for r in I.overlap_join(left, right, report=True).collect())


def test_only_met_buckets_are_written(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "document_id string, point_id long, value int"
    rows = spark.createDataFrame([(f"d{k % 30}", k, 0) for k in range(300)] + [(None, 1000, 0)], schema)
    A.write_buckets(rows, path, 8)
    before = {tuple(r) for r in A.files_of(spark, path).collect()}
    met = A.upsert_buckets(spark.createDataFrame([("d1", 1, 7), ("d1", 5_000, 7)], schema), path, schema, buckets=8)
    after = {tuple(r) for r in A.files_of(spark, path).collect()}
    assert len(met) == 1 and {b for b, *_ in before ^ after} == set(met) and len(before & after) >= 5
    whole = {(r.point_id, r.value) for r in A.bucketed(spark, path, schema, buckets=8).collect()}
    assert whole == {(k, 7 if k == 1 else 0) for k in range(300)} | {(5_000, 7), (1000, 0)}
    one = A.bucketed(spark, path, schema, "d1", buckets=8)
    assert sorted(r.point_id for r in one.collect()) == [*range(1, 300, 30), 5_000]
    assert "bucket#" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    # a bucket that is emptied
    gone = A.upsert_buckets(rows.limit(0), path, schema, buckets=8, removed=A.bucketed(spark, path, schema).select("*"))
    assert A.bucketed(spark, path, schema).count() == 0 and len(gone) == 8


def test_files_are_digested_block_by_block(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {"a": rng.bytes(10_000), "b": rng.bytes(4_096), "c": b"", "d": b"x"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    blocks = A.block_digests(spark, f"file://{tmp_path}", 4_096).collect()
    got = {(r.path.rsplit("/", 1)[1], r["at"]): (r["size"], r.sha256) for r in blocks}
    known = {(n, at): (len(c[at : at + 4_096]), hashlib.sha256(c[at : at + 4_096]).hexdigest()) for n, c in data.items() for at in range(0, len(c), 4_096)}  # an empty file has no block
    assert got == known
    files = {r.path.rsplit("/", 1)[1]: (r["size"], r.digest) for r in A.file_digests(spark.createDataFrame(blocks)).collect()}
    assert files == {n: (len(c), hashlib.sha256("\n".join(known[n, at][1] for at in range(0, len(c), 4_096)).encode()).hexdigest()) for n, c in data.items() if c}
    table = spark.createDataFrame(blocks)
    assert A.verified(spark, f"file://{tmp_path}", table, 4_096).count() == 0
    (tmp_path / "a").write_bytes(data["a"][:5_000] + b"?" + data["a"][5_001:])
    (tmp_path / "d").unlink()
    (tmp_path / "e").write_bytes(b"new")
    assert sorted((r.path.rsplit("/", 1)[1], r["at"], r.problem) for r in A.verified(spark, f"file://{tmp_path}", table, 4_096).collect()) == [("a", 4_096, "changed"), ("d", 0, "missing"), ("e", 0, "new")]


def test_inventory_numbers_ranges(spark):
    rows = [(date(2020, 1, 1) + timedelta(k * 7 % 11) if k % 6 else None, f"{'A' if k % 2 else 'a'}{k:03d}") for k in range(500)]
    got = [r.source_file for r in A.inventory(spark.createDataFrame(rows, "issued_date date, source_file string").repartition(7)).orderBy("batch_order").collect()]
    assert got == [n for _, n in sorted(rows, key=lambda r: (r[0] is None, r[0] or date(1, 1, 1), r[1].lower(), r[1]))]
