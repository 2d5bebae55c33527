"""Centroid clustering (k-means in whole numbers) with partial-distance search.

A vector of finite components becomes whole numbers, ``floor(256 * x)``.  The first centroids are the ``k`` vectors with the
smallest SHA-256 of a salted id; a round assigns every vector to its nearest centroid (squared Euclidean distance, ties to
the smaller number) and replaces each centroid that has vectors by the floor of their mean, component by component.  All
sums are whole numbers, so neither partitions nor the order of adding up can change a result.

Partial-distance search: dimensions are ordered by their variance in the table, largest first, and squared differences are
added up block by block.  After the first block the centroid nearest so far is finished for every vector, which gives a
distance that some centroid reaches; from then on a centroid is abandoned for a vector as soon as its partial sum is
strictly greater than that distance.  Survivors finish all dimensions.  A partial sum never exceeds the whole, so the
nearest centroid and every tie of it survive.

A round is one pass of Spark over the table of whole numbers, which is written once: the ``k`` centroids go to every task
(``k`` rows of ``DIMS`` numbers, however large the table), each task sends back one row for each centroid and dimension at
most, and Spark adds them up.  A cluster that holds most vectors is thus no hot key.

Defined results: vectors of another length, with a null or a component that isn't finite, and null vectors are left out, as are
those with a number of ``2^62`` or more in size, which no long column can add up; equal ids are ordered by their vectors, and a null id
counts as an empty one; with fewer than ``k`` vectors there are fewer centroids; repeated rows are rows; an empty table
gives no rows; extra columns of any name are left alone.  A squared distance, or a sum of them, that doesn't fit in a
long is null (numbers below ``2^27`` in size always fit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.deploy import ship_code
from .common import discard, materialize

DIMS = 64
SCALE = 256
SALT = 2
CLUSTERS = 40
ROUNDS = 5
#: dimensions whose squared differences are added up at a time
BLOCK = 8
#: vectors worked on at a time
ROWS = 4_096
#: numbers of this size and more are reckoned with as Python's whole numbers
WIDE = 1 << 27
LIMIT = 1 << 62
LONG = (1 << 63) - 1


def whole_numbers(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """The vector as an array of longs; null if it isn't one of ``dims`` finite components."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    fits = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double") * F.lit(float(scale))) < F.lit(float(LIMIT)), F.lit(False)))  # false for null, NaN (the greatest) and infinity
    return F.when((F.size(vector) == dims) & F.coalesce(fits, F.lit(False)), x)


def seeds(table: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The vectors with the ``k`` smallest salted hashes of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in table.orderBy(digest, "q").limit(k).select("q").collect()]


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x``: its nearest centroid (the first of equal ones) and the squared distance; ``order``: dimensions, the most telling first.

    Sums are of the arrays' own kind: int64, or whole numbers of Python for numbers too large for that.
    """
    n, k = len(x), len(centroids)
    x, centroids = x[:, order], centroids[:, order]
    dims = x.shape[1]
    part = ((x[:, None, :block] - centroids[None, :, :block]) ** 2).sum(axis=2).reshape(n, k)
    guess = part.argmin(axis=1)
    bound = part[np.arange(n), guess] + ((x[:, block:] - centroids[guess, block:]) ** 2).sum(axis=1)
    rows, cols = np.nonzero(part <= bound[:, None])
    sums = part[rows, cols]
    for at in range(block, dims, block):
        sums = sums + ((x[rows, at : at + block] - centroids[cols, at : at + block]) ** 2).sum(axis=1)
        alive = sums <= bound[rows]
        rows, cols, sums = rows[alive], cols[alive], sums[alive]
    # pairs lie row by row and centroid by centroid: of the least in a row the first is taken
    starts = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(sums, starts) if n else sums
    hit = np.flatnonzero(sums == least[rows])
    first = hit[np.searchsorted(rows[hit], np.arange(n))]
    return cols[first], sums[first]


def _batches(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], order: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the batches with their vectors, nearest centroids and distances."""
    c = np.array(centroids, np.int64)
    wide = bool((np.abs(c) >= WIDE).any())
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            large = wide or bool((np.abs(x) >= WIDE).any())
            own, distance = nearest(x.astype(object), c.astype(object), order) if large else nearest(x, c, order)
            yield batch, x, own, distance


def spread(table: DataFrame) -> np.ndarray:
    """The dimensions by variance, largest first; only the work depends on it, so doubles do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                own = np.array([x.sum(axis=0), (x * x).sum(axis=0)])
                n, total = n + len(x), own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1]), pa.int32()), pa.array(np.full(total.shape[1], n), pa.int64()), pa.array(total[0]), pa.array(total[1])], ["dim", "n", "s", "ss"])

    sums = table.select("q").mapInArrow(run, "dim int, n long, s double, ss double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    variance = F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    return np.array([r["dim"] for r in sums.orderBy(variance.desc(), "dim").select("dim").collect()], np.int64)


def moved(table: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, high, low = np.zeros(k, np.int64), np.zeros((k, len(order)), np.int64), np.zeros((k, len(order)), np.int64)
        for _, x, own, _ in _batches(batches, centroids, order):
            n += np.bincount(own, minlength=k)
            np.add.at(high, own, x >> 32)  # sums of halves can't overflow
            np.add.at(low, own, x & 0xFFFFFFFF)
        met = np.flatnonzero(n)
        columns = np.repeat(met, len(order)), np.tile(np.arange(len(order)), len(met)), np.repeat(n[met], len(order)), high[met].ravel(), low[met].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["cluster", "dim", "n", "high", "low"])

    parts = table.select("q").mapInArrow(run, "cluster int, dim int, n long, high long, low long")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect():  # at most k x dims rows
        out[r["cluster"]][r["dim"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return out


def assigned(table: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    """``id``, ``cluster``, ``distance`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, own, distance in _batches(batches, centroids, order):
            found = pa.array(distance) if distance.dtype != object else pa.array([int(d) if d <= LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.int32()), found], ["id", "cluster", "distance"])

    schema = T.StructType([table.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return table.mapInArrow(run, schema)



def cluster(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every vector kept."""
    spark = vectors.sparkSession
    ship_code(spark)
    table = materialize(vectors.select(F.col(key).alias("id"), whole_numbers(F.col(vector), dims, scale).alias("q")).filter("q is not null"), "whole-numbers")
    centroids = seeds(table, k, salt)
    order = spread(table)
    for _ in range(rounds):
        centroids = moved(table, centroids, order)
    found = materialize(assigned(table, centroids, order), "assigned")
    discard(table)
    digests = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)]
    # one row for each cluster; a sum with a distance that is null is null
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = found.groupBy("cluster").agg(total.alias("total")).collect()
    whole = None if any(r["total"] is None for r in inertia) else sum(int(r["total"]) for r in inertia)
    fits = lambda v: int(v) if v is not None and v <= LONG else None
    own = {r["cluster"]: fits(r["total"]) for r in inertia}
    facts = spark.createDataFrame([(n, own.get(n), fits(whole), d) for n, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
