"""Dense search: all vectors, or an index of inverted lists.

An index deals vectors to lists by their nearest centroid (k-means by Spark on a bounded sample; every vector is indexed) and is written with a
folder for each list, so that a search reads the lists it probes and no others.  A list's radius is the largest distance of a
vector from its centroid; a query can't score higher in a list than ``q.c + |q| radius``, which lets the exact way skip lists as well.  How many lists have to be probed depends on how well the vectors cluster (a
few where they do, more than half where they are spread evenly), so it is measured: see ``calibrate``.

Queries go to the tasks in lots of a fixed size; a task multiplies its vectors with the queries that probe their list and keeps the best
``k`` of each query, so what is shuffled is ``k`` rows a task and query.  With several lots each is written before the next is sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from ..functions.lineage import settle, shared_dir
from .ranking import CANDIDATES, top_rows

#: query vectors sent to every task at a time
BLOCK_QUERIES = 4_096
#: vectors on which centroids are fitted, in expectation, and the most lists
SAMPLE, MOST_LISTS = 50_000, 4_096
#: scores that a task works out at a time
SCORES = 1 << 20
SEED = 13
#: how many lists a query probes is calibrated on so many of the vectors, for so much recall
TRIALS, RECALL = 256, 0.95


class Best:
    """The best ``k`` of every query, of batches of scores."""

    def __init__(self, names: np.ndarray, k: int) -> None:
        self.names, self.k, self.kept, self.held = names, k, [], 0
        self.least = np.full(len(names), -np.inf)

    def add(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the queries ``own`` (rows) and the vectors ``ids``; everything that may be among the best is kept, with all ties of the last."""
        n = min(self.k, scores.shape[1])
        least = np.maximum(np.partition(scores, -n, axis=1)[:, -n] if scores.shape[1] >= self.k else -np.inf, self.least[own])
        q, p = np.nonzero(scores >= least[:, None])
        self.kept.append((own[q], ids[p], scores[q, p]))
        self.held += len(q)
        if self.held > 4 * self.k * len(self.names):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k of each query, best first and ties by id."""
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, scores = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = place == self.k - 1
        self.least[q[last]] = scores[last]
        top = place < self.k
        self.kept, self.held = [(q[top], ids[top], scores[top])], int(top.sum())
        return self.kept[0]


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def parts(n: int, others: int, scores: int) -> Iterator[slice]:
    """``n`` rows in parts of which each has at most ``scores`` scores with ``others`` others, or is a row."""
    step = max(1, scores // max(1, others))
    return (slice(at, at + step) for at in range(0, n, step))


def _search(points: DataFrame, queries: DataFrame, k: int, block: int, lists: tuple[np.ndarray, np.ndarray] | None, exact: bool) -> DataFrame:
    """``points`` has ``doc_id``, ``embedding`` (and ``list``); ``queries`` has ``query_id``, ``embedding`` (and ``probes``); ``lists``: centroids and radii."""
    spark = points.sparkSession
    ship_code(spark)
    names = ["query_id", "embedding", *(["probes"] if lists is not None and not exact else [])]
    total, most = max(1, -(-queries.count() // block)), SCORES
    lot = F.pmod(F.xxhash64("query_id"), F.lit(total))
    out = None
    for at in range(total):
        rows = queries.filter(lot == at).select(F.col("query_id").cast("long").alias("query_id"), *names[1:]).toArrow().combine_chunks()
        asked = matrix(_whole(rows["embedding"]), len(rows)) if len(rows) else np.zeros((0, 0))
        probing = None
        if len(names) > 2:  # which query probes which list
            lengths = _whole(rows["probes"]).value_lengths().to_numpy(zero_copy_only=False)
            probing = np.zeros((len(rows), len(lists[1])), bool)
            probing[np.repeat(np.arange(len(rows)), lengths), _whole(rows["probes"]).flatten().to_numpy()] = True
        shared = spark.sparkContext.broadcast((_whole(rows["query_id"]).to_numpy(), asked, probing, lists))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids_of, asked, probing, known = shared.value
            best = Best(ids_of, k)
            norms = np.linalg.norm(asked, axis=1)
            for batch in batches:
                if not len(ids_of) or not batch.num_rows:
                    continue
                vectors, ids = matrix(batch.column("embedding"), batch.num_rows), batch.column("doc_id").to_numpy()
                if known is None:
                    for part in parts(len(ids), len(asked), most):
                        best.add(np.arange(len(asked)), ids[part], asked @ vectors[part].T)
                    continue
                held = batch.column("list").to_numpy()
                for n in np.unique(held):
                    own = np.flatnonzero(probing[:, n]) if probing is not None else np.arange(len(asked))
                    there = np.flatnonzero(held == n)
                    for part in parts(len(there), len(own), most):
                        own = own[asked[own] @ known[0][n] + norms[own] * known[1][n] >= best.least[own] - 1e-9]
                        if not len(own):
                            break
                        best.add(own, ids[there[part]], asked[own] @ vectors[there[part]].T)
            q, ids, scores = best.shrink()
            yield pa.RecordBatch.from_arrays([pa.array(ids_of[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])

        columns = [F.col("doc_id").cast("long").alias("doc_id"), "embedding", *([F.col("list")] if lists is not None else [])]
        part = points.select(*columns).mapInArrow(run, "query_id long, doc_id long, score double")
        if total > 1:
            part = settle(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return top_rows(out, k, F.desc("score"), F.col("doc_id"))


def dense(points: DataFrame, queries: DataFrame, k: int = CANDIDATES, block: int = BLOCK_QUERIES) -> DataFrame:
    """Top ``k`` points a query by dot product over all points: ``query_id``, ``doc_id``, ``score``, ``rank``; ties by id."""
    return _search(points, queries, k, block, None, True)


class Lists:
    """An index of inverted lists over ``doc_id``, ``embedding``."""

    def __init__(self, points: DataFrame, n_lists: int | None = None, sample: int = SAMPLE, path: str | None = None) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = points.sparkSession
        ship_code(spark)
        points = points.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter("embedding is not null")
        total = points.count()
        n_lists = n_lists or max(1, min(MOST_LISTS, round(total**0.5)))
        some = points.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, total)))))
        some = settle(some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        self.centroids = np.array(KMeans(k=n_lists, seed=SEED, maxIter=8).fit(some).clusterCenters(), np.float64) if n_lists > 1 and not some.isEmpty() else np.zeros((0, 0))
        centroids, most = spark.sparkContext.broadcast(self.centroids), SCORES

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centroids.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("embedding"), batch.num_rows)
                if len(c):
                    own = np.concatenate([((c * c).sum(axis=1) - 2 * x[part] @ c.T).argmin(axis=1) for part in parts(len(x), len(c), most)])
                    away = np.linalg.norm(x - c[own], axis=1)
                else:  # one list, around the origin
                    own, away = np.zeros(len(x), np.int64), np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("embedding"), pa.array(away), pa.array(own, pa.int32())], ["doc_id", "embedding", "away", "list"])

        kind = points.schema["embedding"].dataType.simpleString()
        dealt = points.mapInArrow(deal, f"doc_id long, embedding {kind}, away double, list int")
        self.path = path or f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
        # REBALANCE splits what a common list would make too large and joins what is small
        dealt.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(self.path)
        self.table = spark.read.schema(f"doc_id long, embedding {kind}, away double, list int").parquet(self.path)
        n = max(1, len(self.centroids))
        self.sizes, self.radii = np.zeros(n, np.int64), np.zeros(n)
        for r in self.table.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # a row for each list
            self.sizes[r["list"]], self.radii[r["list"]] = r["n"], r["radius"]
        self.n_probes: int | None = None

    def calibrate(self, k: int = CANDIDATES, recall: float = RECALL, trials: int = TRIALS) -> int:
        """The fewest lists whose vectors hold ``recall`` of the best ``k`` of a vector, over ``trials`` of them (in expectation) searched exactly among all."""
        total = int(self.sizes.sum())
        drawn = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, trials / max(1, total))))
        asked = settle(self.table.filter(drawn).select(F.col("doc_id").alias("query_id"), "embedding"))
        near = dense(self.table, asked, k).select("query_id", "doc_id")
        places = near.join(self.table.select("doc_id", "list"), "doc_id").join(self.probes(asked, len(self.sizes)), "query_id").groupBy(F.array_position("probes", F.col("list")).alias("place")).agg(F.count(F.lit(1)).alias("n"))
        met = np.zeros(len(self.sizes) + 1, np.int64)
        for r in places.collect():  # a row for each place among the lists
            met[r["place"]] = r["n"]
        enough = np.flatnonzero(met.cumsum() >= recall * met.sum())
        self.n_probes = max(1, int(enough[0])) if met.sum() else 1
        return self.n_probes

    def probes(self, queries: DataFrame, n: int | None = None) -> DataFrame:
        """``queries`` with ``probes``, the lists whose centroids score highest, and ``probed``, the vectors in them."""
        n = n or self.n_probes or self.calibrate()
        facts, most = queries.sparkSession.sparkContext.broadcast((self.centroids, self.sizes)), SCORES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, sizes = facts.value
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("embedding"), batch.num_rows)
                    for part in parts(len(x), len(c), most):
                        own = np.argsort(-(x[part] @ c.T), axis=1, kind="stable")[:, :n] if len(c) else np.zeros((len(x[part]), 1), np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel(), pa.int32()))
                        rows = batch.slice(part.start, len(own))
                        yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("embedding"), lists, pa.array(sizes[own].sum(axis=1))], ["query_id", "embedding", "probes", "probed"])

        kind = queries.schema["embedding"].dataType.simpleString()
        return queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding is not null").mapInArrow(run, f"query_id long, embedding {kind}, probes array<int>, probed long")

    def search(self, queries: DataFrame, k: int = CANDIDATES, n_probes: int | None = None, exact: bool = False, allowed: DataFrame | None = None, block: int = BLOCK_QUERIES) -> DataFrame:
        """Top ``k`` of the probed lists, or of all vectors with ``exact``; ``allowed`` (``doc_id``): only these may be found, none if it is empty.

        Scores are always the vectors' own dot products.
        """
        lists = (self.centroids if len(self.centroids) else np.zeros((1, self._dims(queries))), self.radii)
        rows = self.table
        if exact:
            asked = queries
        else:
            asked = settle(self.probes(queries, n_probes))
            met = [r["list"] for r in asked.select(F.explode("probes").alias("list")).distinct().collect()]  # numbers of lists
            rows = rows.filter(F.col("list").isin(met)) if len(met) < len(self.sizes) else rows
        if allowed is not None:
            rows = rows.join(allowed.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return _search(rows, asked, k, block, lists, exact)

    @staticmethod
    def _dims(queries: DataFrame) -> int:
        first = queries.select(F.size("embedding").alias("n")).first()
        return first["n"] if first else 0
