"""A lexical index over documents: statistics for any number of temporal scopes, and top k with pruning.

The index is one row for each block of documents: its terms, the postings of each (documents by their place in the block, with
counts), lengths and validity.  A task makes its blocks from the texts it reads, so building shuffles nothing, and searching
shuffles the best ``k`` of each task and query.  One pass over the texts serves every statistic and every search.

Temporal scopes
---------------
A scope counts the documents that overlap its days.  An interval ``[from, to)`` overlaps ``[low, high]`` if it has begun by
``high`` and hasn't ended by ``low``, so with documents counted by the first ``high`` and by the first ``low`` they meet, a scope's count is the
difference of two prefix sums.  Every term has such counts, one number for each boundary it meets; all scopes' document
frequencies follow from them, and no scope is counted by itself.

Pruning
-------
A term adds at most its weight times its largest impact in a block.  Terms are taken in the order of that bound.  Once what is left can't lift
a document without any term so far into the best ``k`` (of this task so far, or of this block by what is known of it), no new
documents are met; those met are dropped as soon as what is left can't lift them; blocks whose bounds together are too small are passed over.
What remains is scored exactly, with terms in one fixed order, so that equal documents have equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from ..functions.lineage import settings, settle, stored
from .ranking import B, CANDIDATES, EPSILON, K1, tokens, top_rows as top

#: documents and words of a block, at most (a longer document is a block by itself)
BLOCK_DOCS, BLOCK_WORDS = 1_024, 1 << 18
#: query terms that are sent to every task at a time, about
LOT_TERMS = 200_000
#: distinct ranges of scopes that are worked on at a time
LOT_SCOPES = 2_048
#: bounds and partial sums are compared with room for rounding
SLACK = 1e-9
NEVER, ALWAYS = np.iinfo(np.int32).max, np.iinfo(np.int32).min

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: a row of the index is a block of some megabytes, so rows are counted one by one wherever they are gathered: in batches to and from
#: Python and of the Parquet reader (whose usual thousands of rows would be a task's whole index at once, several times over) ...
ONE_BY_ONE = {BATCH: "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
#: ... and in the Parquet writer, which otherwise looks at its size after a hundred rows
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}

INDEX = "terms array<string>, starts array<int>, ords array<int>, tfs array<int>, ids array<long>, dls array<int>, froms array<int>, tos array<int>"


def build(docs: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """The index of ``doc_id``, ``text`` and, if they are there, ``valid_from`` and ``valid_to``; intervals without a day are left out."""
    ship_code(docs.sparkSession)
    day = lambda c, empty: F.coalesce(F.unix_date(F.to_date(c)), F.lit(int(empty))) if c in docs.columns else F.lit(int(empty))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), tokenize(F.col("text")).alias("words"), day("valid_from", ALWAYS).alias("from"), day("valid_to", NEVER).alias("to")).filter(F.col("from") < F.col("to"))

    def blocks(words: pa.ListArray) -> Iterator[tuple[int, int]]:
        bounds, at = words.offsets.to_numpy(), 0
        while at < len(words):
            to = min(at + BLOCK_DOCS, max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_WORDS, "right")) - 1), len(words))
            yield at, to
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in blocks(batch.column("words")):
                part = batch.slice(at, to - at)
                words = part.column("words")
                lengths = np.diff(words.offsets.to_numpy())
                coded = words.flatten().dictionary_encode()
                n = len(part)
                keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
                starts = np.searchsorted(keys, np.arange(len(coded.dictionary) + 1) * n)
                own = (coded.dictionary, starts, keys % n, counts, part.column("id"), lengths, part.column("from"), part.column("to"))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k) if isinstance(x, np.ndarray) else x.cast(k)) for x, k in zip(own, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(one, ["terms", "starts", "ords", "tfs", "ids", "dls", "froms", "tos"])

    with settings(docs.sparkSession, {BATCH: str(BLOCK_DOCS)}):
        return stored(read.mapInArrow(run, INDEX), "lexical-index", **SMALL_GROUPS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The index row by row, numbers as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: v if name == "terms" else v.to_numpy() for name in batch.schema.names for v in [batch.column(name)[k].values]}


# ---- statistics -----------------------------------------------------------------------------------


def statistics(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term``, ``df``, ``idf``, and one row ``n``, ``avgdl``, of all documents; a negative idf becomes a quarter of the mean idf of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([row["terms"], pa.array(np.diff(row["starts"]), pa.int64())], ["term", "df"])

    words = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
    with settings(index.sparkSession, ONE_BY_ONE):
        counted = stored(index.select("terms", "starts").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "terms")
        size = settle(index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("n"), (F.sum(words) / F.sum(F.size("ids"))).alias("avgdl")))
    raw = counted.join(F.broadcast(size.select("n")), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", idf.alias("idf")), size


def scoped_statistics(index: DataFrame, scopes: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics of every scope: ``scope_id``, ``term``, ``df``, ``idf`` for the pairs ``asked`` (``scope_id``, ``term``), and ``scope_id``, ``low``, ``high``, ``n``, ``avgdl``, ``mean_idf``.

    ``scopes`` has ``scope_id``, ``low``, ``high`` (days, both included).  Scopes with the same days share their work, and
    ``LOT_SCOPES`` ranges are worked on at a time.  A term that no document of a scope has gives no row.
    """
    days = scopes.select("scope_id", F.unix_date(F.to_date("low")).alias("low"), F.unix_date(F.to_date("high")).alias("high"))
    ranges = days.select("low", "high").distinct()
    n_lots = max(1, -(-ranges.count() // LOT_SCOPES))
    terms, sizes = None, None
    for lot in range(n_lots):
        own = [(r["low"], r["high"]) for r in ranges.filter(F.pmod(F.xxhash64("low", "high"), F.lit(n_lots)) == lot).collect()]
        found = _lot(index, sorted(own), asked.join(days, "scope_id"))
        terms, sizes = (found[0], found[1]) if terms is None else (terms.unionByName(found[0]), sizes.unionByName(found[1]))
    pairs = asked.distinct().join(days, "scope_id").join(terms, ["low", "high", "term"]).select("scope_id", "term", "df", "idf")
    return pairs, days.join(sizes, ["low", "high"])


def _lot(index: DataFrame, ranges: list[tuple[int, int]], asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = index.sparkSession
    low, high = np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64)
    lows, highs = np.unique(low), np.unique(high)
    at_low, at_high = np.searchsorted(lows, low), np.searchsorted(highs, high)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents, and each term's documents, by the boundary they begin to count at (``side`` 0) and cease to count at (1)."""
        for row in _rows(batches):
            met = np.searchsorted(highs, row["froms"]), np.searchsorted(lows, row["tos"])
            n_terms = len(row["terms"])
            of = np.repeat(np.arange(n_terms), np.diff(row["starts"]))
            for side, (places, size) in enumerate(zip(met, (len(highs), len(lows)), strict=True)):
                keys, n = np.unique(of.astype(np.int64) * (size + 1) + places[row["ords"]], return_counts=True)
                keep = keys % (size + 1) < size  # past every boundary: never counted
                keys, n = keys[keep], n[keep]
                docs = np.bincount(places, minlength=size + 1)[:size]
                words = np.bincount(places, weights=row["dls"], minlength=size + 1)[:size].astype(np.int64)
                k = np.flatnonzero(docs)
                names = pa.concat_arrays([row["terms"].take(pa.array(keys // (size + 1))), pa.array([""] * len(k), pa.string())])  # no term is empty
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.full(len(names), side), pa.int32()), pa.array(np.concatenate([keys % (size + 1), k]), pa.int32()), pa.array(np.concatenate([n, docs[k]]), pa.int64()), pa.array(np.concatenate([np.zeros(len(n), np.int64), words[k]]), pa.int64())],
                    ["term", "side", "at", "n", "words"],
                )

    events = index.mapInArrow(count, "term string, side int, at int, n long, words long").groupBy("term", "side", "at").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    # at most one number a boundary for every term
    with settings(spark, ONE_BY_ONE):
        by_term = stored(events.groupBy("term").agg(F.collect_list(F.struct("side", "at", "n", "words")).alias("events")), "term-events")

    def of_scopes(found: list, what: str) -> np.ndarray:
        begun, ended = np.zeros(len(highs) + 1, np.int64), np.zeros(len(lows) + 1, np.int64)
        for e in found:
            (ended if e["side"] else begun)[e["at"]] += e[what]
        return begun.cumsum()[at_high] - ended.cumsum()[at_low]

    whole = by_term.filter("term = ''").first()
    n, words = (of_scopes(whole["events"] if whole else [], what) for what in ("n", "words"))

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        """Documents of every term (rows) in every scope (columns)."""
        lists = batch.column("events")
        of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        side, at, many = (flat.field(c).to_numpy() for c in ("side", "at", "n"))
        begun, ended = np.zeros((batch.num_rows, len(highs)), np.int64), np.zeros((batch.num_rows, len(lows)), np.int64)
        for into, own in ((begun, side == 0), (ended, side == 1)):
            np.add.at(into, (of[own], at[own]), many[own])
        return begun.cumsum(axis=1)[:, at_high] - ended.cumsum(axis=1)[:, at_low]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        step = max(1, (1 << 20) // max(1, len(ranges)))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                df = frequencies(part)
                with np.errstate(divide="ignore"):
                    yield part, df, np.where(df > 0, np.log(np.maximum(n - df, 0) + 0.5) - np.log(df + 0.5), 0.0)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(len(ranges)), np.zeros(len(ranges), np.int64)
        for _, df, raw in parts(batches):
            total += raw.sum(axis=0)
            known += (df > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ranges)), pa.int32()), pa.array(total), pa.array(known)], ["scope", "total", "terms"])

    terms = by_term.filter("term <> ''")
    means = np.zeros(len(ranges))
    for r in terms.mapInArrow(mean, "scope int, total double, terms long").groupBy("scope").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms")).collect():
        means[r["scope"]] = r["total"] / r["terms"] if r["terms"] else 0.0

    def idf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, df, raw in parts(batches):
            of, scope = np.nonzero(df > 0)
            weight = raw[of, scope]
            weight = np.where(weight < 0, EPSILON * means[scope], weight)
            yield pa.RecordBatch.from_arrays([part.column("term").take(pa.array(of)), pa.array(low[scope], pa.int32()), pa.array(high[scope], pa.int32()), pa.array(df[of, scope]), pa.array(weight)], ["term", "low", "high", "df", "idf"])

    wanted = terms.join(asked.select("term").distinct(), "term", "left_semi")
    sizes = [(int(a), int(b), int(k), float(w / k) if k else None, float(m) if k else None) for a, b, k, w, m in zip(low, high, n, words, means, strict=True)]
    return wanted.mapInArrow(idf, "term string, low int, high int, df long, idf double"), spark.createDataFrame(sizes, "low int, high int, n long, avgdl double, mean_idf double")


# ---- search ---------------------------------------------------------------------------------------


class Searcher:
    """Best ``k`` documents of the blocks seen so far, for every query of a lot."""

    def __init__(self, queries: list[tuple], k: int) -> None:
        #: (query_id, terms, weights, avgdl, low, high)
        self.queries, self.k = queries, k
        names = sorted({t for q in queries for t in q[1]})
        place = {t: i for i, t in enumerate(names)}
        self.names = pa.array(names, pa.string())
        self.own = [np.array([place[t] for t in q[1]], np.int64) for q in queries]
        self.weights = [np.array(q[2], np.float64) for q in queries]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        self.scored = np.zeros(len(queries), np.int64)
        self.shared = np.zeros(len(queries), np.int64)

    def least(self, q: int) -> float:
        """What a document needs to be among the best so far; scores of 0 are never wanted."""
        scores = self.best[q][0]
        return max(0.0, float(scores[-1])) if len(scores) >= self.k else 0.0

    def block(self, row: dict, count_shared: bool) -> None:
        at = pc.index_in(self.names, value_set=row["terms"]).fill_null(-1).to_numpy()
        starts, ords, tfs, dls = row["starts"], row["ords"], row["tfs"], row["dls"]
        impacts: dict[float, tuple[np.ndarray, np.ndarray]] = {}
        for q, (_, _, _, avgdl, low, high) in enumerate(self.queries):
            own = at[self.own[q]]
            there = own >= 0
            if not there.any():
                continue
            if avgdl not in impacts:  # the same for all queries of a scope
                impact = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * dls[ords] / avgdl))
                impacts[avgdl] = impact, np.maximum.reduceat(impact, starts[:-1])
            valid = (row["froms"] <= high) & (row["tos"] > low)
            if count_shared:
                met = np.zeros(len(dls), bool)
                for t in own[there]:
                    met[ords[starts[t] : starts[t + 1]]] = True
                self.shared[q] += int((met & valid).sum())
            self._query(q, own, there, row, *impacts[avgdl], valid)

    def _query(self, q: int, own: np.ndarray, there: np.ndarray, row: dict, impact: np.ndarray, best: np.ndarray, valid: np.ndarray) -> None:
        starts, ords, weights, k = row["starts"], row["ords"], self.weights[q], self.k
        at, w = own[there], weights[there]
        most = w * best[at]
        order = np.argsort(-most, kind="stable")
        rest, debt = float(most[most > 0].sum()), float(most[most < 0].sum())  # what terms to come add, and take away, at most
        need = self.least(q)
        if rest <= 0 or rest < need * (1 - SLACK):
            return
        sums, met, found = np.zeros(len(valid)), np.zeros(len(valid), bool), None
        for step, j in enumerate(order, 1):
            t = at[j]
            places = ords[starts[t] : starts[t + 1]]
            sums[places] += w[j] * impact[starts[t] : starts[t + 1]]
            rest, debt = (rest - most[j], debt) if most[j] > 0 else (rest, debt - most[j])
            if found is None:
                met[places] = True
            if step % 4 == 0 or step == len(order):
                held = np.flatnonzero(met & valid) if found is None else found
                own_sums = sums[held]
                if len(held) > k:
                    need = max(need, float(np.partition(own_sums, -k)[-k]) + debt)
                if found is not None or step == len(order) or rest < need * (1 - SLACK):
                    found = held[own_sums + rest >= need * (1 - SLACK) - 1e-12]
        # exactly, and in the order of the query's terms whatever the block
        exact = np.zeros(len(found))
        for j in np.flatnonzero(there):
            t = own[j]
            places = ords[starts[t] : starts[t + 1]]
            where = np.minimum(np.searchsorted(places, found), len(places) - 1)
            exact += np.where(places[where] == found, weights[j] * impact[starts[t] : starts[t + 1]][where], 0.0)
        self.scored[q] += len(found)
        scores, ids = np.concatenate([self.best[q][0], exact]), np.concatenate([self.best[q][1], row["ids"][found]])
        keep = np.lexsort((ids, -scores))[:k]
        self.best[q] = scores[keep], ids[keep]


def search(index: DataFrame, weights: DataFrame, k: int = CANDIDATES, report: bool = False) -> DataFrame:
    """Top ``k`` documents a query: ``query_id``, ``doc_id``, ``score``, ``rank``; ties by id, scores above 0 only.

    ``weights`` has ``query_id``, ``term``, ``weight`` (occurrences times idf), ``avgdl`` and, for a scope, ``low`` and ``high`` (days since 1970).
    Queries go to the tasks in lots of about ``LOT_TERMS`` terms; what a lot finds is written before the next is sent, so one is held at a time.
    With ``report``: ``query_id``, ``shared`` (documents that share a term with the query) and ``scored`` instead.
    """
    spark = index.sparkSession
    ship_code(spark)
    if "low" not in weights.columns:  # without a scope every document is in it
        weights = weights.withColumns({"low": F.lit(int(ALWAYS)), "high": F.lit(int(NEVER) - 1)})
    queries = settle(weights.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"), F.first("avgdl").alias("avgdl"), F.first("low").alias("low"), F.first("high").alias("high")))
    total = queries.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    n_lots = max(1, -(-int(total) // LOT_TERMS))
    lot = F.pmod(F.xxhash64("query_id"), F.lit(n_lots))
    out = None
    for at in range(n_lots):
        own = [(r["query_id"], [t["term"] for t in r["terms"]], [t["weight"] for t in r["terms"]], r["avgdl"], r["low"], r["high"]) for r in queries.filter(lot == at).orderBy("query_id").collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, k)
            for row in _rows(batches):
                if len(row["ords"]):
                    searcher.block(row, report)
            names = np.array([q[0] for q in shared.value], np.int64)
            if report:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(searcher.shared), pa.array(searcher.scored.astype(np.float64))], ["query_id", "doc_id", "score"])
                return
            many = np.array([len(s) for s, _ in searcher.best], np.int64)
            scores, ids = (np.concatenate([b[i] for b in searcher.best]) if len(names) else np.zeros(0) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, many)), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])

        with settings(spark, ONE_BY_ONE):
            part = settle(index.mapInArrow(run, "query_id long, doc_id long, score double"))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    if report:
        return out.groupBy("query_id").agg(F.sum("doc_id").alias("shared"), F.sum("score").cast("long").alias("scored"))
    return top(out.filter("score > 0"), k, F.desc("score"), F.col("doc_id"))


def asked_terms(queries: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """``query_id``, ``term``, ``times`` (and ``scope_id``, if queries have one): every occurrence in the query counts."""
    extra = ["scope_id"] if "scope_id" in queries.columns else []
    return queries.select("query_id", *extra, F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", *extra, "term").agg(F.count(F.lit(1)).alias("times"))


def query_weights(index: DataFrame, queries: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """What ``search`` takes, with the statistics of all documents."""
    idf, size = statistics(index)
    return asked_terms(queries, tokenize).join(idf, "term").join(F.broadcast(size), F.lit(True)).select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl")  # one row


def scoped_weights(index: DataFrame, queries: DataFrame, scopes: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """The same with the statistics of each query's scope (``scope_id``)."""
    asked = settle(asked_terms(queries, tokenize))
    idf, size = scoped_statistics(index, scopes, asked.select("scope_id", "term"))
    return asked.join(idf, ["scope_id", "term"]).join(size, "scope_id").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl", "low", "high")
