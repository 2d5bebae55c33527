"""Benchmark decontamination by winnowing.

Fingerprints: of the hashes of all 5-word grams, the minimum of every 6 neighbouring ones is kept
(every tie of it).  Any 10 consecutive words hold 6 grams, so a shared span of 10 words or more
always shares a fingerprint.  Fingerprints of documents are joined with those of the items; each
hit is then extended to the 10-word windows around it, and only windows that equal an item's window
word for word (by 64-bit hashes of all ten words) count.  Items of 1 to 9 words are shorter than the
guarantee; each is one window and is looked for among all grams of its length.

The items' index goes to every task, and its size is bounded, not assumed: items are counted and dealt
by hash into blocks of about ``BLOCK_BYTES`` of text.  A usual benchmark is one block.  With more, the documents
are scanned once for each block, and the documents with what was found so far are written to the shared folder before
the next block's index is built, so driver and tasks hold one block at a time whatever the size of the benchmark.  Documents are never shuffled, so neither a hot source nor a
passage in a third of all documents piles up anywhere.

Defined results
---------------
* null, empty or wordless text: no words, no hits; null, empty or wordless items: no windows;
* items with a null id are left out; rows that repeat an id count as one item;
* no items at all: nothing is contaminated; no documents at all: no rows;
* repeated documents are judged one by one; all columns of a document travel as one struct, so their
  names can't clash with ours; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.deploy import ship_code
from . import words as W
from .common import carry, discard, materialize, text_of

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
U = np.uint64


@dataclass
class Table:
    """Windows of one length: sorted distinct hashes, the items of each, and a bit filter in front."""

    length: int
    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, length: int, hashes: np.ndarray, items: np.ndarray) -> Table:
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        distinct, first = np.unique(hashes, return_index=True)
        return cls(length, distinct, np.append(first, len(hashes)), items, bit_filter(distinct))


def bit_filter(hashes: np.ndarray) -> np.ndarray:
    size = 1 << max(16, int(16 * max(1, len(hashes)) - 1).bit_length())
    out = np.zeros(size, bool)
    out[hashes & U(size - 1)] = True
    return out


def lookup(hashes: np.ndarray, table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``hashes`` whose value is in the sorted ``table``, and the index there."""
    at = np.flatnonzero(bits[hashes & U(len(bits) - 1)])
    if not len(at) or not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
    hit = table[k] == hashes[at]
    return at[hit], k[hit]


def winnow(grams: np.ndarray, room: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Positions of the grams that are the minimum of some run of ``window - gram + 1`` grams inside one text."""
    w = window - gram + 1
    if len(grams) < w:
        return np.zeros(0, np.int64)
    n = len(grams) - w + 1
    low = grams[:n].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : n + j], out=low)
    valid = room[:n] >= window
    low[~valid] = 0
    # the largest of the minima of the runs around a gram equals the gram if it is one of them
    high = np.zeros(len(grams), U)
    for j in range(w):
        np.maximum(high[j : n + j], low, out=high[j : n + j])
    return np.flatnonzero((high == grams) & (high > 0))


@dataclass
class Index:
    ids: list[str]
    fingerprints: np.ndarray
    bits: np.ndarray
    windows: Table | None
    short: list[Table]

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Index:
        ids = sorted({str(i) for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        own = np.array([number[str(i)] for i, _ in items], np.int64)
        prints: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for g in W.groups(pa.array([t for _, t in items], pa.string()), W.ALNUM, fold=True):
            room, n = g.room(), np.diff(g.offsets)
            item = np.repeat(own[g.first : g.last], n)
            grams = W.ngrams(g.hashes, GRAM)
            prints.append(grams[winnow(grams, room)])
            whole = W.ngrams(g.hashes, WINDOW)
            at = np.flatnonzero(room[: len(whole)] >= WINDOW)
            found.setdefault(WINDOW, []).append((whole[at], item[at]))
            for length in range(1, WINDOW):
                at = g.offsets[:-1][n == length]
                if len(at):
                    found.setdefault(length, []).append((W.ngrams(g.hashes, length)[at], item[at]))
        tables = {k: Table.of(k, np.concatenate([a for a, _ in v]), np.concatenate([b for _, b in v])) for k, v in found.items()}
        fingerprints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U)
        return cls(ids, fingerprints, bit_filter(fingerprints), tables.pop(WINDOW, None), list(tables.values()))

    def hits(self, g: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and table entry number of every occurrence, as (positions, lengths, flat item lists by CSR)."""
        room = g.room()
        starts, lengths, items, owners = [], [], [], []

        def add(at: np.ndarray, k: np.ndarray, table: Table) -> None:
            count = table.first[k + 1] - table.first[k]
            starts.append(at)
            lengths.append(np.full(len(at), table.length))
            if count.sum():
                take = np.repeat(table.first[k] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                items.append(table.items[take])
                owners.append(np.repeat(at, count))

        if self.windows is not None and len(self.windows.hashes):
            grams = W.ngrams(g.hashes, GRAM)
            chosen = winnow(grams, room)
            near, _ = lookup(grams[chosen], self.fingerprints, self.bits)
            if len(near):
                span = WINDOW - GRAM + 1
                at = np.unique((chosen[near][:, None] - np.arange(span)[None, :]).ravel())
                at = at[at >= 0]
                at = at[room[at] >= WINDOW]
                whole = g.hashes[at].copy()
                for j in range(1, WINDOW):
                    whole *= W.P
                    whole += g.hashes[at + j]
                hit, k = lookup(W.mix(whole), self.windows.hashes, self.windows.filter)
                add(at[hit], k, self.windows)
        for table in self.short:
            grams = W.ngrams(g.hashes, table.length)
            hit, k = lookup(grams, table.hashes, table.filter)
            fits = room[hit] >= table.length
            add(hit[fits], k[fits], table)
        none = np.zeros(0, np.int64)
        join = lambda x: np.concatenate(x) if x else none
        return join(starts), join(lengths), np.stack([join(owners), join(items)])


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _scan(index, earlier: bool, name: str):
    """Adds ``found`` (n_words, spans as start/end pairs in words, item ids); hits of earlier blocks are merged in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        names = np.array(ix.ids, object)
        for batch in batches:
            before = batch.column("found").to_pylist() if earlier else None
            n_words, spans, span_n, items, item_n = [], [], [], [], []
            for g in W.groups(text_of(batch, name), W.ALNUM, fold=True):
                starts, lengths, owned = ix.hits(g)
                mark = np.zeros(len(g.hashes) + 1, np.int32)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + lengths, -1)
                covered = np.cumsum(mark[:-1]) > 0
                doc = np.searchsorted(g.offsets, owned[0], "right") - 1
                pairs = np.unique(np.stack([doc, owned[1]]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                for k in range(g.last - g.first) if before else ():
                    if before[g.first + k]["spans"]:
                        for s, e in np.array(before[g.first + k]["spans"]).reshape(-1, 2) + g.offsets[k]:
                            covered[s:e] = True
                # runs of covered words, cut at the ends of texts
                edge = np.zeros(len(covered) + 1, bool)
                edge[g.offsets] = True
                begin = covered.copy()
                begin[1:] &= ~covered[:-1] | edge[1:-1]
                end = covered.copy()
                end[:-1] &= ~covered[1:] | edge[1:-1]
                b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
                home = np.searchsorted(g.offsets, b, "right") - 1
                n_words.append(np.diff(g.offsets))
                spans.append(np.stack([b - g.offsets[home], e - g.offsets[home]], axis=1).ravel())
                span_n.append(2 * np.bincount(home, minlength=g.last - g.first))
                count = np.bincount(pairs[0], minlength=g.last - g.first)
                mine = names[pairs[1]].tolist()
                if before:
                    merged, at = [], np.concatenate([[0], np.cumsum(count)])
                    for k in range(g.last - g.first):
                        merged.append(sorted({*before[g.first + k]["items"], *mine[at[k] : at[k + 1]]}))
                    count, mine = np.array([len(x) for x in merged]), [y for x in merged for y in x]
                items += mine
                item_n.append(count)
            if not n_words:
                continue
            found = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(n_words), pa.int64()), _lists(np.concatenate(spans), np.concatenate(span_n), pa.int32()), _lists(items, np.concatenate(item_n), pa.string())],
                ["n_words", "spans", "items"],
            )
            sent = [c for c in batch.schema.names if c != "found"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in sent), found], [*sent, "found"])

    return run


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Items without null ids, each with the number of its block, and how many blocks there are."""
    known = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    total = known.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    return known.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the document's columns, or those in ``keep``, as a struct) and ``found`` (``n_words``, ``spans``: start and end words in turn, ``items``: ids as strings)."""
    spark = docs.sparkSession
    ship_code(spark)
    dealt, n = item_blocks(items, item_id, item_text, block_bytes)
    out = carry(docs, text, keep)
    for block in range(n):
        own = [(r["id"], r["text"]) for r in dealt.filter(F.col("block") == block).select("id", "text").collect()]
        index = spark.sparkContext.broadcast(Index.of(own))
        sent = [f for f in out.schema.fields if f.name != "found"]
        before, out = out, out.mapInArrow(_scan(index, block > 0, text), T.StructType([*sent, T.StructField("found", ADDED)]))
        if block < n - 1:
            out = materialize(out, "scanned")
            index.destroy()
            discard(before)
    return out.select("row", "found")


def n_hit():
    """Words inside spans, of a ``found`` struct."""
    s = F.col("found.spans")
    return F.aggregate(F.transform(s, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_contamination(docs, items, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )
