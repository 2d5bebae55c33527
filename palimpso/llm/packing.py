"""Packing of documents into sequences along a space-filling curve.

Each token id has a fixed random point in ``DIMS`` dimensions; a document's vector is the mean over
its tokens, quantised to a cell of a grid and numbered along the Hilbert curve.  Documents are
range-sorted by that key and laid end to end, and the line is cut at every 4096th token: neighbours
on the curve share sequences, and only the last sequence can have padding.

Range sort without a sampler: tokens are counted by key, and the keys' running sum is cut into buckets of an equal share
of tokens (by windows in cells of the keys' leading bits, put behind one another by the cells' sums).  So a
crowded cell is cut between its keys, as far down as keys differ; only a key with more than a bucket's share by itself
(many copies of one text) has several buckets, over which its documents are dealt by a hash.  A bucket is a task's
unit, so no key can fill a task, and buckets follow one another in the order of keys.  The buckets' first keys and positions (some 16 bytes
for ``BUCKET_TOKENS`` tokens) go to every task, and each task cuts its own documents as they stream by.
Documents of one key follow one another by lane, id and a hash of their ids.
Tokens are computed once, written to the shared folder and shuffled once as 2-byte ids.

Defined results: null text is empty and still has its end id; repeated rows are packed each by
itself; an empty table packs to nothing; texts of any length are cut into rows of at most
``ROW_TOKENS`` ids; an id that is no whole number is an error; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from .common import discard, materialize, shuffle_width
from .tokens import encoder, release, tidy, vocabulary

SEQUENCE = 4096
END_ID = 2
DIMS = 4
BITS = 10
CELL_BITS = 16
FINE_BITS = 12
SPREAD = 0.5
SEED = 5
ROW_TOKENS = 1 << 18
BUCKET_TOKENS = 8 << 20
LEAST_BUCKETS = 256
BUCKETS_A_TASK = 8
MOST_TASKS = 100_000


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (the transpose method of Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def token_points(size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMS)).astype(np.float32)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = token_points()
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            ids, means = [], np.zeros((len(docs), DIMS), np.float32)
            for k, own in enumerate(map(encoder(path).encode, batch.column("text").to_pylist())):
                ids.append(own + end)
                own = np.frombuffer(ids[-1], "<u2")
                for at in range(0, len(own), ROW_TOKENS):
                    means[k] += points[own[at : at + ROW_TOKENS]].sum(axis=0)
                means[k] /= len(own)
            cells = np.clip((means / SPREAD + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            keys = hilbert_key(cells)
            rows = [(docs[k], int(keys[k]), zlib.crc32(x), at, len(x) // 2, x[2 * at : 2 * (at + ROW_TOKENS)]) for k, x in enumerate(ids) for at in range(0, len(x) // 2, ROW_TOKENS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "key", "mark", "start", "doc_tokens", "ids"])
            del batch, ids, rows
            tidy()

    return run


def _cut(firsts, sequence: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # a worker that has tokenised needs its cache no more
        first, bucket, at = firsts.value, None, 0
        for batch in batches:
            rows = []
            for doc, b, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "start", "doc_tokens", "ids")), strict=True):
                if b != bucket:
                    bucket, at = b, int(first[b])
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                done = 0
                while done < len(wide):
                    n = min(len(wide) - done, sequence - at % sequence)
                    piece = wide[done : done + n].tobytes()
                    rows.append((doc, start + done, n, zlib.crc32(piece), total, at // sequence, at % sequence, *([piece] if keep_ids else [])))
                    done += n
                    at += n
            kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names[: len(kinds)])

    return run


def cut_keys(weights: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every bucket that a key begins in, in order: the least such key, the bucket, and how many buckets that key has (1, but for a key with more than a bucket's share).

    ``weights`` has ``key`` and ``n``; a bucket's share is the sum of ``n`` over ``n_buckets``.
    """
    # two levels of cells: a window over at most 4,096 keys, and one over at most 4,096 cells
    fine, coarse = F.shiftright("key", FINE_BITS), F.shiftright("fine", DIMS * BITS - CELL_BITS - FINE_BITS).cast("int")
    before = lambda cell, place: F.coalesce(F.sum("n").over(Window.partitionBy(cell).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = weights.withColumn("fine", fine)
    fines = keys.groupBy("fine").agg(F.sum("n").alias("n")).withColumn("coarse", coarse)
    sums = {r["coarse"]: int(r["n"]) for r in fines.groupBy("coarse").agg(F.sum("n").alias("n")).collect()}
    share = max(1, -(-sum(sums.values()) // max(1, n_buckets)))
    base, at = {}, 0
    for c in sorted(sums):
        base[c], at = at, at + sums[c]
    # one literal, folded when the query is planned
    bases = F.get(F.split(F.lit(",".join(str(base.get(c, 0)) for c in range(1 << CELL_BITS))), ",").cast("array<long>"), F.col("coarse"))
    starts = fines.select(F.col("fine").alias("cell"), (before("coarse", "fine") + bases).alias("base"))
    own = keys.withColumn("own", before("fine", "key"))
    line = own.join(starts, F.col("fine") == F.col("cell")).select("key", "n", (F.col("base") + F.col("own")).alias("at"))
    bucket = F.floor(F.col("at") / F.lit(share)).cast("long")
    lanes = F.when(F.col("n") > share, F.floor((F.col("at") + F.col("n") - 1) / F.lit(share)).cast("long") - bucket + 1).otherwise(F.lit(1))
    cut = line.select("key", bucket.alias("bucket"), lanes.alias("lanes"))
    # a large key begins a bucket of its own, so that the lanes of keys before it stay one; there are at most as many as buckets
    firsts = cut.filter("lanes > 1").unionByName(cut.filter("lanes = 1").groupBy("bucket").agg(F.min("key").alias("key")).select("key", "bucket", F.lit(1).cast("long").alias("lanes")))
    rows = sorted((r["key"], r["bucket"], r["lanes"]) for r in firsts.collect())
    out: list[tuple[int, int, int]] = []
    for key, _, n in rows:  # numbered anew and gapless, in the order of keys
        out.append((key, out[-1][1] + out[-1][2] if out else 0, n))
    table = np.array(out, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if wished, ``ids``."""
    spark = docs.sparkSession
    ship_code(spark)
    sent = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = "doc_id long, key long, mark long, start long, doc_tokens long, ids binary"
    rows = materialize(sent.mapInArrow(_tokenise(tokenizer or vocabulary(), end_id), kinds), "tokens")

    n = (F.octet_length("ids") / 2).cast("long")
    weights = materialize(rows.groupBy("key").agg(F.sum(n).alias("n")), "keys")
    total = int(weights.agg(F.sum("n")).first()[0] or 0)
    keys, numbers, lanes = cut_keys(weights, max(LEAST_BUCKETS, total // BUCKET_TOKENS))
    discard(weights)
    cuts = spark.sparkContext.broadcast((keys, numbers, lanes))

    @F.pandas_udf("long")
    def bucket_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        release()
        at, first, width = cuts.value
        for key, mark in batches:
            k = np.searchsorted(at, key.to_numpy(), "right") - 1
            # a key between a large one and the next bucket's first is behind the large one's last lane
            inner = (width[k] > 1) & (at[k] == key.to_numpy())
            yield pd.Series(np.where(inner, first[k] + mark.to_numpy() % width[k], first[k] + width[k] - 1))

    dealt = rows.withColumn("bucket", bucket_of("key", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "mark"), F.lit(1 << 40))))

    sums = {r["bucket"]: int(r["n"]) for r in dealt.groupBy("bucket").agg(F.sum(n).alias("n")).collect()}
    line = np.zeros(max(sums, default=0) + 2, np.int64)
    for bucket, tokens in sums.items():
        line[bucket + 1] = tokens
    firsts = spark.sparkContext.broadcast(np.cumsum(line))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    # as many tasks as the data asks for, whatever the session's width
    tasks = min(MOST_TASKS, max(shuffle_width(spark), len(sums) // BUCKETS_A_TASK))
    ordered = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "mark", "start")
    return ordered.select("doc_id", "bucket", "start", "doc_tokens", "ids").mapInArrow(_cut(firsts, sequence, keep_ids), kinds)


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
