"""Removal of long repeated word sequences by recompression.

Recompression names runs of equal tokens and pairs of neighbouring symbols round by round, the same
way wherever they stand, so that equal substrings get equal symbols except near their ends.  Here a
name is a 64-bit hash of what it stands for, which makes it global without a dictionary: round 0
joins runs of exactly two equal words, and each later round splits all symbols into left and right
ones by a hash bit and joins every left symbol with a right one behind it.

After two pair rounds a symbol has at most 8 words, and whether it is formed depends on at most 8
words on either side.  So the symbols 8 words inside two equal windows of 35 words are equal, and at
least one starts in every 12 words.  The symbol with the least name there is the window's anchor;
equal windows have equal anchors at equal places, and with them equal surroundings of 24 words.

1. All anchors' surroundings, hashed, are counted over the corpus; those met twice or more are shared.
2. Windows on a shared anchor -- few, if little repeats -- are verified: their 35 words are hashed and
   counted over the corpus.  Windows met twice or more are repeats.
3. Every word inside a repeat is removed, in all occurrences, judged on the input.

Counts are pre-aggregated before they are shuffled, joins back have one row per hash on one side (so
that a passage in a third of all documents can be split over tasks), and each phase ends in a table
in the shared folder.  Whole texts are shuffled twice by document: where candidates are, and for
the result.  Nothing is collected or broadcast.

Windows and documents are told apart by 64-bit hashes: among n candidate windows some n^2 / 2^65 meet
by chance.

Defined results: a null or empty text has no words and an empty rest; a text under 35 words loses
nothing; rows that repeat a document repeat its windows, so they lose all of them; texts of any length are read whole; an
empty table gives no rows; other columns, whatever their names, are not read by ``find_repeats`` and travel as one struct through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.deploy import ship_code
from . import words as W
from .common import carry, discard, materialize, text_of

U = np.uint64
WINDOW = 35
ROUNDS = 2
NONE = U((1 << 64) - 1)


def reach(rounds: int = ROUNDS) -> int:
    """Words on either side that decide about a symbol, and its greatest length: 2, doubled each round."""
    return 2 << rounds


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols; ``first[i]`` says that word i begins a text."""
    if not len(h):
        return h.copy(), np.zeros(0, np.int64)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & ~first[1:]
    # a word equal to the one before, with other words around the two of them
    second = same[:-1] & ~same[1:]
    second[1:] &= ~same[:-2]
    at = np.flatnonzero(~second)
    names = h[at].copy()
    runs = np.zeros(len(h), bool)
    runs[:-1] = second[1:]
    runs = runs[at]
    names[runs] = W.mix(names[runs] * W.P + U(1))
    for r in range(rounds):
        left = (W.mix(names ^ U(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)) >> U(63)).astype(bool)
        joined = np.zeros(len(at), bool)  # with the symbol before
        joined[1:] = left[:-1] & ~left[1:] & ~first[at[1:]]
        heads = np.zeros(len(at), bool)
        heads[:-1] = joined[1:]
        k = np.flatnonzero(heads)
        new = names.copy()
        new[k] = W.mix(names[k] * W.P + names[k + 1] * U(0x2545F4914F6CDD1D) + U(r + 2))
        names, at = new[~joined], at[~joined]
    names[names == NONE] = 0
    return names, at


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width]; places past the end count as NONE."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        shifted = np.full(len(out), NONE)
        shifted[: max(0, len(out) - step)] = out[step:]
        out = np.minimum(out, shifted)
        done += step
    return out


class Anchors:
    """Anchors of all windows of a group of texts."""

    def __init__(self, g: W.Words, window: int = WINDOW, rounds: int = ROUNDS):
        n, side = len(g.hashes), reach(rounds)
        self.lead, self.width = side, window - 3 * side + 1
        if self.width < side:
            raise ValueError("the window is too short for so many rounds")
        first = np.zeros(n + 1, bool)
        first[g.offsets] = True
        names, at = recompress(g.hashes, first[:n], rounds)
        self.value = np.full(n, NONE)
        self.value[at] = names
        self.valid = g.room() >= window
        low = sliding_min(self.value, self.width)
        #: for each window, the least name among the places where its anchor may start
        self.least = np.full(n, NONE)
        self.least[: max(0, n - side)] = low[side:]
        self.least[~self.valid] = NONE
        # largest least name of the windows that a place may serve; a place is an anchor if it equals its own name
        serve = np.where(self.least == NONE, U(0), self.least)
        high = ~sliding_min(~serve[::-1], self.width)[::-1]
        own = np.zeros(n, U)
        own[side:] = high[: max(0, n - side)]
        self.places = np.flatnonzero((own == self.value) & (self.value != NONE) & (own > 0))
        self.surroundings = (side, window - side - self.width + 1)

    def context(self, g: W.Words) -> np.ndarray:
        """Hash of the words that all windows on an anchor have in common."""
        before, behind = self.surroundings
        return W.range_hash(g.hashes, self.places - before, self.places + behind)

    def windows(self, flagged: np.ndarray) -> np.ndarray:
        """Windows whose anchor is flagged (one of them, if several places have the least name)."""
        value = np.where(flagged, self.value, NONE)
        low = sliding_min(value, self.width)
        own = np.full(len(value), NONE)
        own[: max(0, len(value) - self.lead)] = low[self.lead :]
        return np.flatnonzero((own == self.least) & (own != NONE))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for g in W.groups(batch.column("text"), W.PLAIN, fold=False):
                a = Anchors(g, window)
                doc = np.searchsorted(g.offsets, a.places, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [_signed(a.context(g)), pa.array(keys[g.first : g.last][doc]), pa.array((a.places - g.offsets[doc]).astype(np.int32))],
                    ["context", "key", "place"],
                )

    return run


def _flags(column: pa.Array, g: W.Words) -> np.ndarray:
    """Marks the listed places of each text."""
    out = np.zeros(len(g.hashes), bool)
    part = column.slice(g.first, g.last - g.first)
    places, counts = part.flatten().to_numpy(zero_copy_only=False), np.diff(part.offsets.to_numpy())
    out[np.repeat(g.offsets[:-1], counts) + places] = True
    return out


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for g in W.groups(batch.column("text"), W.PLAIN, fold=False):
                at = Anchors(g, window).windows(_flags(batch.column("places"), g))
                doc = np.searchsorted(g.offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [_signed(W.range_hash(g.hashes, at, at + window)), pa.array(keys[g.first : g.last][doc]), pa.array((at - g.offsets[doc]).astype(np.int32))],
                    ["content", "key", "place"],
                )

    return run


def document_key(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text))


def _met_twice(rows: DataFrame, by: str, name: str, places) -> DataFrame:
    """Where the values of ``by`` stand that occur twice or more: key and ``places`` of the sorted places, as a table."""
    # a table, so that Spark can split the join where one hash has many rows
    shared = materialize(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(by), f"shared-{by}")
    found = rows.join(shared, by).groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places"))
    out = materialize(found.select("key", places.alias("places")), name)
    discard(rows, shared)
    return out


def _ranges():
    """First and last of every run of consecutive places, in turn."""
    p = F.col("places")
    edge = lambda x, i: F.concat(
        F.when(F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)), F.array(x)).otherwise(F.array().cast("array<int>")),
        F.when(F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)), F.array(x)).otherwise(F.array().cast("array<int>")),
    )
    return F.flatten(F.transform(p, edge))


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``key`` (see ``document_key``) and ``places``: first words of windows that occur twice or more, as first and last of each run."""
    ship_code(docs.sparkSession)
    sent = docs.select(document_key(key, text).alias("key"), F.col(text).alias("text")).filter(F.length("text") >= 2 * window - 1)
    anchors = materialize(sent.mapInArrow(_anchors(window), "context long, key long, place int"), "anchors")
    shared = _met_twice(anchors, "context", "shared-anchors", F.col("places"))
    windows = materialize(sent.join(shared, "key").select("key", "text", "places").mapInArrow(_windows(window), "content long, key long, place int"), "windows")
    discard(shared)
    return _met_twice(windows, "content", "repeats", _ranges())


REST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


def _remove(window: int, with_text: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for text, places in zip(text_of(batch, name).cast(pa.binary()), batch.column("places"), strict=True):
                words = (text.as_py() or b"").split()  # ASCII white space: just the separators
                out[0].append(len(words))
                if places.is_valid:
                    mark = np.zeros(len(words) + 1, np.int32)
                    runs = places.values.to_numpy(zero_copy_only=False)
                    mark[runs[::2]] += 1
                    np.subtract.at(mark, runs[1::2] + window, 1)
                    keep = np.cumsum(mark[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                rest = b" ".join(words)
                out[1].append(out[0][-1] - len(words))
                out[2].append(hashlib.sha256(rest).hexdigest())
                out[3].append(rest.decode() if with_text else None)
            rest = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], REST.names)
            yield pa.RecordBatch.from_arrays([batch.column("row"), rest], ["row", "rest"])
            del batch, rest, out
            W.tokens.tidy()

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """``row`` (the document's columns, or those in ``keep``, as a struct) and ``rest``."""
    repeats = find_repeats(docs, text, key, window)
    sent = carry(docs, text, keep).withColumn("key", document_key(f"row.`{key}`", "text" if keep is not None and text not in keep else f"row.`{text}`"))
    joined = sent.join(repeats, "key", "left").drop("key")
    return joined.mapInArrow(_remove(window, with_text, text), T.StructType([joined.schema["row"], T.StructField("rest", REST)]))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, keep=["doc_id"], with_text=False)
    return found.select("row.doc_id", "rest.n_words", "rest.n_removed", "rest.kept_sha256")
