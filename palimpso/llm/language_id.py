"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound by multiplying the vectors of
its letters, each permuted (rolled) by its place; a text's profile bundles (adds) its trigrams,
and a language's prototype bundles the profiles of its training texts.  A document gets the
language whose prototype has the largest cosine with its profile.  Trigrams are counted over whole
texts, so a profile is a sum over distinct trigrams weighted by count.

Prototypes are fitted on a bounded sample of labelled rows: ``TRAIN_DOCS`` documents of each
language in expectation, drawn by a hash of the document's id; counts per language come first, so
rare languages keep all of their rows.  They are few vectors of ``DIM`` numbers each and go to
every task.  Prediction is a plain map over whole texts: no shuffle.

Defined results: null text or text without a letter: ``und`` with score 0; no labelled rows at all:
nothing is learned and every text is ``und``; ties of cosine go to the first language by name;
repeated rows are judged one by one; texts of any length are read whole; an empty table gives no rows; more than ``MOST_LANGS`` languages are an error; a document's columns travel as one
struct, so their names can't clash with ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.deploy import ship_code
from . import tokens
from .common import carry, text_of

DIM = 1024
SEED = 11
TRAIN_DOCS = 4000
#: so many languages of more than TRAIN_DOCS documents go to every task; more of them are joined by a shuffle
BROADCAST_LANGS = 10_000
#: languages whose prototypes (4 KB each) every task can hold; more of them are an error
MOST_LANGS = 20_000
FOLDS = 5
SLICE = 1 << 20
#: codes: 0 the gap between words; 1 to 26 a-z; the rest are other letters by code point, modulo
CODES = 128
UND = "und"


def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (CODES, DIM)) * 2 - 1).astype(np.int8)


def _letters() -> np.ndarray:
    """Code of every code point below 2^16: 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()[:1]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CODES - 27)
    return out


class Profiler:
    def __init__(self) -> None:
        tokens.release()
        self.code = _letters()
        v = letter_vectors()
        self.places = [np.roll(v, shift, axis=1) for shift in (2, 1, 0)]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the text as numbers, and their counts; words are set apart by single gaps."""
        keys, carry = [], np.zeros(1, np.uint8)
        for at in range(0, len(text), SLICE):
            points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = self.code[np.minimum(points, 0xFFFF)]
            far = np.flatnonzero(points > 0xFFFF)
            for i in far:  # letters outside the basic plane
                codes[i] = 27 + int(points[i]) % (CODES - 27) if chr(points[i]).isalpha() else 0
            codes = np.concatenate([carry, codes])
            keep = np.ones(len(codes), bool)
            keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
            codes = codes[keep]
            if at + SLICE >= len(text):
                codes = np.append(codes, 0)
            k = codes.astype(np.int32)
            found = (k[:-2] * CODES + k[1:-1]) * CODES + k[2:]
            keys.append(found[codes[1:-1] > 0])  # the middle is a letter
            carry = codes[-2:]
        if not keys:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(keys) > 64:  # a very long text: add up its slices in one dense table
            dense = np.zeros(CODES**3, np.int64)
            for k in keys:
                dense += np.bincount(k, minlength=CODES**3)
            return np.flatnonzero(dense).astype(np.int32), dense[dense > 0]
        return np.unique(np.concatenate(keys), return_counts=True)

    def profile(self, text: str | None) -> np.ndarray | None:
        grams, counts = self.trigrams(text or "")
        if not len(grams):
            return None
        out = np.zeros(DIM, np.float32)
        for at in range(0, len(grams), 2048):
            g, n = grams[at : at + 2048], counts[at : at + 2048].astype(np.float32)
            a, b, c = self.places
            bound = a[g // CODES**2] * b[g // CODES % CODES] * c[g % CODES]
            out += n @ bound.astype(np.float32)
        return out


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the unit profiles of each language in this task."""
    p, sums = Profiler(), {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            v = p.profile(text)
            if v is not None and (norm := np.linalg.norm(v)):
                sums[lang] = sums.get(lang, np.zeros(DIM)) + v / norm
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(v)], ["lang", "place", "value"])


def drawn(known: DataFrame, train_docs: int) -> DataFrame:
    """The training rows: all of a language that has few, and ``train_docs`` in expectation of the others, however many languages there are."""
    common = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > train_docs).select("lang", (F.lit(train_docs) / F.col("n")).alias("rate"))
    first = common.limit(BROADCAST_LANGS + 1).collect()
    if len(first) <= BROADCAST_LANGS:
        common = F.broadcast(known.sparkSession.createDataFrame(first, common.schema))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.join(common, "lang", "left").filter(F.col("rate").isNull() | (draw < F.col("rate")))


def fit(training: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages by name and their unit prototypes, from a bounded sample of ``training``."""
    ship_code(training.sparkSession)
    known = training.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = drawn(known, train_docs).select("lang", "text").repartition(32)
    parts = sample.mapInArrow(_bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    # one array of DIM numbers a language, and no more of them than every task can hold
    vectors = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    got = vectors.limit(MOST_LANGS + 1).collect()
    if len(got) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: their prototypes are too many for one task")
    sums = {r["lang"]: np.array(r["values"]) for r in got}
    names = sorted(n for n, v in sums.items() if np.any(v))
    # rounded, so that the order of adding up can't change a verdict between runs
    return names, np.array([np.round(sums[n] / np.linalg.norm(sums[n]), 6) for n in names], np.float32).reshape(-1, DIM)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns, or those in ``keep``, as a struct) and ``found`` (``lang_pred``, ``score``: the cosine, 0 at least)."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value
        p = Profiler()
        for batch in batches:
            langs, scores = [], []
            for value in text_of(batch, text):
                v = p.profile(value.as_py()) if names else None
                norm = float(np.linalg.norm(v)) if v is not None else 0.0
                if v is None:
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ v / (norm or 1.0)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            found = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "found"])
            del batch, found
            tokens.tidy()

    sent = carry(docs, text, keep)
    return sent.mapInArrow(run, T.StructType([sent.schema["row"], T.StructField("found", PREDICTED)]))


def fold(key: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold(F.col("doc_id")) != 0))
    found = predict(docs, model, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (fold(F.col("row.doc_id")) == 0).alias("held_out"),
        F.col("found.lang_pred").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )
