"""Models in Spark tasks: embedders and pair scorers.

A model is named by a *loader*, a function without arguments that gives the model: for an embedder a function from texts to an array of
vectors, for a scorer one from pairs of texts to numbers.  A Python worker loads a model when it first needs it and keeps it for all
batches and tasks it works on after that.  Texts are given to the model in batches of a fixed size, whatever the size of Spark's.

A text on which an embedder fails gets the zero vector, and a pair on which a scorer fails gets 0: a batch that fails is tried again text by text, so one bad text costs no
other its result.  The defaults need no model file: word hashing, and the share of the question's words that a text has.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions.deploy import ship_code

EMBED_BATCH, SCORE_BATCH = 32, 8
DIMS = 64
#: rows whose vectors a worker holds at a time
EMBED_ROWS = 1_024

#: models of this process, by loader
_loaded: dict[tuple, Callable] = {}


def loaded(loader: Callable[[], Callable]) -> Callable:
    key = loader.__module__, loader.__qualname__, getattr(loader, "key", None)
    if key not in _loaded:
        _loaded[key] = loader()
    return _loaded[key]


class HashedEmbedder:
    """Words, and pairs of neighbours, hashed to signed places; of length 1, or zero without words.  The same text has the same vector everywhere."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims, self.places = dims, {}

    def _place(self, feature: str) -> tuple[int, float]:
        if feature not in self.places:
            h = zlib.crc32(feature.encode("utf-8", "surrogatepass"))
            if len(self.places) > 1 << 18:
                self.places.clear()
            self.places[feature] = (h >> 1) % self.dims, 1.0 if h & 1 else -1.0
        return self.places[feature]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            for feature in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
                place, sign = self._place(feature)
                row[place] += sign
            if norm := np.sqrt((row * row).sum()):
                row /= norm
        return out


def hashed_embedder() -> HashedEmbedder:
    return HashedEmbedder()


def overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """The share of the first text's distinct words that the second has."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        words = [(set(a.lower().split()), set(b.lower().split())) for a, b in pairs]
        return [len(a & b) / max(1, len(a)) for a, b in words]

    return score


def _safely(model: Callable, items: list, batch: int, shape: tuple[int, ...]) -> np.ndarray:
    """The model's results batch by batch; zeros for what it fails on, or gives in another shape or as numbers that aren't finite."""
    out = np.zeros((len(items), *shape))

    def put(at: int, own: list) -> bool:
        try:
            got = np.asarray(model(own), np.float64)
            if got.shape != (len(own), *shape) or not np.isfinite(got).all():
                return False
        except Exception:  # whatever a model does with a text, the others are to be worked on
            return False
        out[at : at + len(own)] = got
        return True

    for at in range(0, len(items), batch):
        own = items[at : at + batch]
        if not put(at, own) and len(own) > 1:
            for k, one in enumerate(own):
                put(at + k, [one])
    return out


def embedder(spark: SparkSession, loader: Callable[[], Callable] = hashed_embedder, dims: int = DIMS, batch: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A column function from texts to vectors; a null text has a null vector."""
    ship_code(spark)

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(loader)
        for texts in batches:
            known = texts.notna().to_numpy()
            out: list = [None] * len(texts)
            for k, v in zip(np.flatnonzero(known), _safely(model, texts[known].tolist(), batch, (dims,)), strict=True):
                out[k] = v
            yield pd.Series(out)

    return embed


def scorer(spark: SparkSession, loader: Callable[[], Callable] = overlap_scorer, batch: int = SCORE_BATCH) -> Callable[[Column, Column], Column]:
    """A column function from a question and a text to a score; nulls read as empty."""
    ship_code(spark)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(loader)
        for a, b in batches:
            yield pd.Series(_safely(model, list(zip(a.fillna("").tolist(), b.fillna("").tolist(), strict=True)), batch, ()))

    return score


def embedded(docs: DataFrame, text: str = "text", name: str = "embedding", loader: Callable[[], Callable] = hashed_embedder, dims: int = DIMS, batch: int = EMBED_BATCH) -> DataFrame:
    """``docs`` with the vectors of their texts; a null text has a null vector.  Rows stream through Python whole: unlike a column function's input they don't wait in a queue, which goes to disk where rows are large."""
    ship_code(docs.sparkSession)
    schema = ST.StructType([*docs.schema.fields, ST.StructField(name, ST.ArrayType(ST.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(loader)
        for whole in batches:
            for at in range(0, whole.num_rows, EMBED_ROWS):
                part = whole.slice(at, EMBED_ROWS)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                known = [k for k, t in enumerate(texts) if t is not None]
                out: list = [None] * len(texts)
                for k, v in zip(known, _safely(model, [texts[k] for k in known], batch, (dims,)), strict=True):
                    out[k] = v
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float64()))], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)
