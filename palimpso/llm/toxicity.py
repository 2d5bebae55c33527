"""Toxicity scores by a counterfactual-regularised linear classifier.

A text's features are the words it has anywhere and the beginnings of its words (``PREFIXES``
characters), hashed, each at up to three levels: present; and two or three times and in at least one of
``SPARSE`` words.  So a stem with many endings is one feature, and meeting it once by chance is told
from using it.  The classifier is logistic with an L1 penalty, and it is trained on pairs: for a
labelled text that mentions an identity term, the term is swapped for others of its kind, and every
difference between the two logits is penalised.  So a mention of a group by itself can't move a score,
while the words around it can.

Training uses a bounded sample: ``TRAIN_DOCS`` labelled texts of each class in expectation, drawn by
a hash of the id.  The sampled ids are few enough for every task (and are checked to be), so texts
are joined with them without a shuffle.  Spark counts in how many sampled texts each feature is and keeps the
features whose share of toxic texts is not chance; only those, some thousands, go to the driver with the texts that have
them, whatever the length of the texts.  The driver fits.  Scoring is a plain map over whole texts.

Defined results: null, empty or wordless texts have no features and score the intercept; without
labels of both classes the score is the share of toxic labels (0 without labels); several labels of
one id count as toxic if any is; of rows that repeat a labelled id with other texts one is learned in expectation; texts of any length
are read whole; repeated rows are scored one by one; an empty table gives no rows; a document's columns travel as one struct, so their names can't clash with ours.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.deploy import ship_code
from . import words as W
from .common import carry, text_of
from .language_id import fold

TRAIN_DOCS = 8000
FEATURE_BITS = 22
PREFIXES = (3, 4, 5, 6, 7)
#: a feature's levels: so many times at least
LEVELS = (1, 2, 3)
SPARSE = 256
MIN_TEXTS = 3
#: expected number of features that pass the screening by chance
BY_CHANCE = 0.05
COUNTERFACTUAL = 1.0
L1 = 1.0
L2 = 1e-4
STEPS = 300
SEED = 3
FOLDS = 3
THRESHOLD = 0.7
#: share of the loss that toxic texts have: below a half, so that a text without a sign of it scores low
TOXIC_MASS = 0.25
U = np.uint64

#: Identity terms of the learned languages by kind; terms of a kind are swapped for one another, and no term is in two kinds.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "lady", "gentleman"),
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("blind", "deaf", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    # French
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("lesbienne", "bisexuelle", "hétérosexuelle", "homosexuelle"),
    ("bisexuel", "hétérosexuel", "homosexuel"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("chrétienne", "musulmane", "juive"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("américain", "mexicain", "chinois", "indien", "allemand", "français", "espagnol", "russe", "turc", "polonais"),
    ("immigré", "réfugié", "étranger", "citoyen"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("aveugle", "sourd", "handicapé", "autiste"),
    ("vieux", "jeune", "âgé", "adolescent"),
    # German
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "jungen"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"),
    ("christ", "moslem", "jude", "katholik"),
    ("christen", "muslime", "juden", "buddhisten", "katholiken", "protestanten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("amerikaner", "mexikaner", "chinesen", "inder", "deutsche", "franzosen", "spanier", "russen", "türken", "polen"),
    ("einwanderer", "flüchtling", "ausländer", "einheimischer", "bürger"),
    ("migranten", "flüchtlinge", "fremde", "einheimische"),
    ("blinder", "gehörloser", "behinderter", "autist"),
    ("alte", "junger", "ältere", "jugendliche"),
    # Spanish
    ("mujer", "hombre", "niña", "niño"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("lesbiana", "heterosexuales", "homosexuales", "bisexuales"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "católico", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("americano", "mexicano", "chino", "indio", "alemán", "francés", "español", "ruso", "turco", "polaco"),
    ("inmigrante", "refugiado", "extranjero", "ciudadano"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("ciego", "sordo", "discapacitado", "autista"),
    ("viejo", "joven", "anciano", "adolescente"),
)


def features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - FEATURE_BITS)).astype(np.int32)


def prefixes(g: W.Words) -> np.ndarray:
    """A row for each length in PREFIXES: the feature of every word's first so many characters, or -1 if it has fewer."""
    values = W.byte_values(fold=True)
    out = np.full((len(PREFIXES), len(g.starts)), -1, np.int32)
    word, at, end = np.arange(len(g.starts)), g.starts.copy(), g.ends
    h, chars = np.ones(len(word), U), np.zeros(len(word), np.int8)  # 1: else palindromes would hash as whole words do
    for _ in range(4 * max(PREFIXES)):  # a character has 4 bytes at most
        if not len(word):
            break
        h = h * W.P + values[g.data[at]]
        at = at + 1
        over = at >= end
        whole = over | ((g.data[np.minimum(at, len(g.data) - 1)] & 0xC0) != 0x80)
        chars = chars + whole
        for row, n in zip(out, PREFIXES, strict=True):
            met = np.flatnonzero(whole & (chars == n))
            row[word[met]] = features(W.mix(h[met]))
        on = ~over & (chars < max(PREFIXES))
        word, at, end, h, chars = word[on], at[on], end[on], h[on], chars[on]
    return out


def parts(g: W.Words) -> np.ndarray:
    """The features of every word of a group: a row for whole words, and those of ``prefixes``."""
    return np.concatenate([features(g.hashes)[None], prefixes(g)])


def term_parts(terms=IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind, the hashes of its terms and their parts."""
    groups = (next(W.groups(pa.array(kind, pa.string()), W.ALNUM, fold=True)) for kind in terms)
    return [(g.hashes, parts(g)) for g in groups]


def levels(times: np.ndarray, words: np.ndarray | int) -> list[np.ndarray]:
    """Which of the LEVELS a feature reaches that a text of so many words has so many times."""
    return [times >= n if n == 1 else (times >= n) & (times * SPARSE >= words) for n in LEVELS]


def text_features(own: np.ndarray) -> np.ndarray:
    """A text's features at their levels, from its words' parts."""
    met, times = np.unique(own[own >= 0], return_counts=True)
    return np.sort(np.concatenate([met[at] * len(LEVELS) + k for k, at in enumerate(levels(times, own.shape[1]))]))


def counterfactuals(hashes: np.ndarray, own: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each identity term of the text swapped for the next two of its kind: the features that go and those that come."""
    out, before = [], None
    met = set(np.unique(hashes[np.isin(hashes, np.concatenate([terms for terms, _ in kinds]))]).tolist())
    for terms, kind in kinds if met else ():
        for k, term in enumerate(terms.tolist()):
            if term not in met:
                continue
            before = text_features(own) if before is None else before
            for step in (1, 2):
                swapped = own.copy()
                swapped[:, hashes == terms[k]] = kind[:, [(k + step) % len(terms)]]
                after = text_features(swapped)
                out.append((np.setdiff1d(before, after), np.setdiff1d(after, before)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text: its features, a digest of them, and for every swap the features that go and those that come."""
    kinds = term_parts()
    ints = pa.list_(pa.int32())
    pair = pa.struct([("gone", ints), ("come", ints)])
    for batch in batches:
        rows, digests, swaps = [], [], []
        for g in W.groups(batch.column("text"), W.ALNUM, fold=True):
            p = parts(g)
            for s, e in zip(g.offsets[:-1].tolist(), g.offsets[1:].tolist(), strict=True):
                rows.append(text_features(p[:, s:e]).astype(np.int32))
                digests.append(hashlib.blake2b(rows[-1].tobytes(), digest_size=16).digest())
                swaps.append([{"gone": a, "come": b} for a, b in counterfactuals(g.hashes[s:e], p[:, s:e], kinds)])
        yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(digests, pa.binary()), pa.array(rows, ints), pa.array(swaps, pa.list_(pair))], EXTRACTED)


EXTRACTED = ["toxic", "digest", "own", "swaps"]
KINDS = "toxic int, digest binary, own array<int>, swaps array<struct<gone array<int>, come array<int>>>"


def _pick(chosen):
    """The texts' features among the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(len(LEVELS) << FEATURE_BITS, bool)
        mask[chosen.value] = True

        def cut(lists: pa.Array) -> pa.Array:
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ok = mask[values]
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok)])[ends], pa.int32()), pa.array(values[ok], pa.int32()))

        for batch in batches:
            swaps = batch.column("swaps")
            inner = swaps.flatten()
            inner = pa.StructArray.from_arrays([cut(inner.field("gone")), cut(inner.field("come"))], ["gone", "come"])
            offsets = pa.array(swaps.offsets.to_numpy() - swaps.offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("digest"), cut(batch.column("own")), pa.ListArray.from_arrays(offsets, inner)], EXTRACTED)

    return run


class Design:
    """Sparse 0/1 rows over the chosen features."""

    def __init__(self, rows: list, place: np.ndarray):
        picked = [p[p >= 0] for p in (place[np.asarray(r, np.int64)] for r in rows)]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(p) for p in picked])
        self.col = np.concatenate(picked) if picked else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def transposed(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(x: Design, left: Design, right: Design, toxic: np.ndarray, weight: np.ndarray, strength: float, l1: np.ndarray | float, l2: float, steps: int, width: int) -> tuple[np.ndarray, float]:
    """Proximal gradient steps; each feature has its own rate, or common words would set the pace for rare ones."""
    w, b = np.zeros(width), 0.0
    g2, gb2 = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        error = weight * (sigmoid(x.times(w) + b) - toxic)
        grad = x.transposed(error, width) + l2 * w
        if left.n:
            change = (left.times(w) - right.times(w)) * (strength / left.n)
            grad += left.transposed(change, width) - right.transposed(change, width)
        g2 += grad**2
        gb2 += error.sum() ** 2
        rate = 0.5 / np.sqrt(g2)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        b -= 0.5 * error.sum() / np.sqrt(gb2)
    return w, float(b)


#: a feature that every text has, by which texts are counted
EVERY = -1
COUNT_TEXTS = 512


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts, and toxic ones, of each few hundred have a feature."""
    for whole in batches:
        for at in range(0, len(whole), COUNT_TEXTS):
            batch = whole.slice(at, COUNT_TEXTS)
            own = batch.column("own")
            toxic = np.repeat(batch.column("toxic").to_numpy(), np.diff(own.offsets.to_numpy()))
            met, where = np.unique(own.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            n, k = np.bincount(where, minlength=len(met)), np.bincount(where, toxic, minlength=len(met))
            out = [np.append(met, EVERY), np.append(n, len(batch)), np.append(k, batch.column("toxic").to_numpy().sum())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["feature", "n", "k"])


def screen(rows: DataFrame) -> dict[int, int]:
    """The features whose share of toxic texts is not that of all texts by chance, and the number of texts that have them.

    Chernoff's bound for the binomial, for as many features as are tried.  Equal texts count once, as copies are no evidence.
    """
    distinct = rows.select("toxic", "digest", "own").dropDuplicates(["toxic", "digest"])
    counts = distinct.select("toxic", "own").mapInArrow(_count, "feature int, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).persist()
    try:
        every = counts.filter(F.col("feature") == EVERY).first()
        if every is None or every["k"] in (0, every["n"]):
            return {}
        base = every["k"] / every["n"]
        tried = counts.filter((F.col("feature") != EVERY) & (F.col("n") >= MIN_TEXTS))
        n, k = F.col("n").cast("double"), F.col("k").cast("double")
        part = lambda x, p: x * F.log(F.greatest(x, F.lit(1.0)) / (n * F.lit(p)))
        kept = tried.filter(part(k, base) + part(n - k, 1 - base) > math.log(max(1, tried.count()) / BY_CHANCE))
        return {r["feature"]: r["n"] for r in kept.select("feature", "n").collect()}
    finally:
        counts.unpersist()


def train(own: list, swaps: list, toxic: np.ndarray, screened: dict[int, int], strength: float = COUNTERFACTUAL, l1: float = L1, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the intercept.

    First the L1 penalty chooses features among the ``screened`` ones: it is ``l1`` times the noise of
    the feature's own gradient, which grows with the root of the number of texts that have it, so a rare
    feature is held against its own noise and not against that of common ones.  Then the chosen are fitted
    again without it, as it shrinks them.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    none = np.zeros(0, np.int64), np.zeros(0)
    if share in (0.0, 1.0):
        return *none, (30.0 if share else -30.0)
    vocabulary = np.array(sorted(screened), np.int64)
    texts = np.array([screened[f] for f in vocabulary.tolist()], float)
    weight = np.where(toxic > 0, TOXIC_MASS / share, (1 - TOXIC_MASS) / (1 - share)) / len(toxic)
    pairs = [x for rows in swaps for x in rows]
    noise = TOXIC_MASS * (1 - TOXIC_MASS) * np.sqrt(texts / (share * (1 - share))) / len(toxic)
    for penalty, ridge in ((l1 * noise, 0.0), (0.0, l2)):
        place = np.full(len(LEVELS) << FEATURE_BITS, -1, np.int32)
        place[vocabulary] = np.arange(len(vocabulary))
        designs = Design(own, place), Design([a for a, _ in pairs], place), Design([b for _, b in pairs], place)
        w, b = _descend(*designs, toxic, weight, strength, penalty, ridge, steps, len(vocabulary))
        used = np.flatnonzero(w)
        vocabulary, w = vocabulary[used], w[used]
        if not len(vocabulary):
            break
    return vocabulary, np.round(w, 6), round(b, 6)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    ship_code(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).filter("key is not null and toxic is not null").groupBy("key").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(train_docs) / F.when(F.col("toxic") == 1, F.lit(max(1, sizes.get(1, 0)))).otherwise(F.lit(max(1, sizes.get(0, 0))))
    draw = lambda *by: F.pmod(F.xxhash64(F.lit(SEED), *by), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(draw("key") < rate)
    few = sample.count() <= 4 * train_docs  # the rate bounds the sample; were it larger for any reason, it would be joined by a shuffle
    near = lambda t: F.broadcast(t) if few else t
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # rows that repeat an id are drawn so that they count as one in expectation, and equal ones are one
    repeats = texts.select("key").join(near(sample), "key").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    sample = sample.join(repeats, "key", "left")
    rows = texts.join(near(sample), "key").filter(F.col("rows").isNull() | (draw("key", "text") * F.col("rows") < 1))
    if not repeats.isEmpty():
        rows = rows.groupBy("key", "text").agg(F.first("toxic").alias("toxic"))
    rows = rows.select("toxic", "text")
    # worked out twice, for the counts and for what is kept: cheaper than a table of all features
    found = rows.mapInArrow(_extract, KINDS)
    screened = screen(found)
    chosen = docs.sparkSession.sparkContext.broadcast(np.array(sorted(screened), np.int64))
    got = sorted((r["toxic"], bytes(r["digest"]), r["own"], r["swaps"]) for r in found.mapInArrow(_pick(chosen), KINDS).collect())  # the same model whatever the order of arrival
    ids = lambda x: np.array(x, np.int64)
    return train([ids(own) for _, _, own, _ in got], [[(ids(a), ids(b)) for a, b in swaps] for *_, swaps in got], np.array([toxic for toxic, *_ in got], float), screened)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns, or those in ``keep``, as a struct) and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, intercept = shared.value
        met, slot = np.unique(chosen // len(LEVELS), return_inverse=True)
        width = max(1, len(met))
        place = np.full(1 << FEATURE_BITS, -1, np.int32)
        place[met] = np.arange(len(met))
        table = np.zeros((width, len(LEVELS)))
        table[slot, chosen % len(LEVELS)] = weights
        for batch in batches:
            scores = []
            for g in W.groups(text_of(batch, text), W.ALNUM, fold=True):
                found = []
                for row in parts(g):
                    at = np.flatnonzero(row >= 0)
                    p = place[row[at]]
                    at, p = at[p >= 0], p[p >= 0]
                    found.append((np.searchsorted(g.offsets, at, "right") - 1) * width + p)
                key, times = np.unique(np.concatenate(found), return_counts=True)
                doc = key // width
                gain = sum(table[key % width, k] * at for k, at in enumerate(levels(times, np.diff(g.offsets)[doc])))
                logits = intercept + np.bincount(doc, gain if len(key) else None, minlength=g.last - g.first)
                scores.append(sigmoid(logits))
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), out], ["row", "score"])

    sent = carry(docs, text, keep)
    return sent.mapInArrow(run, T.StructType([sent.schema["row"], T.StructField("score", T.DoubleType())]))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(fold(F.col("doc_id"), FOLDS) != 1))
    held_out = (fold(F.col("row.doc_id"), FOLDS) == 1).alias("held_out")
    return score(docs, model, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
