"""How far the sources of a language diverge: term-block dense matrices of smoothed term shares.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII.  A language keeps the terms that are in at
least ``MIN_DOCS`` of its documents, ``V`` of them.  A group (lang, source), and likewise the whole language, gives each kept term

    p = 1 + floor(10^9 * (count + 5) / (N + 5 V))

with ``N`` the sum of its counts over kept terms.  Two sources differ by the sum of ``|p - q|`` over all kept terms; a source's own terms are
those it uses with ``p`` above the language's share.  Everything is whole numbers; the division is carried out in three steps of three
decimal digits, so nothing overflows below ``9 * 10^15`` words in a group.

1. Every task counts occurrences and documents for each group and term of its texts, and sends partial sums on when it holds
   ``HELD`` of them; Spark adds them up.  A hot source or a hot term is so a few rows for each task.
2. Kept terms are dealt into blocks of about ``TERMS`` by their hash, the sources of a language into blocks of about ``GROUPS``.
   A tile is a pair of blocks of sources and a block of terms.  It gets the counts that aren't zero, and one row for each of its sources
   (so that a source without any of these terms is there too), and is a dense matrix of sources by terms of bounded size.
3. A tile subtracts all pairs of its rows by broadcasting, a few terms at a time, and gives partial sums for each pair of sources;
   terms that none of its sources has differ by a constant.  Spark adds up the partial pair matrices of the tiles.
4. A tile of a block of sources with itself also gives each source's ``RANKS`` first terms; these heaps are merged in Spark.

That every pair of a language's sources is compared is the result asked for; texts, documents and terms are never paired.

Defined results: null text, lang or source reads as empty, and an empty name is a name; a group without terms has counts of zero; a
language that keeps no term gives pairs of value 0 and no terms; a source that is alone in its language has no pairs; texts of any length
are counted whole, a stretch at a time; repeated rows are documents of their own; an empty table gives no rows; extra columns are left alone.
Ties of value are ranked by the item's bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from . import tokens
from .common import discard, materialize

MIN_DOCS = 30
ADDED = 5
UNIT = 1_000_000_000
RANKS = 50
#: kept terms of a block and sources of a block, about
TERMS = 1_024
GROUPS = 64
#: partial counts that a task holds
HELD = 400_000
#: bytes of a text that are cut into terms at a time
STRETCH = 1 << 20
#: so many languages go to every task; more of them are joined by a shuffle
BROADCAST_LANGS = 10_000
#: terms whose differences are held at a time
CHUNK = 128

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(data: bytes) -> Counter:
    """Occurrences of every term of a text in UTF-8."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        to = min(at + STRETCH, len(data))
        if to < len(data):  # a stretch ends behind a whole term
            begin = to - 1
            while begin >= at and TERM.match(data, begin, begin + 1):
                begin -= 1
            if begin >= at:
                to = begin + 1
            elif m := TERM.match(data, to):
                to = m.end()
        found.update(TERM.findall(data[at:to].translate(FOLD)))
        at = to
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the task; every group comes with a blank and its source in place of a term (no term has a blank), so that one without terms is known."""
    tokens.release()
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            names = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array([t.decode() for t in names], pa.string()), pa.array([n[t] for t in names], pa.int64()), pa.array([docs[t] for t in names], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        seen.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            n, docs = seen.setdefault((lang, source), (Counter({(mark := f" {source}".encode()): 0}), Counter({mark: 0})))
            held -= len(n)
            own = terms_of(text.as_buffer().to_pybytes()) if text.is_valid and len(text.as_buffer()) else Counter()
            n.update(own)
            docs.update(own.keys())
            held += len(n)
            if held >= HELD:
                yield from out()
                held = 0
    yield from out()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * count / total)`` for whole numbers, exactly; ``total`` is below 9e15."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):  # three decimal digits at a time
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial pair sums (``other`` set) and first terms (``term`` set) of one tile.

    Rows without a term are the sources: their ``n`` is N + 5 V, ``lang_n`` the same of the language, ``size`` the kept terms of this block of terms.
    """
    lang = rows["lang"].iloc[0]
    a, b = int(rows["block_a"].iloc[0]), int(rows["block_b"].iloc[0])
    anchors = rows[rows["term"].isna()].sort_values("source")
    cells = rows[rows["term"].notna()]
    sources = anchors["source"].to_numpy()
    total = anchors["n"].to_numpy(np.int64)
    block = anchors["block"].to_numpy()
    first, second = np.flatnonzero(block == a), np.flatnonzero(block == b)
    at, names = pd.factorize(cells["term"])
    dense = np.zeros((len(sources), len(names)), np.int64)
    dense[np.searchsorted(sources, cells["source"].to_numpy()), at] = cells["n"].to_numpy(np.int64)
    kept = int(anchors["size"].iloc[0])
    p = shares(dense + ADDED, np.maximum(total, 1)[:, None]) if len(names) else np.zeros(dense.shape, np.int64)
    sums = np.zeros((len(first), len(second)), np.int64)
    for c in range(0, len(names), CHUNK):
        sums += np.abs(p[first, None, c : c + CHUNK] - p[None, second, c : c + CHUNK]).sum(axis=2)
    if kept > len(names):  # terms of this block that no source of the tile has
        none = shares(np.full(len(sources), ADDED), np.maximum(total, 1))
        sums += (kept - len(names)) * np.abs(none[first][:, None] - none[second][None, :])
    i, j = np.nonzero(first[:, None] < second[None, :]) if a == b else np.nonzero(np.ones(sums.shape, bool))
    out = [pd.DataFrame({"source": sources[first[i]], "other": sources[second[j]], "term": None, "value": sums[i, j]})]
    if a == b and len(names):
        lang_n = cells.drop_duplicates("term")["lang_n"].to_numpy(np.int64)  # in the order of names
        q = shares(lang_n + ADDED, np.full(len(names), max(1, int(anchors["lang_n"].iloc[0]))))
        order = np.argsort(np.array(names, object), kind="stable")  # code points are in the order of UTF-8
        for s in range(len(sources)):
            over = p[s] - q
            own = order[((dense[s] > 0) & (over > 0))[order]]
            best = own[np.argsort(-over[own], kind="stable")[:RANKS]]
            out.append(pd.DataFrame({"source": sources[s], "other": None, "term": np.array(names, object)[best], "value": over[best]}))
    found = pd.concat([x for x in out if len(x)] or out[:1])
    found.insert(0, "lang", lang)
    return found


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, terms: int = TERMS, groups: int = GROUPS) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank``."""
    ship_code(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.col(text).alias("text"))
    # one shuffle by language and term serves the counts of groups and those of languages; what a language doesn't keep goes no further
    parts = named.mapInArrow(_count, COUNTED).repartition("lang", "term")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("docs"), F.startswith("term", F.lit(" ")).alias("is_group"))
    counts = materialize(whole.filter(F.col("is_group") | (F.col("docs") >= min_docs)).drop("docs"), "counts")
    cells = counts.filter("not is_group").drop("is_group")
    kept = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_n"))
    listed = counts.filter("is_group").select("lang", "source")
    langs = listed.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(size, "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("all_n"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / terms)).cast("int").alias("n_blocks"), F.ceil(F.col("n_sources") / groups).cast("int").alias("n_groups"))
    langs = own_langs = materialize(langs, "langs", at_most=1)
    few = langs.count() <= BROADCAST_LANGS
    langs = F.broadcast(langs) if few else langs
    block = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    own_n = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    dealt = cells.join(langs, "lang").select("lang", "source", "term", "n", "lang_n", block("term", "n_blocks").alias("terms"), block("source", "n_groups").alias("block"), "n_groups", F.lit(None).cast("long").alias("size"))
    in_block = kept.join(langs.select("lang", "n_blocks"), "lang").groupBy("lang", block("term", "n_blocks").alias("terms")).agg(F.count(F.lit(1)).alias("size"))
    members = listed.join(own_n, ["lang", "source"], "left").join(langs, "lang")
    anchors = members.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), (F.coalesce("own_n", F.lit(0)) + ADDED * F.col("v")).alias("n"), (F.col("all_n") + ADDED * F.col("v")).alias("lang_n"),
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("terms"), block("source", "n_groups").alias("block"), "n_groups",
    ).join(in_block, ["lang", "terms"], "left")
    every = dealt.unionByName(anchors.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))))
    # to every tile of its block of sources
    sent = every.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    tiles = sent.select("lang", "source", "term", "n", "lang_n", "terms", "block", "size", F.least("block", "with").alias("block_a"), F.greatest("block", "with").alias("block_b"))
    found = materialize(tiles.groupBy("lang", "terms", "block_a", "block_b").applyInPandas(_tile, "lang string, source string, other string, term string, value long"), "tiles")
    discard(counts, own_langs)
    sums = found.filter("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("p"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(order))
    term = found.filter("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pair.unionByName(term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RANKS))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
