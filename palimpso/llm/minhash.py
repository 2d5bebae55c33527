"""Near-duplicate groups by HyperMinHash.

A text's set of word shingles is dealt by leading hash bits into 128 buckets; a bucket's register
keeps the least hash there as a count of leading zeros and 10 mantissa bits (2 bytes instead of 8).
A bucket without a shingle borrows the value of another one (in an order of its own), so that registers
are equal as often as sets are similar even for sets of a few shingles.  Equal registers estimate Jaccard
similarity once the expected number of chance collisions is taken off.  Four registers make a band;
two texts that share a band are candidates.  With 32 bands a pair at the threshold of 0.85 shares none with probability
6e-11 (5e-8 at 0.8).  What the estimate leaves (six standard errors below the threshold) is verified
on the full sets.

Work stays in proportion to the input:

* texts with equal sets are one class, found by a digest of the set; only classes are compared;
* round 1 compares each class with one hub in each of its bands, the member that shares most bands with
  others (the common original of many edited copies, usually); links give components;
* round 2 takes the large bands that still hold several components: members outside the largest one
  are compared with everyone, in blocks, by their 512 least shingles (the whole set, mostly), and one
  link a component comes out.  In a band with many such outsiders (``HOT``; common boilerplate that is not
  similar enough) members meet where they share one of their rarest shingles, so many of each that two sets
  at the threshold must share one (prefix filter).  This is exact: no pair of such a band is lost.
  A block has at most 512 members and ``HOT`` outsiders;
* round 3 takes what is left between components: small bands are paired in full, and larger sets in large
  bands that an estimate could not rule out are verified.

So no link between different texts is lost, but no group is expanded into its pairs.

Defined results: null, empty or wordless texts have an empty set and are linked with nothing; a text
with fewer words than a shingle is one shingle; rows with a null id get no component and are kept;
rows that repeat an id are one node; texts of any length are read whole; an empty table gives no rows; an id that is no whole number
is an error; no column but id and text is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from . import words as W
from .common import discard, materialize, shuffle_width
from .components import components

U = np.uint64
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
BAND = 4
SMALL_BAND = 64
BLOCK = 512
ERRORS = 6
BEST = 2
LOWEST = 512
HOT = 2048
SHINGLE_ROWS = 100_000
CELLS_A_TASK = 8
MOST_TASKS = 10_000
#: 8 bytes each, some 100 MB in a hash table
BROADCAST_IDS = 2_000_000


def shingle_sets(g: W.Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of the group."""
    grams = W.ngrams(g.hashes, size)
    for s, e in zip(g.offsets[:-1].tolist(), g.offsets[1:].tolist(), strict=True):
        if e - s >= size:
            yield np.unique(grams[s : e - size + 1])
        elif e > s:
            yield W.range_hash(g.hashes[s:e], np.array([0]), np.array([e - s]))
        else:
            yield np.zeros(0, U)


LENDERS = np.random.default_rng(13).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)
EDGES = np.arange(REGISTERS, dtype=U) << U(64 - REGISTER_BITS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers a set: (leading zeros + 1) and mantissa of each bucket's least hash; all 0 for an empty set."""
    least = np.zeros((len(sets), REGISTERS), U)
    full = np.zeros((len(sets), REGISTERS), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, EDGES)
            value = s[np.minimum(at, len(s) - 1)]
            full[k] = (at < len(s)) & (value >> U(64 - REGISTER_BITS) == np.arange(REGISTERS, dtype=U))
            least[k] = value
    # an empty bucket borrows from the first full one in a random order of its own, the same for all sets
    for k in np.flatnonzero(full.any(axis=1) & ~full.all(axis=1)):
        gaps = np.flatnonzero(~full[k])
        least[k, gaps] = least[k, LENDERS[gaps, full[k][LENDERS[gaps]].argmax(axis=1)]]
        full[k] = True
    rest = least << U(REGISTER_BITS)
    zeros = np.minimum(53 - np.frexp((rest >> U(11)).astype(np.float64))[1], 64 - REGISTER_BITS).astype(U)
    mantissa = (rest << zeros << U(1)) >> U(64 - MANTISSA)
    return np.where(full, (zeros + U(1)) << U(MANTISSA) | mantissa, U(0)).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity: the share of equal registers less the expected chance collisions."""
    equal = (a == b).sum(axis=-1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    # expected collisions of registers for disjoint sets (the closed form of the HyperMinHash paper)
    chance = 0.169919487159739093975 * 2.0 ** (REGISTER_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - chance) / REGISTERS


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Not to be ruled out: sizes allow the similarity, and the estimate is within six standard errors of it.

    A set of few shingles fills few buckets, and only those count for the error.
    """
    low, high = np.minimum(n, m), np.maximum(n, m)
    filled = np.maximum(1, REGISTERS * (1 - np.exp(-low / REGISTERS)))
    return (low >= threshold * high) & (estimate(a, b, n, m) >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / filled) - 1 / filled)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in W.groups(batch.column("text"), W.PLAIN, fold=True):
                sets = list(shingle_sets(g, size))
                sigs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(g.first, g.last - g.first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sigs], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "sig"],
                )

    return run


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), "<u2").reshape(-1, REGISTERS)


def _filter_likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column
            ok = likely(_stack(c("sig_a")), _stack(c("sig_b")), c("n_a").to_numpy(), c("n_b").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([c("a"), c("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in W.groups(batch.column("text"), W.PLAIN, fold=True):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(g.first, g.last - g.first), pa.array([s.tobytes() for s in shingle_sets(g, size)], pa.binary())], ["doc_id", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _lowest(size: int):
    """The ``LOWEST`` least shingles of each text: the whole set, if it is no larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in W.groups(batch.column("text"), W.PLAIN, fold=True):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(g.first, g.last - g.first), pa.array([s[:LOWEST].tobytes() for s in shingle_sets(g, size)], pa.binary())], ["cid", "lowest"])

    return run


def _shingle_rows(size: int):
    """A row for each shingle of each text, with the size of its set and a mark of it (rows that repeat an id may differ in text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in W.groups(batch.column("text"), W.PLAIN, fold=True):
                for cid, s in zip(batch.column("doc_id").slice(g.first, g.last - g.first).to_pylist(), shingle_sets(g, size), strict=True):
                    mark = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    for x in np.split(s, range(SHINGLE_ROWS, len(s), SHINGLE_ROWS)):
                        same = lambda v, n=len(x): pa.array(np.full(n, v, np.int64))
                        yield pa.RecordBatch.from_arrays([same(cid), same(mark), same(len(s)), pa.array(x.view(np.int64))], ["cid", "mark", "n_shingles", "shingle"])

    return run


def _across(percent: int, decided: bool):
    """Links between the members of one block and members of other components, from their least shingles.

    Whole sets are compared exactly, and of a member's links with one component the best is given.  Larger
    sets are estimated; those that can't be ruled out are left to verification: of each member the
    ``BEST`` ones at first, and all of them if ``decided`` says that whole sets have been dealt with.
    """
    threshold = percent / 100

    def run(key, members: pd.DataFrame, minor: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if not len(members) or not len(minor):
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        n, ids, comps = members["n_shingles"].to_numpy(), members["cid"].to_numpy(), members["comp"].to_numpy()
        lows = [np.frombuffer(x, U) for x in members["lowest"]]
        owner = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
        every = np.concatenate(lows)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        cut = np.array([x[-1] for x in lows])
        whole, sizes = n <= LOWEST, np.array([len(x) for x in lows])
        for row in minor.itertuples():
            own = np.frombuffer(row.lowest, U)
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            fits = (np.minimum(n, row.n_shingles) >= threshold * np.maximum(n, row.n_shingles)) & (comps != row.comp)
            hits = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owner[hits], minlength=len(lows))
            exact = whole & (row.n_shingles <= LOWEST)
            if not decided:
                linked = np.flatnonzero(fits & exact & (100 * both >= percent * (n + row.n_shingles - both)))
                linked = linked[np.argsort(-both[linked], kind="stable")]
                linked = linked[np.unique(comps[linked], return_index=True)[1]]
                out += [(min(row.cid, x), max(row.cid, x)) for x in ids[linked].tolist()]
            # what is common in all is no less than what is common up to an end, and no union is smaller than the shorter list
            least = np.minimum(sizes, len(own))
            fits &= exact | (both >= (threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / least)) * least - 1)
            for k in np.flatnonzero(fits & ~exact):
                # shingles up to the lower of the two ends are a random part of the union
                end = min(cut[k] if not whole[k] else own[-1], own[-1] if row.n_shingles > LOWEST else cut[k])
                a, b = np.searchsorted(own, end, "right"), np.searchsorted(lows[k], end, "right")
                same = len(np.intersect1d(own[:a], lows[k][:b], assume_unique=True))
                union = a + b - same
                if same < (threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / union)) * union - 1:
                    fits[k] = False
            open_ = np.flatnonzero(fits & ~exact)
            if not decided:
                open_ = open_[np.argsort(-both[open_], kind="stable")[:BEST]]
            out += [(min(row.cid, x), max(row.cid, x)) for x in ids[open_].tolist()]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return run


class NearDuplicates:
    """Builds groups of documents linked by similar sets of shingles; ``percent`` is the least similarity."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80, small_band: int = SMALL_BAND, block: int = BLOCK, hot: int = HOT):
        ship_code(docs.sparkSession)
        self.shingle, self.percent, self.threshold, self.small_band, self.block, self.hot = shingle, percent, percent / 100, small_band, block, hot
        self.docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def groups(self) -> DataFrame:
        """``doc_id``, ``n_shingles``, ``component_id`` for every row."""
        sketches = materialize(self.docs.mapInArrow(_sketch(self.shingle), "doc_id long, n_shingles long, digest binary, sig binary"), "sketches")
        usable = sketches.filter("n_shingles > 0 and doc_id is not null")
        classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
        self.classes = classes
        links = self._links(classes).unionByName(self._repeated_ids(usable, classes))
        roots = components(links, at_most=2 * (self.most + links.count()))
        out = sketches.join(classes.select("digest", "cid"), "digest", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
        own = F.when(F.col("n_shingles") > 0, F.coalesce("root", "cid"))
        final = materialize(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id")), "groups")
        discard(sketches, classes, roots, *self.links)
        return final

    def _repeated_ids(self, usable: DataFrame, classes: DataFrame) -> DataFrame:
        """Links between classes that hold rows of one id."""
        several = usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
        of = usable.join(several, "doc_id").join(classes.select("digest", "cid"), "digest").groupBy("doc_id", "cid").agg(F.lit(1).alias("one"))
        least = of.groupBy("doc_id").agg(F.min("cid").alias("a"))
        return of.join(least, "doc_id").select("a", F.col("cid").alias("b")).filter("a != b")

    def _links(self, classes: DataFrame) -> DataFrame:
        n = REGISTERS // BAND
        keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * BAND * i + 1, 2 * BAND)) for i in range(n)])
        bands = classes.select("cid", "n_shingles", F.explode(keys).alias("band"))
        # sides with a row for each key are tables, so that a join with a hot key can be split
        full = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "full-bands")
        shared = materialize(bands.join(full, "band"), "shared-bands")
        self.most = shared.count()  # bounds what follows

        # round 1: everyone meets a hub
        weight = shared.groupBy("cid").agg(F.sum("size").alias("weight"))
        hub = shared.join(weight, "cid").groupBy("band").agg(F.max(F.struct("weight", (-F.col("cid")).alias("minus"))).alias("best")).select("band", (-F.col("best.minus")).alias("hub"))
        hubs = materialize(hub, "hubs", self.most)
        near_hub = shared.join(hubs, "band").filter("cid != hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        tried = materialize(self._likely(near_hub), "candidates-1", self.most)
        discard(full, hubs)
        self.links, self.tried = [self._verified(tried)], [tried]

        # round 2: in large bands, who is outside the largest component meets everyone by their least shingles
        mixed = self._mixed(shared)
        self.links.append(self._large(mixed, False))
        discard(mixed)

        # round 3: small bands in full, and large sets in large bands that couldn't be ruled out
        mixed = self._mixed(shared)
        rest = materialize(self._likely(self._untried(self._small(mixed))), "candidates-3", self.small_band * self.most // 2)
        self.links += [self._verified(rest), self._large(mixed.filter(F.col("n_shingles") > self.threshold * LOWEST), True)]
        discard(mixed, rest, shared, *self.tried)
        return self._all_links()

    def _untried(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets have not been compared."""
        for t in self.tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        return pairs

    def _all_links(self) -> DataFrame:
        out = self.links[0]
        for more in self.links[1:]:
            out = out.unionByName(more)
        return out

    def _likely(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.classes.select(F.col("cid").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(_filter_likely(self.threshold), "a long, b long").distinct()

    def _texts(self, ids: DataFrame) -> DataFrame:
        """The documents with these ids.  Up to ``BROADCAST_IDS`` of them (they are counted) go to every task, so that no text is shuffled."""
        listed = materialize(ids, "ids", self.most)
        few = listed.count() <= BROADCAST_IDS
        return self.docs.join(F.broadcast(listed) if few else listed, "doc_id")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = materialize(self._texts(ids).mapInArrow(_sets(self.shingle), "doc_id long, shingles binary"), "sets")
        side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
        out = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(self.percent), "a long, b long").distinct()
        out = materialize(out, "links", pairs.count())
        discard(sets)
        return out

    def _mixed(self, shared: DataFrame) -> DataFrame:
        """Rows of the bands that hold members of several components (by the links so far), with their component."""
        links = self._all_links()
        roots = components(links, at_most=2 * links.count())
        of = materialize(shared.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("band", "cid", "n_shingles", "size", F.coalesce("root", "cid").alias("comp")), "components", self.most)
        mixed = materialize(of.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("band"), "mixed", self.most)
        out = materialize(of.join(mixed, "band"), "mixed-bands", self.most)
        discard(roots, of, mixed)
        return out

    def _small(self, mixed: DataFrame) -> DataFrame:
        """All pairs of different components in bands of a bounded size."""
        small = mixed.filter(F.col("size") <= self.small_band).select("band", "cid", "comp")
        other = small.select("band", F.col("cid").alias("b"), F.col("comp").alias("comp_b"))
        return small.join(other, "band").filter("cid < b and comp != comp_b").select(F.col("cid").alias("a"), "b").distinct()

    def _largest(self, large: DataFrame) -> DataFrame:
        """Of every band its largest component, and how many members are outside it."""
        parts = large.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
        return parts.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).select("band", F.col("top.comp").alias("top"), (F.col("all") - F.col("top.n")).alias("outside"), "all")

    def _rarest(self, ids: DataFrame) -> DataFrame:
        """Of every set the shingles of which two sets at the threshold must share one: the rarest ones (ties by value), with their places in this order.

        Any order would do that is the same for all; shingles of one set alone come first and need not be told apart.
        """
        rows = materialize(self._texts(ids).mapInArrow(_shingle_rows(self.shingle), "cid long, mark long, n_shingles long, shingle long"), "shingles")
        often = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
        own = Window.partitionBy("cid", "mark")
        placed = rows.join(often, "shingle").select("cid", "n_shingles", "shingle", F.row_number().over(own.orderBy("often", "shingle")).alias("nth"), F.count(F.lit(1)).over(own).alias("shared"))
        place = F.col("n_shingles") - F.col("shared") + F.col("nth")
        least = F.floor((self.percent * F.col("n_shingles") + 99) / 100)  # what a set has in common with one similar enough
        out = materialize(placed.select("cid", "n_shingles", "shingle", place.alias("place")).filter(F.col("place") <= F.col("n_shingles") - least + 1), "rarest")
        discard(rows, often)
        return out

    def _split(self, large: DataFrame, largest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Large bands, with those of more than ``hot`` outsiders split by the rarest shingles; and the pairs of different components that share one of few."""
        crowded = largest.filter(F.col("outside") > self.hot).select("band")
        of = materialize(large.join(crowded, "band").groupBy("cid").agg(F.first("comp").alias("comp")), "crowded", self.most)
        rarest = self._rarest(of.select(F.col("cid").alias("doc_id")))
        parts = rarest.join(of, "cid")
        sizes = parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("shingle", "size")
        met = materialize(parts.join(sizes, "shingle"), "split-bands")
        few = met.filter(F.col("size") <= self.small_band)
        side = lambda x: few.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "comp", "n_shingles", "place")])
        # no more can be common than what stands up to here in both and what is left in both
        n, m = F.col("n_shingles_a"), F.col("n_shingles_b")
        most = F.least("place_a", "place_b") + F.least(n - F.col("place_a"), m - F.col("place_b"))
        enough = (100 + self.percent) * most >= self.percent * (n + m)
        pairs = side("a").join(side("b"), "shingle").filter("cid_a < cid_b and comp_a != comp_b").filter(enough).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()
        pairs = materialize(pairs, "split-pairs")
        many = met.filter(F.col("size") > self.small_band).withColumn("band", F.xxhash64(F.lit("shingle"), "shingle"))
        names = ("band", "cid", "n_shingles", "size", "comp")
        bands = materialize(large.join(crowded, "band", "left_anti").select(*names).unionByName(many.select(*names)), "large-bands")
        discard(of, rarest, met)
        return bands, pairs

    def _large(self, mixed: DataFrame, decided: bool) -> DataFrame:
        """Links in the other bands: who is outside a band's largest component against everyone, block by block."""
        large = materialize(mixed.filter(F.col("size") > self.small_band), "large-bands", self.most)
        if large.isEmpty():
            discard(large)
            return mixed.sparkSession.createDataFrame([], "a long, b long")
        largest = materialize(self._largest(large), "largest", self.most // self.small_band)
        pairs = None
        if not largest.filter(F.col("outside") > self.hot).isEmpty():
            before = (large, largest)
            large, pairs = self._split(large, largest)
            largest = materialize(self._largest(large), "largest")
            discard(*before)
        ids = large.select(F.col("cid").alias("doc_id")).distinct()
        lowest = materialize(self._texts(ids).mapInArrow(_lowest(self.shingle), "cid long, lowest binary").filter("length(lowest) > 0"), "lowest")
        blocks, sides = F.ceil(F.col("size") / self.block).cast("int"), F.ceil(F.col("outside") / self.hot).cast("int")
        dealt = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        # a block is much work for few bytes, so tasks follow the blocks and are not put together by size
        cells = largest.agg(F.sum(F.ceil(F.col("all") / self.block) * F.ceil(F.col("outside") / self.hot))).first()[0] or 0
        tasks = min(MOST_TASKS, max(shuffle_width(self.docs.sparkSession), int(cells) // CELLS_A_TASK))
        signed = large.join(largest, "band").join(lowest, "cid")
        names = ("cid", "comp", "n_shingles", "lowest")
        members = signed.select("band", dealt(blocks).alias("block"), every(sides).alias("side"), *names)
        minor = signed.filter("comp != top").select(F.col("band").alias("band"), every(blocks).alias("block"), dealt(sides).alias("side"), *[F.col(c).alias(c) for c in names])
        dealt_out = lambda rows: rows.repartition(tasks, "band", "block", "side").groupBy("band", "block", "side")
        found = dealt_out(members).cogroup(dealt_out(minor)).applyInPandas(_across(self.percent, decided), "a long, b long").distinct()
        if pairs is not None:
            found = found.unionByName(pairs).distinct()
        open_ = materialize(self._untried(found), "candidates-2")
        self.tried.append(open_)
        out = self._verified(open_)
        discard(large, largest, lowest, *([] if pairs is None else [pairs]))
        return out


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = NearDuplicates(docs, shingle=3, percent=85).groups()
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
