"""Spans in texts, over whole tables: to the letter and nearly.

Texts are never shuffled and never compared with every span.  Every span has *seeds*, short pieces of which a text that says the span must hold
one to the letter; a task looks all positions of a text up in a sorted table of seeds (numbers of ``SEED`` bytes), and only where a seed stands is
a span compared.  Spans go to the tasks in lots of a bounded size; with several lots each is written before the next is sent, so one is held at a time.

*Nearly* is what ``functions.text.match_span`` says: a run of words whose similarity is 0.95 or more.  Such a run differs from the span by at most
``D = 0.1053 n`` letters left out or put in, ``n`` being the span's length (a longer run couldn't be similar enough).  Each of them breaks at most seven of the span's
``n - 6`` overlapping runs of seven letters, so ``n - 6 - 7 D`` of them stand in the near run unchanged, and about where they stand in the span (the q-gram lemma; the number is above 0
for all spans that have near matches).  They are counted for all spans at once; only where enough lie together is the text read, and compared if enough of the span's letters are there in their order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.deploy import ship_code
from ..functions.lineage import settle

SEED = 7
#: bytes of spans that are sent to every task at a time
SPAN_BYTES = 16 << 20
#: letters that may differ, as a share of the span's
DIFFERENT = (1 - T.FUZZY) * (2 / T.FUZZY)


def _numbers(data: np.ndarray, width: int) -> np.ndarray:
    """Every run of ``width`` bytes as one number."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


class Seeds:
    """A sorted table of seeds of one width; ``find`` gives (position, entry) of all that stand in a text."""

    def __init__(self, width: int, numbers: list[int], entries: list) -> None:
        order = np.argsort(np.array(numbers, np.uint64), kind="stable")
        keys = np.array(numbers, np.uint64)[order]
        self.width, self.entries = width, [entries[i] for i in order]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.last = np.append(self.first[1:], len(keys))
        # a bit for the lowest bytes keeps most positions from being looked up
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, data: np.ndarray) -> Iterator[tuple[int, object]]:
        numbers = _numbers(data, self.width)
        at = np.flatnonzero(self.seen[(numbers & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(self.keys, numbers[at])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == numbers[at]
        for p, k in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
            for e in self.entries[self.first[k] : self.last[k]]:
                yield p, e


class Exact:
    """Spans by their first bytes: at a seed, spans of one length are looked up together."""

    def __init__(self, spans: list[tuple]) -> None:
        groups: dict[tuple[int, int], dict[int, dict[bytes, list]]] = {}
        for item, s in spans:
            b = s.encode("utf-8", "surrogatepass")
            width = min(SEED, len(b))
            groups.setdefault((width, int.from_bytes(b[:width], "big")), {}).setdefault(len(b), {}).setdefault(b, []).append(item)
        by_width: dict[int, tuple[list, list]] = {}
        for (width, number), lengths in groups.items():
            numbers, entries = by_width.setdefault(width, ([], []))
            numbers.append(number)
            entries.append(lengths)
        self.tables = [Seeds(width, *x) for width, x in by_width.items()]

    def items(self, text: str) -> list:
        data = _bytes(text)
        whole, found = data.tobytes(), {}
        for table in self.tables:
            for p, lengths in table.find(data):
                for n, known in lengths.items():
                    for item in known.get(whole[p : p + n], ()):
                        found[item] = None
        return list(found)


def _grams(text: str) -> np.ndarray:
    """A number for every run of ``SEED`` letters; equal runs have equal numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return out


class Near:
    """Spans by all their runs of ``SEED`` letters: a near run holds so many of them that all others' places are passed over by counting."""

    def __init__(self, spans: list[tuple]) -> None:
        self.spans, keys, owner, offsets = [], [], [], []
        short = []
        for item, s in spans:
            folded = " ".join(s.split()).casefold()
            if len(folded) < 32 or len(s.split()) < 6:
                short += [((item, s), folded)] if folded else []
                continue
            different = int(DIFFERENT * len(folded) + 1e-9)
            masks = T.letter_masks(folded)
            grams = _grams(folded)
            keys.append(grams)
            owner.append(np.full(len(grams), len(self.spans), np.int64))
            offsets.append(np.arange(len(grams), dtype=np.int64))
            self.spans.append((item, s, folded, different, masks))
        self.exact = Exact(short)  # these have no near matches: they are looked for to the letter
        if self.spans:
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.owner, self.offset = np.concatenate(owner)[order], np.concatenate(offsets)[order]
            self.keys, self.first = np.unique(flat[order], return_index=True)
            self.many = np.diff(np.append(self.first, len(flat)))
            self.seen = np.zeros(1 << 20, bool)  # keeps most places from being looked up
            self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
            self.different = np.array([x[3] for x in self.spans], np.int64)
            # a letter left out, put in or changed breaks SEED runs at most
            self.needed = np.array([len(x[2]) for x in self.spans], np.int64) - SEED + 1 - SEED * self.different

    def places(self, folded: str) -> dict[int, list[tuple[int, int]]]:
        """For each span the ranges of places at which a near run may begin.

        The runs that a near run has kept lie at places that differ by ``different`` from its beginning at most, so in two neighbouring strips of that width.
        """
        grams = _grams(folded)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.keys, grams[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == grams[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return {}
        n = self.many[k]
        entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        owner = self.owner[entry]
        width = 2 * self.different[owner] + 1
        strip = (np.repeat(at, n) - self.offset[entry]) // width + 1_000_000  # a span may begin before the text
        strips, counts = np.unique(owner * (1 << 40) + strip, return_counts=True)
        both = counts.copy()
        both[:-1] += np.where(strips[1:] == strips[:-1] + 1, counts[1:], 0)
        found: dict[int, list[tuple[int, int]]] = {}
        # a strip and the next, or one by itself whose neighbour before has no more
        for key in strips[both >= self.needed[strips >> 40]].tolist():
            o = key >> 40
            lo = ((key & ((1 << 40) - 1)) - 1_000_000) * int(2 * self.different[o] + 1)
            found.setdefault(o, []).append((lo, lo + 2 * int(2 * self.different[o] + 1)))
        return found

    def matches(self, text: str) -> Iterator[tuple[object, tuple[str, str, float]]]:
        words = [w[0] for w in re.finditer(r"\S+", text)]
        folded_words = [w.casefold() for w in words]
        joined = " ".join(folded_words)
        for item, s in self.exact.items(joined):
            if m := T.match_span(s, text):
                yield item, m
        if not self.spans or not words:
            return
        found = self.places(joined)
        if not found:
            return
        source, lowered = T.Source(text), " ".join(words).lower()
        lengths = np.array([len(w) + 1 for w in folded_words], np.int64)
        starts = np.cumsum(lengths) - lengths
        for k, ranges in found.items():
            item, s, folded, different, masks = self.spans[k]
            if s in text:
                yield item, (s, "exact", 1.0)
                continue
            if " ".join(s.split()).lower() in lowered:
                yield item, T.match_span(s, text)
                continue
            best, room = None, different + 2
            for lo, hi in ranges:
                first = max(0, int(np.searchsorted(starts, max(0, lo - room), "right")) - 2)
                last = min(len(starts), int(np.searchsorted(starts, hi + len(folded) + 2 * room, "left")) + 2)
                if T.common_letters(masks, len(folded), " ".join(folded_words[first:last])) < len(folded) - different:
                    continue
                m = T.match_span(s, text[source.words[first].start() : source.words[last - 1].end()])
                if m and (best is None or m[2] > best[2] or (m[1] == "whitespace_normalized" and best[1] == "fuzzy")):
                    best = m
                    if m[1] != "fuzzy":
                        break
            if best:
                yield item, best


def _in_lots(texts: DataFrame, spans: DataFrame, lot_bytes: int, schema: str, prepare: Callable, rows: Callable) -> DataFrame:
    """``rows(prepare(spans of a lot), doc_id, text)`` for every text and lot; ``texts`` has ``doc_id``, ``t``; ``spans`` has ``item_id``, ``s``."""
    spark = texts.sparkSession
    ship_code(spark)
    total = spans.agg(F.sum(F.octet_length("s") + F.lit(16))).first()[0] or 0
    n = max(1, -(-int(total) // lot_bytes))
    out = None
    for at in range(n):
        own = [tuple(r) for r in spans.filter(F.pmod(F.xxhash64("s"), F.lit(n)) == at).select("item_id", "s").collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = prepare(shared.value) if shared.value else None
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
            for batch in batches:
                found = [x for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True) for x in rows(known, doc, text)] if known else []
                columns = zip(*found, strict=True) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)], names)

        part = texts.mapInArrow(run, schema)
        if n > 1:
            part = settle(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _contained(known: Exact, doc: int, text: str) -> list[tuple]:
    return [(doc, item) for item in known.items(text)]


def contained_spans(texts: DataFrame, spans: DataFrame, block_bytes: int = SPAN_BYTES) -> DataFrame:
    """``doc_id`` and ``item_id`` of every text that says a span but for blanks and case, wherever in it and in whatever part of a word; spans with an ellipsis, and blank ones, are said nowhere.

    ``texts`` has ``doc_id``, ``text``; ``spans`` has ``item_id``, ``span``.
    """
    fold = lambda c: F.lower(T.collapse(c))
    usable = spans.select("item_id", fold(F.col("span")).alias("s")).filter((F.col("s") != "") & ~F.col("s").contains("...") & ~F.col("s").contains("…"))
    folded = texts.select("doc_id", fold(F.col("text")).alias("t")).filter("t is not null")
    return _in_lots(folded, usable, block_bytes, "doc_id long, item_id long", Exact, _contained).distinct()


def _matched(known: Near, doc: int, text: str) -> list[tuple]:
    return [(doc, item, *m) for item, m in known.matches(text)]


def matched_spans(texts: DataFrame, spans: DataFrame, block_bytes: int = SPAN_BYTES) -> DataFrame:
    """Every text and span for which ``match_span`` finds something: ``doc_id``, ``item_id``, ``support_span``, ``match_type``, ``match_score``.

    Null and blank spans, and null texts, match nothing; ids of spans are numbers and each names one span.
    """
    usable = spans.select("item_id", F.col("span").alias("s")).filter(F.length(F.trim(T.collapse(F.col("span")))) > 0)
    read = texts.select("doc_id", F.col("text").alias("t")).filter("t is not null")
    return _in_lots(read, usable, block_bytes, "doc_id long, item_id long, support_span string, match_type string, match_score double", Near, _matched)
