"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch with numpy.

A word is a run of word bytes; which bytes those are is a table of 256 flags, so both alphabets used
here cut UTF-8 only at ASCII bytes.  A word's hash is a polynomial in random byte values modulo 2^64,
taken from one prefix sum over the bytes, and then mixed.  Texts are worked on in groups of a few
MB; a longer text is a group by itself and is cut at separators, so temporaries stay small and
only its words' hashes and positions (24 bytes a word) are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import tokens

U = np.uint64
CHUNK = 1 << 20
GROUP = 2 << 20

#: words `[^\x20\x09-\x0D]+`
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

P = U(0x9E3779B97F4A7C15 & ~7 | 5)
P_INV = U(pow(int(P), -1, 1 << 64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_values(fold: bool) -> np.ndarray:
    """A random 64-bit value for every byte; with ``fold`` A-Z have the values of a-z."""
    values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i up to n; kept for the usual sizes."""
    size = CHUNK + 1
    while size < n + 1:
        size *= 4
    if size not in _tables:
        up, down = np.full(size, P), np.full(size, P_INV)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > 16 * CHUNK:
            return made
        _tables[size] = made
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (splitmix finaliser); changes ``x``."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair, the same wherever the range lies."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i that has room; documents are not told apart here."""
    if len(h) < n:
        return np.zeros(0, U)
    if n > 12:
        at = np.arange(len(h) - n + 1)
        return range_hash(h, at, at + n)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= P
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends in them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of the texts ``first`` to ``last - 1`` of a batch; ``offsets[k]`` is the first word of the k-th of them."""

    first: int
    last: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def room(self) -> np.ndarray:
        """For every word, how many words of its text begin with it."""
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        return ends - np.arange(len(self.hashes))


def _cuts(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        to = min(at + CHUNK, n)
        if to < n:
            k = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            if k > at:
                to = k
            else:
                gaps = np.flatnonzero(~is_word[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one word of more than a chunk
                    stop = int(bounds[np.searchsorted(bounds, to, "right")])
                    gaps = np.flatnonzero(~is_word[data[to:stop]])
                    to = to + int(gaps[0]) + 1 if len(gaps) else stop
        yield at, to
        at = to


def split(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, starts, ends (bytes) of all words and the first word of every text."""
    hashes, starts, ends = [], [], []
    for lo, hi in _cuts(data, bounds, is_word):
        part = data[lo:hi]
        word = is_word[part]
        edges = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        begin[edges] = word[edges]
        end = word.copy()
        end[:-1] &= ~word[1:]
        edges = edges[edges > 0] - 1
        end[edges] = word[edges]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        hashes.append(range_hash(values[part], s, e))
        starts.append(s + lo)
        ends.append(e + lo)
    none = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else none
    return np.concatenate(hashes) if hashes else np.zeros(0, U), s, np.concatenate(ends) if ends else none, np.searchsorted(s, bounds)


def groups(column: pa.Array, is_word: np.ndarray, fold: bool) -> Iterator[Words]:
    """The words of a column of texts, a few MB of text at a time."""
    tokens.release()
    values = byte_values(fold)
    data, bounds = buffers(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GROUP, "right")) - 1)
        own = data[bounds[first] : bounds[last]]
        yield Words(first, last, own, *split(own, bounds[first : last + 1] - bounds[first], is_word, values))
        first = last
