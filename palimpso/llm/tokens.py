"""Token ids of whole texts, with a cache of the ids of whitespace-separated pieces.

The vocabulary file drops white space before its merges, so a text's ids are those of its pieces
one after another, and a piece is encoded once for each worker while its cache lasts.  Texts with the
few characters that Python takes for white space and the vocabulary does not are encoded whole.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

CACHE_PIECES = 700_000
CACHE_LENGTH = 48
MARKS = 10_000
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: the characters that stand for bytes above 0x7F in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on
BYTES = {b: 0xFF + k for k, b in enumerate([*range(0x7F, 0xA1), 0xAD], 34)}
#: white space to ``str.split`` only
ODD = re.compile("[\x1c-\x1f]")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder(dict):
    """Ids as bytes: little-endian unsigned 16-bit numbers, so the vocabulary must have at most 65,536 ids.

    As a dictionary it holds the ids of pieces met before, and works out those of others.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {}
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _plain(self, piece: str) -> bytes | None:
        """Ids of Latin letters with punctuation behind them, straight from the merges; None for anything else.

        Such a piece is already in normal form but for its case, and letters and punctuation are merged apart.
        """
        m = PLAIN.fullmatch(piece)
        if m is None:
            return None
        word, mark = m.groups()
        word = word.lower()
        if mark:
            if mark not in self.marks:
                if len(self.marks) >= MARKS:
                    self.marks.clear()
                self.marks[mark] = self.whole(mark)
            return self[word] + self.marks[mark]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTES)
        ids = array("H", [t.id for t in self.model.tokenize(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > CACHE_LENGTH:
            return self.whole(piece)
        ids = self._plain(piece)
        self[piece] = ids = self.whole(piece) if ids is None else ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text; null reads as empty."""
        if not text:
            return b""
        if ODD.search(text):
            return self.whole(text)
        if len(self) > CACHE_PIECES:
            self.clear()
        if text.isascii():
            text = text.lower()  # as the vocabulary does
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, plain_specials: bool = False) -> PieceEncoder:
    """One encoder for each worker process: its cache outlives a task."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(path, plain_specials)
    return _encoders[key]


def release() -> None:
    """Give encoders and their caches up: for a worker that turns to other work."""
    _encoders.clear()
    tidy()


def tidy() -> None:
    """Give what memory is free back to the system, as one batch's room is rarely the next one's."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@functools.cache
def _trim():
    """The C library's call that returns free memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None
