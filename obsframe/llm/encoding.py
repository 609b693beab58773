"""Byte-level BPE encoding with the tokenizers library, one call per distinct word.

A byte-level BPE never merges across the pieces of its splitting pattern, so the ids of a text are those of its
pieces in a row. Pieces repeat far more often than texts do; each worker therefore gives a piece to the library's model
once and gathers ids from a table. The splitting pattern is spelt out for Latin characters, whose classes are fixed; a text with any
other character goes to the library whole, so results never depend on a Unicode version. So does one that spells an
added token of the vocabulary, which the library looks for before it splits a text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

LATIN_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACE = "\t-\r \u0085\u00a0"
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTER}]+| ?[{LATIN_NUMBER}]+| ?[^{SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_OTHER = re.compile("[^\u0000-\u024f]")
#: Texts beyond this many characters are still encoded whole; only the cache of pieces is bounded.
CACHE_WORDS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Codes(dict):
    """Piece to row of the id table; unseen pieces get the next row and wait in `pending`."""

    def __init__(self):
        super().__init__()
        self.rows = 0
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        row = self[piece] = self.add(piece)
        return row

    def add(self, text: str) -> int:
        self.pending.append(text)
        self.rows += 1
        return self.rows - 1


class PieceEncoder:
    """encode(texts) gives all ids as uint32 and the number of ids of each text; null is the empty text.

    added_tokens: whether the vocabulary's added tokens (<|endoftext|>) count as such where a text spells them, as they do
    for the library unless told otherwise, and for all operators; if not, they are plain text."""

    def __init__(self, path: str, added_tokens: bool = False):
        # Workers are many already, and threads of their own cost more than they bring for single words.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added_tokens
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self._model = self._tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the byte-level alphabet spells each Latin character.
        self._spelling = {c: spell(chr(c))[0][0] for c in range(0x250)}
        self._reset()

    def _reset(self) -> None:
        self._codes, self._ids, self._start = _Codes(), array("I"), array("i", [0])

    def _whole(self, text: str) -> bool:
        """Whether a text goes to the library whole."""
        return (not text.isascii() and _OTHER.search(text) is not None) or any(t in text for t in self._added)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if self._codes.rows > CACHE_WORDS:
            self._reset()
        codes, look_up = self._codes, self._codes.__getitem__
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._whole(text):
                parts.append(np.array([codes.add(text)], np.int32))
            else:
                pieces = _PIECES.findall(text)
                parts.append(np.fromiter(map(look_up, pieces), np.int32, len(pieces)))
            sizes[i] = len(parts[-1])
        tokenize, spelling, ids, start = self._model.tokenize, self._spelling, self._ids, self._start
        for piece in codes.pending:
            if self._whole(piece):
                ids.extend(self._tokenizer.encode(piece, add_special_tokens=False).ids)
            else:
                ids.extend([t.id for t in tokenize(piece.translate(spelling))])
            start.append(len(ids))
        codes.pending = []
        rows = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first, flat = np.array(start, np.int32), np.array(ids, np.uint32)
        length = (first[1:] - first[:-1])[rows] if len(rows) else rows
        before = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        place = np.repeat((first[rows] - before[:-1]).astype(np.int32), length)
        place += np.arange(before[-1], dtype=np.int32)
        return flat[place], np.diff(before[np.cumsum(sizes)], prepend=0)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, added_tokens=True)
    return _encoders[path]
