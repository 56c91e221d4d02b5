"""Token ids of many texts by a public tokenizer, a distinct word at a time.

A byte-level or word-level tokenizer never joins text across a single space or
line end that stands between two words, so the ids of a text are those of its
words, each with the space before it, and those of letters with punctuation
behind them are those of the letters and of the punctuation. Words repeat, so
each task keeps the ids of the words it has met (up to ``KEPT``, then it starts
anew) and encodes only new ones. Texts with other runs of white space are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

KEPT = 1_000_000
TEXTS_AT_ONCE = 256
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = re.compile(r"[^\S \n]|\s\s")
_encoders: dict[str, Encoder] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(sorted(set(range(256)) - {*_PLAIN}), map(chr, range(256, 512)), strict=False))


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.lower = self.tokenizer.model, self.tokenizer.normalizer is not None
        self.spaced = self.whole(" a") != self.whole("a")
        self.known = _Known(self._word)
        self.marks: dict[str, bytes] = {}
        # Latin letters whose words the merges alone get right: none in a vocabulary of another
        # kind, and not those whose lower case is more than a letter
        self.letters = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and self._direct("a" + c + "e") and self._direct(c))

    def _direct(self, word: str) -> bool:
        return self._letters(word, True) == self.whole(" " + word) and self._letters(word, False) == self.whole(word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str, after_space: bool) -> bytes:
        """Ids of a word of Latin letters, straight from the model's merges."""
        if word.isascii():  # letters stand for themselves
            piece = word.lower() if self.lower else word
        else:
            piece = (unicodedata.normalize("NFC", word).lower() if self.lower else word).encode().decode("latin-1").translate(_BYTES)
        if after_space and self.spaced:
            piece = "\u0120" + piece
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) >= KEPT // 10:
                self.marks.clear()
            self.marks[mark] = self.whole(mark)
        return self.marks[mark]

    def _word(self, word: str) -> bytes:
        """Ids of a word that follows a space; one that starts with a line end follows none."""
        new_line = word[:1] == "\n"
        core = word[1:] if new_line else word
        stem = core.rstrip(_MARKS)
        if not (stem and self.letters.issuperset(stem)):
            return self.whole(word if new_line else " " + word)
        ids = self._letters(stem, not new_line)
        if new_line:
            ids = self._mark("\n") + ids
        return ids + self._mark(core[len(stem) :]) if len(stem) < len(core) else ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        ids = self.known.__getitem__
        for t in texts:
            if _ODD.search(t):
                yield self.whole(t)
            else:
                first, *rest = t.replace("\n", " \n").split(" ")
                yield (self.whole(first) if first else b"") + b"".join(map(ids, rest))


class _Known(dict):
    """Ids of the words met so far, found as they are asked for; started anew once ``KEPT`` are held."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        self[word] = ids = self.find(word)
        return ids


def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str) -> Iterator[bytes]:
    """Ids of each row; a null row counts as empty."""
    enc = encoder(path)
    for i in range(0, len(column), TEXTS_AT_ONCE):
        yield from enc.encode([x or "" for x in column.slice(i, TEXTS_AT_ONCE).to_pylist()])
