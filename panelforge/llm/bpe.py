"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library.

A byte-level pre-tokenizer cuts a text the same way wherever a piece of it stands: between white space and
what surrounds it, but that one space belongs to the word after it. So a text falls into pieces at white
space; the library encodes each new piece once and pieces that were seen are looked up. A word with
marks after it is two pieces, so that the word is known without them. A text that holds the string of an
added token or a control character that only Python counts as white space, and any text where the file
has a normalizer or another pre-tokenizer, is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Pieces that a worker remembers at most, and characters of the longest that it does.
REMEMBERED, LONGEST = 1 << 20, 64

#: Latin letters, then marks: two pieces in the eyes of the pre-tokenizer.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
_SPACE = re.compile(r"(\s+)")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Pieces(dict):
    """The ids of pieces as bytes; ``before`` is put before each, ``starts`` knows the pieces without it."""

    def __init__(self, library, before: str, starts: _Pieces | None = None):
        self.library, self.merge, self.before = library, library.model.tokenize, before
        self.starts = self if starts is None else starts
        self.alphabet = byte_alphabet()
        self.shown = "".join([self.alphabet[b] for b in before.encode()])

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            ids = self._merged(self.shown + piece)
        elif word := _WORD.fullmatch(piece):
            ids = self[word[1]] + self.starts[word[2]] if word[2] else self._merged(self.shown + "".join([self.alphabet[b] for b in piece.encode()]))
        else:
            ids = array("I", self.library.encode(self.before + piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST and len(self) < REMEMBERED:
            self[piece] = ids
        return ids

    def _merged(self, shown: str) -> bytes:
        """The ids of one word, written in the alphabet of bytes."""
        return array("I", [t.id for t in self.merge(shown)]).tobytes()


class TextEncoder:
    """``encode(text)`` gives the ids of a text as an array of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        self.in_pieces = spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.starts = _Pieces(self.library, "")
        self.spaced = _Pieces(self.library, " ", self.starts)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if not self.in_pieces or any(t in text for t in self.added) or any(c in text for c in _NOT_SPACE):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if any(x in text for x in _ODD) or text[0].isspace() or text[-1].isspace() or not text.isascii() and _WIDE.search(text):
            found = self._loose(text)
        else:
            found, spaced = [], self.spaced.__getitem__
            for line in text.split("\n"):
                words = line.split(" ")
                found.append(self.starts[words[0]])
                found += map(spaced, words[1:])
                found.append(self.starts["\n"])
            found.pop()
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _loose(self, text: str) -> list[bytes]:
        """The pieces of any text: of a run of white space the last character stands alone, or goes with the word if it is a space."""
        parts = _SPACE.split(text)
        starts, spaced = self.starts, self.spaced
        found = [starts[parts[0]]] if parts[0] else []
        for space, word in zip(parts[1::2], parts[2::2]):
            if not word:
                found.append(starts[space])
                continue
            if len(space) > 1:
                found.append(starts[space[:-1]])
            if space[-1] == " ":
                found.append(spaced[word])
            else:
                found += (starts[space[-1]], starts[word])
        return found


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
