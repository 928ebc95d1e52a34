"""Token ids of whole texts, with the ids of frequent words kept per Python worker.

A text is cut at single spaces, where both kinds of tokenizer always begin a new piece, so
the ids of the text are the ids of its chunks in turn. A single line end between two words
is a piece of its own, so such a chunk is the two words and that piece. Texts in which a cut
could matter (runs of white space beside a cut) are encoded whole.
"""
from __future__ import annotations

import functools
import re
import struct

from tokenizers import Tokenizer

#: Chunks kept per worker; further ones are encoded each time they come.
KEPT_CHUNKS = 600_000
#: White space that a line end could join in one piece.
SPACES = re.compile(r"\s\s")
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%*&$#|]*)")


class _Cut(Exception):
    """The text must be encoded whole."""


class _Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(self) < KEPT_CHUNKS and "\n" not in chunk:
            self[chunk] = ids
        return ids


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """`encode(text)` gives the ids that the tokenizer of a file gives, as u32 bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = self.tokenizer.encode(" a", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        self.mapped: dict[int, str] = {}
        self.first, self.rest = _Chunks(self._plain_chunk), _Chunks(self._spaced_chunk)
        self.marks = _Chunks(lambda marks: _bytes(self._piece(marks)))
        self.line_end = self._whole("\n")
        if not self.spaced:
            self.first = self.rest = _Chunks(self._plain_chunk)

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, word: str) -> list[int]:
        """Ids of one pre-token, by the model alone."""
        if word.isascii():
            word = word.replace(" ", "\u0120")
        else:
            word = self._as_letters(word)
        return [t.id for t in self.model.tokenize(word)]

    def _as_letters(self, word: str) -> str:
        """The visible characters that byte-level models put for the bytes of a word."""
        if not self.mapped:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            self.mapped = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        return "".join(map(self.mapped.__getitem__, word.encode()))

    def _plain_chunk(self, chunk: str) -> bytes:
        return self._chunk("", chunk)

    def _spaced_chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # the common case of `_chunk`, without its tests
            return _bytes([t.id for t in self.model.tokenize("\u0120" + chunk)])
        return self._chunk(" ", chunk)

    def _chunk(self, before: str, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if plain:
            word, marks = plain.groups()
            if not self.spaced and not word.islower():
                return self.rest[word.lower() + marks]
            if marks:
                return (self.rest if before else self.first)[word] + self.marks[marks]
            return _bytes(self._piece(before + word))
        if self.spaced and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            raise _Cut
        if self.spaced and "\n" in chunk and not SPACES.search(chunk):
            start, *others = chunk.split("\n")
            parts = [(self.rest if before else self.first)[start], *map(self.first.__getitem__, others)]
            return self.line_end.join(parts)
        return self._whole(before + chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.spaced:
            return b"".join(map(self.rest.__getitem__, text.replace("\n", " ").split(" ")))
        first, *others = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.rest.__getitem__, others))
        except _Cut:
            return self._whole(text)


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder per file and Python worker."""
    return TextEncoder(path)
