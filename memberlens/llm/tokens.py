"""Token ids by a public tokenizer, with a memory of words already seen.

A pre-tokenizer never joins what stands on the two sides of white space, nor a word with the stops behind it, so a text
can be cut there and its pieces be looked up one by one. New words go through the tokenizer's model; pieces that are
anything but a Latin word with stops go through the whole tokenizer. Strings of special tokens are cut out first and give
their ids, as the library does by default; what stands between two of them is a text of its own.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np

#: Words and other pieces that a worker remembers (some 200 bytes each), and the longest ones worth it. A full memory starts
#: anew; results do not depend on it.
REMEMBERED = 400_000
LONGEST = 32

#: White space for Python but not for the tokenizers' patterns: texts with these take the plain path.
UNSURE = "\x1c\x1d\x1e\x1f"

#: Cuts for vocabularies in which a word carries the space in front of it.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: A word of composed Latin letters (lower-casing and normal forms act letter by letter) and the ASCII signs behind it,
#: apostrophes aside.
PLAIN_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-įı-ž]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies show for each byte: printable bytes show themselves, the others
    follow from U+0100 in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: b if b in shown else next(rest) for b in range(256)}


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit integers as bytes; for a few of them far quicker than a numpy array."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_LETTERS = byte_letters()
_SPACE = chr(_LETTERS[0x20])
_LOADED: dict[str, WordEncoder] = {}


class WordEncoder:
    """``encode(text)`` gives the ids of a whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None  # lower case, white space dropped
        self.cut = str.split if self.lower else SPACED.findall
        special = {t.content: np.uint32(i).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special, self.between = special, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word or run of stops, from the model itself."""
        ids = self.known.get(word)
        if ids is None:
            # ASCII letters and stops show themselves
            shown = word.replace(" ", _SPACE) if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = little_endian([t.id for t in self.model.tokenize(shown)])
            self.remember(word, ids)
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a piece that is not remembered: a word, a word with stops, or anything else."""
        match = PLAIN_WORD.fullmatch(piece)
        if match is None:
            ids = self.plain(piece)
            self.remember(piece, ids)
            return ids
        word, stops = match.groups()
        ids = self.word(word.lower() if self.lower else word)
        return ids + self.word(stops) if stops else ids

    def remember(self, piece: str, ids: bytes) -> None:
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids

    def encode(self, text: str) -> bytes:
        if any(map(text.__contains__, UNSURE)):  # a search for a fixed string is far quicker than one for a pattern
            return self.plain(text)
        if any(map(text.__contains__, self.special)):
            out, at = [], 0
            for m in self.between.finditer(text):
                out += [self.stretch(text[at:m.start()]), self.special[m.group()]]
                at = m.end()
            return b"".join([*out, self.stretch(text[at:])])
        return self.stretch(text)

    def stretch(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        cut = self.cut(text)
        found = list(map(self.known.get, cut))
        if None in found:
            found = [self.piece(w) if ids is None else ids for w, ids in zip(cut, found)]
        return b"".join(found)


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def encoded(texts: Iterable[str | None], path: str, end_id: int | None = 0) -> Iterable[bytes]:
    """Ids of each text (null: empty), with ``end_id`` appended."""
    tail = b"" if end_id is None else np.uint32(end_id).tobytes()
    enc = encoder(path)
    for text in texts:
        yield (enc.encode(text) if text else b"") + tail
