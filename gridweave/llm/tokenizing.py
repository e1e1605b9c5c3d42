"""Exact, cached encoding with the `tokenizers` library.

Encoding a text whole spends most of its time on words seen before. Both vocabularies used here let a
text be cut at places where the encoding cannot depend on what stands on the other side, so each
distinct piece goes to the library once per cache:

- "dropped" (white space is dropped between words): any run of ASCII white space is such a place.
- "joined" (one blank may lead a word): a single blank between two characters that are no white space.

Pieces that are not plain Latin text, or that could hold a special token, are encoded by the library's full
encode(); plain pieces are split into the vocabulary's own pre-tokens and each is given to the
library's model. Ids are the same as those of encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import contextlib
import functools
import re

import numpy as np
from tokenizers import Tokenizer

#: Bounds of the caches: entries, not bytes; entries are short (a word and its ids). Pieces have two generations of that size.
MAX_PIECES, MAX_TOKENS, MAX_LENGTH = 500_000, 150_000, 64

_ASCII_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters without those whose lower case or normal form is not one character, digits, ASCII marks but "<".
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[{_LATIN}0-9!-/:;=>?@\[-`{{-~\n]+")
#: Marks that are a pre-token of their own behind a word's end.
_MARKS = tuple(".,;:!?)")
#: White space, or what Python takes for it, other than blanks and line feeds.
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# The pre-token patterns of the two vocabularies, on plain pieces.
_DROPPED_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
_JOINED_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """encode(text) gives the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.joined = self.tokenizer.normalizer is None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.tokens: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.pattern = _JOINED_PATTERN if self.joined else _DROPPED_PATTERN

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, token: str) -> bytes:
        written = token.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.coded[x.id] for x in self.model.tokenize(written)])

    def _token(self, token: str) -> bytes:
        found = self.tokens.get(token)
        if found is None:
            found = self._model(token)
            if len(token) <= MAX_LENGTH:
                if len(self.tokens) >= MAX_TOKENS:
                    self.tokens.clear()
                self.tokens[token] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece[1:] if self.joined and piece[:1] == " " else piece):
            return self._whole(piece)
        return b"".join(map(self._token, self.pattern.findall(piece if self.joined else piece.lower())))

    def _known(self, part: str) -> bytes:
        """Ids of a part, which a blank precedes if the vocabulary joins blanks to words. A full cache becomes the older one, so words in use survive."""
        ids = self.older.get(part)
        if ids is None:
            if part.isascii() and part.isalpha():  # one pre-token, whose letters are written as themselves
                coded = self.coded
                ids = b"".join([coded[x.id] for x in self.model.tokenize(self.blank + part if self.joined else part.lower())])
            elif part[-1:] in _MARKS and part.isascii() and part[:-1].isalpha():  # a word and a mark are two pre-tokens
                word = self.pieces.get(part[:-1])
                ids = (self._known(part[:-1]) if word is None else word) + self._token(part[-1])
            else:
                ids = self._piece(" " + part if self.joined else part)
        if len(part) <= MAX_LENGTH:
            if len(self.pieces) >= MAX_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[part] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """The parts of a text between safe places."""
        rare = _RARE_SPACE.search(text)
        if not self.joined:
            return [p for p in _ASCII_SPACE.split(text) if p] if rare else text.split()
        odd = rare or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n"
        return _SINGLE_BLANK.split(text) if odd else text.split(" ")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._whole(text)
        parts = self.split(text)
        first = self._piece(parts.pop(0)) if self.joined else b""
        out = list(map(self.pieces.get, parts))
        with contextlib.suppress(ValueError):  # no more of them
            k = -1
            while True:
                k = out.index(None, k + 1)
                ids = self.pieces.get(parts[k])
                out[k] = self._known(parts[k]) if ids is None else ids
        return first + b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(path)
