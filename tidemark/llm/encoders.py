"""Token ids of whole texts by public tokenizers, a word at a time and each distinct word once.

Both tokenizers cut a text at white space before anything else, so a text's ids are those of its
pieces in order. Pieces are looked up in a bounded table that a Python worker keeps across tasks; only
a new piece is encoded, by the tokenizer's own model. A piece with anything out of the ordinary (a
character beyond Latin, several spaces in a row, ...) is encoded by the whole tokenizer.

The strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Bytes of pieces and ids that a worker's table takes in before it drops those not used since it last did; it holds up to twice as many.
MOST_BYTES = 48 << 20
#: Bytes that an entry takes beside its piece and ids: two objects' heads and its share of the dictionary.
ENTRY_BYTES = 164
#: Latin letters: their lower case goes letter by letter and they are in composed form.
LATIN = "ɐ"
PUNCTUATION = ".,;:!?*%&$#|<>()=+@^~"


#: A text with such white space is not cut before its spaces.
ODD = re.compile(r"\s\s|[^\S \n]")
#: Every text that ODD finds something in has one of these: pairs of white space, other ASCII space, the starts of other space.
SIGNS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def spaced_pieces(text: bytes) -> list[bytes] | None:
    """A line break and the text, cut before each space and line break, which no pre-token spans; null where white space is odd.

    A piece is named by what it holds but for the space that leads it, so one that a line break leads stands
    for itself, and any other for a space and itself. The first piece has a line break too many.
    """
    if any(sign in text for sign in SIGNS) and ODD.search(text.decode(errors="replace")):
        return None
    return (b"\n" + text).replace(b"\n", b" \n").split(b" ")[1:]


def piece_text(piece: bytes) -> str:
    return (piece if piece[:1] == b"\n" else b" " + piece).decode(errors="replace")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones for themselves, then from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level(s: str) -> str:
    if s.isascii() and s.isprintable():  # of these only the space has another letter
        return s.replace(" ", "Ġ")
    return s.encode().decode("latin-1").translate(byte_letters())


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class _Pieces(dict):
    """Piece (UTF-8) -> its ids as 32-bit little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.make(self.text_of(piece))
            if len(piece) > 200:  # rarely seen again
                return ids
        if self.held >= MOST_BYTES:
            self.before = dict(self)
            self.clear()
            self.held = 0
        self[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES
        return ids

    @staticmethod
    def text_of(piece: bytes) -> str:
        return piece.decode(errors="replace")

    def make(self, piece: str) -> bytes:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def one(self, word: str) -> bytes:
        """Of a word that the tokenizer does not cut further."""
        return as_bytes([t.id for t in self.model.tokenize(byte_level(word))])


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class LowerWordPieces(_Pieces):
    """For a tokenizer that lower-cases, drops white space and marks word ends."""

    def make(self, piece: str) -> bytes:
        if max(piece) < LATIN and "İ" not in piece:
            if piece.isalpha():
                low = piece.lower()
                return self.one(low) if low == piece else self[low.encode()]
            word = piece.rstrip(PUNCTUATION)
            if len(word) < len(piece) and word.isalpha():  # the tokenizer cuts there
                return self[word.encode()] + self[piece[len(word) :].encode()]
        return self.whole(piece)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


class SpacedPieces(_Pieces):
    """For a byte-level tokenizer that joins a single space to the word after it; pieces are those of ``spaced_pieces``."""

    text_of = staticmethod(piece_text)

    def make(self, piece: str) -> bytes:
        if piece[0] == "\n":
            return self.whole("\n") + (self.bare(piece[1:]) if len(piece) > 1 else b"")
        return self.bare(piece)

    def bare(self, piece: str) -> bytes:
        """Of a piece with a space or nothing before it."""
        if max(piece) < LATIN:
            if piece.removeprefix(" ").isalpha():
                return self.one(piece)
            word = piece.rstrip(PUNCTUATION)
            if len(word) < len(piece) and word.removeprefix(" ").isalpha():  # the tokenizer cuts there
                ids = self[word[1:].encode()] if word[0] == " " else self.one(word)
                return ids + self[b"\n" + piece[len(word) :].encode()][len(self[b"\n"]) :]
        return self.whole(piece)

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        pieces = spaced_pieces(text)
        return self.whole(text.decode(errors="replace")) if pieces is None else b"".join(map(self.__getitem__, pieces))[len(self[b"\n"]) :]


KINDS = {"lower_words": LowerWordPieces, "spaced_words": SpacedPieces}


@lru_cache(maxsize=4)
def encoder(kind: str, path: str) -> _Pieces:
    """The worker's encoder of this kind, with the table that earlier tasks have filled."""
    return KINDS[kind](path)
