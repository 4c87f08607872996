"""Word-by-word use of a tokenizer of the tokenizers library.

Byte-pair encoding never merges across the pieces that the pre-tokenizer cuts,
so a text's ids are its pieces' ids one after another.  ``PieceEncoder`` cuts
texts with a plain pattern, asks the library only for pieces it has not seen,
and joins the answers.  The plain pattern holds for texts over a set of common
characters (``PLAIN``); any other text, and one that may hold a special token,
goes to the library whole.  Results are the library's in both cases.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: ASCII, Latin-1 and Latin Extended-A, without the few characters whose case or class differs between regex engines.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]*")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two ways of cutting, for plain characters: with leading spaces kept, or with white space dropped.
SPACED = re.compile(rf"{ENDINGS}| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
UNSPACED = re.compile(rf"{ENDINGS}|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")


def load(path: str):
    """The library's tokenizer without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cutting(path: str) -> str:
    """How the file cuts texts: 'spaced', 'unspaced', or 'other', for which everything goes to the library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if norm is None and byte_level.items() <= pre.items():
        return "spaced"
    if norm and norm.get("type") == "Sequence" and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
        first, *rest = pre["pretokenizers"]
        if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["use_regex"]:
            if first["pattern"].get("Regex") == ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                return "unspaced"
    return "other"


class Pieces(dict):
    """Piece to answer, cleared once it holds ``most`` pieces, so that memory stays bounded."""

    most = 800_000

    def room(self) -> None:
        if len(self) > self.most:
            self.clear()


def byte_letters() -> dict[int, str]:
    """The published one-to-one map of bytes to printable characters of byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.cut = cutting(path)
        self.known = Pieces()
        self.letters = byte_letters()
        self.words = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=False))]

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text over plain characters; None if the library has to see it whole."""
        if self.cut == "other" or "<|" in text or not PLAIN.fullmatch(text):
            return None
        return SPACED.findall(text) if self.cut == "spaced" else UNSPACED.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        self.known.room()
        cut = [self.pieces(t) for t in texts]
        new = set().union(*(p for p in cut if p)).difference(self.known)
        whole = [t for t, p in zip(texts, cut, strict=True) if p is None]
        tokenize, words, letters = self.tokenizer.model.tokenize, self.words, self.letters
        for piece in new:
            # the model sees a piece as the letters that stand for its bytes
            spelled = piece if piece.isascii() and piece.isalpha() else "".join(map(letters.__getitem__, piece.encode()))
            self.known[piece] = b"".join([words[t.id] for t in tokenize(spelled)])
        left = iter([self.raw(e.ids) for e in self.tokenizer.encode_batch(whole, add_special_tokens=False)] if whole else [])
        get = self.known.__getitem__
        return [next(left) if p is None else b"".join(map(get, p)) for p in cut]

    @staticmethod
    def raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()
