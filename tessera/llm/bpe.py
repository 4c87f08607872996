"""Byte-pair encoding and decoding as streaming transducers.

Encoding.  Whether a merge happens can depend on text to its right: a merge
that overlaps it from the right and has a smaller rank takes its symbols away,
that one may itself be prevented by a third one further right with a still
smaller rank, and so on.  Ranks fall along such a chain, so chains are finite,
and ``lookahead`` computes the longest stretch of symbols that any chain of a
merge list covers.  A token that starts more than that many symbols before the
end of what has been read can no longer change: ``Transducer`` emits it and
forgets its symbols.  It holds at most the lookahead plus two blocks, however
long the piece is.  Merges never cross the pieces of the pre-tokenizer, so a text
goes through in stretches of about 64 thousand characters that end between
words; ids leave in blocks, and the decoder takes each block as it comes.  A file
of another kind of pre-tokenizer is cut as a whole.

Decoding.  ``Detokenizer`` maps ids to bytes and bytes to text with an
incremental UTF-8 state machine, which keeps at most three bytes between ids;
ill-formed sequences become U+FFFD.

Inputs: null and empty texts give no ids and the empty text.  Rows are
independent of each other, so ties, repeated rows and skewed keys need no care;
an empty table gives an empty table; extra columns are kept aside and ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vocab

#: Symbols that end a word stand as one character each: this is added to the code of the character before the suffix.
_END = 0xF0000

_GAP = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


LETTER_OF = vocab.byte_letters()
BYTE_OF = {c: b for b, c in LETTER_OF.items()}


class Merges:
    """A merge list: pairs of symbol strings in order of rank, with the ids of single symbols and of results."""

    def __init__(self, pairs: list[tuple[str, str]], ids: dict[str, int]):
        self.ids = ids
        self.rank = {pair: r for r, pair in reversed(list(enumerate(pairs)))}
        made = {}
        for left, right in pairs:
            for part in (left, right):
                if len(part) > 1 and part not in made:
                    raise ValueError(f"merge list isn't proper: {part!r} is used before it is made")
            made.setdefault(left + right, None)
        self.lookahead = lookahead(pairs)


def lookahead(pairs: list[tuple[str, str]]) -> int:
    """Symbols before the end of what was read in which tokens may still change.

    reach[prefix] is the longest stretch to the right of that prefix's start
    that a merge beginning with the prefix can depend on, over merges so far.
    A merge of larger rank can depend on one of smaller rank if a proper suffix
    of it is a prefix of the other; it starts as much further left as the rest of it is long.
    """
    reach: dict[str, int] = {}
    most = 0
    for left, right in pairs:
        whole = left + right
        own = n = len(whole)
        for i in range(1, n):
            own = max(own, i + reach.get(whole[i:], 0))
        most = max(most, own)
        for i in range(1, n + 1):
            if reach.get(whole[:i], 0) < own:
                reach[whole[:i]] = own
    return most


def merge(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """All merges of a finished stretch, smallest rank first and leftmost first among equals."""
    if len(symbols) > 48:
        return _merge_long(symbols, rank)
    get, none = rank.get, len(rank)
    while len(symbols) > 1:
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def _merge_long(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap of candidate pairs over a linked list."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := rank.get((symbols[a], symbols[b]))) is not None:
                heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
    return [s for s in symbols if s]


class Transducer:
    """Ids of one piece, given block by block: ``feed`` returns what has become stable, ``close`` the rest."""

    def __init__(self, merges: Merges, block: int | None = None):
        self.merges, self.block, self.held = merges, block or max(256, merges.lookahead), ""

    def feed(self, symbols: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(symbols), self.block):
            self.held += symbols[i : i + self.block]
            stable = len(self.held) - self.merges.lookahead
            if stable >= self.block:
                at = 0
                for token in merge(list(self.held), self.merges.rank):
                    if at >= stable:
                        break
                    out.append(self.merges.ids[token])
                    at += len(token)
                self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, ""
        return [self.merges.ids[t] for t in merge(list(held), self.merges.rank)]


class Detokenizer:
    """Ids to text, piece by piece."""

    def __init__(self, table: list[bytes], between: bytes):
        self.table, self.between = table, between
        self.reset()

    def reset(self) -> None:
        self.machine, self.started = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        raw = self.between.join(map(self.table.__getitem__, ids))
        if raw and self.between and self.started:
            raw = self.between + raw
        self.started |= bool(raw)
        return self.machine.decode(raw)

    def close(self) -> str:
        text = self.machine.decode(b"", True)
        self.reset()
        return text


class Codec:
    """Encoder and decoder of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: byte-level byte-pair encoding is asked for")
        self.suffix = model.get("end_of_word_suffix") or ""
        fold = self._fold
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        self.merges = Merges([(fold(a), fold(b)) for a, b in pairs], {fold(t): i for t, i in model["vocab"].items()})
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.library, self.cut = vocab.load(path), vocab.cutting(path)
        decoder = (spec.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: unknown decoder {decoder}")
        table = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in (model["vocab"] | self.special).items():
            letters = decoder and token not in self.special
            table[i] = bytes(BYTE_OF[c] for c in token) if letters else token.encode()
        self.detokenizer = Detokenizer(table, b"" if decoder else b" ")
        self.known, self.written = vocab.Pieces(), vocab.Pieces()

    def _fold(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            stem = token[: -len(self.suffix)]
            return stem[:-1] + chr(_END + ord(stem[-1]))
        return token

    def symbols(self, piece: str) -> Iterator[str]:
        """The symbols of a piece, in blocks; the last one carries the end of the word."""
        for i in range(0, len(piece), 4096):
            block = "".join(map(LETTER_OF.__getitem__, piece[i : i + 4096].encode()))
            if self.suffix and i + 4096 >= len(piece):
                block = block[:-1] + chr(_END + ord(block[-1]))
            yield block

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer, which merges never cross."""
        machine, out = Transducer(self.merges), []
        for block in self.symbols(piece):
            out += machine.feed(block)
        return out + machine.close()

    def pieces(self, text: str) -> list[str]:
        """Cuts a text without special tokens, as the vocabulary's own normaliser and pre-tokenizer do."""
        if self.cut != "other" and vocab.PLAIN.fullmatch(text):
            return vocab.SPACED.findall(text) if self.cut == "spaced" else vocab.UNSPACED.findall(text.lower())
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        letters = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [bytes(BYTE_OF[c] for c in p).decode("utf-8", "surrogateescape") for p in letters]

    def stream(self, text: str, block: int = 8192) -> Iterator[list[int]]:
        """Ids of a text in blocks, as soon as they are stable."""
        out: list[int] = []
        for stretch in self._stretches(text):
            for part in self._parts(stretch):
                for piece in [None] if part in self.special else self.pieces(part):
                    if piece is None:
                        out.append(self.special[part])
                    elif len(piece) < block:
                        out += self._known(piece)
                    else:
                        machine = Transducer(self.merges)
                        for symbols in self.symbols(piece):
                            out += machine.feed(symbols)
                            if len(out) >= block:
                                yield out
                                out = []
                        out += machine.close()
                    if len(out) >= block:
                        yield out
                        out = []
        if out:
            yield out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))

    def _stretches(self, text: str, most: int = 1 << 16) -> Iterator[str]:
        """The text in stretches that no piece and no special token crosses: cut before a single space between ASCII letters."""
        at = 0
        while self.cut != "other" and len(text) - at > most and (found := _GAP.search(text, at + most)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which stay themselves."""
        parts = [text]
        if "<|" in text:
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [p for p in parts if p]

    def _known(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.piece(piece)
            if len(piece) < 64:
                self.known.room()
                self.known[piece] = ids
        return ids

    def decode(self, ids: Iterable[int], block: int = 8192) -> Iterator[str]:
        ids = iter(ids)
        while some := list(islice(ids, block)):
            yield self.detokenizer.feed(some)
        yield self.detokenizer.close()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>): every row's whole text, encoded."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in common.sliced(batches):
            ids = pa.array([use.encode(t) for t in common.texts(batch, "_text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_column, "ids"])

    return docs.select(id_column, docs[text_column].alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): every row's ids, decoded."""
    kind = dict(tokens.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in common.sliced(batches):
            made = ["".join(use.decode(ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_column, "text"])

    return tokens.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text and decodes its ids again, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in common.sliced(batches):
            n, spelled, decoded = [], [], []
            for text in batch.column(1):
                count, digits, characters = 0, hashlib.sha256(), hashlib.sha256()
                for ids in use.stream(text.as_py() or ""):
                    digits.update((" " * bool(count) + " ".join(map(str, ids))).encode())
                    characters.update(use.detokenizer.feed(ids).encode())
                    count += len(ids)
                characters.update(use.detokenizer.close().encode())
                n.append(count)
                spelled.append(digits.hexdigest())
                decoded.append(characters.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spelled), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
