"""Toxicity by a noisy channel: disguised words are restored, then scored.

A writer means a word and sends it in disguise: letters as digits or signs, letters
repeated, spaces or dots between them.  A chunk that may be one becomes a lattice:
each character's run has the letters that it may stand for, none at all, or a word's
end, each with the channel's cost.  Viterbi's algorithm takes the cheapest
way through it under a language model of letters, whose states are the last two
letters, and its words are read instead of the chunk.

The language model holds counts of letter triples of all training texts: tasks add up
at most 64 x 64 x 64 numbers, whatever the input's size.

Restored texts are scored by a lexicon: words and beginnings of words (3 to 7 letters,
hashed) that occur in more toxic documents than chance explains, with weights, none
negative, of a logistic regression that is fitted in numpy and calibrated to the rate of toxic
labels.  It is fitted on about ``sample`` toxic and ``sample`` other labelled documents
(all, if there are fewer), chosen by a hash of the id; their ids are drawn first, so texts
are read where they lie, and only a few numbers for each reach the driver.

A document's score comes from the set of its words, from whole texts, in stretches.
Null and empty texts, and those without a word of the lexicon, have the
score of the constant alone.  Labels that are null, or whose ids are, aren't learned from;
an id with different labels is toxic.  Without both labels every score is 0.5.
Repeated rows get equal scores, and an exact copy counts once in the fit.  Columns
besides id and text aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = 64
END = 0  # a word's end, and what stands before its beginning


def _code(char: str) -> int:
    """END for what is no letter; a to z; other letters share 37 numbers."""
    if not char.isalpha():
        return END
    return ord(char) - 96 if "a" <= char <= "z" else 27 + ord(char) % 37


_CODES = np.array([_code(chr(i)) for i in range(1 << 16)], np.uint8)

#: Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u",
}
#: Signs around a word that belong to no disguise; three or more of a sign are decoration.
_EDGES = " .,;:!?\"'`´()[]{}<>…«»„“”‘’*#%&-–—_~^=/\\|"
_DECORATION = re.compile(r"^[$@+]{3,}|[$@+]{3,}$")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")

#: The channel's costs, as negative natural logarithms.
AS_SIGN, DROPPED, SPLIT, SEPARATOR_DROPPED, DIGIT_SPLIT, TWO_AS_ONE, MANY_AS_ONE, MANY_AS_TWO = 0.5, 6.0, 3.0, 0.2, 6.0, 3.0, 0.5, 1.0


class LetterModel:
    """Interpolated letter triples; costs are negative natural logarithms."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
        p3 = (c3 + 2 * p2[None]) / (c3.sum(2, keepdims=True) + 2)
        self.cost = (-np.log(p3)).astype(np.float32)


def letter_counts(rows: DataFrame) -> np.ndarray:
    """Counts of letter triples, word ends included, in all texts of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3)
        words: Counter[str] = Counter()
        for batch in common.sliced(batches, 200):
            for text in batch.column(0):
                for part in stretches(text.as_py() or ""):
                    words.update(WORD.findall(part.lower()))
                    if len(words) > 100_000:
                        total += _triples(words)
                        words = Counter()
        total += _triples(words)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["gram", "n"])

    found = rows.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 64^3 rows at most
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[[r["gram"] for r in found]] = [r["n"] for r in found]
    return counts


def _triples(words: Counter[str]) -> np.ndarray:
    if not words:
        return np.zeros(SYMBOLS**3)
    points = np.frombuffer(("\n\n" + "\n\n".join(words) + "\n\n").encode("utf-32-le"), np.uint32)
    codes = _CODES[np.where(points < len(_CODES), points, 0)].astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes + 2)
    # a word's triples: each of its letters and its end, after the two before
    grams = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
    return np.bincount(grams, times, SYMBOLS**3)


def stretches(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at white space."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + most)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_BREAK = re.compile(r"\s")


class Decoder:
    """The most likely words of a disguised chunk.

    Chunks are decoded in pieces of ``piece`` runs; the best way of a piece is
    taken before the next, so a chunk of any length needs little room.
    """

    def __init__(self, model: LetterModel, piece: int = 64):
        self.cost, self.piece = model.cost.reshape(-1).tolist(), piece
        self.cached = lru_cache(100_000)(self._decoded)

    def __reduce__(self):
        return _decoder, (np.array(self.cost, np.float32), self.piece)

    @staticmethod
    def options(char: str, n: int) -> list[tuple[str, float]]:
        """What a run of n equal characters may stand for, with costs; a space is a word's end."""
        if char.isalpha():
            return [(char, 0.0)] if n == 1 else [(char * 2, 0.0), (char, TWO_AS_ONE)] if n == 2 else [(char, MANY_AS_ONE), (char * 2, MANY_AS_TWO)]
        found = [("", SEPARATOR_DROPPED if char not in LEET else DROPPED), (" ", SPLIT if char not in LEET else DIGIT_SPLIT)]
        for letter in LEET.get(char, ""):
            found.append((letter, AS_SIGN))
            if n > 1:
                found.append((letter * 2, AS_SIGN))
        return found

    def decode(self, chunk: str) -> tuple[str, ...]:
        """Restored words of a lower-case chunk."""
        return self.cached(chunk) if len(chunk) <= self.piece else self._decoded(chunk)

    def _decoded(self, chunk: str) -> tuple[str, ...]:
        cost = self.cost
        ways: dict[tuple[int, int], tuple[float, tuple | None]] = {(END, END): (0.0, None)}
        out: list[str] = []
        for place, (char, run) in enumerate(groupby(chunk)):
            if place and place % self.piece == 0:
                state, (_, way) = min(ways.items(), key=lambda w: w[1][0])
                out.append(_spelled(way))
                ways = {state: (0.0, None)}
            options = self.options(char, sum(1 for _ in run))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, way) in ways.items():
                for letters, price in options:
                    total, x, y = so_far + price, a, b
                    for letter in letters:
                        z = _code(letter)
                        if z == END:
                            if y == END:  # already at a word's beginning
                                continue
                            total, x, y = total + cost[(x * SYMBOLS + y) * SYMBOLS], END, END
                        else:
                            total, x, y = total + cost[(x * SYMBOLS + y) * SYMBOLS + z], y, z
                    held = after.get((x, y))
                    if held is None or total < held[0]:
                        after[x, y] = (total, (way, letters) if letters else way)
            ways = after
        best = min(ways.items(), key=lambda w: w[1][0] + (cost[(w[0][0] * SYMBOLS + w[0][1]) * SYMBOLS] if w[0][1] != END else 0.0))
        out.append(_spelled(best[1][1]))
        return tuple("".join(out).split())

    def chunk(self, token: str) -> tuple[str, ...] | None:
        """Restored words of a lower-case chunk without white space; nothing if it is a plain word or has no letter."""
        if token.isalpha():
            return self.decode(token) if _TRIPLE.search(token) else None
        core = _DECORATION.sub("", token.strip(_EDGES)).strip(_EDGES)
        if not core or core.isalpha() and not _TRIPLE.search(core):
            return (core,) if core else ()
        return self.decode(core) if WORD.search(core) else ()

    def words(self, text: str) -> set[str]:
        """Different words of a text: as they stand, and restored where they may be disguised."""
        found: set[str] = set()
        for part in stretches(text):
            part = part.lower()
            triple = _TRIPLE.search(part) is not None
            for token in set(part.split()):
                if token.isalpha():
                    found.add(token)
                    if not triple:
                        continue
                else:
                    found.update(WORD.findall(token))
                restored = self.chunk(token)
                if restored:
                    found.update(restored)
            for run in _SPACED.finditer(part):
                found.update(self.decode(run.group()))
        return found

    def restore(self, text: str) -> str:
        """The text in lower case, with its chunks' restored words, parted by single spaces; line ends stay."""
        lines = []
        for line in text.lower().split("\n"):
            spaced = _SPACED.sub(lambda m: " ".join(self.decode(m.group())), line)
            lines.append(" ".join(" ".join((t,) if (r := self.chunk(t)) is None else r) for t in spaced.split()))
        return "\n".join(line for line in lines)


def _decoder(cost: np.ndarray, piece: int) -> Decoder:
    made = Decoder.__new__(Decoder)
    made.cost, made.piece = cost.tolist(), piece
    made.cached = lru_cache(100_000)(made._decoded)
    return made


def _spelled(way: tuple | None) -> str:
    letters = []
    while way is not None:
        way, last = way
        letters.append(last)
    return "".join(reversed(letters))


BUCKETS = 1 << 22


def features(word: str) -> list[int]:
    """Hashed word and its beginnings."""
    raw = [f"={word}"] + [f"^{word[:n]}" for n in range(3, min(7, len(word) - 1) + 1)]
    return [zlib.crc32(r.encode()) % BUCKETS for r in raw]


class Model:
    """A decoder, and the lexicon's weights."""

    def __init__(self, decoder: Decoder, weights: dict[int, float], bias: float):
        self.decoder, self.weights, self.bias = decoder, weights, bias
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def score(self, text: str) -> float:
        """The probability that the text is toxic."""
        own: set[int] = set()
        if self.weights:
            if len(self.seen) > 300_000:
                self.seen.clear()
            seen, weights = self.seen, self.weights
            for word in self.decoder.words(text):
                known = seen.get(word)
                if known is None:
                    known = seen[word] = tuple(f for f in features(word) if f in weights)
                if known:
                    own.update(known)
        z = self.bias + math.fsum(self.weights[f] for f in own)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def regress(rows: list[np.ndarray], toxic: np.ndarray, importance: np.ndarray, n_features: int, ridge: float = 1e-5, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights, none below zero, and constant of a logistic regression on sets of features, by Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    share = importance / importance.sum()
    rate_of_toxic = float((share * toxic).sum())
    w = np.zeros(n_features + 1)
    w[-1] = math.log(rate_of_toxic / (1 - rate_of_toxic))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(at, w[feature], len(rows)) + w[-1], -30, 30)
        off = share * (1 / (1 + np.exp(-z)) - toxic)
        g = np.append(np.bincount(feature, off[at], n_features), off.sum())
        g[:-1] += ridge / n_features**0.5 * w[:-1]
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= rate * (1 - step / (steps + 1)) * 2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def _drawn(docs: DataFrame, labels: DataFrame, training: Column, sample: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(doc_id, toxic) of about ``sample`` training ids of each label; how many there are of each, and the share that is drawn."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = docs.where(training & F.col("doc_id").isNotNull()).select("doc_id").distinct().join(known, "doc_id")
    counts = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}  # two rows
    shares = {t: min(1.0, sample / max(1, counts.get(t, 0))) for t in (0, 1)}
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    return ids.where(mark < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]) * 1_000_003), counts, shares


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = 6000, most_features: int = 2000, least_g: float = 15.0) -> Model:
    """Learns from rows that ``training`` selects: letters of all of them, labels of the drawn ones."""
    spark = docs.sparkSession
    store = common.Scratch(spark, "toxicity")
    decoder = Decoder(LetterModel(letter_counts(docs.where(training))))
    drawn, counts, shares = _drawn(docs, labels, training, sample)
    if not counts.get(0) or not counts.get(1):
        return Model(decoder, {}, 0.0)
    drawn = store.write(drawn, "drawn")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 200):
            found = []
            for text in batch.column(1):
                words = decoder.words(text.as_py() or "")
                found.append(np.unique(np.fromiter((f for w in words for f in features(w)), np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["toxic", "own"])

    # about 2 * sample ids travel to the texts
    texts = docs.where(training).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    documents = store.write(texts.mapInArrow(sets, "toxic int, own binary").distinct(), "documents")
    n = {r["toxic"]: r["count"] for r in documents.groupBy("toxic").count().collect()}

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 500):
            for toxic in (0, 1):
                own = [np.frombuffer(o.as_py(), np.uint32) for t, o in zip(batch.column(0).to_pylist(), batch.column(1)) if t == toxic]
                if own:
                    feature, times = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int64)), pa.array(times if toxic else 0 * times), pa.array(0 * times if toxic else times)], ["feature", "a", "b"])

    # the likelihood ratio of a feature's rate in toxic and in other documents, each set weighed as one half
    counted = documents.mapInArrow(occurrences, "feature long, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    pa_, pb = F.col("a") / n[1], F.col("b") / n[0]
    both = (F.col("a") + F.col("b")) / (n[0] + n[1])
    part = lambda k, p, q: F.when(k > 0, k * F.ln(p / q)).otherwise(0.0)
    g = 2 * (part(F.col("a"), pa_, both) + part(n[1] - F.col("a"), 1 - pa_, 1 - both) + part(F.col("b"), pb, both) + part(n[0] - F.col("b"), 1 - pb, 1 - both))
    chosen = counted.where((pa_ > pb) & (g > least_g)).orderBy(g.desc(), "feature").limit(most_features).select("feature").collect()
    place = {r["feature"]: i for i, r in enumerate(chosen)}
    if not place:
        rate = counts[1] / (counts[0] + counts[1])
        return Model(decoder, {}, math.log(rate / (1 - rate)))
    wanted = np.array(sorted(place), np.uint32)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(o.as_py(), np.uint32) for o in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.intersect1d(o, wanted, True).tobytes() for o in own], pa.binary())], ["toxic", "own"])

    rows = sorted(documents.mapInArrow(known, "toxic int, own binary").collect())  # 2 * sample rows of the lexicon's features
    sets_of = [np.array([place[f] for f in np.frombuffer(r["own"], np.uint32).tolist()], np.int64) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], float)
    importance = np.where(toxic > 0, counts[1] / n[1], counts[0] / n[0])
    weights, bias = regress(sets_of, toxic, importance, len(place))
    return Model(decoder, {f: float(weights[i]) for f, i in place.items() if weights[i] > 0}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.score(t.as_py() or "") for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double")


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, restored) of every row: its whole text with disguised words restored; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model.decoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if (x := t.as_py()) is None else sent.value.restore(x) for t in batch.column(1)], pa.string())], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, restored string")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from rows whose crc32 of the id modulo 3 is not 1."""
    held_out = F.coalesce(common.remainder("doc_id", 3) == 1, F.lit(False))
    found = score(docs, fit(docs, labels, ~held_out, sample))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
