"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its words' features: each word and
its character 3- and 4-grams with word ends, hashed into a table of fixed size.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on fragments of a bounded sample of labelled documents: about
``per_label`` documents of each label, chosen by a hash of id and text.  A fifth of
them is kept back to fit the softmax temperature, so that scores are calibrated,
and the least score below which a prediction counts as rejected.

Prediction reads whole texts.  As the softmax is linear in the average, each
word adds a fixed vector, which a worker keeps for words it has seen.

Null text or no letter: language ``und``, score 0, rejected.  A null label or id
is never learned from.  No labelled rows at all: everything is ``und``.  Only the
text enters a prediction; repeated rows get equal predictions; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def features(word: str, buckets: int) -> list[int]:
    """Hashed features of a lower-case word."""
    framed = f"<{word}>"
    grams = [framed] + [framed[i : i + n] for n in (3, 4) for i in range(len(framed) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels: embeddings times softmax
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    #: A worker's words: place in ``rows``, which holds summed weights and, last, the number of features.
    seen: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "rows": None}

    def _learn(self, words: set[str]) -> None:
        if len(self.seen) > 300_000:
            self.seen.clear()
        new = sorted(words.difference(self.seen))
        if self.rows is None or len(self.rows) < len(self.seen) + len(new):
            grown = np.zeros((2 * (len(self.seen) + len(new)), len(self.labels) + 1), np.float32)
            if self.rows is not None:
                grown[: len(self.seen)] = self.rows[: len(self.seen)]
            self.rows = grown
        if new:
            own = [features(w, len(self.weights)) for w in new]
            sizes = np.array([len(f) for f in own])
            at = len(self.seen)
            self.rows[at : at + len(new), :-1] = np.add.reduceat(self.weights[np.concatenate(own)], np.cumsum(sizes) - sizes)
            self.rows[at : at + len(new), -1] = sizes
            self.seen.update(zip(new, range(at, at + len(new))))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score of each text."""
        cut = [WORD.findall(t.lower()) for t in texts]
        self._learn(set().union(*cut))
        names, scores = [], np.zeros(len(cut))
        for i, words in enumerate(cut):
            if not self.labels or not any(c.isalpha() for w in words for c in w):
                names.append(UNKNOWN)
                continue
            total = self.rows[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
            p = softmax((total[:-1] / total[-1] + self.bias)[None] / self.temperature)[0]
            names.append(self.labels[int(p.argmax())])
            scores[i] = p.max()
        return names, np.minimum(scores, 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fragments(words: list[str], seed: int) -> list[str]:
    """A few stretches of a text, from one word to many, and from anywhere in it."""
    rng = np.random.default_rng(seed)
    out = []
    for low, high in ((1, 4), (4, 16), (16, 80)):
        n = min(len(words), int(rng.integers(low, high)))
        at = int(rng.integers(0, len(words) - n + 1))
        out.append(" ".join(words[at : at + n]))
    return out


def train(examples: list[tuple[str, str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, least_steps: int = 1200, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits embeddings and softmax to (text, label) by mini-batch gradient descent with a falling rate."""
    labels = sorted({label for _, label in examples})
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    soft, bias = np.zeros((dim, len(labels))), np.zeros(len(labels))
    rows = []
    for text, label in examples:
        if own := [f for w in WORD.findall(text.lower()) for f in features(w, buckets)]:
            rows.append((np.array(own), labels.index(label)))
    if not rows:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0))
    size, step = 64, 0
    each = -(-len(rows) // size)
    epochs = max(epochs, -(-least_steps // each))
    steps = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), size):
            batch = [rows[j] for j in order[i : i + size]]
            lengths = np.array([len(f) for f, _ in batch])
            flat, at = np.concatenate([f for f, _ in batch]), np.cumsum(lengths) - lengths
            mean = np.add.reduceat(table[flat], at) / lengths[:, None]
            error = softmax(mean @ soft + bias)
            error[np.arange(len(batch)), [y for _, y in batch]] -= 1
            now = rate * (1 - step / steps)
            back = np.repeat(error @ soft.T / lengths[:, None], lengths, 0)
            soft -= now * mean.T @ error
            bias -= now * error.mean(0)
            used, where = np.unique(flat, return_inverse=True)
            for d in range(dim):
                table[used, d] -= now * np.bincount(where, back[:, d])
            step += 1
    return Model(labels, (table @ soft).astype(np.float32), bias)


def calibrate(model: Model, examples: list[tuple[str, str]], lost: float = 0.001) -> Model:
    """Sets the temperature by likelihood, and the rejection bound so that at most ``lost`` of right answers are rejected."""
    usable = [(t, y) for t, y in examples if y in model.labels and WORD.search(t)]
    if not usable:
        return model
    logits = []
    model._learn({w for t, _ in usable for w in WORD.findall(t.lower())})
    for t, _ in usable:
        total = model.rows[[model.seen[w] for w in WORD.findall(t.lower())]].sum(0)
        logits.append(total[:-1] / total[-1] + model.bias)
    z, y = np.array(logits), np.array([model.labels.index(label) for _, label in usable])
    grid = np.geomspace(0.05, 8, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-300).mean()))
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == y]
    model.reject_below = float(min(0.5, np.quantile(right, lost))) if right.size else 0.0
    return model


def fit(docs: DataFrame, training, per_label: int = 1500, most_labels: int = 500) -> Model:
    """Learns from rows that ``training`` (a column) selects: about ``per_label`` documents of each label, by a hash of id and text.

    Beyond ``most_labels`` labels only the most frequent ones are learned.  What
    reaches the driver is three fragments of each document, so its size depends on
    these two numbers only.
    """
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).collect()}
    if not counts:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for label, n in counts.items() for x in (label, min(1.0, per_label / n))))[F.col("lang")]
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows = []
            for key, mark, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                words = WORD.findall(text)
                rows += [(key, i, mark, f, label) for i, f in enumerate(fragments(words, key & 0xFFFFFFFF) if words else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "i", "mark", "text", "lang"])

    # Repeated rows are learned from once.
    chosen = usable.where(mark < share * 1_000_003).select(F.col("doc_id").cast("long"), mark.alias("mark"), "text", "lang").dropDuplicates(["doc_id", "mark", "lang"])
    found = sorted(map(tuple, chosen.mapInArrow(run, "doc_id long, i int, mark long, text string, lang string").collect()))
    if not found:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0))
    kept_back = [(text, label) for _, _, mark, text, label in found if mark % 5 == 0]
    return calibrate(train([(text, label) for _, _, mark, text, label in found if mark % 5]), kept_back)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the table of weights has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            names, scores = sent.value.predict(common.texts(batch))
            rejected = [n == UNKNOWN or s < sent.value.reject_below for n, s in zip(names, scores.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, per_label: int = 1500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learns from rows whose crc32 of the id modulo 4 is not 2."""
    held_out = F.coalesce(common.remainder("doc_id", 4) == 2, F.lit(False))
    found = predict(docs, fit(docs, ~held_out, per_label))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
