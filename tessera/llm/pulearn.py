"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is a sample of all
training documents, whatever their label.  The classifier minimises the
non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with the logistic loss; where the second part would fall below zero, the step
climbs back, which keeps the negatives' risk from being over-fitted.  The class
prior is estimated from positives and unlabelled documents alone: a network
learns to tell half of the ones from half of the others, and among the highest
scores of the other halves the ratio of the two sets' shares, least with its
confidence bound, is the prior (best bin estimation).  Labels of 0 are not used.
g is a network with one hidden layer over measurements of the whole text and the
shares of its words by hashed bucket, trained in numpy on about ``sample``
positives and as many unlabelled documents, chosen by a hash of id and text; only
their measurements reach the driver.

Null and empty texts have measurements too (all zero) and get a score.  Rows
without id are scored, not learned from; repeated rows are learned from once.  A
document with several labels counts as positive if none of them is 0.  Without
any positive nothing is learned and every score is 0.5.  Repeated rows get equal scores; an empty table
gives an empty result; only the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASSES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASSES[[*b"0123456789"]] = 3
_CLASSES[[*b".,;:?'\"()-"]] = 4
_CLASSES[[*b"!"]] = 5
_CLASSES[[*b"#*$%&<>@=+/\\_^~{}[]"]] = 6
_CLASSES[[*b"|"]] = 7
_CLASSES[[*b" \t\n\r\x0b\x0c"]] = 8
_CLASSES[128:] = 9
HASHED = 64  # buckets of words
MEASURES = 20 + HASHED


def measure(raw: bytes) -> np.ndarray:
    """Measurements of a whole text; shares and logarithms, so that length matters little."""
    out = np.zeros(MEASURES)
    words = raw.split()
    n = len(words)
    if not n:
        return out
    data = np.frombuffer(raw, np.uint8)
    share = np.bincount(_CLASSES[data], minlength=10)
    letters = share[1] + share[2] + share[9]
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stutters = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    codes = np.bincount(data, minlength=256)
    p = codes[codes > 0] / len(data)
    out[:20] = (
        np.log1p(n), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        share[2] / max(1, letters), share[3] / len(data), share[4] / n, share[5] / n, share[6] / n, share[7] / n,
        letters / len(data), len(counts) / n, np.log(len(counts)) / np.log(n + 1), max(counts.values()) / n,
        stutters / n, 1 - pairs / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        -(p * np.log(p)).sum(), np.count_nonzero(sizes == 1) / n,
    )
    hashes = common.word_hashes(raw)
    if len(hashes):
        out[20:] = np.sqrt(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=HASHED) / len(hashes))
    return out


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # weights and biases of the hidden layer and of the output; empty: score is the prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-_forward(self.layers, self.scaled(x))[1]))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden, np.clip(hidden @ layers[2] + layers[3], -30, 30)


def _gradient(layers: list[np.ndarray], x: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
    """Gradients of the layers, given that of each row's output."""
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    back = by_output[:, None] * layers[2] * (hidden > 0)
    return [x.T @ back, back.sum(0), hidden.T @ by_output, by_output.sum(keepdims=True)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _descended(gradient, hidden: int, steps: int, rate: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Layers after steps of Adam with a falling rate along ``gradient(layers)``."""
    layers = [rng.normal(0, MEASURES**-0.5, (MEASURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, steps + 1):
        now = rate * (1 - step / (steps + 1))
        for w, g, a, b in zip(layers, gradient(layers), first, second):
            g = g + 1e-4 * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return layers


def risk(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray], list[np.ndarray]]:
    """The positives' risk and the negatives' unbiased risk with the logistic loss, and the gradients of each."""
    gp, gu = _forward(layers, p)[1], _forward(layers, u)[1]
    # log(1 + exp(-g)) for label 1 and log(1 + exp(g)) for label 0
    of_positive = prior * np.logaddexp(0, -gp).mean()
    of_negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    up = _gradient(layers, p, prior * -_sigmoid(-gp) / len(p))
    down = [a + b for a, b in zip(_gradient(layers, p, -prior * _sigmoid(gp) / len(p)), _gradient(layers, u, _sigmoid(gu) / len(u)))]
    return of_positive, of_negative, up, down


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 2000, rate: float = 0.01, back: float = 0.1, seed: int = 3) -> Model:
    """Minimises the non-negative risk by Adam on mini-batches; ``back`` scales the steps that climb back."""
    scale = unlabelled.std(0)
    model = Model(prior, unlabelled.mean(0), np.where(scale > 1e-9, scale, 1.0), [])
    pos, unl = model.scaled(positive), model.scaled(unlabelled)
    rng = np.random.default_rng(seed)

    def gradient(layers: list[np.ndarray]) -> list[np.ndarray]:
        _, of_negative, up, down = risk(layers, pos[rng.integers(0, len(pos), 512)], unl[rng.integers(0, len(unl), 1024)], prior)
        return [a + b for a, b in zip(up, down)] if of_negative >= 0 else [-back * b for b in down]

    model.layers = _descended(gradient, hidden, steps, rate, rng)
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, halves: tuple[np.ndarray, np.ndarray], steps: int = 500, delta: float = 0.1, gamma: float = 0.01, seed: int = 5) -> float:
    """The share of positives among unlabelled rows, by best bin estimation; halves: which rows of each set are learned from.

    A document in both sets has to be in the same half of each.
    """
    (p, q), (u, v) = ((x[h], x[~h]) for x, h in zip((positive, unlabelled), halves))
    if min(map(len, (p, q, u, v))) == 0:
        return 0.5
    scale = u.std(0)
    model = Model(0.5, u.mean(0), np.where(scale > 1e-9, scale, 1.0), [])
    p, q, u, v = map(model.scaled, (p, q, u, v))
    rng = np.random.default_rng(seed)

    def gradient(layers: list[np.ndarray]) -> list[np.ndarray]:
        a, b = p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]
        return [x + y for x, y in zip(_gradient(layers, a, -_sigmoid(-_forward(layers, a)[1]) / len(a)), _gradient(layers, b, _sigmoid(_forward(layers, b)[1]) / len(b)))]

    layers = _descended(gradient, 12, steps, 0.01, rng)
    of_p, of_u = np.sort(_forward(layers, q)[1]), np.sort(_forward(layers, v)[1])
    share_p = 1 - np.arange(len(of_p)) / len(of_p)
    share_u = 1 - np.searchsorted(of_u, of_p, "left") / len(of_u)
    doubt = np.sqrt(np.log(4 / delta) / (2 * len(of_u))) + np.sqrt(np.log(4 / delta) / (2 * len(of_p)))
    best = int(np.argmin(share_u / share_p + (1 + gamma) * doubt / share_p))
    return float(share_u[best] / share_p[best])


_DRAWS = 1_000_003  # steps of a hash by which rows are drawn


def drawn(docs: DataFrame, labels: DataFrame, training: Column, sample: int) -> DataFrame:
    """(doc_id, mark, positive, unlabelled, x): measures of about ``sample`` positive and ``sample`` unlabelled rows; a row can be both.

    The positives' ids are drawn first, from ids alone, and travel to the texts,
    which are read where they lie, however rare positives are.
    """
    usable = docs.where(training & F.col("doc_id").isNotNull())
    quality = F.col("quality").cast("double")
    known = labels.where(F.col("doc_id").isNotNull() & quality.isNotNull() & ~F.isnan(quality)).groupBy("doc_id").agg(F.min(quality).alias("quality")).where("quality > 0").select("doc_id")
    positives = usable.select("doc_id").distinct().join(known, "doc_id")
    n, of_them = usable.count(), positives.count()
    share = lambda rows: min(1.0, sample / max(1, rows)) * _DRAWS
    chosen = positives.where(F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)) < share(of_them)).withColumn("positive", F.lit(True))
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_DRAWS))
    rows = usable.select("doc_id", mark.alias("mark"), "text").join(F.broadcast(chosen), "doc_id", "left")  # about ``sample`` ids
    rows = rows.select("doc_id", "mark", F.coalesce("positive", F.lit(False)).alias("positive"), (F.col("mark") < share(n)).alias("unlabelled"), "text").where("positive or unlabelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            x = [measure(t).tolist() for t in common.raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "mark", "positive", "unlabelled", "x"])

    found = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, positive boolean, unlabelled boolean, x array<double>")
    return found.dropDuplicates(["doc_id", "mark"])


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = 6000) -> Model:
    """Learns from rows that ``training`` selects; about ``sample`` positives and unlabelled rows, whatever the input's size."""
    rows = sorted(drawn(docs, labels, training, sample).collect(), key=lambda r: (r["doc_id"], r["mark"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, MEASURES)
    positive, unlabelled = (np.array([r[c] for r in rows], bool) for c in ("positive", "unlabelled"))
    if not positive.any() or not unlabelled.any():
        return Model(0.5, np.zeros(MEASURES), np.ones(MEASURES), [])
    half = np.array([r["mark"] % 2 == 0 for r in rows], bool)
    prior = estimated_prior(x[positive], x[unlabelled], (half[positive], half[unlabelled]))
    return train(x[positive], x[unlabelled], min(max(prior, 0.01), 0.99))


def scores(model: Model, raws: list[bytes]) -> np.ndarray:
    return model.score(np.array([measure(t) for t in raws]).reshape(-1, MEASURES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, common.raw_texts(batch)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from rows whose crc32 of the id modulo 5 is not 0."""
    held_out = F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False))
    found = score(docs, fit(docs, labels, ~held_out, sample))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
