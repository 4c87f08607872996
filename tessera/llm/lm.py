"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of word pairs and single words with
a uniform distribution and the mass of unknown words:

    P(w | u) = l2 c(u,w) / c(u) + l1 c(w) / N + l0 / (V + 1) + lu [w unknown]

with one set of weights for each bucket of log2 c(u), the context's frequency.
It is a distribution over the V known words and the unknown one.  The weights
are learned by expectation-maximisation on a part of the training documents, with
that part's counts deleted from the estimates.

Counts are of the whole training corpus and stay distributed.  Tasks gather
documents to blocks of at most about a million tokens, which are written once: the
words' hashes, and the tokens as places among them.  A block asks for each of
its distinct words and pairs once, with its own counts, at the bucket of the
key's hash.  The bucket adds up the corpus counts and answers every block in the
order of its request, so answers carry no keys.  A word in every document is thus
at most one entry for each block, and repeated rows fill as many blocks as
others.  Blocks and buckets are as many as the texts' bytes ask for, so a worker's
memory doesn't grow with the input.  The driver sees totals and one histogram of
fixed size, on which the weights are learned.

Words are known by 64-bit hashes, pairs by 40 bits of theirs and their bucket.

Null and empty texts are one end token.  Rows without id are scored, not learned
from, and not held out.  Rows with equal ids are scored each.  Without training
rows all counts are zero: the base is uniform and so is the model.  An empty
table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .jaccard import mix

END, START = np.uint64(1), np.uint64(2)  # keys of the end token and of the context before the first word
_END = np.array([END])
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CONTEXTS = 33  # buckets of log2 of a context's count
_FINE = 4  # histogram steps for each doubling of a probability
BLOCK_TOKENS, BUCKET_BYTES = 1 << 20, 12 << 20

#: Bytes of a key in a request: words are known by all of theirs, pairs by the bucket and five bytes.
_WORD_BYTES, _PAIR_BYTES = 8, 5


def keys_start(lengths) -> np.ndarray:
    """Place of the first token of each text."""
    ends = np.cumsum(np.asarray(lengths, np.int64))
    return ends - lengths


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, lowest first, as many as the largest needs, after their number: leading zeros cost nothing."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n numbers from planes that begin at a place, and the place behind them."""
    width, out = raw[at], np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.int64), at + 1 + n * width


class Tokens(NamedTuple):
    """Tokens of a block's texts one after another: distinct words, and distinct pairs with the token before."""

    lengths: np.ndarray  # tokens of each text
    words: np.ndarray  # hashes
    word: np.ndarray  # place of each token's word
    before: np.ndarray  # place of the word before; beyond the last one: a text's start
    pairs: np.ndarray  # hashes
    pair: np.ndarray  # place of each token's pair

    @classmethod
    def of(cls, lengths: np.ndarray, words: np.ndarray, word: np.ndarray) -> Tokens:
        before = np.concatenate([[0], word[:-1]]) if word.size else word
        before[keys_start(lengths)] = len(words)
        codes, pair = common.distinct_places(before * len(words) + word)
        of_before, of_word = np.divmod(codes, max(1, len(words)))
        pairs = mix(np.append(words, START)[of_before] * _LEFT + words[of_word] * _RIGHT)
        return cls(lengths, words, word, before, pairs, pair)


def _by_bucket(every: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each bucket, in order of the keys."""
    bucket = (every % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _blocks(rows: DataFrame, block_tokens: int) -> DataFrame:
    """(block, part, body): texts as tokens; documents of the part have blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def out(of_part: bool) -> pa.RecordBatch:
            nonlocal number
            ids, train, keys = zip(*held[of_part])
            held[of_part], size[of_part], number = [], 0, number + 1
            lengths = np.array([len(k) for k in keys], np.int64)
            words, word = common.distinct_places(np.concatenate(keys))
            # places by frequency: their higher bytes are mostly zero
            order = np.argsort(-np.bincount(word), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            body = pickle.dumps((ids, np.array(train, bool), lengths, words[order], zlib.compress(_planes(rank[word]), 1)), 5)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), pa.array([of_part]), pa.array([body], pa.binary())], ["block", "part", "body"])

        for batch in common.sliced(batches):
            for doc_id, text, train, of_part in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                held[of_part].append((doc_id, train, np.append(common.word_hashes(text.as_py() or b""), END)))
                size[of_part] += len(held[of_part][-1][2])
                if size[of_part] >= block_tokens:
                    yield out(of_part)
        for of_part in (False, True):
            if held[of_part]:
                yield out(of_part)

    return rows.mapInArrow(run, "block long, part boolean, body binary")


def _read(body: bytes) -> tuple[tuple, np.ndarray, Tokens]:
    """Ids of a block's texts, whether they are learned from, and their tokens."""
    ids, train, lengths, words, places = pickle.loads(body)
    return ids, train, Tokens.of(lengths, words, _from_planes(zlib.decompress(places), int(lengths.sum()))[0])


def _asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """Requests: each block's distinct words and pairs by bucket, with their counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, of_part, body in zip(*(batch.column(i) for i in range(3))):
                _, train, tokens = _read(body.as_py())
                in_train = np.repeat(train, tokens.lengths)
                for first, every, at, width in ((0, tokens.words, tokens.word, _WORD_BYTES), (buckets, tokens.pairs, tokens.pair, _PAIR_BYTES)):
                    count = np.bincount(at[in_train], minlength=len(every))
                    for b, own in _by_bucket(every, buckets):
                        part = every[own].view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes() + _planes(count[own])
                        yield pa.RecordBatch.from_arrays([pa.array([first + b], pa.int32()), pa.array([block.as_py()], pa.int64()), pa.array([of_part.as_py()]), pa.array([len(own)], pa.int32()), pa.array([part], pa.binary())], ["bucket", "block", "part", "n", "body"])

    return blocks.mapInArrow(run, "bucket int, block long, part boolean, n int, body binary")


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts for every block, in the order of its request, and totals of the bucket's words.

    Blocks of the part are answered with both counts, the others with those of training.
    """

    def run(group: pa.Table) -> pa.Table:
        m, bodies, of_part = group.num_rows, group.column("body").to_pylist(), group.column("part").to_numpy()
        bucket, sizes = group.column("bucket")[0].as_py(), group.column("n").to_numpy().astype(np.int64)
        width = _WORD_BYTES if bucket < buckets else _PAIR_BYTES
        raw_key = np.zeros((int(sizes.sum()), 8), np.uint8)
        count = np.empty(len(raw_key), np.int64)
        ends = np.cumsum(sizes)
        for raw, i, j in zip(bodies, (ends - sizes).tolist(), ends.tolist()):
            raw_key[i:j, 8 - width :] = np.frombuffer(raw, np.uint8, (j - i) * width).reshape(-1, width)
            count[i:j] = _from_planes(raw, j - i, (j - i) * width)[0]
        del bodies
        order = np.argsort(raw_key.view(np.uint64).reshape(-1))
        key = raw_key.view(np.uint64).reshape(-1)[order]
        del raw_key
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(starts, len(key)))
        train = np.add.reduceat(count[order], starts)
        part = np.add.reduceat((count * np.repeat(of_part, sizes))[order], starts)
        totals = [int(train.sum()), int((train > 0).sum()), int((train - part).sum()), int((train > part).sum())] if bucket < buckets else [0] * 4
        given = np.empty((2, len(key)), np.int64)
        given[0, order], given[1, order] = np.repeat(train, times), np.repeat(part, times)
        answers = [_planes(given[0, i:j]) + (_planes(given[1, i:j]) if both else b"") for i, j, both in zip((ends - sizes).tolist(), ends.tolist(), of_part)]
        return pa.table(
            [group.column("block"), pa.array([bucket] * m, pa.int32()), group.column("part"), pa.array(answers, pa.binary())] + [pa.array([t] + [0] * (m - 1), pa.int64()) for t in totals], [*_ANSWER, *_TOTALS]
        )

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, part boolean, body binary, " + ", ".join(f"{t} long" for t in _TOTALS))


_ANSWER = ["block", "bucket", "part", "body"]
_TOTALS = ["n", "v", "n_left", "v_left"]


def _looked_up(block: pa.Table, answers: pa.Table, buckets: int, less_part: bool):
    """Ids and lengths of a block's texts, and for each token the counts of its word, context and pair in training, less the part's if asked for."""
    given = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()))
    ids, _, tokens = _read(block.column("body")[0].as_py())
    found = []
    for first, every in ((0, tokens.words), (buckets, tokens.pairs)):
        counts = np.zeros(len(every), np.int64)
        for b, own in _by_bucket(every, buckets):
            raw, n = given.pop(first + b), len(own)
            counts[own], behind = _from_planes(raw, n)
            if less_part:
                counts[own] -= _from_planes(raw, n, behind)[0]
        found.append(counts)
    # every text ends once, and its first word follows the start
    of_word, of_pair = found
    ends = of_word[np.flatnonzero(tokens.words == END)]
    return ids, tokens.lengths, of_word[tokens.word], np.append(of_word, ends)[tokens.before], of_pair[tokens.pair]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXTS - 1, np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0)).astype(np.int64)


def _estimates(word, context, pair, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of the pair and of the word."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1)


def _step(p: np.ndarray) -> np.ndarray:
    """Histogram step of a probability; -1: zero."""
    return np.where(p > 0, np.round(-_FINE * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)


def learn(cells: np.ndarray, v: int, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """Weights (contexts x (pair, word, uniform, unknown)) by expectation-maximisation.

    cells: rows of context bucket, step of the pair estimate, step of the word estimate, tokens.
    Each context's weights lean on those of all contexts together, as if these had been seen in ``prior`` tokens.
    """
    back = lambda step: np.where(step >= 0, 2.0 ** (-step / _FINE), 0.0)
    context, count = cells[:, 0].astype(np.int64), cells[:, 3].astype(float)
    p = np.stack([back(cells[:, 1]), back(cells[:, 2]), np.full(len(cells), 1 / (v + 1)), (cells[:, 2] < 0).astype(float)], 1)

    def em(rows: np.ndarray, start: np.ndarray, lean: float) -> np.ndarray:
        weights = start.copy()
        for _ in range(rounds):
            share = weights * p[rows]
            share *= (count[rows] / share.sum(1))[:, None]
            weights = share.sum(0) + lean * start
            weights /= weights.sum()
        return weights

    even = np.full(4, 0.25)
    pooled = em(np.arange(len(cells)), even, 0.0) if len(cells) else np.array([0, 0, 1.0, 0])
    out = np.empty((CONTEXTS, 4))
    for c in range(CONTEXTS):
        rows = np.flatnonzero(context == c)
        out[c] = em(rows, pooled, prior) if rows.size else pooled
    # an unseen context has no pair estimate: its weight goes to the others
    out[0, 0] = 0
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, training: Column, part: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row; ``part`` selects training rows that the weights are learned on."""
    spark = docs.sparkSession
    store = common.Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(training, F.lit(False)).alias("train"), F.coalesce(training & part, F.lit(False)).alias("part"))
    buckets = max(4, -(-common.text_bytes(rows) // BUCKET_BYTES))
    blocks = store.write(_blocks(rows, block_tokens), "blocks")
    answers = store.write(_answered(_asked(blocks, buckets), buckets), "answers")
    n, v, n_left, v_left = (x or 0 for x in answers.agg(*(F.sum(t) for t in _TOTALS)).first())

    def histogram(block: pa.Table, given: pa.Table) -> pa.Table:
        _, _, word, context, pair = _looked_up(block, given, buckets, True)
        p2, p1 = _estimates(word, context, pair, n_left)
        code, count = np.unique((context_bucket(context) << 32) + (_step(p2) + 1 << 16) + _step(p1) + 1, return_counts=True)
        return pa.table([pa.array(code >> 32), pa.array((code >> 16 & 0xFFFF) - 1), pa.array((code & 0xFFFF) - 1), pa.array(count)], ["context", "pair", "word", "n"])

    # Only blocks of the part are read here.
    seen = blocks.where("part").groupBy("block").cogroup(answers.where("part").select(*_ANSWER).groupBy("block"))
    found = seen.applyInArrow(histogram, "context long, pair long, word long, n long").groupBy("context", "pair", "word").agg(F.sum("n").alias("n")).collect()
    weights = learn(np.array([tuple(r) for r in found], np.int64).reshape(-1, 4), v_left)
    spread = np.log10(n + 0.5 * (v + 1))

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        ids, lengths, word, context, pair = _looked_up(block, given, buckets, False)
        p2, p1 = _estimates(word, context, pair, n)
        w = weights[context_bucket(context)]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1) + w[:, 3] * (word == 0)
        starts = keys_start(lengths)
        add = lambda x: np.add.reduceat(x, starts)
        base = add(np.log10(word + 0.5)) - lengths * spread
        columns = [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(lengths), n, np.int64)), pa.array(base), pa.array(add(np.log10(np.maximum(p, 1e-300))))]
        return pa.table(columns, _NAMES)

    return blocks.groupBy("block").cogroup(answers.select(*_ANSWER).groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_NAMES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
