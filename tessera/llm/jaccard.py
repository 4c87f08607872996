"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

Two documents link if their sets of word n-grams have a Jaccard similarity of at
least num/den.  With sizes x and y that means at least T = num (x + y) / (num +
den) common n-grams.  DivideSkip divides a document's inverted lists into short
and long ones, merges the short ones with a heap, and looks candidates up in the
long ones by binary search.

Distributed, it runs in three steps.

1. *Set aside.*  A document that links shares at least num/den of its n-grams with
   one other document, so more than the rest of them can't be its own alone.  Tasks
   gather documents to blocks, and ask the bucket of each distinct n-gram of a
   block whether any other block or document has it.  An n-gram is asked for once
   by a block, in four bytes and the bucket's number; the answer is a bit, in the
   order of the request.  Most documents end here.
2. *Divide.*  The sets of the others go through the same exchange, which now
   answers how many documents have an n-gram.  In order of that number, a
   document's first x - num x / den + 1 n-grams are its short lists; a partner
   shares at least one of them.  N-grams of one document alone come first
   and need not be sent.  The rest goes packed to buckets of n-grams.  In
   each bucket, documents that meet in a list are joined, unless their sizes and
   places in the order rule the similarity out.  A bucket returns a spanning
   forest, never pairs, and connected candidates form *groups*: every pair that
   may link lies within one.
   Groups with more than ``block`` members are first taken apart by signatures
   a sixteenth as large as their sets, which bound overlaps from above.
3. *Merge and probe.*  The sets of a group meet in one task, or, if there are more
   than ``block``, in tasks for each pair of blocks.  There ``divide_skip`` merges
   a query's short lists with a heap and probes the long ones, on whole sets.

Nothing here is as large as the number of documents but rows of tables; the one
broadcast is a bitmap of 8 MB.  Equal answers for n-grams whose short keys
collide make a list longer, and lose nothing.

Copies: documents with the same set form one class from the start, and a task
sends a class once, so groups of copies cost nothing.  In lists with more than ``hot``
classes, pairs of distinct sizes and places are looked at instead of pairs of classes.

Sets hold 59-bit hashes of n-grams with their lengths, and classes are known by 64-bit hashes.

Null text or no words: size 0, no links, a component of its own.  Fewer words
than n: the whole sequence is the one n-gram.  Rows with equal ids share their
component.  A null id joins its class's component.  Columns besides the id and
the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from . import common

#: Odd multipliers for the places of an n-gram, from a fixed seed.
_PLACES = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_LENGTH = np.uint64(31)
_FILTER_BITS = 26
_BLOCK_GRAMS, _BLOCK_DOCS = 1 << 20, 50_000  # a block of documents that asks together
_BUCKET_BYTES = 16 << 20  # of text for each bucket of n-grams
_BASE = 1.06  # sizes are sent as logarithms to this base


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; the lowest five bits tell an n-gram's length."""
    h, lengths = common.words_and_lengths(raw)
    if len(h) < n:
        if not len(h):
            return h
        found, size = (h * _PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)), lengths.sum(keepdims=True)
    else:
        m = len(h) - n + 1
        found, size = h[:m] * _PLACES[0], lengths[:m].copy()
        for i in range(1, n):
            found += h[i : i + m] * _PLACES[i]
            size += lengths[i : i + m]
    return common.distinct(mix(found) & ~_LENGTH | np.minimum(31, size >> 1).astype(np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by cells, a fourth as many as there are hashes, rounded up to a power of two; at least 64."""
    bits = max(6, (max(1, len(found) // 4) - 1).bit_length())
    return np.bincount((mix(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def class_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


class Join:
    """The join for n-grams of n words and a similarity of num/den."""

    def __init__(self, n: int = 5, num: int = 75, den: int = 100, hot: int = 48, block: int = 1024, most_grams: int = 1_500_000):
        self.n, self.num, self.den, self.hot, self.block, self.most_grams = n, num, den, hot, block, most_grams

    # --- sizes and bounds -------------------------------------------------

    def short_lists(self, size: int) -> int:
        """How many of a document's rarest lists are short: a partner misses at most the others' complement."""
        return size - -(-self.num * size // self.den) + 1

    def needed(self, x, y):
        """T, the least overlap of sizes x and y."""
        return -(-self.num * (x + y) // (self.num + self.den))

    def may_link(self, size_a, place_a, size_b, place_b) -> np.ndarray:
        """Whether sizes (as logarithms, rounded down) and places (fractions of 255, rounded down) allow T common n-grams from there on."""
        low_a, low_b = _BASE ** size_a.astype(float), _BASE ** size_b.astype(float)
        high_a, high_b = low_a * _BASE, low_b * _BASE
        t = self.num / (self.num + self.den)
        left_a, left_b = high_a * (1 - place_a / 255), high_b * (1 - place_b / 255)
        return np.minimum(left_a, left_b) >= t * (low_a + low_b) - 1e-6

    # --- how common n-grams are -------------------------------------------------

    def _asked(self, rows: DataFrame, read, buckets: int, whole: bool) -> DataFrame:
        """Requests (kind 0, target: bucket) and what a block needs to read the answers (kind 1, target: its task)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for number, (held, sets) in enumerate(_gathered(read(batches))):
                keys, sizes = np.fromiter(sets, np.int64, len(sets)), np.fromiter(map(len, sets.values()), np.int64, len(sets))
                block = class_key(np.array([task, number, *keys.tolist()], np.int64))
                own = Arranged.of(np.concatenate(list(sets.values())), np.repeat(np.arange(len(keys)), sizes), buckets)
                edges = np.searchsorted(own.bucket, np.arange(buckets + 1))
                alone = np.add.reduceat(np.append(own.times == 1, 0), np.minimum(edges[:-1], len(own.every)))
                alone[edges[:-1] == edges[1:]] = 0
                some = np.flatnonzero(np.diff(edges))
                short, times = (own.every >> np.uint64(32)).astype("<u4"), np.minimum(own.times, 65535).astype("<u2")
                parts = [short[edges[b] : edges[b + 1]].tobytes() + times[edges[b] + alone[b] : edges[b + 1]].tobytes() for b in some.tolist()]
                for i in range(0, len(some), 64):
                    now = some[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([0] * len(now), pa.int32()), pa.array(now.astype(np.int32)), pa.array([block] * len(now), pa.int64()), pa.array(alone[now].astype(np.int32)), pa.array(parts[i : i + 64], pa.binary())], _ASKED_NAMES)
                if whole:
                    note = keys, list(sets.values())
                else:
                    of = {k: i for i, k in enumerate(sets)}
                    steps = np.diff(own.first[own.times == 1].astype("<u2"), prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2)
                    note = held, [of[row[3]] for row in held], sizes, alone, zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([task], pa.int32()), pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([pickle.dumps(note, 5)], pa.binary())], _ASKED_NAMES)

        return rows.mapInArrow(run, "kind int, target int, block long, alone int, part binary")

    @staticmethod
    def _answered(asked: DataFrame, whole: bool) -> DataFrame:
        """(block, bucket, part): answers in the order of the requests; the blocks' own notes pass, as bucket -1."""

        def run(group: pa.Table) -> pa.Table:
            if group.column("kind")[0].as_py():
                return pa.table([group.column("block"), pa.array([-1] * group.num_rows, pa.int32()), group.column("part")], _ANSWER_NAMES)
            parts, alone = group.column("part").to_pylist(), group.column("alone").to_numpy()
            sizes = (np.fromiter(map(len, parts), np.int64, len(parts)) + 2 * alone) // 6
            ends = np.cumsum(sizes)
            key, times = np.empty(int(sizes.sum()), "<u4"), np.ones(int(sizes.sum()), np.int64)
            for raw, n, a, end in zip(parts, sizes.tolist(), alone.tolist(), ends.tolist()):
                key[end - n : end] = np.frombuffer(raw, "<u4", n)
                times[end - n + a : end] = np.frombuffer(raw, "<u2", n - a, 4 * n)
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.add.reduceat(times[order], starts)
            # 0: one document; else eight steps for each doubling
            level = np.where(total > 1, np.minimum(255, 8 * np.log2(np.maximum(total, 1)) - 7), 0).astype(np.uint8)
            given = np.empty(len(key), np.uint8)
            given[order] = np.repeat(level, np.diff(np.append(starts, len(key))))
            spans = zip((ends - sizes).tolist(), ends.tolist(), alone.tolist())
            answers = [given[i:j].tobytes() if whole else np.packbits(given[i : i + a] > 0).tobytes() for i, j, a in spans]
            return pa.table([group.column("block"), group.column("target"), pa.array(answers, pa.binary())], _ANSWER_NAMES)

        return asked.groupBy("kind", "target").applyInArrow(run, "block long, bucket int, part binary")

    def _sizes(self, docs: DataFrame, buckets: int) -> DataFrame:
        """(doc_id, text_key, n_shingles, key, open): per document its size and class, and whether it may link."""
        n, join = self.n, self

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in common.sliced(batches):
                for doc_id, text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                    found = shingles(text.as_py() or b"", n)
                    yield doc_id, text_key, class_key(found), found

        def run(group: pa.Table) -> pa.Table:
            note, given = _note_and_answers(group)
            if note is None:
                return _SIZE_SCHEMA.empty_table()
            held, of, sizes, alone, steps = note
            steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(steps), np.uint8).reshape(2, -1).T).view("<u2").reshape(-1)
            owner, lonely, at = np.cumsum(steps, dtype=np.uint16), np.zeros(len(sizes), np.int64), 0
            for bucket, count in enumerate(alone.tolist()):
                # an answer that isn't there, as after the loss of a task of an input without order, sets nothing aside
                if count and bucket in given:
                    shared = np.unpackbits(np.frombuffer(given[bucket], np.uint8), count=count).astype(bool)
                    lonely += np.bincount(owner[at : at + count][~shared], minlength=len(sizes))
                at += count
            stays = (sizes > 0) & (lonely < [join.short_lists(int(x)) for x in sizes])
            return pa.table([*(pa.array([row[i] for row in held], pa.int64()) for i in range(4)), pa.array(stays[of])], _SIZE_SCHEMA.names)

        asked = self._asked(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), read, buckets, False)
        return self._answered(asked, False).groupBy("block").applyInArrow(run, "doc_id long, text_key long, n_shingles long, key long, open boolean")

    def _postings(self, sets: DataFrame, buckets: int) -> DataFrame:
        """Packed (hash, class, size, place) of every class's short lists that others have too, by bucket of the hash."""
        short = self.short_lists

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in common.sliced(batches):
                for key, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield None, None, key, np.frombuffer(own.as_py(), np.uint64)

        def run(group: pa.Table) -> pa.Table:
            note, given = _note_and_answers(group)
            packer = common.Packer(buckets, 1 << 62)
            if note is not None:
                keys, found = note
                sizes = np.array([len(f) for f in found])
                own = Arranged.of(np.concatenate(found), np.repeat(np.arange(len(keys)), sizes), buckets)
                edges = np.searchsorted(own.bucket, np.arange(buckets + 1))
                level = np.concatenate([np.frombuffer(given[b], np.uint8) for b in np.flatnonzero(np.diff(edges)).tolist()])
                for key, grams, common_to in zip(keys.tolist(), found, np.split(own.back(level), np.cumsum(sizes)[:-1])):
                    size, lonely = len(grams), int((common_to == 0).sum())
                    p = short(size)
                    if lonely >= p:
                        continue
                    rank = common_to.astype(np.uint64) << np.uint64(56) | mix(grams) >> np.uint64(8)
                    first = (np.argpartition(rank, p - 1) if p < size else np.arange(size))[:p]
                    first = first[np.argsort(rank[first])][lonely:]
                    h = mix(grams[first] + np.uint64(1))
                    place = (255 * np.arange(lonely, p) // size).astype(np.uint8)
                    m = p - lonely
                    packer.add((h % np.uint64(buckets)).astype(np.int32), (h >> np.uint64(32)).astype(np.uint32), np.full(m, key, np.int64), np.full(m, np.log(size) // np.log(_BASE), np.uint16), place)
            return pa.Table.from_batches(list(packer.flush()), pa.schema([("bucket", pa.int32()), ("part", pa.binary())]))

        return self._answered(self._asked(sets.select("key", "own"), read, buckets, True), True).groupBy("block").applyInArrow(run, common.Packer.schema)

    # --- candidate groups ------------------------------------------------------

    def _meet(self, postings: DataFrame) -> DataFrame:
        """(bucket, a, b): per bucket a spanning forest of the classes that meet in a list and may link."""
        join = self

        def run(group: pa.Table) -> pa.Table:
            h, key, size, place = common.unpack((p.as_py() for p in group.column("part")), "<u4", "<i8", "<u2", "u1")
            order = np.lexsort((size, key, h))
            h, key, size, place = h[order], key[order], size[order], place[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
            h, key, size, place = h[new], key[new], size[new], place[new]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            lengths = np.diff(np.concatenate([starts, [h.size]]))
            made = [np.empty((0, 2), np.int64)]
            for m in np.unique(lengths[(lengths > 1) & (lengths <= join.hot)]).tolist():
                rows = starts[lengths == m]
                i, j = np.triu_indices(m, 1)
                for part in np.array_split(rows, max(1, len(rows) * len(i) >> 21)):
                    a, b = (part[:, None] + i).reshape(-1), (part[:, None] + j).reshape(-1)
                    ok = join.may_link(size[a], place[a], size[b], place[b])
                    made.append(_pairs(key[a[ok]], key[b[ok]]))
            for at, m in zip(starts[lengths > join.hot].tolist(), lengths[lengths > join.hot].tolist()):
                made.append(join._joined(key[at : at + m], size[at : at + m], place[at : at + m]))
            return _table(_forest(np.concatenate(made)), bucket=group.column("bucket")[0].as_py())

        return postings.groupBy("bucket").applyInArrow(run, "bucket int, a long, b long")

    def _joined(self, key: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Edges that connect the same classes of a list as all its pairs that may link would.

        Whether two classes may link depends on their sizes and places only, so
        pairs of distinct (size, place) are looked at, however long the list is.
        """
        cells, first, cell = np.unique(size.astype(np.int64) << 8 | place, return_index=True, return_inverse=True)
        partner = np.full(len(cells), -1)
        made = []
        for i in range(0, len(cells), 256):
            a, b = np.divmod(np.arange(min(256, len(cells) - i) * len(cells)), len(cells))
            a += i
            ok = self.may_link(cells[a] >> 8, cells[a] & 255, cells[b] >> 8, cells[b] & 255)
            a, b = a[ok], b[ok]
            partner[a] = b
            made.append(_pairs(key[first[a]], key[first[b]]))
        some = partner[cell] >= 0
        made.append(_pairs(key[some], key[first[partner[cell[some]]]]))
        edges = np.concatenate(made)
        return edges[edges[:, 0] != edges[:, 1]]

    @staticmethod
    def _merged(edges: DataFrame, many: int = 8) -> DataFrame:
        """Forests of several buckets as one: what they share is sent on once."""

        def run(group: pa.Table) -> pa.Table:
            return _table(_forest(np.stack([group.column("a").to_numpy(), group.column("b").to_numpy()], 1))).drop_columns(["bucket"])

        return edges.withColumn("bucket", F.floor(F.col("bucket") / many).cast("int")).groupBy("bucket").applyInArrow(run, "a long, b long")

    # --- search in groups --------------------------------------------------------

    def _sets(self, texts: DataFrame, open_classes: DataFrame) -> DataFrame:
        """(key, own): the sets of classes that may link, each from one of its texts."""
        n = self.n
        chosen = open_classes.groupBy("key").agg(F.min("text_key").alias("text_key"))
        bits = chosen.select((F.pmod("text_key", F.lit(1 << _FILTER_BITS)) + 1).alias("p"))
        # A bitmap of fixed size tells which texts are needed; its false alarms cost time only.
        rows = bits.groupBy(F.bitmap_bucket_number("p").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
        bitmap = np.zeros(((1 << _FILTER_BITS) // 32768, 4096), np.uint8)
        for row in rows:
            bitmap[row["i"] - 1] = np.frombuffer(row["bits"], np.uint8)
        wanted = texts.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, sent = wanted.value, set()
            for batch in common.sliced(batches):
                at = np.mod(batch.column(0).to_numpy(), 1 << _FILTER_BITS)
                needed = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                keys, found, held, column = [], [], 0, batch.column(1).cast(pa.binary())
                for i in needed.tolist():
                    own = shingles(column[i].as_py() or b"", n)
                    key = class_key(own)
                    if len(own) and key not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(key)
                        keys.append(key)
                        found.append(own.tobytes())
                        held += len(own)
                    if held > _BLOCK_GRAMS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "own"])
                        keys, found, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "own"])

        # Copies in other tasks are the same class.
        return texts.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "key long, own binary").dropDuplicates(["key"])

    @staticmethod
    def _signatures(sets: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches):
                made = [signature(np.frombuffer(own.as_py(), np.uint64)).tobytes() for own in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "own"])

        return sets.select("key", "own").mapInArrow(run, "key long, own binary")

    @staticmethod
    def _members(found: DataFrame) -> DataFrame:
        """(key, group) of all nodes of stars, their middles included."""
        members = found.select(F.col("node").alias("key"), F.col("component").alias("group"))
        return members.unionAll(members.select(F.col("group").alias("key"), "group").distinct())

    def _blocks(self, members: DataFrame) -> DataFrame:
        """(group, blocks): so many that a block has at most ``block`` members and about ``most_grams`` n-grams."""
        return members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / self.block), F.ceil(F.sum("n") / self.most_grams)).cast("int").alias("blocks"))

    def _dealt(self, own: DataFrame, members: DataFrame) -> DataFrame:
        """(group, i, j, whole, key, own): members of a group in one task, or of each pair of its blocks; whole: the task has all of the group."""
        placed = members.select("key", "group").join(self._blocks(members), "group").withColumn("o", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("o")) | (F.col("blocks") == 1))
        pairs = F.transform(others, lambda x: F.struct(F.least("o", x).alias("i"), F.greatest("o", x).alias("j")))
        joined = own.join(placed, "key")
        return joined.select("group", F.explode(pairs).alias("p"), (F.col("blocks") == 1).alias("whole"), "key", "own").select("group", "p.i", "p.j", "whole", "key", "own")

    def _refined(self, sets: DataFrame, large: DataFrame) -> DataFrame:
        """(a, b): forests of the members of large groups whose signatures allow the similarity.

        A signature counts a set's n-grams by cells of their hashes.  The sums of
        smaller counts bound the overlap from above, so every pair that links
        stays connected, and groups that chance has strung together fall apart.
        """
        join = self

        def run(group: pa.Table) -> pa.Table:
            key, first = np.unique(group.column("key").to_numpy(), return_index=True)
            own = group.column("own")
            return _table(_forest(key[join.allowed([np.frombuffer(own[i].as_py(), np.uint16) for i in first.tolist()])])).drop_columns(["bucket"])

        return self._dealt(self._signatures(sets.join(large, "key", "left_semi")), large).groupBy("group", "i", "j").applyInArrow(run, "a long, b long")

    def allowed(self, signatures: list[np.ndarray]) -> np.ndarray:
        """Pairs (rows) of signatures whose bound reaches the overlap that their sizes need."""
        n = np.array([int(s.sum()) for s in signatures], np.int64)
        cells = np.array([len(s) for s in signatures], np.int64)
        order = np.lexsort((n, cells))
        made = [np.empty((0, 2), np.int64)]
        for width in np.unique(cells).tolist():
            own = order[cells[order] == width]
            table = np.stack([signatures[k] for k in own.tolist()])
            # partners have as many cells, or half of them: sizes differ by less than a factor of two
            half = order[cells[order] == width // 2]
            half_table = np.stack([signatures[k] for k in half.tolist()]) if half.size else None
            for at, k in enumerate(own.tolist()):
                low = -(-self.num * int(n[k]) // self.den)
                begin = int(np.searchsorted(n[own], low))
                parts = [(own[begin:at], table[begin:at], table[at])]
                if half_table is not None and (begin := int(np.searchsorted(n[half], low))) < half.size:
                    parts.append((half[begin:], half_table[begin:], table[at].reshape(-1, 2).sum(1)))
                for other, rows, mine in parts:
                    if other.size:
                        bound = np.minimum(rows, mine).sum(1, dtype=np.int64)
                        fit = other[bound >= self.needed(int(n[k]), n[other])]
                        made.append(np.stack([np.full(len(fit), k), fit], 1))
        return np.concatenate(made)

    def _search(self, sets: DataFrame, members: DataFrame) -> DataFrame:
        """(whole, key, label): the first linked class of each member's component in its task."""
        dealt = self._dealt(sets, members)
        join = self

        def run(group: pa.Table) -> pa.Table:
            key, first = np.unique(group.column("key").to_numpy(), return_index=True)
            own = group.column("own")
            label = join.labels([np.frombuffer(own[i].as_py(), np.uint64) for i in first.tolist()])
            return pa.table([pa.array([group.column("whole")[0].as_py()] * len(key)), pa.array(key), pa.array(key[label])], ["whole", "key", "label"])

        return dealt.groupBy("group", "i", "j").applyInArrow(run, "whole boolean, key long, label long")

    def labels(self, sets: list[np.ndarray]) -> list[int]:
        """For each set the first one of its component.

        The set that shares most with the others is the first query.  Sets that
        belong to its component when their turn comes need no query of their own:
        two such sets are connected, and any other pair has a query.
        """
        n = len(sets)
        root = list(range(n))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(every)]]))
        heads = every[starts]
        del every
        shared = np.bincount(owner, np.repeat(lengths, lengths), minlength=n)
        queries = sorted(range(n), key=lambda k: (-shared[k], k))
        for k in queries:
            if k != queries[0] and find(k) == find(queries[0]):
                continue
            at = np.searchsorted(heads, sets[k])
            at = at[lengths[at] > 1]
            # smaller partners than this can't reach the threshold, so this is the least overlap that any needs
            least = int(self.needed(len(sets[k]), -(-self.num * len(sets[k]) // self.den)))
            if len(at) < least:
                continue
            lists = [owner[i : i + m] for i, m in zip(starts[at].tolist(), lengths[at].tolist())]
            for other, common_grams in divide_skip(lists, least).items():
                if self.den * common_grams >= self.num * (int(sizes[k]) + int(sizes[other]) - common_grams):
                    a, b = find(k), find(other)
                    root[max(a, b)] = min(a, b)
        return [find(k) for k in range(n)]

    # --- the whole join ----------------------------------------------------------

    def groups(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(doc_id, text_key, n_shingles, label) for every row: rows with equal labels are connected; rows without words have none."""
        spark = docs.sparkSession
        store = common.Scratch(spark, "jaccard")
        docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        buckets = max(8, -(-common.text_bytes(docs) // _BUCKET_BYTES))
        sizes = store.write(self._sizes(docs, buckets), "sizes")
        open_classes = sizes.where("open").select("key", "text_key", F.col("n_shingles").alias("n"))
        sets = store.write(self._sets(docs.select("text"), open_classes), "sets")
        met = self._merged(self._meet(self._postings(sets, buckets)))
        members = self._members(stars(store.write(met, "met"), "a", "b"))
        members = store.write(members.join(open_classes.groupBy("key").agg(F.first("n").alias("n")), "key"), "members")
        large = self._blocks(members).where("blocks > 1").select("group")
        if not large.isEmpty():
            refined = self._refined(sets, members.join(large, "group", "left_semi").select("key", "group", "n"))
            refined = self._members(stars(store.write(refined, "refined"), "a", "b")).join(members.select("key", "n"), "key")
            members = store.write(members.join(large, "group", "left_anti").select("key", "group", "n").unionAll(refined.select("key", "group", "n")), "fewer")
        searched = store.write(self._search(sets, members), "searched")
        label = searched.where("whole and key <> label").select("key", "label")
        parts = searched.where("not whole and key <> label")
        if not parts.isEmpty():
            label = label.unionAll(stars(parts, "key", "label").select(F.col("node").alias("key"), F.col("component").alias("label")))
        of = sizes.where("n_shingles > 0").join(label, "key", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "key").alias("label"))
        # Documents without words have one key; their rows must not meet.
        alone = sizes.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("label"))
        named = store.write(of.unionAll(alone), "named")
        for name in ("sizes", "sets", "met", "members", "refined", "fewer", "searched"):
            store.drop(name)
        return named

    def components(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row."""
        named = self.groups(docs, id_column, text_column)
        least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
        linked = named.where("label is not null").join(least, "label").select("doc_id", "n_shingles", "component_id")
        return linked.unionAll(named.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

    def unique(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """One row of each component with all its columns: that with the smallest id (null last), and among equal ids the smallest hash of the text.

        Rows without words are linked with nothing and stay, each.  Of rows equal
        in id and text one stays; which one isn't defined.
        """
        hashes = [F.xxhash64(text_column).alias("_text_key"), F.xxhash64(F.xxhash64(text_column), F.col(id_column).cast("long")).alias("_row_key")]
        found = self.groups(docs, id_column, text_column).where("label is not null")
        first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m"))
        first = first.select(F.col("m.text_key").alias("_text_key"), F.xxhash64("m.text_key", "m.doc_id").alias("_row_key"))
        worded = F.coalesce(F.col(text_column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = docs.where(worded).select("*", *hashes).join(first, ["_text_key", "_row_key"], "left_semi").dropDuplicates(["_text_key", "_row_key"])
        return kept.select(docs.columns).unionAll(docs.where(~worded))


def _forest(edges: np.ndarray) -> np.ndarray:
    """A spanning forest of edges as stars: each node but the smallest of its component, with that one."""
    edges = np.unique(edges, axis=0)
    nodes, at = np.unique(edges, return_inverse=True)
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in at.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(k) for k in range(len(nodes))], np.int64)
    keep = np.flatnonzero(top != np.arange(len(nodes)))
    return np.stack([nodes[keep], nodes[top[keep]]], 1)


def _table(edges: np.ndarray, bucket: int = 0) -> pa.Table:
    return pa.table([pa.array([bucket] * len(edges), pa.int32()), pa.array(edges[:, 0], pa.int64()), pa.array(edges[:, 1], pa.int64())], ["bucket", "a", "b"])


_ASKED_NAMES = ["kind", "target", "block", "alone", "part"]
_ANSWER_NAMES = ["block", "bucket", "part"]
_SIZE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("open", pa.bool_())])


class Arranged(NamedTuple):
    """The distinct n-grams of a block in the order of its requests: by bucket, those of one class first and by class."""

    every: np.ndarray
    times: np.ndarray  # classes of the block that have it
    first: np.ndarray  # one of them
    bucket: np.ndarray
    place: np.ndarray  # of each of these among the sorted ones
    order: np.ndarray  # that sorts the block's n-grams

    @classmethod
    def of(cls, grams: np.ndarray, owner: np.ndarray, buckets: int) -> Arranged:
        order = np.argsort(grams)
        every = grams[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if every.size else np.empty(0, np.int64)
        times = np.diff(np.append(starts, len(every)))
        every, first = every[starts], owner[order[starts]]
        # the high half of a hash is what is sent, the rest tells the bucket
        bucket = (every >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)
        place = np.argsort(bucket << np.uint64(32) | (times > 1).astype(np.uint64) << np.uint64(31) | first.astype(np.uint64))
        return cls(every[place], times[place], first[place], bucket[place], place, order)

    def back(self, given: np.ndarray) -> np.ndarray:
        """What was given for each distinct n-gram, for all n-grams of the block."""
        times, of_sorted = np.empty_like(self.times), np.empty_like(given)
        times[self.place], of_sorted[self.place] = self.times, given
        out = np.empty(len(self.order), given.dtype)
        out[self.order] = np.repeat(of_sorted, times)
        return out


def _gathered(docs: Iterable[tuple]) -> Iterator[tuple[list, dict[int, np.ndarray]]]:
    """Blocks: rows (doc_id, text_key, size, class), and the sets of their classes."""
    held: list[tuple] = []
    sets: dict[int, np.ndarray] = {}
    size = 0
    for doc_id, text_key, key, found in docs:
        held.append((doc_id, text_key, len(found), key))
        if key not in sets:
            sets[key] = found
            size += len(found)
        if size >= _BLOCK_GRAMS or len(held) >= _BLOCK_DOCS:
            yield held, sets
            held, sets, size = [], {}, 0
    if held:
        yield held, sets


def _note_and_answers(group: pa.Table) -> tuple:
    """What a block noted for itself (None: nothing), and its answers by bucket."""
    given = dict(zip(group.column("bucket").to_pylist(), group.column("part").to_pylist()))
    note = given.pop(-1, None)
    return (pickle.loads(note) if note is not None else None), given


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two keys, the larger first."""
    return np.stack([np.maximum(a, b), np.minimum(a, b)], 1)


def divide_skip(lists: list, threshold: int, weight: float = 0.0085) -> dict[int, int]:
    """Numbers that occur in at least ``threshold`` of the sorted lists, with their counts.

    The longest lists are set aside.  A heap merges the others; a number that
    occurs there too rarely to reach the threshold even with all long lists is
    skipped, and so is everything up to the next number that still may.  What is
    left is looked up in the long lists by binary search.  Lists may be arrays;
    only short ones become Python lists.
    """
    lists = sorted(lists, key=len, reverse=True)
    threshold = max(1, threshold)
    if len(lists) < threshold:
        return {}
    aside = min(threshold - 1, int(threshold / (weight * np.log2(max(1, len(lists[0]))) + 1)), len(lists) - 1)
    long, least = lists[:aside], threshold - aside
    short = [own.tolist() if hasattr(own, "tolist") else own for own in lists[aside:]]
    heap = [(own[0], i, 0) for i, own in enumerate(short)]
    heapq.heapify(heap)
    merged: dict[int, int] = {}
    while heap:
        number = heap[0][0]
        top = []
        while heap and heap[0][0] == number:
            top.append(heapq.heappop(heap))
        if len(top) >= least:
            merged[number] = len(top)
            target = number + 1
        else:
            # least - 1 lists may fall behind without harm: all jump to the smallest number of the rest
            while heap and len(top) < least - 1:
                top.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], number + 1)
        for _, i, at in top:
            own = short[i]
            at = bisect_left(own, target, at)
            if at < len(own):
                heapq.heappush(heap, (own[at], i, at))
    return _probed(merged, long, threshold)


def _probed(merged: dict[int, int], long: list, threshold: int) -> dict[int, int]:
    """Counts with the long lists added, of numbers that reach the threshold."""
    if len(merged) > 4:
        numbers, counts = np.array(list(merged)), np.array(list(merged.values()))
        for left, own in zip(range(len(long), 0, -1), long):
            live = counts + left >= threshold
            if not live.all():
                numbers, counts = numbers[live], counts[live]
                if not numbers.size:
                    return {}
            own = np.asarray(own)
            at = np.minimum(np.searchsorted(own, numbers), len(own) - 1)
            counts += own[at] == numbers
        return {n: c for n, c in zip(numbers.tolist(), counts.tolist()) if c >= threshold}
    found: dict[int, int] = {}
    for number, count in merged.items():
        for left, own in zip(range(len(long), 0, -1), long):
            if count + left < threshold:
                break
            at = bisect_left(own, number)
            count += bool(at < len(own) and own[at] == number)
        if count >= threshold:
            found[number] = count
    return found


def components(docs: DataFrame) -> DataFrame:
    """Five-word n-grams, similarity 0.75: (doc_id, n_shingles, component_id)."""
    return Join().components(docs)


def unique(docs: DataFrame) -> DataFrame:
    """Five-word n-grams, similarity 0.75: one row of each group of near-duplicates."""
    return Join().unique(docs)
