"""Best-two-fit packing of documents into sequences of fixed length.

A bin is filled greedily, each time with the longest unpacked document that
fits.  When none fits, its smallest document is replaced by the two unpacked
documents that fill the expanded gap most tightly, if they fill it better.

Documents of one length are interchangeable, so the plan is made from the number
of pieces of each length alone: ``plan`` works on at most ``capacity`` counts and
repeats each bin pattern as often as the counts allow, so its cost doesn't depend
on the number of documents.  Pieces then find their places by their rank among
the pieces of their length: ranks come from counts by (task, length) and a prefix
sum over tasks, so no length, however common, meets in one task.

Null or empty text: a piece with the end id only.  Repeated rows are packed as
often as they occur; null ids are kept.  An empty table gives no pieces.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokenfile import encoder

#: Runs of equal documents in equal bins: length, first rank, documents in each bin, bins, first bin, first offset.
RUN = ["length", "rank", "each", "bins", "bin", "offset"]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows of RUN, ordered by length and rank, for so many documents of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)  # ranks given so far
    rows: list[list[int]] = []
    bins = 0
    while (there := np.flatnonzero(left)).size:
        pattern, gap = _fill(left, int(there[-1]), capacity)
        pattern = _exchange(pattern, gap, left)
        times = int(min(left[length] // n for length, n in pattern))
        offset = 0
        for length, n in pattern:
            rows.append([length, int(used[length]), n, times, bins, offset])
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        bins += times
    found = np.array(rows, np.int64).reshape(-1, len(RUN))
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _fill(left: np.ndarray, first: int, capacity: int) -> tuple[list[tuple[int, int]], int]:
    """The greedy content of one bin as (length, number), and its gap."""
    pattern, gap, length = [], capacity, first
    while length:
        n = int(min(gap // length, left[length]))
        pattern.append((length, n))
        gap -= n * length
        below = np.flatnonzero(left[: min(length, gap + 1)])
        length = int(below[-1]) if below.size else 0
    return pattern, gap


def _exchange(pattern: list[tuple[int, int]], gap: int, left: np.ndarray) -> list[tuple[int, int]]:
    """The pattern with one document of its smallest length given for the best two others, if they fit more tightly."""
    smallest = pattern[-1][0]
    if not gap:
        return pattern
    spare = left.copy()
    for length, n in pattern:
        spare[length] -= n
    once, twice = spare > 0, spare > 1
    for total in range(min(smallest + gap, 2 * (len(left) - 1)), smallest, -1):
        small = np.arange(max(1, total - len(left) + 1), (total + 1) // 2)
        hits = small[once[small] & once[total - small]]
        pair = (int(hits[-1]), total - int(hits[-1])) if hits.size else (total // 2,) * 2 if total % 2 == 0 and twice[total // 2] else None
        if pair:
            content = dict(pattern)
            content[smallest] -= 1
            for length in pair:
                content[length] = content.get(length, 0) + 1
            return sorted(((length, n) for length, n in content.items() if n), reverse=True)
    return pattern


def place(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of documents given by length and rank."""
    key = runs[:, 0] << 44 | runs[:, 1]
    run = runs[np.searchsorted(key, length << 44 | rank, "right") - 1]
    nth = rank - run[:, 1]
    return run[:, 4] + nth % run[:, 3], run[:, 5] + nth // run[:, 3] * run[:, 0]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts the pieces of this length in this task."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, task = encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in common.sliced(batches):
            rows: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), use.encode(common.texts(batch)), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((key, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES, strict=True)], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def assign(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (which must not be computed anew: ranks are by task)."""
    sizes = cut.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # At most one number for each length up to the capacity.
    runs = plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    kept = [n for n in cut.columns if n not in ("task", "nth")]
    ranked = cut.join(bases, ["length", "task"]).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    table = cut.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            sequence, offset = place(table.value, batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    return ranked.mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in kept), "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most ``capacity`` ids.

    A document is its ids and the end id.  Only longer ones are cut, into pieces of the capacity and a last one.
    """
    store = common.Scratch(docs.sparkSession, "packing")
    return assign(store.write(pieces(docs, path, capacity, end_id), "pieces"), capacity)
