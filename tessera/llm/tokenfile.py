"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A *shard* is one self-contained file image of consecutive documents in
ascending id order.  It replaces each id by its rank by frequency within the
shard (ties by id), so that the commonest 256 ids take one byte, writes every
rank in one to four bytes, and keeps the byte counts, two bits for each id, in a
separate stream of control bytes.  The reader takes four ids at a time: the
control byte selects a row of a 256-entry table that tells which data bytes make
up the four integers, so a shard is decoded by three numpy look-ups.

Layout, little-endian: magic ``TVB1``; u32 documents, u64 ids, u32 ranked ids;
i64 document ids; u8 flags (1: the document id is null); u64 lengths; u32 ids by
rank; control bytes; data bytes.

``write`` range-partitions whole texts by document id, encodes and packs them
there and lets Spark's committer store the shards as rows of a Parquet folder,
which any file system that Spark knows can hold, and which a retried task cannot
leave half written.  ``save_files`` lays the same images down as plain files.

Null text: the end id only.  Null document ids come first.  Rows with equal ids
keep all their tokens and stand in order of a hash of their texts.  An empty table gives
no shards.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vocab

MAGIC = b"TVB1"
_HEAD = struct.Struct("<4sIQI")
#: Which of four little-endian bytes a number of one to four bytes keeps.
_KEEP = np.tril(np.ones((4, 4), bool))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: the data bytes of its four integers, and the place of each of their 16 bytes (-1: zero)."""
    sizes = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
    starts = np.cumsum(sizes, 1) - sizes
    lane = np.arange(4)
    places = np.where(lane < sizes[:, :, None], starts[:, :, None] + lane, -1)
    return sizes.sum(1), places.reshape(256, 16)


SIZES, PLACES = _tables()


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    values = np.ascontiguousarray(values, "<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = more
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[_KEEP[more]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int, block: int = 1 << 16) -> np.ndarray:
    """n integers from control and data bytes, by table look-up."""
    out = np.empty(len(control) * 4, "<u4")
    at = 0
    for i in range(0, len(control), block):
        codes = control[i : i + block]
        ends = np.cumsum(SIZES[codes])
        # The last control byte may count bytes for absent integers: they read as zero, beyond the data.
        window = np.zeros(int(ends[-1]) + 1, np.uint8)
        part = data[at : at + int(ends[-1])]
        window[: len(part)] = part
        places = PLACES[codes]
        index = np.where(places < 0, len(window) - 1, places + (ends - SIZES[codes])[:, None])
        out[i * 4 : (i + len(codes)) * 4] = window[index].view("<u4").reshape(-1)
        at += int(ends[-1])
    return out[:n]


def shard(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    """The file image of documents, whose ids are given as little-endian 32-bit bytes."""
    lengths = np.array([len(d) // 4 for d in documents], "<u8")
    ids = np.frombuffer(b"".join(documents), "<u4")
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    seen = np.flatnonzero(counts)
    order = np.argsort(-counts[seen], kind="stable")
    rank = np.zeros(len(counts), "<u4")
    rank[seen[order]] = np.arange(len(seen))
    control, data = pack(rank[ids])
    head = _HEAD.pack(MAGIC, len(documents), len(ids), len(seen))
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join((head, keys, lengths.tobytes(), seen[order].astype("<u4").tobytes(), control, data))


def read_shard(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all token ids of a file image."""
    magic, docs, n, ranked = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(image, dtype, count, at)
        at += found.nbytes
        return found

    keys, null, lengths, by_rank, control = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", ranked), take("u1", -(-n // 4))
    ids = by_rank[unpack(control, np.frombuffer(image, np.uint8, offset=at), n)] if n else np.empty(0, "<u4")
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], lengths, ids


@lru_cache(maxsize=4)
def encoder(path: str) -> vocab.PieceEncoder:
    """One encoder for each file and Python worker."""
    return vocab.PieceEncoder(path)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, shard_tokens: int = 1 << 20) -> None:
    """Writes shards of all documents to a folder: (part, within, n_tokens, image); within: ids before it in its part."""
    spark = docs.sparkSession
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part, within = encoder(path), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([within], pa.int64()), pa.array([size], pa.int64()), pa.array([shard(keys, held)], pa.binary())], ["part", "within", "n_tokens", "image"])

        for batch in common.sliced(batches):
            for key, raw in zip(batch.column(0).to_pylist(), use.encode(common.texts(batch)), strict=True):
                keys.append(key)
                held.append(raw + end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield out()
                    keys, held, within, size = [], [], within + size, 0
        if held:
            yield out()

    # Rows with equal ids, or none, are dealt out by their texts, and repeated rows by the task that reads them.
    marks = [F.xxhash64("text").alias("mark"), F.spark_partition_id().alias("task")]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", *marks).repartitionByRange(common.partitions(spark), "doc_id", "mark", "task").sortWithinPartitions("doc_id", "mark", "text")
    with common.small_batches(spark):
        ordered.select("doc_id", "text").mapInArrow(run, "part int, within long, n_tokens long, image binary").write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<long>) of a folder of shards."""
    return _scan(spark, folder, "ids array<long>", lambda ids, edges: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a folder of shards."""

    def sums(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        raw, at = memoryview(ids.tobytes()), (4 * edges).tolist()
        return pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])], pa.int64())

    return _scan(spark, folder, "ids_crc32 long", sums)


def _scan(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    shards = spark.read.schema("part int, within long, n_tokens long, image binary").parquet(folder)
    # One number for each part, of which there are as many as shuffle partitions.
    sizes = dict(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            for i in range(batch.num_rows):
                keys, lengths, ids = read_shard(batch.column(2)[i].as_py())
                edges = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                start = edges[:-1] + before[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start), pa.array(lengths.astype(np.int64)), make(ids, edges)], ["doc_id", "start", "n_tokens", name])

    return shards.select("part", "within", "image").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def save_files(spark: SparkSession, folder: str, target: str) -> int:
    """Lays the shards down as plain files part-<part>-<within>.tvb under a URI that pyarrow can write; returns their number.

    Each file is written under another name and then moved, so a retried task replaces whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in common.sliced(batches):
            for i in range(batch.num_rows):
                name = f"{root}/part-{batch.column(0)[i].as_py():06d}-{batch.column(1)[i].as_py():015d}.tvb"
                attempt = f"{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(attempt) as f:
                    f.write(batch.column(2)[i].as_py())
                store.move(attempt, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    made = spark.read.parquet(folder).select("part", "within", "image").mapInArrow(run, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
