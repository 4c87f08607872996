"""Helpers shared by the operators of this package.

Two ideas recur.  *Scratch tables*: intermediate results that several plans
read are written as Parquet below ``spark.checkpoint.dir``, the folder that the
driver and all executors share, so a lost executor costs a task and no data.
*Packed rows*: where a step moves very many small keys, a task gathers them per
bucket and sends one binary row per bucket and flush, so that the exchange
handles few, large rows and numpy does the sorting inside the bucket.
"""

from __future__ import annotations

import atexit
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ensure_checkpoint_dir

#: White space of all word rules here: space and the control characters 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder below /tmp/checkpoints, and on a cluster an error."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


class Scratch:
    """Named Parquet tables of one run in the shared folder; removed one by one, the rest when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df, and returns the table that has been written."""
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; leftovers lie in the checkpoint folder only
            if name:
                raise


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Batches of at most so many rows for what runs inside, which spares executors the room of larger ones; then as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows: Spark bounds a batch by bytes, but Python objects of its texts take more room than it does."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(rows: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by which blocks and buckets are sized."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def remainder(column: str, n: int) -> Column:
    """crc32 of a number's decimal text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Strings of a column; null becomes the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a column; null becomes the empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for both cases of A to Z, and odd bases' powers: from a fixed seed.
_RNG = np.random.default_rng(20)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64th, at least n of each."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of ``words_of(raw)``, in order: polynomials over the words' bytes, all words at once.

    Prefix sums of letter times power give each word's polynomial times the power
    of its place, which the inverse power takes away.
    """
    return words_and_lengths(raw)[0]


def words_and_lengths(raw: bytes, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` and the words' lengths in bytes; long texts are hashed in stretches of about ``most`` bytes."""
    if len(raw) <= most:
        return _words_and_lengths(raw)
    found, at = [], 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + most)
        end = cut.start() if cut else len(raw)
        found.append(_words_and_lengths(memoryview(raw)[at:end]))
        at = end
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _words_and_lengths(raw: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return np.empty(0, np.uint64), starts
    power, inverse = _powers_to(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return h ^ (h >> np.uint64(29)), ends - starts


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if keys.size else keys


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if keys.size else np.empty(0, bool)
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], places


def words_of(raw: bytes) -> list[bytes]:
    """Words between white space, A to Z lower-cased: bytes.lower and bytes.split know ASCII only, which is the rule."""
    return raw.lower().split()


def word_count(column: Column) -> Column:
    return F.size(F.filter(F.split(column, WORD_BREAK), lambda w: w != ""))


class Packer:
    """Gathers arrays per bucket and yields packed rows (bucket int, part binary) once they reach flush_bytes in all.

    Every part is the concatenation of equally long columns, each raw little-endian.
    """

    schema = "bucket int, part binary"

    def __init__(self, buckets: int, flush_bytes: int = 48 << 20):
        self.buckets, self.flush_bytes = buckets, flush_bytes
        self.held: list[tuple[np.ndarray, tuple[np.ndarray, ...]]] = []
        self.size = 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> None:
        self.held.append((bucket, columns))
        self.size += sum(c.nbytes for c in columns)

    @property
    def full(self) -> bool:
        return self.size >= self.flush_bytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket = np.concatenate([b for b, _ in self.held])
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        columns = [np.concatenate([c[i] for _, c in self.held])[order] for i in range(len(self.held[0][1]))]
        self.held, self.size = [], 0
        ids, parts = [], []
        for b in np.flatnonzero(np.diff(edges)):
            ids.append(int(b))
            parts.append(b"".join(c[edges[b] : edges[b + 1]].tobytes() for c in columns))
        for i in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64], pa.int32()), pa.array(parts[i : i + 64], pa.binary())], ["bucket", "part"])


def unpack(parts: Iterable[bytes], *dtypes: str) -> list[np.ndarray]:
    """Columns of packed parts, one after another."""
    width = sum(np.dtype(t).itemsize for t in dtypes)
    found: list[list[np.ndarray]] = [[] for _ in dtypes]
    for part in parts:
        n, at = len(part) // width, 0
        for held, t in zip(found, dtypes, strict=True):
            held.append(np.frombuffer(part, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(held) if held else np.empty(0, t) for held, t in zip(found, dtypes, strict=True)]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def keep_rows(docs: DataFrame, mask, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, for which mask(raw texts of a batch) is true; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(mask(raw_texts(batch, text_column)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
