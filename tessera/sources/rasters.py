"""Binary raster and matrix files, read with ``binaryFile`` and decoded in Arrow batches.

Files are the unit of work: one file is decoded in one task, and yields its rows
in slices, so memory holds one file and one slice.
"""

from __future__ import annotations

import ast
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sample types of the image format by bits for each pixel.
FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
BLOCK = 2880


def fits_image(raw: bytes) -> np.ndarray:
    """The first two-dimensional image of a file: that of the primary header, or else of an extension."""
    at = 0
    while at + BLOCK <= len(raw):
        cards, end = {}, False
        while not end and at + BLOCK <= len(raw):
            block = raw[at : at + BLOCK].decode("ascii", "replace")
            at += BLOCK
            for i in range(0, BLOCK, 80):
                card = block[i : i + 80]
                if card.startswith("END     "):
                    end = True
                    break
                if card[8:10] == "= ":
                    cards[card[:8].strip()] = card[10:].split("/")[0].strip()
        bits = int(cards.get("BITPIX", 8))
        shape = [int(cards[f"NAXIS{i}"]) for i in range(int(cards.get("NAXIS", 0)), 0, -1)]
        count = int(np.prod(shape)) if shape else 0
        if len(shape) == 2 and count:
            image = np.frombuffer(raw, FITS_TYPES[bits], count, at).reshape(shape)
            return image.astype(float) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
        size = abs(bits) // 8 * (count + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1))
        at += -(-size // BLOCK) * BLOCK
    raise ValueError("no two-dimensional image")


def fits_bytes(image: np.ndarray) -> bytes:
    """A minimal file of one image of 64-bit floats."""
    cards = [("SIMPLE", "T"), ("BITPIX", "-64"), ("NAXIS", "2"), ("NAXIS1", str(image.shape[1])), ("NAXIS2", str(image.shape[0]))]
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
    body = np.ascontiguousarray(image, ">f8").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode() + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def npy_matrix(raw: bytes) -> np.ndarray:
    """All parts of a file of one or more arrays one after another, stacked; Fortran order is honoured."""
    parts, at = [], 0
    while at < len(raw):
        if raw[at : at + 6] != b"\x93NUMPY":
            raise ValueError("not an array file")
        wide = raw[at + 6] >= 2
        size = struct.unpack_from("<I" if wide else "<H", raw, at + 8)[0]
        begin = at + (12 if wide else 10)
        head = ast.literal_eval(raw[begin : begin + size].decode("latin1").strip())
        kind, shape = np.dtype(head["descr"]), head["shape"]
        count = int(np.prod(shape))
        data = np.frombuffer(raw, kind, count, begin + size)
        parts.append(data.reshape(shape, order="F" if head["fortran_order"] else "C"))
        at = begin + size + count * kind.itemsize
    return np.concatenate(parts) if parts else np.empty((0, 0))


def text_header_matrix(raw: bytes) -> np.ndarray:
    """An 80-byte header ``rows=...,cols=...`` and 32-bit floats by row."""
    head = dict(p.split("=") for p in raw[:80].decode("ascii").strip(" \0\n").split(","))
    return np.frombuffer(raw, "<f4", int(head["rows"]) * int(head["cols"]), 80).reshape(int(head["rows"]), -1)


DECODERS = {"fits": fits_image, "npy": npy_matrix, "matrix": text_header_matrix}


def read_pixels(spark: SparkSession, path: str | list[str], kind: str = "fits", rows: int = 256) -> DataFrame:
    """(path, y, x, value) of image files; crop with a filter on y and x."""
    decode = DECODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):  # one file at a time
                image = decode(raw.as_py())
                for at in range(0, len(image), rows):
                    part = image[at : at + rows]
                    y, x = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array((y + at).reshape(-1).astype(np.int32)), pa.array(x.reshape(-1).astype(np.int32)), pa.array(part.reshape(-1).astype(float))], ["path", "y", "x", "value"])

    return _files(spark, path).mapInArrow(run, "path string, y int, x int, value double")


def _full_path(spark: SparkSession, path: str) -> str:
    """The path as a scan names it: with its file system, and without what is relative."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(made).toUri().toString()


def read_cube(spark: SparkSession, files: DataFrame, kind: str = "fits", rows: int = 256) -> DataFrame:
    """(area, x, y, a column for each band) of a manifest (area, band, path): bands of one area are joined by pixel; a band without the pixel is null."""
    listed = [(r["area"], r["band"], r["path"]) for r in files.select("area", "band", "path").collect()]  # a row for each file
    full = {p: _full_path(spark, p) for _, _, p in listed}
    names = spark.createDataFrame([(a, b, full[p]) for a, b, p in listed], "area int, band string, path string")
    same = lambda rows: rows.withColumn("path", F.regexp_replace("path", "^file:/*", "file:/"))  # noqa: E731  local paths are written with one slash or three
    tagged = same(read_pixels(spark, sorted(full.values()), kind, rows)).join(F.broadcast(same(names)), "path")
    bands = sorted({b for _, b, _ in listed})
    return tagged.groupBy("area", "x", "y").agg(*(F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands))


def read_vectors(spark: SparkSession, path: str, kind: str = "npy", rows: int = 4096) -> DataFrame:
    """(path, idx, v) of matrix files, a row each; idx counts within the file."""
    decode = DECODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                matrix = decode(raw.as_py())
                for at in range(0, len(matrix), rows):
                    part = matrix[at : at + rows].astype(float)
                    made = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), made], ["path", "idx", "v"])

    return _files(spark, path).mapInArrow(run, "path string, idx long, v array<double>")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def npy_bytes(matrix: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, matrix)
    return out.getvalue()
