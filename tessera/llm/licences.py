"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every stretch of one to ``span`` consecutive lines of a text is compared with
every template; a document's own licence is the template with the largest
cosine, if that reaches the threshold.  Term weights are counts times
ln((1 + N) / (1 + df)) + 1, with N and df counted over all documents; words outside
the templates weigh as if no document held them.

Whole texts are read, but few lines are compared.  By the Cauchy-Schwarz
inequality, a stretch that shares no term of a template but its lightest ones,
whose weights make up less than the threshold of the template's length, can't
reach the threshold.  The other terms are *anchors*; stretches without one are skipped.
In a line with an anchor, windows of as many terms as a template has are compared with it too,
so a notice between other words counts.

Licence bodies and standard headers (``licence_texts``) are compared with the whole
text and with every window of as many terms, weighed by themselves.  A text that
shares too little of a body's length for the threshold is skipped, by the same
inequality.  A body that reaches the threshold goes before short notices: the
largest cosine wins, then the longer body.

A licence file gives its licence to its directory.  A document without an own
licence takes that of the nearest ancestor directory that has one: distinct
directories are joined with their ancestors' licences first, and documents join
their directory's answer, so a large directory costs one row per document.

Null text: no own licence.  Null path: no inheritance.  Ties: template order for
texts; larger cosine, then smaller path, for files of a directory.  Repeated rows
are kept.  Empty table: empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Public licences' customary short notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright is waived under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
#: Bodies and standard headers of licences: file names are a licence, and perhaps a kind.
BODIES = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
TERM = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.\-][a-z0-9\x80-\xff]+)*")


_BREAK = bytes(c if c >= 0x80 or chr(c).islower() or chr(c).isdigit() or c in b".-" else 0x20 for c in range(256))
_JOINTS = re.compile(rb"[.\-]{2}")


def distinct_terms(raw: bytes) -> set[bytes]:
    """The set of ``terms``, found faster: other characters become spaces, and dots and dashes at the ends of a term go."""
    low = raw.lower()
    if _JOINTS.search(low):
        return set(TERM.findall(low))
    return {t.strip(b".-") for t in set(low.translate(_BREAK).split())}


def terms(raw: bytes) -> list[bytes]:
    """Lower-case terms; dots and dashes between letters or digits belong to them."""
    return TERM.findall(raw.lower())


class Scanner:
    """Compares stretches of lines with weighted templates."""

    def __init__(self, templates: dict[str, str], df: dict[bytes, int], n: int, threshold: float, span: int):
        self.names, self.threshold, self.span = list(templates), threshold, span
        split = [Counter(terms(t.encode())) for t in templates.values()]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*split)))}
        idf = np.array([np.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in sorted(self.vocabulary)])
        self.idf, self.idf_unknown = idf, float(np.log(1 + n) + 1)
        self.matrix = np.zeros((len(idf), len(split)))
        for k, counts in enumerate(split):
            for t, c in counts.items():
                self.matrix[self.vocabulary[t], k] = c
        self.matrix *= idf[:, None]
        self.matrix /= np.sqrt((self.matrix**2).sum(0))
        anchors = set()
        for k in range(len(split)):
            order = np.argsort(self.matrix[:, k], kind="stable")
            light = np.sqrt(np.cumsum(self.matrix[order, k] ** 2)) < threshold - 1e-9
            anchors |= set(order[~light].tolist())
        names = sorted(self.vocabulary)
        self.anchors = frozenset(names[i] for i in anchors)
        of = np.array([sum(c.values()) for c in split])
        self.lengths = {n: np.flatnonzero(of == n) for n in sorted(set(of.tolist()))}
        self.bodies = Bodies(BODIES, threshold) if BODIES else None

    def scan(self, raw: bytes) -> tuple[str | None, float, int]:
        """Best licence that reaches the threshold, the largest cosine found, and the line where its stretch starts (-1: none compared)."""
        best, name, line = 0.0, None, -1
        distinct = distinct_terms(raw)
        if self.bodies and (found := self.bodies.scan(raw, distinct)):
            return found
        if self.anchors.isdisjoint(distinct):
            return name, best, line
        lines = raw.lower().split(b"\n")
        marked = [i for i, x in enumerate(lines) if not self.anchors.isdisjoint(TERM.findall(x))]
        done = set()
        for i in marked:
            for first in range(max(0, i - self.span + 1), i + 1):
                for n in range(max(1, i - first + 1), self.span + 1):
                    if first + n > len(lines) or (first, n) in done:
                        continue
                    done.add((first, n))
                    cosine, k = self._best(TERM.findall(b"\n".join(lines[first : first + n])))
                    if cosine > best + 1e-12:
                        best, line, name = cosine, first, self.names[k]
            for cosine, k in self._windows(TERM.findall(lines[i])):
                if cosine > best + 1e-12:
                    best, line, name = cosine, i, self.names[k]
        return name if best >= self.threshold else None, best, line

    def _windows(self, found: list[bytes]) -> Iterator[tuple[float, int]]:
        """(cosine, template) of the windows inside a line that may reach the threshold."""
        if len(found) <= min(self.lengths):
            return
        at = np.array([self.vocabulary.get(t, -1) for t in found])
        # A window's squared length is at least the sum of its terms' squares.
        square = np.concatenate([[0.0], np.cumsum(np.where(at < 0, self.idf_unknown, self.idf[at]) ** 2)])
        dot = np.concatenate([np.zeros((1, self.matrix.shape[1])), np.cumsum(np.where(at[:, None] < 0, 0.0, self.matrix[at] * self.idf[at][:, None]), 0)])
        for n, own in self.lengths.items():
            if n < len(found):
                likely = (dot[n:, own] - dot[:-n, own]).max(1) >= (self.threshold - 1e-9) * np.sqrt(square[n:] - square[:-n])
                for i in np.flatnonzero(likely).tolist():
                    yield self._best(found[i : i + n], own)

    def _best(self, found: list[bytes], own: np.ndarray | None = None) -> tuple[float, int]:
        known, square = np.zeros(len(self.idf)), 0.0
        for t, c in Counter(found).items():
            i = self.vocabulary.get(t)
            if i is None:
                square += (c * self.idf_unknown) ** 2
            else:
                known[i] = c * self.idf[i]
        square += (known**2).sum()
        if not square:
            return 0.0, 0
        cosines = known @ self.matrix / np.sqrt(square)
        k = int(cosines.argmax()) if own is None else int(own[cosines[own].argmax()])
        return float(cosines[k]), k


class Bodies:
    """Compares whole texts and their windows with long templates; a term weighs less the more templates hold it."""

    def __init__(self, bodies: dict[str, str], threshold: float):
        split = {k: Counter(terms(t.encode())) for k, t in bodies.items()}
        df = Counter(t for c in split.values() for t in c)
        self.threshold, self.unknown = threshold, float(np.log(1 + len(split)) + 1)
        self.idf = {t: float(np.log((1 + len(split)) / (1 + n)) + 1) for t, n in df.items()}
        self.vocabulary = frozenset(df)
        self.templates = []  # name, terms, unit weights
        for k, c in sorted(split.items(), key=lambda i: (-sum(i[1].values()), i[0])):
            norm = sum((n * self.idf[t]) ** 2 for t, n in c.items()) ** 0.5
            self.templates.append((k.removesuffix(".header"), sum(c.values()), {t: n * self.idf[t] / norm for t, n in c.items()}))
        self.place = {t: i for i, t in enumerate(sorted(df))}
        self.squares = np.zeros((len(df), len(self.templates)))
        for k, (_, _, weights) in enumerate(self.templates):
            for t, w in weights.items():
                self.squares[self.place[t], k] = w * w
        # No text with fewer distinct terms of a template can share enough of its length.
        self.fewest = min(int((np.cumsum(np.sort(column)[::-1]) < threshold**2 - 1e-9).sum()) + 1 for column in self.squares.T)

    def scan(self, raw: bytes, distinct: set[bytes]) -> tuple[str, float, int] | None:
        """Licence, cosine and line of the best body that reaches the threshold."""
        shared = self.vocabulary & distinct
        if len(shared) < self.fewest:
            return None
        likely = np.flatnonzero(self.squares[[self.place[t] for t in shared]].sum(0) >= self.threshold**2 - 1e-9)
        if not likely.size:
            return None
        low = raw.lower()
        places = [(m.group(), m.start()) for m in TERM.finditer(low)]
        found, best = [t for t, _ in places], None
        for k in likely.tolist():
            name, n, weights = self.templates[k]
            for length in {min(n, len(found)), len(found)}:
                cosine, at = self._slide(found, weights, length)
                if cosine >= self.threshold and (best is None or cosine > best[1] + 1e-12):
                    best = name, min(cosine, 1.0), low.count(b"\n", 0, places[at][1])
        return best

    def _slide(self, found: list[bytes], weights: dict[bytes, float], length: int) -> tuple[float, int]:
        """The largest cosine of a window of so many terms, and where it starts."""
        counts, dot, square, best, at = Counter(), 0.0, 0.0, 0.0, 0
        for i, t in enumerate(found):
            idf = self.idf.get(t, self.unknown)
            square += idf * idf * (2 * counts[t] + 1)
            dot += idf * weights.get(t, 0.0)
            counts[t] += 1
            if i >= length:
                t = found[i - length]
                idf = self.idf.get(t, self.unknown)
                counts[t] -= 1
                square -= idf * idf * (2 * counts[t] + 1)
                dot -= idf * weights.get(t, 0.0)
            if i >= length - 1 and square > 0 and dot > best * square**0.5 + 1e-12:
                best, at = dot / square**0.5, i - length + 1
        return best, at


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each term of a bounded vocabulary occurs, and the number of documents; tasks send one row each."""
    names = sorted(vocabulary)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in common.sliced(batches):
            for raw in common.raw_texts(batch):
                n += 1
                found.update(vocabulary.intersection(distinct_terms(raw)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[found[t] for t in names]], pa.list_(pa.int64()))], ["n", "df"])

    counted = docs.select("text").mapInArrow(run, "n long, df array<long>")
    row = counted.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("df", F.lit(i))) for i in range(len(names)))).alias("df")).first()
    return {t: int(c or 0) for t, c in zip(names, row["df"])}, int(row["n"] or 0)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, span: int = 3) -> DataFrame:
    """(doc_id, path, is_file, licence, cosine, line) of rows (doc_id, path, is_file, text)."""
    templates = templates or TEMPLATES
    vocabulary = set().union(*(terms(t.encode()) for t in templates.values()))
    scanner = Scanner(templates, *document_frequencies(docs, vocabulary), threshold, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            names, cosines, lines = zip(*map(scanner.scan, common.raw_texts(batch))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(cosines, pa.float64()), pa.array(lines, pa.int32())], ["doc_id", "path", "is_file", "licence", "cosine", "line"])

    return docs.select(F.col("doc_id").cast("long"), "path", "is_file", "text").mapInArrow(run, "doc_id long, path string, is_file boolean, licence string, cosine double, line int")


def directory(path: Column) -> Column:
    """The directory of a slash-separated path; the empty string is the root, null if the path is null."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds effective (licence that holds), from_dir (directory it was taken from, null if own) and up (directories between)."""
    rows = scanned.withColumn("dir", directory(F.col("path")))
    given = rows.where("is_file and licence is not null and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("best")).select(F.col("dir").alias("from_dir"), F.col("best.licence").alias("inherited"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_dir")))
    wanted = rows.where("dir is not null and licence is null").select("dir").distinct()
    every = wanted.select("dir", F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("from_dir")))).otherwise(ancestors).alias("a")).select("dir", F.explode("a").alias("a")).select("dir", "a.depth", "a.from_dir", F.size(parts).alias("own"))
    nearest = every.join(given, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "inherited", "own")).alias("n"))
    nearest = nearest.select("dir", F.col("n.from_dir"), F.col("n.inherited"), F.when(F.col("dir") == "", 0).otherwise(F.col("n.own") - F.col("n.depth")).alias("up"))
    joined = rows.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return joined.select(*scanned.columns, F.coalesce("licence", "inherited").alias("effective"), F.when(~own, F.col("from_dir")).alias("from_dir"), F.when(~own, F.col("up")).cast("int").alias("up"))
