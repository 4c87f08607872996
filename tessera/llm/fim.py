"""Fill-in-the-middle transformation by a sparse event scan.

A text is a row of *units*: a run of ASCII letters, or any other single code
point.  Two hashes of the id choose ranks among the units, where the text is cut
into prefix, middle and suffix, which are then set in another order between
sentinels.

No list of units is made.  Code points are folded to eight ASCII characters,
one for each code point: letters, those of the sentinels apart, to ``a``, and all
beyond ``< >`` and letters to a space.  One Aho-Corasick automaton over the folded
text finds the pairs of characters where the class changes, and the sentinels.
Between two changes lies a gap whose units are known by arithmetic: one for a run
of letters, else as many as it has code points.  So a rank is looked up among
events only: a binary search for its gap, and a step inside it.

Null text is the empty one.  Empty texts, those that hold a sentinel, and a share
of all stay as they are (form ``plain``).  A null id is hashed as no digits.  Rows
with equal ids are cut by equal hashes; repeated rows give repeated results.
Columns besides the id and the text aren't read; an empty table gives an empty
result.  A row depends on nothing else, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Each byte's folded form: letters, which the sentinels' own stand out of, brackets, and all else.
_FOLD = bytes(c if c in b"PSM<>" else ord("a") if c in _LETTERS else ord(" ") for c in range(256))
_CHANGE, _SENTINEL = 0, 1


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for letter in "aPSM":
        for other in "<> ":
            made.add_word(letter + other, _CHANGE)
            made.add_word(other + letter, _CHANGE)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        made.add_word(sentinel, _SENTINEL)
    made.make_automaton()
    return made


_EVENTS = _automaton()


class Units(NamedTuple):
    """Gaps between class changes: where each begins, whether it is a run of letters, and the units before it; both ends included."""

    starts: np.ndarray
    is_run: np.ndarray
    before: np.ndarray
    has_sentinel: bool

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def place(self, rank: int) -> int:
        """The code point at which the unit of a rank (from 0) begins; at rank n the text's end."""
        gap = int(np.searchsorted(self.before, rank, "right")) - 1
        if gap == len(self.is_run):
            return int(self.starts[-1])
        # a run is one unit, so a rank inside a gap other than its first lies among single code points
        return int(self.starts[gap]) + rank - int(self.before[gap])


def scan(text: str) -> Units:
    """The text's events, as gaps; their number is that of class changes, whatever the text's length."""
    if not text:
        return Units(np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(1, np.int64), False)
    folded = text.encode("ascii", "replace").translate(_FOLD).decode("ascii")
    events = np.fromiter((2 * end + kind for end, kind in _EVENTS.iter(folded)), np.int64)
    sentinels = events & 1 == _SENTINEL
    starts = np.concatenate([[0], events[~sentinels] >> 1, [len(folded)]])
    is_run = np.zeros(len(starts) - 1, bool)
    is_run[0 if folded[0] in "aPSM" else 1 :: 2] = True  # classes alternate
    before = np.concatenate([[0], np.cumsum(np.where(is_run, 1, np.diff(starts)))])
    return Units(starts, is_run, before, bool(sentinels.any()))


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


class Transform:
    """Shares in percent: ``plain`` of the texts stay as they are, ``spm`` of the others have their suffix first."""

    def __init__(self, plain: int = 10, spm: int = 20, salt: str = "1:"):
        self.plain, self.spm, self.salt = plain, spm, salt

    def cut(self, doc_id: int | None, text: str) -> Cut:
        units = scan(text)
        digest = hashlib.sha256(f"{self.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not text or units.has_sentinel or h3 % 100 >= 100 - self.plain:
            return Cut(units.n, "plain", None, None, text)
        i, j = sorted(units.place(h % (units.n + 1)) for h in (h1, h2))
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if h4 % 100 < self.spm:
            return Cut(units.n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
        return Cut(units.n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")

    def apply(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
        cut = self.cut

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches, 200):
                ids = batch.column(0).to_pylist()
                found = [cut(i, t.as_py() or "") for i, t in zip(ids, batch.column(1))]
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], _NAMES
                )

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A sentinel can't begin inside another one, and pieces hold none, so the
    output falls into its pieces at the sentinels in one way only.
    """
    piece = lambda i: F.get(F.split(output, "<[PSM]>", -1), F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def transform(docs: DataFrame, plain: int = 10, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) with production parameters."""
    return Transform(plain, spm).apply(docs)
