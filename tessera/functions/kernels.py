"""Metrics in numpy, for kernels that run in Arrow batches: the same values as the Column expressions of ``vectors``."""

from __future__ import annotations

import numpy as np

#: Metrics that have a numpy form.
NUMPY = ("squared_euclid", "euclidean", "cosine", "pearson", "pspearson", "gradpearson", "fraceuclidean")


def to_rows(name: str, x: np.ndarray, y: np.ndarray, bands: int = 4) -> np.ndarray:
    """Distances of one vector to rows; NaN where a vector has no direction."""
    if name in ("euclidean", "squared_euclid"):
        d = ((y - x) ** 2).sum(1)
        return np.sqrt(d) if name == "euclidean" else d
    if name == "fraceuclidean":
        with np.errstate(invalid="ignore", divide="ignore"):
            part = (y - x) ** 2 / (0.25 * (y + x) ** 2)
        return np.where(y + x != 0, part, 0.0).sum(1)
    if name not in NUMPY:
        raise ValueError(f"no numpy form of {name!r}")
    a, b = (x, y) if name == "cosine" else (x - x.mean(), y - y.mean(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 1 - (b @ a) / (np.sqrt((b * b).sum(1)) * np.sqrt((a * a).sum()))
    if name == "pspearson":
        first = np.arange(bands) * len(x) // bands
        d = d + 0.2 * (np.abs(y[:, first] - x[first]) > 0.2).sum(1)
    if name == "gradpearson":
        u, w = np.diff(x)[:-1], np.diff(y, axis=1)[:, :-1]
        d = d + 0.2 * ((u * w < 0) & (np.abs(u - w) > 0.2)).sum(1)
    return d


def between(name: str, x: np.ndarray, y: np.ndarray, bands: int = 4) -> np.ndarray:
    """Distances of rows to rows, as ``to_rows`` has them; NaN where a vector has no direction.

    Products where they are exact enough, and a loop over components else: nothing is as large as rows by rows by components.
    """
    if name in ("euclidean", "squared_euclid") and x.shape[1] <= 8:
        d, away = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
        for u, w in zip(x.T.copy(), y.T.copy()):
            np.subtract(u[:, None], w, out=away)
            away *= away
            d += away
        return np.sqrt(d, out=d) if name == "euclidean" else d
    if name in ("euclidean", "squared_euclid"):
        middle = y.mean(0) if len(y) else 0.0
        a, b = x - middle, y - middle
        both = (a * a).sum(1)[:, None] + (b * b).sum(1)
        d = both - 2 * (a @ b.T)
        row, other = np.nonzero(~(d > 1e-3 * both))  # what a difference of large numbers would spoil
        for begin in range(0, len(row), 1 << 15):
            i, j = row[begin : begin + (1 << 15)], other[begin : begin + (1 << 15)]
            d[i, j] = ((x[i] - y[j]) ** 2).sum(1)
        return np.sqrt(d) if name == "euclidean" else d
    d = np.zeros((len(x), len(y)))
    if name == "fraceuclidean":
        with np.errstate(invalid="ignore", divide="ignore"):
            for u, w in zip(x.T.copy(), y.T.copy()):
                plus = u[:, None] + w
                part = (u[:, None] - w) ** 2 / (0.25 * plus * plus)
                d += np.where(plus != 0, part, 0.0)
        return d
    if name not in NUMPY:
        raise ValueError(f"no numpy form of {name!r}")
    np.subtract(1, _directions(x, name != "cosine") @ _directions(y, name != "cosine").T, out=d)
    if name == "pspearson":
        for i in np.arange(bands) * x.shape[1] // bands:
            d += 0.2 * (np.abs(x[:, i, None] - y[:, i]) > 0.2)
    if name == "gradpearson":
        opposed = np.zeros(d.shape, np.int32)
        for u, w in zip(np.diff(x, axis=1)[:, :-1].T.copy(), np.diff(y, axis=1)[:, :-1].T.copy()):
            u = u[:, None]
            opposed += (u * w < 0) & (np.abs(u - w) > 0.2)
        d += 0.2 * opposed
    return d


def _directions(x: np.ndarray, centred: bool) -> np.ndarray:
    """Rows, less their own mean if so asked, of unit length; NaN without a direction."""
    if centred:
        flat = x.max(1) == x.min(1) if x.shape[1] else np.ones(len(x), bool)
        x = np.where(flat[:, None], 0.0, x - x.mean(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_rows(x: np.ndarray, at: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared Euclidean distances of each row's k nearest rows of ``at``; ties by place.

    One matrix product, of vectors less the mean of ``at``, names candidates with a
    margin above its rounding; their distances are then taken from differences.
    """
    k = min(k, len(at))
    middle = at.mean(0)
    a, b = x - middle, at - middle
    square_a, square_b = (a * a).sum(1), (b * b).sum(1)
    rough = square_b - 2 * (a @ b.T)
    margin = 1e-15 * (8 + x.shape[1]) * (square_a + square_b.max())
    last = np.partition(rough, k - 1, axis=1)[:, k - 1]
    row, place = np.nonzero(rough <= (last + 2 * margin)[:, None])
    d = np.empty(len(row))
    for begin in range(0, len(row), 1 << 15):
        part = slice(begin, begin + (1 << 15))
        d[part] = ((x[row[part]] - at[place[part]]) ** 2).sum(1)
    order = np.lexsort((place, d, row))
    first = np.searchsorted(row, np.arange(len(x)))
    chosen = order[(first[:, None] + np.arange(k)).reshape(-1)]
    return place[chosen].reshape(-1, k), d[chosen].reshape(-1, k)
