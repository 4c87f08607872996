"""Patch features: shifted 2-D power spectra and their azimuthal means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def radius(dx: Column, dy: Column, width: float = 1.0) -> Column:
    """Ring number of a pixel around the patch's middle, which lies between pixels."""
    return F.floor(F.hypot(dx + 0.5, dy + 0.5) / width).cast("int")


def azimuthal_profile(patch_pixels: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """(gx, gy, ring, n, mean) of patch pixels (gx, gy, dx, dy, value)."""
    return patch_pixels.groupBy("gx", "gy", radius(F.col("dx"), F.col("dy"), width).alias("ring")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def rings(side: int, width: float = 1.0) -> tuple[np.ndarray, int]:
    """Ring of each pixel of a square patch, and the number of values kept: one less than there are rings."""
    axis = np.arange(side) - (side - 1) / 2
    r = np.hypot(axis[:, None], axis[None, :])
    n = int(round(float(r.max()) / width)) + 1
    return np.minimum((r / width).astype(int), n - 1), n - 1


def power_spectrum(patch: np.ndarray) -> np.ndarray:
    """Power of patches (..., side, side), zero frequency in the middle."""
    return np.abs(np.fft.fftshift(np.fft.fft2(patch), axes=(-2, -1))) ** 2


def radial_means(power: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Means by ring (..., values); an empty ring gives zero, and the last one is left out."""
    side = power.shape[-1]
    ring, keep = rings(side, width)
    flat = power.reshape(-1, side * side)
    n = np.bincount(ring.reshape(-1), minlength=keep + 1)
    sums = np.stack([np.bincount(ring.reshape(-1), row, minlength=keep + 1) for row in flat]) if len(flat) else np.empty((0, keep + 1))
    return (sums / np.maximum(n, 1))[:, :keep].reshape(*power.shape[:-2], keep)


#: Feature builders by name: (patches (n, side, side), options) -> (n, values).
FEATURES: dict[str, Callable[..., np.ndarray]] = {"power_spectrum": lambda x, width=1.0: radial_means(power_spectrum(x), width)}


def patch_features(patch_rows: DataFrame, band_columns: list[str], side: int, feature: str = "power_spectrum", area: list[str] | None = None, **options) -> DataFrame:
    """(area..., gx, gy, v): features of all bands in a row; patches that aren't complete have none.  Arrow batches, no shuffle."""
    build, area = FEATURES[feature], area or []
    keys, kinds = [*area, "gx", "gy"], dict(patch_rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [build(batch.column(len(keys) + i).flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side), **options) for i in range(len(band_columns))]
            rows = np.concatenate(parts, 1) if batch.num_rows else np.empty((0, 1))
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], [*keys, "v"])

    whole = patch_rows.where(F.col("n") == side * side).select(*area, F.col("gx").cast("int"), F.col("gy").cast("int"), *band_columns)
    return whole.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in area), "gx int, gy int, v array<double>"]))
