"""Statistics of pixels: the high-pass residual and the contrast of its 8 x 8 lattice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRID, PERIOD, LEAST, MARGIN, SHARE = 4, 8, 0.1, 0.04, 0.75


def residual(plane: np.ndarray) -> np.ndarray:
    """A plane (rows x columns) without the mean of each pixel's 3 x 3 neighbours; edges repeat."""
    p = np.pad(plane.astype(np.float32), 1, mode="edge")
    h, w = plane.shape
    return plane - sum(p[y : y + h, x : x + w] for y in range(3) for x in range(3)) / np.float32(9)


def _upper(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0


def contrast(lines: np.ndarray) -> float:
    """How far the strongest of the eight classes of lines stands out over their median."""
    classes = sorted(_upper(lines[k::PERIOD]) for k in range(PERIOD))
    return (classes[7] - classes[4]) / (classes[4] + LEAST)


def lattice(plane: np.ndarray) -> tuple[float, float]:
    """(median contrast, share of tiles that stand out) over GRID x GRID tiles; a tile has the smaller contrast of its two axes."""
    r = np.abs(residual(plane)).astype(np.float64)
    h, w = r.shape[0] // GRID, r.shape[1] // GRID
    if not h or not w:
        return 0.0, 0.0
    tiles = [r[y * h : (y + 1) * h, x * w : (x + 1) * w] for y in range(GRID) for x in range(GRID)]
    found = np.array([min(contrast(t.mean(axis=0)), contrast(t.mean(axis=1))) for t in tiles])
    return _upper(found), float((found > MARGIN).mean())


def lattice_of(pixels: Column, width: Column) -> Column:
    """struct<median: double, consistent: double> of a plane given as an array of rows one after the other; null for no whole rows."""

    @F.pandas_udf("median double, consistent double")
    def run(values: pd.Series, widths: pd.Series) -> pd.DataFrame:
        ok = [v is not None and w and len(v) and len(v) % w == 0 for v, w in zip(values, widths)]
        return pd.DataFrame([lattice(np.asarray(v, np.float32).reshape(-1, int(w))) if o else (None, None) for v, w, o in zip(values, widths, ok)], columns=["median", "consistent"])

    return run(pixels, width)


def lattice_status(x: Column, threshold: float | None = None) -> Column:
    """Without a threshold inconclusive; else present if the median reaches it and enough tiles stand out."""
    return F.lit("inconclusive") if threshold is None else F.when((x["median"] >= threshold) & (x["consistent"] >= SHARE), "present").otherwise("absent")
