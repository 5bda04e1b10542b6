"""Iterative raster kernels on whole rasters (in-painting, relaxation, gap growth), one raster a task.

Rasters come as rows (id, y, x, h); a raster is handed to one Python task as a dense array, so it has to fit in
memory - larger areas are cut into overlapping rasters first.  Holes are null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Share of holes beyond which a raster is left alone; rounds, tolerance and step of relaxation.
MOST_HOLES, ROUNDS, TOLERANCE, STEP = 0.35, 300, 1e-4, 0.7


def per_raster(cells: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel on each raster's array with NaN for holes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        a = np.full((int(pdf["y"].max() - y0) + 1, int(pdf["x"].max() - x0) + 1), np.nan)
        a[pdf["y"] - y0, pdf["x"] - x0] = pdf["h"].astype(float)
        out = kernel(a)
        yy, xx = np.indices(out.shape)
        h = pd.Series(out.ravel())
        return pd.DataFrame({"id": pdf["id"].iloc[0], "y": yy.ravel() + y0, "x": xx.ravel() + x0, "h": h.where(h.notna(), None)})

    kinds = dict(cells.dtypes)
    return cells.select("id", "y", "x", "h").groupBy("id").applyInPandas(run, f"id {kinds['id']}, y {kinds['y']}, x {kinds['x']}, h double")


def _shifted(a: np.ndarray, radius: int) -> np.ndarray:
    """Stack of the array moved by every offset of a square, NaN beyond the edge."""
    p = np.pad(a, radius, constant_values=np.nan)
    n = 2 * radius + 1
    return np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(n) for j in range(n)])


def _mean(stack: np.ndarray) -> np.ndarray:
    n = np.sum(~np.isnan(stack), 0)
    return np.where(n > 0, np.nansum(stack, 0) / np.maximum(n, 1), np.nan)


def halved(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), constant_values=np.nan)
    return _mean(np.stack([p[i::2, j::2] for i in (0, 1) for j in (0, 1)]))


def bilinear(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The array stretched to a shape by its cells' centres; holes give way to known corners."""
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, a.shape)]
    i, j = (x.astype(int) for x in at)
    i1, j1 = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    fy, fx = (at[0] - i)[:, None], (at[1] - j)[None, :]
    values = np.stack([a[np.ix_(p, q)] for p in (i, i1) for q in (j, j1)])
    weights = np.stack([(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx]) * ~np.isnan(values)
    total = weights.sum(0)
    return np.where(total > 0, np.nansum(values * weights, 0) / np.where(total > 0, total, 1), np.nan)


def push_pull(a: np.ndarray) -> np.ndarray:
    """Holes from a pyramid of means, pulled down bilinearly; filled cells are then blurred 3 x 3."""
    if min(a.shape) < 1 or not np.isnan(a).any() or np.isnan(a).all():
        return a
    coarse = push_pull(halved(a)) if max(a.shape) > 1 else a
    out = np.where(np.isnan(a), bilinear(coarse, a.shape), a)
    return np.where(np.isnan(a), _mean(_shifted(out, 1)), out)


def grow(a: np.ndarray, passes: int = 64, radius: int = 3) -> np.ndarray:
    """Holes take the mean of the known cells around, ring by ring."""
    for _ in range(passes):
        hole = np.isnan(a)
        if not hole.any() or hole.all():
            break
        a = np.where(hole, _mean(_shifted(a, radius)), a)
    return a


def relax(a: np.ndarray, filled: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Filled cells settle between their neighbours: half the mean of four, half a thin plate.  All cells move at
    once by part of the way (a whole step of the thin plate would swing), so the order of cells has no say."""
    a = a.copy()
    for _ in range(rounds):
        p = np.pad(a, 2, mode="edge")
        n = lambda i, j: p[2 + i : 2 + i + a.shape[0], 2 + j : 2 + j + a.shape[1]]  # noqa: B023, E731
        four = n(-1, 0) + n(1, 0) + n(0, -1) + n(0, 1)
        corner = n(-1, -1) + n(-1, 1) + n(1, -1) + n(1, 1)
        far = n(-2, 0) + n(2, 0) + n(0, -2) + n(0, 2)
        goal = 0.5 * four / 4 + 0.5 * (8 * four - 2 * corner - far) / 20
        new = np.where(filled, a + STEP * (goal - a), a)
        moved = np.nanmax(np.abs(new - a), initial=0.0)
        a = new
        if moved < TOLERANCE:
            break
    return a


def box_blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over rows and then columns that leaves holes out; holes stay."""
    for axis in (1, 0):
        known = ~np.isnan(a)
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius + 1, radius)
        s, n = (np.cumsum(np.pad(v, pad), axis=axis) for v in (np.where(known, a, 0.0), known.astype(float)))
        take = lambda v: np.take(v, range(2 * radius + 1, v.shape[axis]), axis) - np.take(v, range(0, v.shape[axis] - 2 * radius - 1), axis)  # noqa: B023, E731
        a = np.where(known, take(s) / np.maximum(take(n), 1), np.nan)
    return a


def finished(a: np.ndarray, smooth: bool, fill: bool, radius: int = 8) -> np.ndarray:
    """A raster made whole.  With `fill`, one without holes, or with too many, is returned as it is - not even
    smoothed; else holes are in-painted, grown into and relaxed."""
    hole = np.isnan(a)
    if fill:
        if not hole.any() or hole.mean() >= MOST_HOLES:
            return a
        a = relax(grow(push_pull(a)), hole)
    return box_blur(box_blur(a, radius), radius) if smooth else a


def dilate(a: np.ndarray) -> np.ndarray:
    """Holes from the mean of their four neighbours, outward until none is left."""
    for _ in range(2 * sum(a.shape) + 4):
        hole = np.isnan(a)
        if not hole.any() or hole.all():
            break
        p = np.pad(a, 1, constant_values=np.nan)
        a = np.where(hole, _mean(np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])), a)
    return a


def flood_components(mask: np.ndarray, least: int = 1) -> np.ndarray:
    """Numbers of the four-connected patches of a mask from 1, 0 outside and in patches under `least` cells."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        near = np.max(np.stack([label, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), 0)
        new = np.where(mask, near, 0)
        if (new == label).all():
            break
        label = new
    ids, n = np.unique(label[label > 0], return_counts=True)
    kept = {i: k + 1 for k, i in enumerate(ids[n >= least])}
    return np.vectorize(lambda v: kept.get(v, 0), otypes=[int])(label) if label.size else label
