"""Work on the points of many lines at once: arrays x, y of all points and n, the points of each line in turn.  So a task spends its time on
points, not on calls a line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Points up to which lines are walked side by side, in classes of like length; longer ones are walked one by one.
SIDE_BY_SIDE = 64


def starts_of(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by keys as tables that hold whole groups, with the rows of each; a group that goes on in the next
    batch waits for it."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        first = np.flatnonzero(_new(rows, keys))
        if first[-1]:
            yield rows.slice(0, first[-1]), np.diff(first)
        held = rows.slice(first[-1])
    if held is not None:
        yield held, np.array([held.num_rows])


def _new(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    new = np.zeros(rows.num_rows, bool)
    for key in keys:
        codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return new


def hulls(x: np.ndarray, y: np.ndarray, n: np.ndarray, z: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the corners of each line's convex hull, counter-clockwise from the leftmost, the lower of these first (Andrew's chains), and
    how many they are.  Of points of one place one counts, with z a highest; points on an edge don't count.  Lines of fewer
    than three places keep these."""
    line = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((y, x, line) if z is None else (-z, y, x, line))
    line, xs, ys = line[order], x[order], y[order]
    new = np.ones(len(order), bool)
    new[1:] = (line[1:] != line[:-1]) | (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])
    order, x, y = order[new], xs[new], ys[new]
    n = np.bincount(line[new], minlength=len(n))
    start = starts_of(n)
    few = n < 3
    made = [(np.repeat(few, n).nonzero()[0], np.flatnonzero(few), n[few])]
    low, top = 2, 4
    while low < SIDE_BY_SIDE:
        of = np.flatnonzero((n > low) & (n <= top))
        if len(of):
            made.append(_side_by_side(x, y, start[of], n[of], of))
        low, top = top, top * 2
    for g in np.flatnonzero(n > low):
        at = np.array(_one_by_one(x[start[g] : start[g] + n[g]].tolist(), y[start[g] : start[g] + n[g]].tolist())) + start[g]
        made.append((at, np.array([g]), np.array([len(at)])))
    at, of, size = (np.concatenate(parts) for parts in zip(*made))
    counts = np.zeros(len(n), np.int64)
    counts[of] = size
    return order[at[np.argsort(np.repeat(of, size), kind="stable")]], counts


def _one_by_one(x: list[float], y: list[float]) -> list[int]:
    halves: list[int] = []
    for points in (range(len(x)), range(len(x) - 1, -1, -1)):
        half: list[int] = []
        for q in points:
            while len(half) > 1:
                a, b = half[-2], half[-1]
                if not (x[b] - x[a]) * (y[q] - y[a]) - (y[b] - y[a]) * (x[q] - x[a]) <= 0:
                    break
                half.pop()
            half.append(q)
        halves += half[:-1]
    return halves


def _side_by_side(x: np.ndarray, y: np.ndarray, start: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chains of lines of like length: each step adds a point to every line's half, after the points that it hides are gone."""
    most, halves = int(n.max()), []
    for back in (False, True):
        half, size = np.zeros((len(n), most), np.int64), np.zeros(len(n), np.int64)
        for step in range(most):
            lines = np.flatnonzero(n > step)
            q = start[lines] + (n[lines] - 1 - step if back else step)
            left, p = lines, q
            while True:
                long = size[left] > 1
                left, p = left[long], p[long]
                if not len(left):
                    break
                a, b = half[left, size[left] - 2], half[left, size[left] - 1]
                hidden = (x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a]) <= 0
                left, p = left[hidden], p[hidden]
                size[left] -= 1
            half[lines, size[lines]] = q
            size[lines] += 1
        halves.append((half, size - 1))
    both = np.concatenate([half for half, _ in halves], axis=1)
    used = np.concatenate([np.arange(most) < size[:, None] for _, size in halves], axis=1)
    return both[used], of, used.sum(axis=1)


def simplified(x: np.ndarray, y: np.ndarray, n: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points that Douglas-Peucker keeps of each line, and how many they are: a round looks at all chords of all lines that
    aren't settled."""
    kept = np.zeros(len(x), bool)
    start = starts_of(n)
    a, b = start[n > 0], (start + n - 1)[n > 0]
    kept[a] = kept[b] = True
    while True:
        open_ = b - a > 1
        a, b = a[open_], b[open_]
        if not len(a):
            break
        size = b - a - 1
        first = starts_of(size)
        at = np.arange(size.sum()) + np.repeat(a + 1 - first, size)
        p = np.repeat(a, size)
        dx, dy = x[at] - x[p], y[at] - y[p]
        cx, cy = np.repeat(x[b] - x[a], size), np.repeat(y[b] - y[a], size)
        chord = cx * cx + cy * cy
        t = np.clip(np.divide(dx * cx + dy * cy, chord, out=np.zeros(len(at)), where=chord != 0), 0, 1)
        away = np.hypot(dx - t * cx, dy - t * cy)
        most = np.maximum.reduceat(away, first)
        # of points that are equally far the first
        far = np.minimum.reduceat(np.where(away == np.repeat(most, size), at, len(x)), first)
        cut = most > tolerance
        a, b, far = a[cut], b[cut], far[cut]
        kept[far] = True
        a, b = np.concatenate([a, far]), np.concatenate([far, b])
    return np.flatnonzero(kept), np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
