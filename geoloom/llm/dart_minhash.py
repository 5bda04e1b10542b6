"""DartMinHash: sparse weighted MinHash signatures.

Think of a plane of (weight, rank) for every element, strewn with darts at unit rate.  A set's
darts are those below an element's weight and below a rank limit; both sets that hold an element
see its darts alike, as they follow from hashes of the element and the plane's cell only.  Each
dart belongs to one of k coordinates and each coordinate keeps its earliest dart (least rank).  Two
sets agree in a coordinate with the probability of their weighted Jaccard similarity.  With the
limit at (k ln k + 2k) / total weight few coordinates stay empty; where one does, the limit
doubles.  The work is that of the elements and of k ln k darts, not of their product.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .common import mix64

#: Total weight beyond which the first rank cell holds more darts than are needed.
WIDE = 1 << 15
_TO_UNIT = 2.0**-53
#: Darts that are worked on at once.
AT_ONCE = 1_000_000


@lru_cache(maxsize=4096)
def _poisson(mean: float) -> np.ndarray:
    """The cumulative distribution of the number of darts in a cell of that area."""
    top = int(mean + 12 * math.sqrt(mean) + 24)
    return np.cumsum([math.exp(n * math.log(mean) - mean - math.lgamma(n + 1)) for n in range(top)])


def _cell(i: int, unit: float) -> tuple[float, float]:
    """Cells double: [0, unit), [unit, 2 unit), [2 unit, 4 unit), ..."""
    return (0.0, unit) if i == 0 else (unit * 2.0 ** (i - 1), unit * 2.0**i)


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k unsigned 64-bit values for each set; sets' elements (unsigned 64-bit) lie one after another.

    Weights are positive; cells start at one unit of weight, so weights far below 1 are right but
    slow.  Each set needs an element."""
    out = np.zeros((len(counts), k), np.uint64)
    darts = k * math.log(k) + 2 * k
    total = np.add.reduceat(weights, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)
    per_set = np.maximum(3 * darts, 2 * darts * total / WIDE)
    group = (np.cumsum(per_set) // AT_ONCE).astype(np.int64)
    ends = np.cumsum(counts)
    for g in np.unique(group):
        sets = np.flatnonzero(group == g)
        lo, hi = ends[sets[0]] - counts[sets[0]], ends[sets[-1]]
        out[sets] = _signatures(elements[lo:hi], weights[lo:hi], counts[sets], total[sets], k, darts, seed)
    return out


def _signatures(elements, weights, counts, total, k, darts, seed):
    n = len(counts)
    out, todo = np.zeros((n, k), np.uint64), np.arange(n)
    owner = np.repeat(np.arange(n), counts)
    limit = darts / total
    while len(todo):
        slot = np.full(n, -1)
        slot[todo] = np.arange(len(todo))
        mine = np.flatnonzero(slot[owner] >= 0)
        rank, ident = _throw(elements[mine], weights[mine], slot[owner[mine]], limit[todo], len(todo), k, darts / WIDE, seed)
        full = ~np.isinf(rank).any(1)
        out[todo[full]] = ident[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def _throw(elements, weights, slots, limit, n, k, unit, seed):
    """Least rank and its dart for each coordinate of n sets; infinite where no dart fell."""
    rank, ident = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    for i in range(64):
        w0, w1 = _cell(i, 1.0)
        heavy = np.flatnonzero(weights > w0)
        if not len(heavy):
            break
        for j in range(64):
            r0, r1 = _cell(j, unit)
            own = heavy[limit[slots[heavy]] > r0]
            if not len(own):
                break
            cell = mix64(elements[own] ^ mix64(np.array([(seed << 16) + (i << 8) + j + 1], np.uint64)))
            number = np.searchsorted(_poisson((w1 - w0) * (r1 - r0)), (cell >> np.uint64(11)).astype(np.float64) * _TO_UNIT, side="right")
            start = np.cumsum(number) - number
            nth = np.arange(int(number.sum())) - np.repeat(start, number)
            dart = mix64(np.repeat(cell, number) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            of = np.repeat(own, number)
            second = mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            r = r0 + (r1 - r0) * ((second >> np.uint64(11)).astype(np.float64) * _TO_UNIT)
            w = w0 + (w1 - w0) * ((dart >> np.uint64(11)).astype(np.float64) * _TO_UNIT)
            hit = np.flatnonzero((w < weights[of]) & (r < limit[slots[of]]))
            third = mix64(second + np.uint64(0x632BE59BD9B4E019))[hit]
            at = slots[of[hit]] * k + (third % np.uint64(k)).astype(np.int64)
            np.minimum.at(rank, at, r[hit])
            won = rank[at] == r[hit]
            ident[at[won]] = third[won]
    return rank.reshape(n, k), ident.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each set and band of rows coordinates."""
    keys = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows])
    return keys.view(np.int64)
