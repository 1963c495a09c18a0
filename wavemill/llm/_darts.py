"""DartMinHash signatures of weighted sets, many sets at once.

Each element of a set owns the half strip (0, weight) x (0, infinity) of (weight, rank) points, on which darts fall as a Poisson
process of rate one; hashes of the element decide where, so equal elements get equal darts in every set. A set is read only up
to a rank at which about ``k ln k + 2 k`` darts are under its weights. Each dart hashes to one of k coordinates, and a
coordinate keeps its dart of the smallest rank: two sets keep the same one with a probability of their weighted Jaccard
similarity. If a coordinate of a set has no dart yet, that set is read on, up to twice the rank.
"""

from __future__ import annotations

import math

import numpy as np

from ._words import U64, mix

#: Rank cells: an octal ladder below 1, then cells of length 1. No cell holds more than one dart on average.
LADDER = [0.0, 2.0**-12, 2.0**-9, 2.0**-6, 2.0**-3, 1.0]
MOST_DARTS = 12  # of a cell; more have a probability under 1e-10
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _cell(c: int) -> tuple[float, float]:
    """(start, length) of rank cell c."""
    if c < len(LADDER) - 1:
        return LADDER[c], LADDER[c + 1] - LADDER[c]
    return float(c - len(LADDER) + 2), 1.0


def _counts(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion of uniform 64-bit values."""
    out, total, p = np.zeros(len(u), dtype=np.int64), 0.0, math.exp(-mean)
    live = np.arange(len(u))
    for n in range(MOST_DARTS):
        total += p
        live = live[u[live] >= U64(min(int(total * 2.0**64), 2**64 - 1))]
        if not len(live):
            break
        out[live] = n + 1
        p *= mean / (n + 1)
    return out


def signatures(elements: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(sets, k) of 64-bit values: equal values are the same dart; a set without elements has EMPTY everywhere.

    Set i holds elements[bounds[i] : bounds[i + 1]]; without weights each weighs 1, and repeats count once.
    """
    sets = len(bounds) - 1
    table = np.full(sets * k, EMPTY, dtype=U64)
    size = np.diff(bounds).astype(np.float64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    part = None
    if weights is not None:  # an element of weight w is cut into cells of weight 1, the last of which may be a part of one
        total = np.bincount(owner, weights=weights, minlength=sets)
        cells = np.ceil(weights).astype(np.int64)
        layer = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        elements = mix(np.repeat(elements, cells) + layer.astype(U64) * U64(0xD1B54A32D192ED03))
        owner, part, size = np.repeat(owner, cells), np.minimum(1.0, np.repeat(weights, cells) - layer), total
    want = k * math.log(k) + 2 * k
    reach = np.where(size > 0, want / np.maximum(size, 1e-300), 0.0)
    read = np.zeros(sets)  # the rank up to which a set has been read
    todo = size > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        _throw(table, elements[mine], owner[mine], None if part is None else part[mine], read, reach, k)
        read[todo] = reach[todo]
        todo &= (table.reshape(sets, k) == EMPTY).any(axis=1)
        reach = np.where(todo, reach * 2, reach)
    return table.reshape(sets, k)


def _throw(table: np.ndarray, elements: np.ndarray, owner: np.ndarray, part: np.ndarray | None, low: np.ndarray, high: np.ndarray, k: int) -> None:
    """Enters the darts with ranks from low to high of each element's set."""
    live, upto, c = np.arange(len(owner)), high[owner], 0
    again = bool(low[owner].any())
    while True:
        start, length = _cell(c)
        on = upto > start
        if not on.all():
            live, upto = live[on], upto[on]
        if not len(live):
            return
        here = live[low[owner[live]] < start + length] if again else live
        seed = mix(elements[here] + U64((c + 1) * 0x9E3779B97F4A7C15 % 2**64))
        many = _counts(seed, length)
        for d in range(int(many.max()) if len(many) else 0):
            on = np.flatnonzero(many > d)
            dart = mix(seed[on] + U64((d + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
            rank = (start + length * ((dart >> U64(32)).astype(np.float64) * 2.0**-32)).astype(np.float32)
            own = owner[here[on]]
            use = (rank >= low[own]) & (rank < high[own])
            second = mix(dart)
            if part is not None:
                use &= (second >> U64(40)).astype(np.float64) * 2.0**-24 < part[here[on]]
            use = np.flatnonzero(use)
            place = own[use] * k + ((second[use] & U64(0xFFFFFFFF)) * U64(k) >> U64(32)).astype(np.int64)
            np.minimum.at(table, place, rank[use].view(np.uint32).astype(U64) << U64(32) | dart[use] & U64(0xFFFFFFFF))
        c += 1
