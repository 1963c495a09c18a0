"""Sums of sparse signals and codes over many blocks of trials at once: NumPy code of sorted rows, without dense arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The time of a row that has none; it meets no other time.
NO_TIME = -(1 << 31)
#: Numbers that the widest intermediate table of a step may hold, about.
MOST = 2_000_000


@dataclass
class Taps:
    """A dictionary: values (K, L, P) of sorted atoms ``ks`` and channels, and where there is a value at all."""

    ks: np.ndarray
    channels: np.ndarray
    value: np.ndarray
    there: np.ndarray

    @property
    def length(self) -> int:
        return self.value.shape[1]

    def over(self, channels: np.ndarray) -> Taps:
        """The same over more channels, without values in the new ones."""
        if len(channels) == len(self.channels):
            return self
        at = np.searchsorted(channels, self.channels)
        value, there = (np.zeros((*a.shape[:2], len(channels)), dtype=a.dtype) for a in (self.value, self.there))
        value[:, :, at], there[:, :, at] = self.value, self.there
        return Taps(self.ks, channels, value, there)


@dataclass
class Table:
    """Rows (group, t) in order, with columns of values and whether there is a value."""

    g: np.ndarray
    t: np.ndarray
    value: np.ndarray
    there: np.ndarray

    def where(self, keep: np.ndarray) -> Table:
        return Table(self.g[keep], self.t[keep], self.value[keep], self.there[keep])

    def find(self, g: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each (g, t)."""
        if not len(self.g):
            return np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=bool)
        keys, wanted = _key(self.g, self.t), _key(g, t)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


def _key(g: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (g.astype(np.int64) << 33) + (t.astype(np.int64) + (1 << 31))


def summed(g: np.ndarray, t: np.ndarray, value: np.ndarray, there: np.ndarray) -> Table:
    """One row for each (g, t), columns summed where there is a value."""
    if not len(g):
        return Table(g, t, value, there)
    keys = _key(g, t)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    at = order[first]
    return Table(g[at], t[at], np.add.reduceat(value[order], first, axis=0), np.logical_or.reduceat(there[order], first, axis=0))


def guard(value: np.ndarray, taps: Taps, terms: int) -> None:
    """Integers that may not fit into 64 bits are an error, as they are in Spark."""
    if value.dtype.kind == "i" and value.size:
        top = float(np.abs(value.astype(float)).max()) * max(1.0, float(np.abs(taps.value.astype(float)).max(initial=0.0))) * max(1, terms)
        if top >= 2.0**63:
            raise OverflowError("sums of these integers may not fit into 64 bits; cast them to doubles")


def placed(g: np.ndarray, t: np.ndarray, k: np.ndarray, z: np.ndarray, taps: Taps) -> tuple[np.ndarray, ...]:
    """(g, t, value, there) rows of the atoms at their codes, not summed."""
    length, at = taps.length, np.searchsorted(taps.ks, k)
    at = np.minimum(at, len(taps.ks) - 1)
    known = taps.ks[at] == k
    g, t, at, z = g[known], t[known], at[known], z[known]
    times = np.where(t[:, None] == NO_TIME, NO_TIME, t[:, None] + np.arange(length)).ravel()
    there = taps.there[at].reshape(len(at) * length, len(taps.channels))
    value = np.where(taps.there[at], z[:, None, None] * taps.value[at], 0).reshape(there.shape)
    some = there.any(axis=1)
    return np.repeat(g, length)[some], times[some], value[some], there[some]


def signal_rows(t: np.ndarray, channel: np.ndarray, x: np.ndarray, channels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, there): each sample in its channel's column."""
    at = np.searchsorted(channels, channel)
    value, there = np.zeros((len(t), len(channels)), dtype=x.dtype), np.zeros((len(t), len(channels)), dtype=bool)
    value[np.arange(len(t)), at], there[np.arange(len(t)), at] = x, True
    return value, there


def correlated(r: Table, taps: Taps, valid: int) -> Table:
    """Columns are atoms: the correlations at 0 <= t < valid where an atom and the rows have a value in common."""
    gs, ts, values, there = [], [], [], []
    for lag in range(taps.length):
        s = r.t - lag
        inside = (r.t != NO_TIME) & (s >= 0) & (s < valid)
        both = r.there[inside][:, None, :] & taps.there[None, :, lag, :]
        gs.append(r.g[inside])
        ts.append(s[inside])
        values.append(np.where(both, r.value[inside][:, None, :] * taps.value[None, :, lag, :], 0).sum(axis=2))
        there.append(both.any(axis=2))
    found = summed(*(np.concatenate(c) for c in (gs, ts, values, there)))
    return found.where(found.there.any(axis=1))


def patches(r: Table, length: int, last: int) -> Table:
    """Sums over the patches that start at 0 <= t <= last."""
    s = (r.t[:, None] - np.arange(length)).ravel()
    keep = (np.repeat(r.t, length) != NO_TIME) & (s >= 0) & (s <= last)
    wide = (np.repeat(c, length, axis=0)[keep] for c in (r.value, r.there))
    return summed(np.repeat(r.g, length)[keep], s[keep], *wide)
