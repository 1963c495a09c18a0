"""Sums over shifts, by sorted blocks of trials.

A sample or a code is shuffled once, as the narrow row that it is, to the blocks of time that it reaches; each task sorts those rows and
widens a few thousand of them at a time. No wide row is hashed, sorted or shuffled, so the memory of a task grows with the rows that it
was dealt and not with atoms, lags and channels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import sparse as S
from ..kernels.sparse import Table, Taps

SIGNAL, CODE, WEIGHT = 0, 1, 2
#: Added to the kind of a row without a value.
NULL = 4
#: Columns that tell rows of results apart; all others are sums.
KEYS = ("k", "channel", "l", "t")
#: Times of a block.
BLOCK = 1024
INTEGERS, FLOATS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def value_type(d: DataFrame, *of: tuple[DataFrame | None, str]) -> str | None:
    """bigint or double, what sums of products of d and these columns are; None where rows or times are of types that blocks do not take."""
    kinds = [d.schema["d"].dataType.simpleString()]
    for df, column in of:
        if df is not None:
            if df.schema["t"].dataType.simpleString() not in INTEGERS[:3] or df.schema["trial"].dataType.simpleString() not in INTEGERS:
                return None
            kinds.append(df.schema[column].dataType.simpleString())
    if any(k not in INTEGERS + FLOATS for k in kinds):
        return None
    return "bigint" if all(k in INTEGERS for k in kinds) else "double"


@dataclass
class Part:
    """Rows of one kind: an index (channel, atom or nothing) and a value, and how far their effect reaches back and on."""

    kind: int
    rows: DataFrame
    index: str | None
    value: str
    back: int
    on: int


@dataclass
class Chunk:
    """Some whole (trial, block) groups: ``g`` numbers the group of each row."""

    b: np.ndarray
    g: np.ndarray
    kind: np.ndarray
    i: np.ndarray
    t: np.ndarray
    v: np.ndarray
    taps: Taps

    def of(self, kind: int) -> tuple[np.ndarray, ...]:
        at = self.kind == kind
        return self.g[at], self.t[at], self.i[at], self.v[at]

    def table(self, sign: int) -> Table:
        """Samples plus ``sign`` times the atoms at their codes, over ``taps.channels``; weighted where there are weights."""
        g, t, i, v = self.of(SIGNAL)
        rows = [(g, t, *S.signal_rows(t, i, v, self.taps.channels))]
        g, t, i, v = self.of(CODE)
        S.guard(v, self.taps, len(self.taps.ks) * self.taps.length * 1024)
        rows.append(S.placed(g, t, i, sign * v, self.taps))
        return S.summed(*(np.concatenate(c) for c in zip(*rows, strict=True)))

    def weights(self, r: Table) -> tuple[np.ndarray, np.ndarray]:
        """(weight, there) of the table's rows."""
        g, t, _, v = self.of(WEIGHT)
        g, t, v = g[t != S.NO_TIME], t[t != S.NO_TIME], v[t != S.NO_TIME]
        w = S.summed(g, t, v[:, None], np.ones((len(g), 1), dtype=bool))
        at, found = w.find(r.g, r.t)
        return (np.where(found, w.value[at, 0], 0) if len(w.g) else np.zeros(len(r.g), dtype=v.dtype)), found

    def own(self, r: Table, per: int = 1) -> Table:
        """Rows of the block itself, ``per`` groups of the table for each group."""
        return r.where(r.t // BLOCK == self.b[r.g // per])


#: What a chunk comes to: the groups of its rows or None where they stand for no trial, and columns by name with their nulls or None.
Found = tuple[np.ndarray | None, dict[str, tuple[np.ndarray, np.ndarray | None]]]


def _with_nulls(work: Callable[[Chunk], Found], c: Chunk) -> Found:
    """The work of a chunk as SQL adds up: rows without a value have sums too, which are null where no value is added."""
    null = c.kind >= NULL
    if not null.any():
        return work(c)
    has = ~null
    groups, columns = work(replace(c, kind=c.kind % NULL))
    known, parts = work(replace(c, g=c.g[has], kind=c.kind[has], i=c.i[has], t=c.t[has], v=c.v[has]))
    keys = [name for name in columns if name in KEYS]
    pairs = [] if groups is None else [(groups, known)]
    for name in keys:
        pairs.append((columns[name][0], parts[name][0]))
        if columns[name][1] is not None:
            pairs.append((columns[name][1], parts[name][1]))
    n = len(pairs[0][0])
    at = np.zeros(n + len(pairs[0][1]), dtype=np.int64)
    for pair in pairs:
        found, place = np.unique(np.concatenate(pair), return_inverse=True)
        at = at * max(1, len(found)) + place
    for name in columns.keys() - set(keys):
        mask = parts[name][1]
        some = at[n:] if mask is None else at[n:][~mask]
        columns[name] = columns[name][0], ~np.isin(at[:n], some)
    return groups, columns


def by_blocks(parts: list[Part], taps: Taps, kind: str, work: Callable[[Chunk], Found], schema: str, widens: int) -> DataFrame:
    """The rows of ``work`` over all chunks; one input row may widen to ``widens`` numbers."""
    rows = None
    for p in parts:
        known = p.rows if p.index is None else p.rows.where(F.col(p.index).isNotNull())
        at = F.coalesce(F.col("t").cast("long"), F.lit(S.NO_TIME))
        edges = [F.floor((at + by) / BLOCK) for by in (-p.back, p.on)]
        block = F.explode(F.sequence(*edges)) if p.back or p.on else edges[0]
        index = F.lit(0) if p.index is None else F.col(p.index).cast("int")
        value = F.col(p.value).cast(kind)
        of = F.when(value.isNull(), p.kind + NULL).otherwise(p.kind)
        one = known.select("trial", block.alias("b"), of.alias("kind"), index.alias("i"), at.alias("t"), F.coalesce(value, F.lit(0).cast(kind)).alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    dealt = rows.repartition("trial", "b").sortWithinPartitions("trial", "b")
    trial = dealt.schema["trial"].dataType.simpleString()
    fields = schema.replace("TRIAL", trial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "smallint": pa.int16(), "tinyint": pa.int8()}
        names, kinds = zip(*((n, types[k]) for n, k in (f.split() for f in fields.split(", "))), strict=True)

        def chunks(c: dict[str, np.ndarray], first: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends, channels = np.append(first[1:], len(c["t"])), taps.channels
            seen = np.unique(c["i"][c["kind"] % NULL == SIGNAL])
            if not np.isin(seen, channels).all():
                channels = np.union1d(seen, channels)
            most, a = max(1, S.MOST // (widens * max(1, len(channels) // max(1, len(taps.channels))))), 0
            while a < len(first):
                z = max(a + 1, int(np.searchsorted(ends, first[a] + most, side="right")))
                lo, hi = first[a], ends[z - 1]
                g = np.repeat(np.arange(z - a), ends[a:z] - first[a:z])
                groups, columns = _with_nulls(work, Chunk(c["b"][first[a:z]], g, *(c[n][lo:hi] for n in ("kind", "i", "t", "v")), taps.over(channels)))
                if groups is not None:
                    columns = columns | {"trial": (c["trial"][first[a:z]][groups], c["none"][first[a:z]][groups])}
                a = z
                out = [pa.array(columns[n][0], type=k, mask=columns[n][1]) if columns[n][0].dtype.kind != "i" else pa.array(columns[n][0].astype(k.to_pandas_dtype()), type=k, mask=columns[n][1]) for n, k in zip(names, kinds, strict=True)]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays(out, names=list(names))

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            trials = batch.column("trial")
            now = {"trial": trials.fill_null(0).to_numpy(zero_copy_only=False), "none": trials.is_null().to_numpy(zero_copy_only=False)}
            now |= {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("b", "kind", "i", "t", "v")}
            held = now if held is None else {n: np.concatenate([held[n], now[n]]) for n in now}
            if not len(held["t"]):
                continue
            first = _starts(held)
            if len(first) > 1:  # the last group may go on in the next batch
                yield from chunks({n: v[: first[-1]] for n, v in held.items()}, first[:-1])
                held = {n: v[first[-1] :] for n, v in held.items()}
        if held is not None and len(held["t"]):
            yield from chunks(held, _starts(held))

    return dealt.mapInArrow(run, fields)


def _starts(c: dict[str, np.ndarray]) -> np.ndarray:
    new = np.ones(len(c["t"]), dtype=bool)
    new[1:] = (c["trial"][1:] != c["trial"][:-1]) | (c["none"][1:] != c["none"][:-1]) | (c["b"][1:] != c["b"][:-1])
    return np.flatnonzero(new)


def _time(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(t == S.NO_TIME, 0, t), t == S.NO_TIME


def _long(r: Table, channels: np.ndarray, name: str, per: int = 1) -> Found:
    row, c = np.nonzero(r.there)
    return r.g[row] // per, {"channel": (channels[c], None), "t": _time(r.t[row]), name: (r.value[row, c], None)}


def signal_part(x: DataFrame, back: int = 0) -> Part:
    return Part(SIGNAL, x, "channel", "x", back, 0)


def code_part(z: DataFrame, length: int, back: int = 0) -> Part:
    return Part(CODE, z, "k", "z", back, length - 1)


def _parts(x: DataFrame | None, z: DataFrame | None, w: DataFrame | None, taps: Taps, back: int = 0) -> list[Part]:
    """All rows that a block of results needs if those look ``back`` times ahead."""
    parts = [] if x is None else [signal_part(x, back)]
    if z is not None:
        parts.append(code_part(z, taps.length, back))
    return parts + ([] if w is None else [Part(WEIGHT, w, None, "w", back, 0)])


def _wide(taps: Taps) -> int:
    return taps.length * max(len(taps.channels), 1)


def _wider(taps: Taps) -> int:
    return taps.length * max(len(taps.channels) * max(len(taps.ks), 1), taps.length * max(len(taps.ks), 1))


def reconstructed(z: DataFrame, taps: Taps, kind: str) -> DataFrame:
    """(trial, channel, t, x)."""
    work = lambda c: _long(c.own(c.table(1)), c.taps.channels, "x")
    return by_blocks(_parts(None, z, None, taps), taps, kind, work, f"trial TRIAL, channel int, t int, x {kind}", _wide(taps))


def _by_atom(c: Chunk) -> Table:
    """The parts of atoms; groups of the table are (group, atom)."""
    g, t, k, z = c.of(CODE)
    at = np.minimum(np.searchsorted(c.taps.ks, k), len(c.taps.ks) - 1)
    S.guard(z, c.taps, c.taps.length * 1024)
    return c.own(S.summed(*S.placed(g * len(c.taps.ks) + at, t, k, z, c.taps)), len(c.taps.ks))


def reconstructed_atoms(z: DataFrame, taps: Taps, kind: str) -> DataFrame:
    """(k, trial, channel, t, x)."""
    n = len(taps.ks)

    def work(c: Chunk) -> Found:
        r = _by_atom(c)
        groups, columns = _long(r, c.taps.channels, "x", n)
        return groups, columns | {"k": (c.taps.ks[r.g[np.nonzero(r.there)[0]] % n], None)}

    return by_blocks(_parts(None, z, None, taps), taps, kind, work, f"k int, trial TRIAL, channel int, t int, x {kind}", _wide(taps))


def atom_moments(z: DataFrame, taps: Taps, kind: str) -> DataFrame:
    """(k, s, q) rows to be added up: sums of each atom's part and of its squares."""
    n = len(taps.ks)

    def work(c: Chunk) -> Found:
        r = _by_atom(c)
        _check(r, len(r.g) * len(c.taps.channels))
        k, x = r.g % n, r.value.sum(axis=1)
        s, q = (np.zeros(n, dtype=r.value.dtype) for _ in range(2))
        np.add.at(s, k, x)
        np.add.at(q, k, (r.value * r.value).sum(axis=1))
        some = np.unique(k)
        return None, {"k": (c.taps.ks[some], None), "s": (s[some], None), "q": (q[some], None)}

    return by_blocks(_parts(None, z, None, taps), taps, kind, work, f"k int, s {kind}, q {kind}", _wide(taps))


def _check(r: Table, terms: int) -> None:
    """Squares of integers that may not fit into 64 bits when so many are added are an error."""
    if r.value.dtype.kind == "i" and r.value.size and float(np.abs(r.value.astype(float)).max()) ** 2 * max(1, terms) >= 2.0**63:
        raise OverflowError("sums of squares of these integers may not fit into 64 bits; cast them to doubles")


def residuals(x: DataFrame, z: DataFrame, taps: Taps, kind: str) -> DataFrame:
    """(trial, channel, t, r)."""
    work = lambda c: _long(c.own(c.table(-1)), c.taps.channels, "r")
    return by_blocks(_parts(x, z, None, taps), taps, kind, work, f"trial TRIAL, channel int, t int, r {kind}", _wide(taps))


def _energies(c: Chunk) -> Table:
    r = c.table(-1)
    _check(r, len(c.taps.channels))
    return Table(r.g, r.t, (r.value * r.value).sum(axis=1, keepdims=True), np.ones((len(r.g), 1), dtype=bool))


def energies(x: DataFrame, z: DataFrame, taps: Taps, kind: str, w: DataFrame | None = None) -> DataFrame:
    """(trial, t, e): squared residuals over all channels, times the weights where there are some."""
    weighted = w is not None

    def work(c: Chunk) -> Found:
        e = c.own(_energies(c))
        if weighted:
            by, found = c.weights(e)
            e.value = e.value * by[:, None]
            e = e.where(found)
        return e.g, {"t": _time(e.t), "e": (e.value[:, 0], None)}

    return by_blocks(_parts(x, z, w, taps), taps, kind, work, f"trial TRIAL, t int, e {kind}", _wide(taps))


def patch_energies(x: DataFrame, z: DataFrame, taps: Taps, kind: str, length: int, last: int) -> DataFrame:
    """(trial, t, e): squared residuals over the patches that start at t, from the signal."""

    def work(c: Chunk) -> Found:
        e = c.own(S.patches(_energies(c), length, last))
        return e.g, {"t": (e.t, None), "e": (e.value[:, 0], None)}

    return by_blocks(_parts(x, z, None, taps, length - 1), taps, kind, work, f"trial TRIAL, t int, e {kind}", taps.length * max(length, len(taps.channels)))


def spread_energies(e: DataFrame, kind: str, length: int, last: int) -> DataFrame:
    """The same from (trial, t, e)."""
    none = Taps(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros((0, 1, 1)), np.zeros((0, 1, 1), dtype=bool))

    def work(c: Chunk) -> Found:
        g, t, _, v = c.of(WEIGHT)
        found = c.own(S.patches(Table(g, t, v[:, None], np.ones((len(g), 1), dtype=bool)), length, last))
        return found.g, {"t": (found.t, None), "e": (found.value[:, 0], None)}

    return by_blocks([Part(WEIGHT, e, None, "e", length - 1, 0)], none, kind, work, f"trial TRIAL, t int, e {kind}", length)


def correlations(x: DataFrame, z: DataFrame | None, taps: Taps, kind: str, valid: int, w: DataFrame | None = None, codes: bool = False) -> DataFrame:
    """(trial, k, t, c): atoms against the signal, or what the codes leave of it; ``codes`` adds a column z, and rows where there is a code alone."""
    weighted = w is not None

    def work(c: Chunk) -> Found:
        r = c.table(-1)
        if weighted:
            by, found = c.weights(r)
            r.value = r.value * by[:, None]
            r = r.where(found)
        S.guard(r.value, c.taps, c.taps.length * len(c.taps.channels))
        found = c.own(S.correlated(r, c.taps, valid))
        if not codes:
            row, k = np.nonzero(found.there)
            return found.g[row], {"k": (c.taps.ks[k], None), "t": (found.t[row], None), "c": (found.value[row, k], None)}
        g, t, k, v = c.of(CODE)
        ks = np.union1d(c.taps.ks, k)
        value, there = (np.zeros((len(found.g), 2 * len(ks)), dtype=a.dtype) for a in (found.value, found.there))
        value[:, np.searchsorted(ks, c.taps.ks)], there[:, np.searchsorted(ks, c.taps.ks)] = found.value, found.there
        held = np.zeros((len(g), 2 * len(ks)), dtype=v.dtype), np.zeros((len(g), 2 * len(ks)), dtype=bool)
        for column, of in zip(held, (v, True), strict=True):
            column[np.arange(len(g)), len(ks) + np.searchsorted(ks, k)] = of
        mine = c.own(Table(g, t, *held))
        both = S.summed(*(np.concatenate(pair) for pair in ((found.g, mine.g), (found.t, mine.t), (value, mine.value), (there, mine.there))))
        there = both.there[:, : len(ks)], both.there[:, len(ks) :]
        row, at = np.nonzero(there[0] | there[1])
        columns = {"c": (both.value[row, at], ~there[0][row, at]), "z": (both.value[row, len(ks) + at], ~there[1][row, at])}
        return both.g[row], {"k": (ks[at], None), "t": _time(both.t[row]), **columns}

    schema = f"trial TRIAL, k int, t int, c {kind}" + (f", z {kind}" if codes else "")
    return by_blocks(_parts(x, z, w, taps, taps.length - 1), taps, kind, work, schema, _wider(taps))


def code_products(x: DataFrame, z: DataFrame, taps: Taps, kind: str, length: int) -> DataFrame:
    """(k, channel, l, v) rows to be added up: codes times what they leave of the signal l later."""

    def work(c: Chunk) -> Found:
        r = c.table(-1)
        g, t, k, v = c.of(CODE)
        mine = (t // BLOCK == c.b[g]) & (t != S.NO_TIME)
        g, t, k, v = g[mine], t[mine], k[mine], v[mine]
        ks, at = np.unique(k, return_inverse=True)
        total = np.zeros((len(ks), length, len(c.taps.channels)), dtype=r.value.dtype)
        there = np.zeros(total.shape, dtype=bool)
        if r.value.dtype.kind == "i" and len(v) and float(np.abs(v.astype(float)).max()) * float(np.abs(r.value.astype(float)).max(initial=0.0)) * len(v) >= 2.0**63:
            raise OverflowError("sums of these integers may not fit into 64 bits; cast them to doubles")
        for lag in range(length):
            place, found = r.find(g, t + lag)
            some = r.there[place[found]]
            np.add.at(total[:, lag], at[found], np.where(some, v[found][:, None] * r.value[place[found]], 0))
            np.logical_or.at(there[:, lag], at[found], some)
        i, lag, p = np.nonzero(there)
        return None, {"k": (ks[i], None), "channel": (c.taps.channels[p], None), "l": (lag, None), "v": (total[i, lag, p], None)}

    return by_blocks(_parts(x, z, None, taps, length - 1), taps, kind, work, f"k int, channel int, l int, v {kind}", _wider(taps))


def score_sums(x: DataFrame, z: DataFrame, taps: Taps, kind: str) -> DataFrame:
    """(trial, xh, xx, hh) rows to be added up: products of the signal and its reconstruction."""

    def work(c: Chunk) -> Found:
        n = len(c.taps.channels)
        g, t, i, v = c.of(SIGNAL)
        x = S.summed(g, t, *S.signal_rows(t, i, v, c.taps.channels))
        g, t, i, v = c.of(CODE)
        S.guard(v, c.taps, len(c.taps.ks) * c.taps.length * 1024)
        h = S.summed(*S.placed(g, t, i, v, c.taps))
        _check(x, n * BLOCK), _check(h, n * BLOCK)
        x, h = c.own(x), c.own(h)
        at, found = h.find(x.g, x.t)
        xh = np.zeros((3, len(c.b)), dtype=x.value.dtype)
        np.add.at(xh[0], x.g[found], (x.value[found] * h.value[at[found]]).sum(axis=1))
        np.add.at(xh[1], x.g, (x.value * x.value).sum(axis=1))
        np.add.at(xh[2], h.g, (h.value * h.value).sum(axis=1))
        some = np.union1d(x.g, h.g)
        return some, {name: (xh[j, some], None) for j, name in enumerate(("xh", "xx", "hh"))}

    return by_blocks(_parts(x, z, None, taps), taps, kind, work, f"trial TRIAL, xh {kind}, xx {kind}, hh {kind}", _wide(taps))
