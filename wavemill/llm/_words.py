"""Vectorised word splitting and hashing over Arrow string buffers.

Everything here works on a slice of an Arrow column at once: bytes in, NumPy arrays out, no Python loop over words.
A word hash is the polynomial ``sum T[byte] * M**i`` modulo 2**64 (``T`` random, ``M`` odd), taken from prefix sums and
finished by a bijective mixer; hashes of word windows are built the same way from word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; bounds the temporary arrays (about 40 bytes for each byte of text).
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values for a seed, alike in every process."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(seeded(seed, 1)[0]) & ~7 | 5
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hasher:
    """Hashes of byte spans and of windows of values; the power tables grow with the longest slice seen."""

    def __init__(self, seed: int) -> None:
        self.seed, self.table = seed, seeded(seed, 256)
        self.up = self.down = np.ones(0, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(self.seed + 1, max(n + n // 4, 1 << 16))

    def _prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = self._prefix(self.table[data])
        return mix((p[ends] - p[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def windows(self, values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of values[i : i + width] for each i of at."""
        p = self._prefix(values)
        return mix((p[at + width] - p[at]) * self.down[at])


#: Fixed byte classes: ASCII white space as in ``bytes.split``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes for scoring: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def parts(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of a text column; only one slice is lower-cased at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for i, j in slices(buffers(column)[1], most):
        part = column.slice(i, j - i)
        yield i, j - i, *buffers(pc.utf8_lower(part) if lower else part)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of the words, and the first word of each row (one more at the end).

    ``inside`` holds, for each byte of data, whether it belongs to a word; rows end words too.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def window_starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, row) of every window of ``width`` words that lies in one row."""
    n = np.maximum(np.diff(bounds) - width + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    return np.arange(n.sum()) - begin[rows] + bounds[:-1][rows], rows


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One text for each row: its spans starts[i], ends[i] for i from bounds[r] to bounds[r + 1], with one space between."""
    size = ends - starts + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.append(data, np.uint8(0x20))[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
    out[upto[1:] - 1] = 0x20
    some = np.diff(bounds) > 0
    keep = np.ones(len(out), dtype=bool)
    keep[upto[bounds[1:][some]] - 1] = False  # no space behind the last
    offsets = upto[bounds] - np.concatenate([[0], np.cumsum(some)])
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())).cast(pa.string())
