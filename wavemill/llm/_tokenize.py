"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once.

A text is cut only where the tokenizer's own splitting ends a pre-token, so the ids of the pieces, put together, are the ids of the
text. Cutting, looking up and putting together are NumPy over a slice of texts; the library sees a piece when it is new. Pieces of up
to 16 bytes, nearly all, are held as two numbers each in arrays, since a worker meets ever new ones. Texts with the string of a special token, with control characters or with white space beyond ASCII go to the library whole.
Ids are little-endian unsigned 32-bit integers throughout.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from . import _words as W

#: Pieces held at most, and bytes of pieces longer than SHORT; a full table is emptied, which costs time and changes no result.
CACHE, SHORT = 1_000_000, 16
_TOGETHER = 200
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
#: Byte classes of ASCII; what continues a longer UTF-8 sequence counts as a letter.
_CLASS = np.full(256, _OTHER, dtype=np.int8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _WHITE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
#: Lead bytes of blocks that hold letters only, but for two signs and a letter whose lower case is more than a letter,
#: which are looked for apart; a word with any other, or with an apostrophe, stays whole.
_ODD = np.zeros(256, dtype=bool)
_ODD[0xC0:] = True
_ODD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = False
_ODD[0x27] = True
#: White space beyond ASCII, and control characters.
_STRANGE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


class Encoder:
    """Encodes texts with a tokenizer file, as the library does by default but for add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would also keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = self.tokenizer.normalizer is None
        special = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.strange = "|".join([_STRANGE, *map(re.escape, sorted(special))])
        (self.digit,) = self.tokenizer.encode("1", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.bytes = 0  # of those
        self.held = 0
        self.flat, self.upto = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64)  # ids, and where those of each piece end
        self.low, self.high = np.zeros(1 << 14, dtype=W.U64), np.zeros(1 << 14, dtype=W.U64)  # bytes of each shorter piece
        self.keys, self.at = np.zeros(0, dtype=W.U64), np.zeros(0, dtype=np.int32)  # their hashes in order, and their numbers

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of a slice of texts."""
        n = len(data)
        kind = _CLASS[data]
        white = kind == _WHITE
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        change = np.ones(n, dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) | first[1:n]
        begins = change & (white | np.concatenate([[True], white[:-1]]) | first[:n])  # of words between white space, and of white space
        odd = _ODD[data]
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        if odd.any():
            word = np.cumsum(begins) - 1
            whole = np.zeros(int(word[-1]) + 1, dtype=bool)
            whole[word[odd]] = True
            change &= ~whole[word] | begins
        if not self.keeps_space:
            starts = np.flatnonzero(change & ~white)
            ends = np.append(np.flatnonzero(change), n)
            return starts, ends[np.searchsorted(ends, starts, side="right")]
        # The last of some white space before a word is a piece of its own, with the word if it is a space.
        last = np.zeros(n, dtype=bool)
        last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
        change |= last
        change[1:] &= ~(last[:-1] & (data[:-1] == 0x20))
        starts = np.flatnonzero(change)
        return starts, np.append(starts[1:], n)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, new: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces; runs of letters or signs go to the library many in one string, set apart by a digit, an id of its own."""
        texts = [p.decode() for p in new]
        plain = [i for i, t in enumerate(texts) if (b := t[1:] if t[0] == " " and len(t) > 1 else t).isalpha() or b.isascii() and not any(c.isalnum() or c in "' \n\t\r" for c in b)]
        out: list = [None] * len(new)
        for i in range(0, len(plain), _TOGETHER):
            some = plain[i : i + _TOGETHER]
            ids = np.array(self._library(["1".join([texts[j] for j in some])])[0], dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.digit)
            if len(cuts) != len(some) - 1:
                raise RuntimeError("a piece was joined to its neighbour")
            for j, part in zip(some, np.split(ids, cuts), strict=True):
                out[j] = part[1:] if j != some[0] else part
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = np.array(ids, dtype=np.uint32)
        return out

    def _store(self, new: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, whose ids are put behind those of all others."""
        found = self._encoded(new)
        at, size = self.held, np.array([len(x) for x in found], dtype=np.int64)
        used, total = int(self.upto[at - 1]) if at else 0, int(size.sum())
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(new) > len(self.upto):
            self.upto, self.low, self.high = (np.concatenate([x, np.zeros_like(x)]) for x in (self.upto, self.low, self.high))
        self.flat[used : used + total] = np.concatenate(found)
        self.upto[at : at + len(new)] = used + np.cumsum(size)
        self.held += len(new)
        return np.arange(at, at + len(new))

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each of some pieces."""
        short = ends - starts <= SHORT
        numbers = np.full(len(starts), -1, dtype=np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            at = self.at[place]
            known = short & (self.keys[place] == key) & (self.low[at] == low) & (self.high[at] == high)
            numbers[known] = at[known]
        for i in np.flatnonzero(~short).tolist():
            numbers[i] = self.long.get(raw[starts[i] : ends[i]], -1)
        absent = np.flatnonzero(numbers < 0)
        if len(absent):
            pieces = [raw[a:b] for a, b in zip(starts[absent].tolist(), ends[absent].tolist(), strict=True)]
            new: dict[bytes, int] = {}
            for p, i in zip(pieces, absent.tolist(), strict=True):
                new.setdefault(p, i)
            at, where = self._store(list(new)), np.array(list(new.values()))
            self.low[at], self.high[at] = low[where], high[where]
            numbers[where] = at
            numbers[absent] = numbers[[new[p] for p in pieces]]
            mine = short[where]
            order = np.argsort(key[where[mine]], kind="stable")
            keys = key[where[mine]][order]
            place = np.searchsorted(self.keys, keys)
            self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, at[mine][order])
            for i in where[~mine].tolist():
                self.long[raw[starts[i] : ends[i]]] = int(numbers[i])
                self.bytes += int(ends[i] - starts[i])
        return numbers

    def _ordinary(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts without anything strange."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = self._pieces(data, offsets)
        size = ends - starts
        raw = data.tobytes() + bytes(16)
        eight = np.ndarray(len(data) + 8, dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each byte on
        low = eight[starts] & _MASK[np.minimum(size, 8)]
        high = eight[np.minimum(starts + 8, len(data))] & _MASK[np.clip(size - 8, 0, 8)]
        key = W.mix(low ^ W.mix(high + size.astype(W.U64)))
        long = np.flatnonzero(size > SHORT)
        key[long] = long.astype(W.U64)  # each on its own
        which, _ = pd.factorize(key)
        first = np.full(int(which.max()) + 1 if len(which) else 0, -1, dtype=np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        same = (low == low[first][which]) & (high == high[first][which]) & (size == size[first][which])
        if not same.all():  # two pieces with one key: look each up by itself
            first, which = np.arange(len(starts)), np.arange(len(starts))
        if self.held + len(first) > CACHE or self.bytes > CACHE:
            self._clear()
        numbers = self._numbers(raw, starts[first], ends[first], key[first], low[first], high[first])[which]
        begin = np.where(numbers > 0, self.upto[numbers - 1], 0)
        many = self.upto[numbers] - begin
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self.flat[np.repeat(begin - upto[:-1], many) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, ids, bounds) of slices of a text column; null is empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        for i, j in W.slices(W.buffers(column)[1]):
            part = column.slice(i, j - i)
            strange = pc.match_substring_regex(part, self.strange)
            if not pc.any(strange).as_py():
                yield i, j - i, *self._ordinary(*W.buffers(part))
                continue
            strange = strange.to_numpy(zero_copy_only=False)
            ids, bounds = self._ordinary(*W.buffers(part.filter(pa.array(~strange))))
            whole = iter(self._library(part.filter(pa.array(strange)).to_pylist()))
            ordinary = iter(np.split(ids, bounds[1:-1]))
            rows = [np.array(next(whole), dtype=np.uint32) if s else next(ordinary) for s in strange.tolist()]
            yield i, j - i, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; a Python worker keeps it from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
