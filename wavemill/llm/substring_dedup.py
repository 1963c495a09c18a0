"""Removal of long word passages that a document with a smaller id has too, by difference-cover anchors.

A window is WINDOW consecutive words of one document. Every word in a window whose words also stand, in this order, in a document with
a smaller id is removed; windows are judged on the input.

1. Documents of the same word sequence: all but the one with the smallest id are removed whole and leave the search.
2. Anchors: ANCHOR words are hashed only where the position modulo PERIOD lies in the cover. Any two positions have a common shift
   below PERIOD that brings both into the cover, so two equal windows share an aligned anchor, as ANCHOR + PERIOD - 1 = WINDOW.
3. Anchors that only one document has (most of them) end here. The others extend: the hashes of the windows around them, and
   only these, are gathered, and a window is a repeat when the smallest id that has it is smaller than its own.

Everything that meets by a key is a narrow row, first summed up in the map tasks, then joined back by a key that Spark may split when it
is hot. The texts are shuffled once, by a hash of id and text, and that exchange serves all steps of one plan; nothing is written or
broadcast, and every join may spill. Window hashes have 88 bits.

Null and empty texts have no words. A null id is neither smaller nor larger than another, so its text stays whole. Rows that repeat an
id with the same text do not remove each other and share one result; several texts under one id are documents of their own, none of
which is smaller than another. A very long text is one slice of a task. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import slack

WINDOW = 50
#: A perfect difference set; every number modulo 31 is a difference of two of them.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Joins back to a sum use the key with these bits flipped, so both sides are dealt anew and a hot key can be split.
FLIP = 0x5DEECE66D


def _sliced(column: pa.Array, hasher: W.Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, bounds) of slices."""
    for i, n, part, cuts in W.parts(column):
        s, e, bounds = W.words(part, cuts, ~W.SPACE[part])
        yield i, n, hasher.spans(part, s, e), bounds


def _anchors(values: np.ndarray, bounds: np.ndarray, hasher: W.Hasher, anchor: int, window: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, row, 48-bit hash) at the cover positions of rows that hold a window; anchors only choose what is looked at."""
    at, rows = W.window_starts(bounds, anchor)
    use = cover[(at - bounds[rows]) % len(cover)] & (np.diff(bounds) >= window)[rows]
    at, rows = at[use], rows[use]
    return at, rows, hasher.windows(values, at, anchor) >> W.U64(16) if len(at) else np.zeros(0, W.U64)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(W.U64).view(np.int64))


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _spans(gone: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The runs of removed words of each row, as (start, length) within the row."""
    first = np.zeros(len(gone) + 1, dtype=bool)
    first[bounds] = True
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1] | first[1:-1]
    ends[:-1] &= ~gone[1:] | first[1:-1]
    at, upto = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(bounds, at, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array((at - bounds[row]).astype(np.int32)), pa.array((upto - at).astype(np.int32))], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), spans)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, removed (spans of words), text (the kept words, one space between)."""
    slack(docs, [id_col, text_col], "substring_dedup")
    anchor = window - period + 1
    if anchor < 1:
        raise ValueError("the period must not exceed the window")
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover does not make every difference")
    covered = np.zeros(period, dtype=bool)
    covered[[c % period for c in cover]] = True

    every = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = every.where("id IS NOT NULL").select(F.xxhash64("id", "text").alias("row"), "id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = W.Hasher(5), W.Hasher(7)
        for batch in batches:
            for i, n, values, bounds in _sliced(batch.column(2), hasher):
                size = np.diff(bounds)
                keys = []
                for h in (hasher, second):
                    p = h._prefix(values)
                    keys.append(W.mix((p[bounds[1:]] - p[bounds[:-1]]) * h.down[bounds[:-1]] + size.astype(W.U64)))
                some = pa.array(np.flatnonzero(size >= window))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n).take(some) for c in (0, 1)), *(_longs(k).take(some) for k in keys)], names=["row", "id", "k1", "k2"])

    whole = rows.mapInArrow(sequence, f"row long, id {kind}, k1 long, k2 long")
    least = whole.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    least = least.select((F.col("k1").bitwiseXOR(F.lit(FLIP))).alias("k"), F.col("k2").alias("k2_"), "first")
    copies = whole.withColumn("k", F.col("k1").bitwiseXOR(F.lit(FLIP))).join(least, "k").where("k2 = k2_ AND id > first").groupBy("row").agg(F.first("first").alias("copy_of"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher(5)
        for batch in batches:
            for i, _, values, bounds in _sliced(batch.column(2), hasher):
                _, own, found = _anchors(values, bounds, hasher, anchor, window, covered)
                order = np.lexsort((found, own))
                own, found = own[order], found[order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + own[new])), _longs(found[new])], names=["row", "h"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = W.Hasher(5), W.Hasher(7)
        for batch in batches:
            lists = batch.column(3)
            offsets, shared = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).view(W.U64)
            for i, n, values, bounds in _sliced(batch.column(2), hasher):
                at, own, found = _anchors(values, bounds, hasher, anchor, window, covered)
                flag = np.zeros(len(values) + 1, dtype=np.int64)
                cut = np.searchsorted(own, np.arange(n + 1))
                for r in range(n):
                    mine = slice(cut[r], cut[r + 1])
                    flag[at[mine][np.isin(found[mine], shared[offsets[i + r] : offsets[i + r + 1]])]] = 1
                total = np.concatenate([[0], np.cumsum(flag)])
                start, own = W.window_starts(bounds, window)
                near = total[start + period] > total[start]  # an anchor within the window is shared
                start, own = start[near], own[near]
                if not len(start):
                    continue
                of = pa.array(i + own)
                extra = (second.windows(values, start, window) >> W.U64(40)).astype(np.int32)
                columns = [batch.column(0).take(of), batch.column(1).take(of), _longs(hasher.windows(values, start, window)), pa.array(extra), pa.array((start - bounds[own]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "h", "x", "at"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, lists = batch.column(2).is_valid().to_numpy(zero_copy_only=False), batch.column(3)
            offsets, marks = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            for i, n, part, cuts in W.parts(batch.column(1)):
                s, e, bounds = W.words(part, cuts, ~W.SPACE[part])
                size = np.diff(bounds)
                of = np.repeat(np.arange(n), np.diff(offsets[i : i + n + 1]))
                at = bounds[of] + marks[offsets[i] : offsets[i + n]]
                change = np.zeros(len(s) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = (np.cumsum(change[:-1]) > 0) | np.repeat(copy[i : i + n], size)
                texts = W.joined(part, s[~gone], e[~gone], np.concatenate([[0], np.cumsum(~gone)])[bounds])
                columns = [batch.column(0).slice(i, n), pa.array(size, pa.int64()), pa.array(_per_row(gone, bounds), pa.int64()), _spans(gone, bounds), texts]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_removed", "removed", "text"])

    # All three joins read the same columns of the same rows by the same key, so Spark shuffles the texts once.
    alone = rows.join(copies, "row", "left")
    found = alone.where("copy_of IS NULL").select("row", "id", "text").mapInArrow(anchors, "row long, h long")
    flipped = F.col("h").bitwiseXOR(F.lit(FLIP)).alias("k")
    # A document sends an anchor once, so a count tells whether another has it (or a repeated row, which costs time only).
    shared = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(flipped)
    back = F.col("k").bitwiseXOR(F.lit(FLIP)).alias("h")
    mine = found.select("row", flipped).join(shared, "k").select("row", back).groupBy("row").agg(F.collect_list("h").alias("shared"))
    near = rows.join(mine, "row", "left").where("shared IS NOT NULL").select("row", "id", "text", "shared")
    seen = near.mapInArrow(windows, f"row long, id {kind}, h long, x int, at int")
    first = seen.groupBy("h", "x").agg(F.min("id").alias("lo"), F.count("*").alias("n")).where("n > 1").select(flipped, F.col("x").alias("x_"), "lo")
    repeats = seen.select("row", "id", "at", "x", flipped).join(first, "k").where("x = x_ AND id > lo").groupBy("row").agg(F.collect_list("at").alias("marks"))
    marked = rows.join(copies, "row", "left").join(repeats, "row", "left").select("id", "text", "copy_of", "marks")
    marked = marked.unionByName(every.where("id IS NULL"), allowMissingColumns=True)
    marked = marked.select("id", "text", "copy_of", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"))
    out = f"`{id_col}` {kind}, n_words long, n_removed long, removed array<struct<start:int,length:int>>, text string"
    return marked.mapInArrow(cleaned, out)
