"""Product codes of vectors: integer Lloyd rounds with Hamerly's bounds, on Spark.

A vector's components become integers floor(4096 x) and are cut into PARTS equal consecutive parts; each part position has a codebook
of up to ENTRIES integer vectors, which begins as that part of the vectors with the smallest ids. A round assigns every part to the nearest entry (squared
Euclidean distance, ties to the lower index) and moves each entry to the componentwise floor of its parts' mean; unused entries stay.
After the last round parts are assigned again, and the code is one byte for each part.

Each vector keeps, from round to round, the entry of each part with two bounds: one above the distance to that entry and one below the distance
to every other. When the entries have moved, the upper bound grows by its entry's move and the lower shrinks by the largest move of another.
A part whose upper bound is strictly below its lower bound, or strictly below half the distance from its entry to the next one, has no
nearer and no equally near entry and keeps its own without any distance; else the upper bound is made exact, and only where it fails again all
entries are measured, in integers. Bounds are rounded outwards, so the codes are those of plain Lloyd, ties included.

The state is a table of one row for each vector, written anew by each round's one narrow pass; each task adds one row with its sums to it,
which are summed up on the executors. The driver holds codebooks, which are as large as ENTRIES vectors.

Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those that have not as many
components as the vector of the smallest id. That number must be a multiple of PARTS, else an error says so. Components beyond
the largest integer for which a sum of squares fits in 64 bits (32768.0 for 64 components) count as that. Null ids come last in the order
of ids; repeated ids are rows of their own, in the order of their integers' bytes. With fewer than ENTRIES rows codebooks are as short.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from ._shared import column, dealt_join, discard, slack, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors whose distances are held at once.
ROWS = 2048


def largest(width: int) -> int:
    """The largest component in size, so that the squared distance of two vectors of this width fits in 63 bits."""
    return (1 << (63 - (width - 1).bit_length()) // 2 - 1) - 1


def quantised(lists: pa.ListArray) -> tuple[np.ndarray, list[bytes]]:
    """(places of the kept rows, their integer components as bytes) of a column of vectors."""
    n = len(lists)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = np.diff(bounds)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[bounds[1:]] == bad[bounds[:-1]]) & (width > 0)
    if lists.null_count:
        good &= ~np.asarray(lists.is_null())
    keep = np.flatnonzero(good)
    out = []
    for i in keep:
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * values[bounds[i] : bounds[i + 1]])
        most = largest(len(x))
        out.append(np.clip(x, -most, most).astype("<i4").tobytes())
    return keep, out


def _flat(binaries: pa.Array, kind: str) -> np.ndarray:
    """All values of a column of binaries, one after another."""
    bounds = binaries.offsets if hasattr(binaries, "offsets") else np.frombuffer(binaries.buffers()[1], "<i4")[binaries.offset : binaries.offset + len(binaries) + 1]
    raw = binaries.buffers()[2]
    if raw is None:
        return np.zeros(0, kind)
    return np.frombuffer(raw, np.uint8)[int(bounds[0]) : int(bounds[-1])].view(kind)


def _binaries(values: np.ndarray) -> pa.Array:
    """A column of one binary for each row of a matrix."""
    values = np.ascontiguousarray(values)
    size = values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(values.tobytes())])


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) squared distances of integer parts, exact."""
    d = x[:, None, :].astype(np.int64) - entries[None, :, :]
    return np.einsum("nkj,nkj->nk", d, d)


@dataclass
class Codebooks:
    """(PARTS, entries, width) integers, and what bounds need: how far entries moved, and half the way to the next entry."""

    entries: np.ndarray
    moved: np.ndarray | None = None
    half: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        gaps = np.stack([distances(c, c) for c in self.entries]).astype(np.float64)
        k = gaps.shape[1]
        gaps[:, np.arange(k), np.arange(k)] = np.inf
        self.half = _down(np.sqrt(gaps.min(axis=2)) / 2)

    def following(self, entries: np.ndarray) -> Codebooks:
        """The next round's codebooks."""
        gone = (entries - self.entries).astype(np.int64)
        return Codebooks(entries, _up(np.sqrt((gone * gone).sum(axis=2).astype(np.float64))))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assigned(x: np.ndarray, books: Codebooks, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Assigns the parts x (rows, PARTS, width) anew, changes code, upper and lower (rows, PARTS) and counts the parts whose entries were all measured."""
    scans = 0
    for p, entries in enumerate(books.entries):
        mine, u, low = code[:, p], upper[:, p].astype(np.float64), lower[:, p].astype(np.float64)
        if books.moved is not None:
            far = books.moved[p].astype(np.float64)
            u += far[mine]
            if len(far) > 1:
                last = np.argsort(far, kind="stable")[-2:]
                low -= np.where(mine == last[1], far[last[0]], far[last[1]])
        u, low = _up(u), _down(low)
        edge = np.maximum(low, books.half[p][mine])
        open_ = np.flatnonzero(~(u < edge))
        if books.moved is not None and len(open_):
            d = x[open_, p].astype(np.int64) - entries[mine[open_]]
            u[open_] = _up(np.sqrt(np.einsum("nj,nj->n", d, d).astype(np.float64)))
            open_ = open_[~(u[open_] < edge[open_])]
        for i in range(0, len(open_), ROWS):
            rows = open_[i : i + ROWS]
            d = distances(x[rows, p], entries)
            mine[rows] = d.argmin(axis=1)  # the first of equals
            two = np.partition(d, 1, axis=1)[:, :2] if len(entries) > 1 else np.stack([d[:, 0], np.full(len(rows), np.iinfo(np.int64).max)], axis=1)
            two = np.sqrt(two.astype(np.float64))
            u[rows], low[rows] = _up(two[:, 0]), _down(two[:, 1])
        scans += len(open_)
        upper[:, p], lower[:, p] = u, low
    return scans


def sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """(PARTS, entries, width + 1): component sums of the parts of each entry, and their number."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        order = np.argsort(code[:, p], kind="stable")
        of = code[order, p]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if n else np.zeros(0, np.int64)
        if n:
            out[p, of[first], :width] = np.add.reduceat(x[order, p].astype(np.int64), first, axis=0)
        out[p, :, width] = np.bincount(of, minlength=entries)
    return out


def _state(vectors: DataFrame) -> StructType:
    return StructType().add("id", vectors.schema["id"].dataType).add("label", vectors.schema["label"].dataType)


def _parts(vectors: DataFrame) -> DataFrame:
    """(id, label, x) of the kept rows of (id, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = quantised(batch.column(2))
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x, pa.binary())], names=["id", "label", "x"])

    return vectors.mapInArrow(run, _state(vectors).add("x", BinaryType()))


def _round(state: DataFrame, books: Codebooks) -> DataFrame:
    """The state after one assignment; one more row a task holds its sums and, behind them, the number of full measurements."""
    parts, entries, width = books.entries.shape
    sent = state.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors
    known = "code" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scans = np.zeros((parts, entries, width + 1), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            x = _flat(batch.column(2), "<i4").reshape(n, parts, width)
            if known:
                code, upper, lower = (_flat(batch.column(3 + i), kind).reshape(n, parts).copy() for i, kind in enumerate(("u1", "<f4", "<f4")))
            else:
                code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.full((n, parts), -np.inf, np.float32)
            scans += assigned(x, sent.value, code, upper, lower)
            total += sums(x, code, entries)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binaries(code), _binaries(upper), _binaries(lower), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([[*total.ravel().tolist(), scans]], pa.list_(pa.int64()))], names=names)

    schema = StructType(state.schema.fields[:3])
    for name in ("code", "upper", "lower"):
        schema = schema.add(name, BinaryType())
    schema = schema.add("sums", ArrayType(LongType()))
    names = schema.names
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[:6]]
    source = state.where("sums IS NULL").drop("sums") if known else state
    return source.mapInArrow(run, schema)


@dataclass
class Coded:
    """State rows (id, label, x, code), the final codebooks, and how many parts had all entries measured in each assignment."""

    rows: DataFrame
    books: Codebooks
    scans: list[int]


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> Coded | None:
    """Codes and codebooks; None where no row is kept."""
    slack(vectors, [id_col, vector_col, label_col], "vector_codes")
    rows = vectors.select(column(id_col).alias("id"), column(label_col).alias("label"), column(vector_col).cast("array<double>").alias("v"))
    kept = _parts(rows)
    first = kept.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).collect()  # ENTRIES rows
    if not first:
        return None
    size = len(first[0].x)
    if size // 4 % PARTS:
        raise ValueError(f"vectors of {size // 4} components cannot be cut into {PARTS} equal parts")
    state = kept.where(F.length("x") == size)
    if any(len(r.x) != size for r in first):  # rows that are dropped hold places among the first
        first = state.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).collect()
    entries = np.stack([np.frombuffer(r.x, "<i4").astype(np.int64).reshape(PARTS, -1) for r in first], axis=1)
    books, scans = Codebooks(entries), []
    for turn in range(rounds + 1):
        after = written(_round(state, books), "codes")
        discard(state)
        state = after
        added = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        flat = np.zeros(len(added), object)
        for r in added:
            flat[r.i] = int(r.s)
        scans.append(int(flat[-1]))
        if turn < rounds:
            total = flat[:-1].reshape(*books.entries.shape[:2], -1)
            count = total[:, :, -1:]
            mean = total[:, :, :-1] // np.where(count == 0, 1, count)
            books = books.following(np.where(count == 0, books.entries, mean).astype(np.int64))
    return Coded(state.where("sums IS NULL").select("id", "label", "x", "code"), books, scans)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """id, code (two hex digits a part), error, label_error and codebooks_sha256 of every kept row."""
    done = coded(vectors, id_col, vector_col, label_col, rounds)
    if done is None:
        empty = vectors.where("false").select(column(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumns({"label_error": F.col("error"), "codebooks_sha256": F.lit("")})
    books = done.books.entries
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, _, width = sent.value.shape
            x = _flat(batch.column(2), "<i4").reshape(-1, parts, width)
            code = _flat(batch.column(3), "u1").reshape(-1, parts)
            d = x - sent.value[np.arange(parts)[None, :], code]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(np.einsum("npj,npj->n", d, d))], names=["id", "label", "code", "error"])

    rows = done.rows.mapInArrow(run, _state(done.rows).add("code", BinaryType()).add("error", LongType()))
    # Nulls are one group; the text of a label and whether it is null stand for it.
    rows = rows.withColumns({"_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "_none": F.col("label").isNull()})
    totals = rows.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"))
    return dealt_join(rows, totals, ["_label", "_none"]).select(
        F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.books.digest()).alias("codebooks_sha256")
    )
