"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition in groups, so nothing is shuffled and no group of equal or long documents
meets in one task. A document's ids are cut into whole windows and rests; the rests of a group are cut into pieces and dealt over the
fewest windows that could hold them: each piece starts as a partial partition, and the two partitions of the widest spread are merged
again and again, the largest sums of one with the smallest of the other. If a window then holds more than its capacity, the
window count rises and the group is dealt anew. Windows come out near-equal, so all of them are nearly full. What is left of a task's
last group above whole windows goes into sequences of lengths that are powers of two, which need no padding.

Null and empty texts are documents of one id, the end id. Texts are encoded as the library does by default: the string of a special token
in a text is that token. A null document id stays null. Repeated rows are packed as often as they occur; of pieces of equal size the first
comes first. A very long text is a slice of its own, and its ids are cut into whole windows at once. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import column, slack

#: Tokens of rests packed together, and the most tokens of a piece: more and smaller pieces leave less padding.
GROUP_TOKENS = 600_000
PIECE_TOKENS = 1024
#: Share of the windows of a task's last group that is left free, so that differencing can fill them.
FREE = 1 / 128


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The indices of the sizes in each of ``windows`` parts of near-equal sums."""
    # A partial partition: sums in falling order without trailing zeros, and the items of each sum.
    heap: list[tuple[int, int, np.ndarray, list]] = [(-s, i, np.array([s]), [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            sums, items = np.concatenate([a, b]), in_a + in_b
        else:  # the smallest of a meet the smallest of b, the other way round
            sums = np.concatenate([a[: len(a) - over], a[len(a) - over :] + b[len(b) - over :][::-1], b[: len(b) - over]])
            met = [(x, y) for x, y in zip(in_a[len(in_a) - over :], in_b[len(in_b) - over :][::-1], strict=True)]
            items = in_a[: len(in_a) - over] + met + in_b[: len(in_b) - over]
        order = np.argsort(-sums, kind="stable")
        sums, items = sums[order], [items[i] for i in order.tolist()]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, count, sums, items))
        count += 1
    return [_flat(x) for x in (heap[0][3] if heap else [])]


def _flat(tree: tuple) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return out


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing can fill."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece is larger than a window")
    windows = -(-sum(sizes) // capacity)
    while True:
        parts = differencing(sizes, windows)
        most = max(sum(sizes[i] for i in p) for p in parts)
        if most <= capacity:
            return parts
        windows += 1


#: A packed piece.
PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
)


def _cut_behind(pieces: list[tuple], size: int) -> list[tuple]:
    """Takes what follows the first ``size`` ids away from the pieces, cutting one if need be, and returns it."""
    upto = 0
    for i, (doc, raw, start, n) in enumerate(pieces):
        if upto + n > size:
            rest = [(doc, raw, start + size - upto, upto + n - size), *pieces[i + 1 :]]
            pieces[i:] = [(doc, raw, start, size - upto)] if size > upto else []
            return rest
        upto += n
    return []


def pack_partition(docs: Iterator[tuple[int | None, bytes]], first: int, capacity: int, with_ids: bool) -> Iterator[list[tuple]]:
    """Batches of packed pieces of (id, little-endian 32-bit ids) rows; sequence ids count up from ``first``."""
    sequence, waiting, held = first, [], 0
    out: list[tuple] = []

    def piece(doc, raw: bytes, start: int, length: int, sequence: int, offset: int) -> tuple:
        part = raw[4 * start : 4 * (start + length)]
        return (doc, start, length, zlib.crc32(part), len(raw) // 4, sequence, offset, *([part] if with_ids else []))

    def lay(parts: list[list[tuple]]) -> None:
        """A sequence of each part, whose pieces are (document, ids, start, length)."""
        nonlocal sequence
        for part in parts:
            offset = 0
            for doc, raw, start, n in part:
                out.append(piece(doc, raw, start, n, sequence, offset))
                offset += n
            sequence += 1

    def flush(last: bool = False) -> None:
        nonlocal held
        tail = _cut_behind(waiting, int(held // capacity * capacity * (1 - FREE))) if last else []
        lay([[waiting[i] for i in sorted(part)] for part in deal([n for _, _, _, n in waiting], capacity)])
        left = sum(n for _, _, _, n in tail)
        while left:
            size = min(capacity, 1 << left.bit_length() - 1)
            rest = _cut_behind(tail, size)
            lay([tail])
            tail, left = rest, left - size
        waiting.clear()
        held = 0

    for doc, raw in docs:
        n = len(raw) // 4
        whole = n // capacity * capacity
        for start in range(0, whole, capacity):
            out.append(piece(doc, raw, start, capacity, sequence, 0))
            sequence += 1
        for start in range(whole, n, PIECE_TOKENS):
            waiting.append((doc, raw, start, min(PIECE_TOKENS, n - start)))
        held += n - whole
        if held >= GROUP_TOKENS:
            flush()
        if len(out) >= 4096:
            yield out
            out = []
    flush(last=True)
    yield out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each packed piece (PIECES, and ``ids`` with its bytes if with_ids); sequence ids are unique."""
    slack(docs, [id_col, text_col], "pack_documents")
    schema = T.StructType([T.StructField("_id", T.LongType()), *PIECES.fields[1:], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from ._tokenize import encoder

        encode = encoder(tokenizer).encode

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for i, n, ids, bounds in encode(batch.column(1)):
                    raw, bounds = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4").tobytes(), bounds + np.arange(n + 1)
                    for d, a, b in zip(batch.column(0).slice(i, n).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        yield d, raw[4 * a : 4 * b]

        for out in pack_partition(rows(), TaskContext.get().partitionId() << 32, capacity, with_ids):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return docs.select(column(id_col).cast("long").alias("_id"), column(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
