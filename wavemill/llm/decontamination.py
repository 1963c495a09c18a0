"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared when they share seeds, windows of LEAST tokens with the same rolling hash. Tiles are
then found as in running Karp-Rabin greedy string tiling: windows of a search length are hashed over what is not yet marked, equal
ones are extended, the longest are marked first, and the search length falls until it is LEAST. Tiles never overlap, so passages that
were cut and put in another order still cover the item. A pair is a hit when its tiles cover at least ``threshold`` of the item.

Tokens are runs of letters and digits, lower-cased; case, punctuation and white space do not matter. The benchmark is a stated
query set: tasks write it as blocks of at most BLOCK_BYTES of text (a single item may exceed that) to the shared folder. Documents are
read once, in a narrow step that loads one block after another for every HELD_BYTES of text, so neither hot items nor copies meet in one
task, nothing of the benchmark passes through the driver, and a task holds one block at a time.

Items of fewer than LEAST tokens, which hold no seed, are matched whole: a text with all their tokens in a row is a hit, once.

Null and empty texts have no tokens and no hits, and null and empty items are in no text; a repeated document row, and a repeated item, has
hits of its own. Of matches of one length the first in the item, then in the text, is marked first. A very long text is one slice of a
task. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import column as named
from ._shared import filesystem, fresh, map_batches, slack

LEAST = 5
THRESHOLD = 0.5
BLOCK_BYTES = 1 << 24
#: Text that a task holds against all blocks, if there are several, before it reads on.
HELD_BYTES = 1 << 26


def tokens(column: pa.Array, hasher: W.Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, token hashes, bounds) of slices of a text column."""
    for i, n, part, cuts in W.parts(column, lower=True):
        s, e, bounds = W.words(part, cuts, W.ALNUM[part])
        yield i, n, hasher.spans(part, s, e), bounds


def _free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows in which nothing is marked."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def tiles(pattern: np.ndarray, text: np.ndarray, least: int, hasher: W.Hasher, dead: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(pattern start, text start, length) of the tiles; ``dead`` marks text tokens that no tile can hold."""
    marked_p = np.zeros(len(pattern), dtype=bool)
    marked_t = np.zeros(len(text), dtype=bool) if dead is None else dead.copy()
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), 20))
    while True:
        free_p, free_t = _free_windows(marked_p, size), _free_windows(marked_t, size)
        matches: list[tuple[int, int, int]] = []
        longest = 0
        if len(free_p) and len(free_t):
            hash_p, hash_t = hasher.windows(pattern, free_p, size), hasher.windows(text, free_t, size)
            order = np.argsort(hash_p, kind="stable")
            lo, hi = np.searchsorted(hash_p[order], hash_t, "left"), np.searchsorted(hash_p[order], hash_t, "right")
            reach: dict[int, int] = {}  # by diagonal: where its last match ends in the text
            for x in np.flatnonzero(hi > lo).tolist():
                t = int(free_t[x])
                for p in free_p[order[lo[x] : hi[x]]].tolist():
                    if reach.get(t - p, -1) >= t + size:
                        continue  # inside a match that began earlier on the same diagonal
                    if not (pattern[p : p + size] == text[t : t + size]).all():
                        continue
                    k = size
                    while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not marked_p[p + k] and not marked_t[t + k]:
                        k += 1
                    reach[t - p] = t + k
                    matches.append((k, p, t))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for k, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if marked_p[p : p + k].any() or marked_t[t : t + k].any():
                again = again or k > size  # what is left of it may still hold a window
                continue
            marked_p[p : p + k] = True
            marked_t[t : t + k] = True
            out.append((p, t, k))
        if again:
            continue
        if size <= least:
            return out
        size = max(least, size // 2)


class Block:
    """Items of the benchmark with their seeds, and what a task needs to hold them against texts."""

    def __init__(self, ids: list, texts: list, least: int, threshold: float) -> None:
        self.least, self.threshold, self.ids = least, threshold, ids
        hasher = W.Hasher(29)
        found: list[np.ndarray] = []
        for _, n, values, bounds in tokens(pa.array(texts, pa.string()), hasher):
            found += [values[bounds[r] : bounds[r + 1]] for r in range(n)]
        self.items = found
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        at, rows = W.window_starts(bounds, least)
        seeds = hasher.windows(flat, at, least) if len(at) else np.zeros(0, np.uint64)
        #: By number of tokens: hashes of the items that are too short for a seed, with their numbers.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, least):
            mine = np.flatnonzero(np.diff(bounds) == n)
            if len(mine):
                whole = hasher.windows(flat, bounds[mine], n)
                by = np.argsort(whole, kind="stable")
                self.short[n] = whole[by], mine[by]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.seed_item, self.seed_at = seeds[order], rows[order], (at - bounds[rows])[order]

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(row, item number, coverage, tiles) of the pairs whose coverage reaches the threshold."""
        if not len(self.seeds) and not self.short:
            return
        hasher = W.Hasher(29)
        known = np.zeros(1 << 20, dtype=bool)
        known[(self.seeds & W.U64((1 << 20) - 1)).astype(np.int64)] = True
        for first, n, values, bounds in tokens(column, hasher):
            for size, (whole, item) in self.short.items():
                yield from self._whole(first, values, bounds, size, whole, item, hasher)
            if not len(self.seeds):
                continue
            at, rows = W.window_starts(bounds, self.least)
            if not len(at):
                continue
            windows = hasher.windows(values, at, self.least)
            near = np.flatnonzero(known[(windows & W.U64((1 << 20) - 1)).astype(np.int64)])
            lo = np.searchsorted(self.seeds, windows[near], "left")
            near, lo = near[self.seeds[np.minimum(lo, len(self.seeds) - 1)] == windows[near]], lo[self.seeds[np.minimum(lo, len(self.seeds) - 1)] == windows[near]]
            for r in np.unique(rows[near]).tolist():
                yield from self._row(first + r, values[bounds[r] : bounds[r + 1]], at[near[rows[near] == r]] - bounds[r], windows[near[rows[near] == r]], hasher)

    def _whole(self, first: int, values: np.ndarray, bounds: np.ndarray, size: int, whole: np.ndarray, item: np.ndarray, hasher: W.Hasher) -> Iterator[tuple]:
        """Hits of items of ``size`` tokens, at their first place in each text."""
        at, rows = W.window_starts(bounds, size)
        if not len(at):
            return
        windows = hasher.windows(values, at, size)
        lo, hi = np.searchsorted(whole, windows, "left"), np.searchsorted(whole, windows, "right")
        seen: set[tuple[int, int]] = set()
        for x in np.flatnonzero(hi > lo).tolist():
            for k in item[lo[x] : hi[x]].tolist():
                pair = (int(rows[x]), k)
                if pair not in seen and (self.items[k] == values[at[x] : at[x] + size]).all():
                    seen.add(pair)
                    yield first + pair[0], k, 1.0, [(0, int(at[x] - bounds[rows[x]]), size)]

    def _row(self, row: int, text: np.ndarray, at: np.ndarray, windows: np.ndarray, hasher: W.Hasher) -> Iterator[tuple]:
        lo, hi = np.searchsorted(self.seeds, windows, "left"), np.searchsorted(self.seeds, windows, "right")
        many = hi - lo
        pick = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, where, here = self.seed_item[pick], self.seed_at[pick], np.repeat(at, many)
        for k in np.unique(item).tolist():
            pattern = self.items[k]
            mine = item == k
            could = np.zeros(len(pattern), dtype=bool)
            could[(where[mine][:, None] + np.arange(self.least)).ravel()] = True
            if could.sum() < self.threshold * len(pattern):
                continue  # no tiling can cover more than the seeds do
            dead = np.ones(len(text), dtype=bool)
            dead[(here[mine][:, None] + np.arange(self.least)).ravel()] = False
            got = tiles(pattern, text, self.least, hasher, dead)
            coverage = sum(x[2] for x in got) / len(pattern)
            if coverage >= self.threshold:
                yield row, k, coverage, got


def blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int, threshold: float, most: int = BLOCK_BYTES) -> list[str]:
    """Files of the benchmark's blocks, built and written by tasks to the shared folder; the driver sees their names only."""
    rows = benchmark.select(named(item_col).alias("_item"), named(text_col).alias("_text")).where("_text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0]
    if size is None:
        return []
    folder = fresh(benchmark.sparkSession, "blocks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)

        def write() -> pa.RecordBatch:
            name = uuid.uuid4().hex  # of this attempt: only files of attempts that end well are named in the result
            with fs.open_output_stream(f"{path}/{name}") as file:
                file.write(pickle.dumps(Block(ids, texts, least, threshold), 5))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(text.encode())
                if ids and held + n > most:
                    yield write()
                    ids, texts, held = [], [], 0
                ids.append(item)
                texts.append(text)
                held += n
        if ids:
            yield write()

    found = rows.coalesce(-(-max(size, 1) // most)).mapInArrow(build, "path string").collect()  # a name for each block
    return sorted(r.path for r in found)


@lru_cache(maxsize=1)
def _loaded(path: str) -> Block:
    fs, name = filesystem(path)
    with fs.open_input_file(name) as file:
        return pickle.loads(file.readall())


def _held(batches: Iterator[pa.RecordBatch], column: int, paths: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Batches that are held against one block after another: HELD_BYTES of text, so that blocks are seldom loaded; a single block stays."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.column(column).nbytes
        if len(paths) == 1 or size >= HELD_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each hit: id, item id, coverage, and the tiles (item token, document token, length)."""
    slack(docs, [id_col, text_col], "contaminated")
    slack(benchmark, [item_col, item_text_col], "contaminated benchmark")
    spark = docs.sparkSession
    rows = docs.select(named(id_col).alias(id_col), named(text_col).alias("_text")).where("_text IS NOT NULL")
    tile = "array<struct<item_token:int,doc_token:int,length:int>>"
    key, other = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, `{item_col}` {other}, coverage double, tiles {tile}"
    kind = pa.list_(pa.struct([("item_token", pa.int32()), ("doc_token", pa.int32()), ("length", pa.int32())]))

    paths = blocks(benchmark, item_col, item_text_col, least, threshold, block_bytes)
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _held(batches, 1, paths):
            for path in paths:
                block = _loaded(path)
                for batch in some:
                    found = list(block.hits(batch.column(1)))
                    if found:
                        parts = [[{"item_token": p, "doc_token": t, "length": n} for p, t, n in sorted(f[3])] for f in found]
                        item = pa.array([block.ids[f[1]] for f in found])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found])), item, pa.array([f[2] for f in found]), pa.array(parts, kind)], names=[id_col, item_col, "coverage", "tiles"])

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit: a narrow filter, so no text is shuffled."""
    slack(docs, [text_col], "clean")
    slack(benchmark, [item_col, item_text_col], "clean benchmark")
    at = docs.columns.index(text_col)
    paths = blocks(benchmark, item_col, item_text_col, least, threshold, block_bytes)
    if not paths:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _held(batches, at, paths):
            hits = [np.zeros(batch.num_rows, dtype=bool) for batch in some]
            for path in paths:
                for batch, hit in zip(some, hits, strict=True):
                    hit[[r for r, *_ in _loaded(path).hits(batch.column(at))]] = True
            for batch, hit in zip(some, hits, strict=True):
                yield batch.filter(pa.array(~hit)) if hit.any() else batch

    return map_batches(docs, run, docs.schema)
