"""Token ids as binary files in Simple-8b, a word-aligned code.

A file is one range of ids in ascending order: documents are range-partitioned by id, sorted within the partition and encoded in
batches. A partition of any size streams through: a file is closed at file_ids ids or file_docs documents and the next one begun, so a
task holds some blocks of ids and the tables of one file.

Layout of a file, all integers little-endian:
  ``S8B1``, then blocks of 64-bit words, then the document table (int64 id, int64 number of ids, for each document; a negative
  number means that there are as many ids and that the document's id is null), then
  the block table (int64 byte offset, int64 first id's index, int64 ids, for each block), then a footer of three
  int64: documents, blocks, byte offset of the document table, and ``S8B1`` again.
A word is a 4-bit selector in its top bits and as many values as fit in the other 60. Selectors 0 and 1 stand for runs of 240 and
120 zeros; selector 15 is the escape, one literal value of up to 60 bits. A block holds BLOCK_IDS ids at most and is decoded alone.

Null texts are empty; an empty document is its end id. Texts are encoded as the library does by default: the string of a special token
in a text is that token. Rows that repeat an id are all kept, in the order of a hash of the text and then of the text; a null id sorts
first. A very long text is encoded whole, as a slice of its own.
Extra columns are ignored; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import column, filesystem, fresh, slack, written

MAGIC = b"S8B1"
BLOCK_IDS = 1024
#: How many values a word holds, and the bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids that are encoded at once.
CHUNK_IDS = 1 << 19
#: A file is closed once it holds so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20


def encode_blocks(values: np.ndarray) -> list[np.ndarray]:
    """The words of each block of BLOCK_IDS values (fewer in the last), all blocks advancing together."""
    n = len(values)
    if not n:
        return []
    if int(values.max()) >> 60:
        raise ValueError("a value has more than 60 bits")
    narrow = values.astype(np.uint32) if int(values.max()) >> 32 == 0 else values.astype(np.uint64)
    rows = -(-n // BLOCK_IDS)
    grid = np.full(rows * BLOCK_IDS, np.iinfo(narrow.dtype).max, dtype=narrow.dtype)  # what follows the last value fits nowhere
    grid[:n] = narrow
    grid = grid.reshape(rows, BLOCK_IDS)
    choice = np.full(grid.shape, 15, dtype=np.int8)
    for s in range(14, -1, -1):  # the last that fits holds most values
        run, count = grid < (1 << int(BITS[s])), int(COUNTS[s])
        if int(run.sum()) < count:
            break  # so do the narrower ones
        width = 1
        while width < count:  # run[i]: values i to i + width fit
            step = min(width, count - width)
            run[:, :-step] &= run[:, step:]
            run[:, -step:] = False
            width += step
        np.putmask(choice, run, np.int8(s))
    choice = choice.ravel()
    values = values.astype(np.uint64)
    at = np.arange(0, n, BLOCK_IDS)
    block = np.arange(len(at))
    took_at, took_block = [], []
    while len(at):
        took_at.append(at)
        took_block.append(block)
        at = at + COUNTS[choice[at]]
        on = at < np.minimum((block + 1) * BLOCK_IDS, n)
        at, block = at[on], block[on]
    at = np.concatenate(took_at)
    at.sort()
    sel = choice[at].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        here = np.flatnonzero(sel == s)
        if len(here):
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            words[here] |= np.bitwise_or.reduce(values[at[here][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    cuts = np.searchsorted(at, np.arange(BLOCK_IDS, n, BLOCK_IDS))
    return np.split(words, cuts)


def decode(words: np.ndarray) -> np.ndarray:
    """The values of a run of words."""
    words = words.astype(np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel])
    begins = ends - COUNTS[sel]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in range(2, 16):
        here = np.flatnonzero(sel == s)
        if len(here):
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            out[begins[here][:, None] + np.arange(COUNTS[s])] = (words[here][:, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    return out


class Writer:
    """Streams documents into one file."""

    def __init__(self, out) -> None:
        self.out, self.at, self.ids, self.n_docs = out, len(MAGIC), 0, 0
        self.docs: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents one behind the other; known tells which doc_ids are not null."""
        self.docs.append(np.stack([np.where(known, doc_ids, 0), np.where(known, counts, -counts)], axis=1).astype("<i8"))
        self.n_docs += len(counts)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= CHUNK_IDS:
            self._flush(self.held_ids // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, upto: int) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        blocks = encode_blocks(values[:upto])
        if blocks:
            size = np.array([8 * len(words) for words in blocks])
            first = np.arange(0, upto, BLOCK_IDS)
            self.blocks.append(np.stack([self.at + np.cumsum(size) - size, self.ids + first, np.minimum(BLOCK_IDS, upto - first)], axis=1).astype("<i8"))
            self.at += int(size.sum())
            self.ids += upto
            self.out.write(np.concatenate(blocks).astype("<u8").tobytes())
        self.held, self.held_ids = [values[upto:]], len(values) - upto

    def close(self) -> None:
        self._flush(self.held_ids)
        for table in (*self.docs, *self.blocks):
            self.out.write(table.tobytes())
        self.out.write(struct.pack("<3q", self.n_docs, sum(len(b) for b in self.blocks), self.at) + MAGIC)
        self.out.close()


def read_documents(source, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids as uint32) of each document of an open file, by its block table; memory holds a few blocks and one document."""

    def at(offset: int, n: int) -> bytes:
        source.seek(offset)
        return source.read(n)

    foot = at(size - 28, 28)
    if foot[24:] != MAGIC or at(0, 4) != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_blocks, table = struct.unpack("<3q", foot[:24])
    raw = at(table, 16 * n_docs + 24 * n_blocks)
    docs = np.frombuffer(raw, dtype="<i8", count=2 * n_docs).reshape(-1, 2)
    blocks = np.frombuffer(raw, dtype="<i8", offset=16 * n_docs).reshape(-1, 3)
    ends = np.append(blocks[1:, 0], table)
    step = max(1, CHUNK_IDS // BLOCK_IDS)
    have, b = np.zeros(0, np.uint32), 0
    for doc_id, n in docs.tolist():
        if n < 0:
            doc_id, n = None, -n
        parts = [have]
        got = len(have)
        while got < n:
            e = min(b + step, n_blocks)
            ids = decode(np.frombuffer(at(int(blocks[b, 0]), int(ends[e - 1] - blocks[b, 0])), dtype="<u8")).astype(np.uint32)
            parts.append(ids)
            got += len(ids)
            b = e
        have = np.concatenate(parts) if len(parts) > 1 else have
        yield doc_id, have[:n]
        have = have[n:]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", where: str | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the files and returns one row for each: path, part, file, bytes, n_docs, n_ids, start (ids of all files before it).

    A task writes under a name of its own and then renames, so a task that runs again or twice leaves the same file.
    """
    slack(docs, [id_col, text_col], "write_tokens")
    where = where or fresh(docs.sparkSession, "tokens")
    schema = "path string, part int, file int, bytes long, n_docs long, n_ids long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from ._tokenize import encoder

        task, encode = TaskContext.get(), encoder(tokenizer).encode
        fs, folder = filesystem(where)
        writer, file = None, 0

        def close() -> pa.RecordBatch:
            writer.close()
            fs.move(temp, final)
            size = fs.get_file_info(final).size
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((final, task.partitionId(), file, size, writer.n_docs, writer.ids), kinds, strict=True)], names=names)

        for batch in batches:
            for i, n, ids, bounds in encode(batch.column(1)):
                if writer is None:
                    fs.create_dir(folder)
                    final, temp = f"{folder}/{task.partitionId():08d}-{file:05d}.s8b", f"{folder}/_{task.taskAttemptId()}-{file}.tmp"
                    writer = Writer(fs.open_output_stream(temp, compression=None))
                doc = batch.column(0).slice(i, n)
                known = doc.is_valid().to_numpy(zero_copy_only=False)
                writer.add(doc.fill_null(0).to_numpy(), known, np.diff(bounds) + 1, np.insert(ids, bounds[1:], np.uint32(end_id)))
                if writer.ids + writer.held_ids >= file_ids or writer.n_docs >= file_docs:
                    yield close()
                    writer, file = None, file + 1
        if writer is not None:
            yield close()

    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    files = written(ordered.mapInArrow(run, schema), "token-files")
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    return files.withColumn("path", F.concat(F.lit(where + "/"), F.element_at(F.split("path", "/"), -1))).withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_tokens(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document, read from the files: id, start, n_tokens, ids_crc32 and, if with_ids, the ids' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                rows: list[list] = [[], [], [], [], []]
                with fs.open_input_file(name) as source:
                    for doc_id, ids in read_documents(source, source.size()):
                        raw = ids.astype("<u4").tobytes()
                        for c, v in zip(rows, (doc_id, start, len(ids), zlib.crc32(raw), raw if with_ids else b""), strict=True):
                            c.append(v)
                        start += len(ids)
                        if len(rows[0]) >= (256 if with_ids else 8192):
                            yield _batch(rows, names)
                            rows = [[], [], [], [], []]
                yield _batch(rows, names)

    def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[: len(names)], kinds, strict=False)], names=names)

    n = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    schema = f"_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.select("path", "start").repartition(max(n, _count(files)), "path").mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _count(files: DataFrame) -> int:
    return min(files.count(), 100_000)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and reads them back: id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, tokenizer, end_id, id_col, text_col), id_col)
