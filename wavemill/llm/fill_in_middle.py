"""Fill-in-the-middle transformation of whole texts in one NumPy pass over Arrow's UTF-8 buffers.

A unit is a run of ASCII letters or one other code point. Bytes are looked up in a table of classes (letter, other first byte,
continuation byte); a unit begins at every first byte that is no letter and at every letter that does not follow one, or that begins a
row. Running sums of these marks, counted anew from each row's first byte, number the units; one ``searchsorted`` over them finds the
byte of both cuts of all rows of a slice, one gather lays all outputs out. No row is handled on its own.

A row's draws come from the SHA-256 of ``<seed>:<id>``: four unsigned 32-bit numbers h1 to h4. The prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text stays plain if it is empty, holds a sentinel, or
h3 % 100 >= rate; otherwise it is put in suffix-prefix-middle order if h4 % 100 < spm_rate, else in prefix-suffix-middle order. The
sentinels tell the parts apart without doubt: they begin and end with signs that stand nowhere else in them, so none arises at a seam.

A null text is empty (and plain); a null id is drawn for as the empty string; repeated rows get equal results. A very long text is
a slice of its own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import column, slack

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SPM, PSM = 0, 1, 2
FORMS = ("plain", "spm", "psm")
#: Bytes of text handled at once, at about 25 bytes of arrays for each.
SLICE_BYTES = 4 << 20

#: Fixed byte classes: 0 continues a code point, 1 is a letter, 2 begins another code point.
CLASS = np.full(256, 2, dtype=np.uint8)
CLASS[0x80:0xC0] = 0
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte."""
    kind = CLASS[data]
    begins = kind > 0
    begins[1:] &= ~((kind[1:] == 1) & (kind[:-1] == 1))
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[rows] = True
    return begins


def _running(marks: np.ndarray) -> np.ndarray:
    """Marks before each place, and before the end."""
    out = np.zeros(len(marks) + 1, dtype=np.int64 if len(marks) >> 31 else np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def sentinels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(at, which): places where a whole sentinel lies in one row, and 0, 1 or 2 for prefix, suffix or middle."""
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) > 2 else np.zeros(0, np.int64)
    which = np.full(256, 3, dtype=np.uint8)
    which[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = [0, 1, 2]
    kind = which[data[at + 1]] if len(at) else np.zeros(0, np.uint8)
    row = np.searchsorted(offsets, at, side="right") - 1
    good = (kind < 3) & (at + 3 <= offsets[row + 1])
    return np.stack([at[good], kind[good]])


def _laid(source: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One text for each row of begins and ends (rows, pieces): its pieces of source, one after another."""
    size = (ends - begins).ravel()
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(upto[-1])
    at += np.repeat(begins.ravel() - upto[:-1], size)
    rows = len(begins)
    offsets = upto[:: begins.shape[1]] if rows else np.zeros(1, np.int64)
    out = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(source[at].tobytes()))
    return out.cast(pa.string())


def transformed(texts: pa.Array, h: np.ndarray, rate: int = 90, spm_rate: int = 20) -> Iterator[pa.RecordBatch]:
    """(n, form, prefix_chars, middle_chars, output) for slices of a text column; h is (rows, 4)."""
    for first, rows, data, offsets in W.parts(texts, most=SLICE_BYTES):
        mine = h[first : first + rows]
        begins = unit_starts(data, offsets)
        units = _running(begins)
        base = units[offsets[:-1]].astype(np.int64)
        n = units[offsets[1:]] - base
        drawn = mine[:, :2] % (n[:, None] + 1)
        cuts = np.stack([drawn.min(axis=1), drawn.max(axis=1)])
        # Unit c of a row, counted from its first byte on, is unit base + c of the slice; behind the last unit is the row's end.
        cut = np.searchsorted(units, base + cuts + 1) - 1
        cut = np.where(cuts == n, offsets[1:], cut)
        at, _ = sentinels(data, offsets)
        form = np.where(mine[:, 3] % 100 < spm_rate, SPM, PSM)
        form[(n == 0) | (mine[:, 2] % 100 >= rate)] = PLAIN
        form[np.searchsorted(offsets, at, side="right") - 1] = PLAIN
        chars = _running(CLASS[data] > 0)
        moved = form != PLAIN
        lengths = [chars[cut[0]] - chars[offsets[:-1]], chars[cut[1]] - chars[cut[0]]]
        # Sources: the text's bytes with the three sentinels behind them.
        source = np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, dtype=np.uint8)])
        sign = len(data) + 3 * np.arange(4)
        prefix, middle, suffix = (offsets[:-1], cut[0]), (cut[0], cut[1]), (cut[1], offsets[1:])
        p, s, m = ((np.full(rows, sign[i]), np.full(rows, sign[i + 1])) for i in range(3))
        none = (offsets[:-1], offsets[:-1])
        orders = {PLAIN: [prefix, middle, suffix, none, none, none], PSM: [p, prefix, s, suffix, m, middle], SPM: [s, suffix, p, prefix, m, middle]}
        pieces = np.zeros((2, rows, 6), dtype=np.int64)
        for kind, order in orders.items():
            these = form == kind
            for i, (a, b) in enumerate(order):
                pieces[0, these, i], pieces[1, these, i] = a[these], b[these]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(n.astype(np.int64)),
                pa.DictionaryArray.from_arrays(pa.array(form.astype(np.int8)), pa.array(FORMS)).cast(pa.string()),
                *(pa.array(x.astype(np.int64), mask=~moved) for x in lengths),
                _laid(source, pieces[0], pieces[1]),
            ],
            names=["n", "form", "prefix_chars", "middle_chars", "output"],
        )


def rebuilt(outputs: pa.Array, forms: np.ndarray) -> Iterator[pa.Array]:
    """The texts that outputs were made of, for slices of the column; forms holds PLAIN, SPM or PSM."""
    for first, rows, data, offsets in W.parts(outputs, most=SLICE_BYTES):
        form = forms[first : first + rows]
        at, which = sentinels(data, offsets)
        row = np.searchsorted(offsets, at, side="right") - 1
        moved = form[row] != PLAIN
        at, which, row = at[moved], which[moved], row[moved]
        place = np.zeros((3, rows), dtype=np.int64)
        place[which, row] = at
        begin, end = offsets[:-1], offsets[1:]
        p, s, m = place
        parts = {
            PLAIN: [(begin, end), (begin, begin), (begin, begin)],
            PSM: [(p + 3, s), (m + 3, end), (s + 3, m)],
            SPM: [(p + 3, m), (m + 3, end), (s + 3, p)],
        }
        pieces = np.zeros((2, rows, 3), dtype=np.int64)
        for kind, order in parts.items():
            these = form == kind
            for i, (a, b) in enumerate(order):
                pieces[0, these, i], pieces[1, these, i] = a[these], b[these]
        yield _laid(data, pieces[0], pieces[1])


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4 of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (code points, null if plain) and output of every row; a narrow step."""
    slack(docs, [id_col, text_col], "fill_in_middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(2 + i).to_numpy() for i in range(4)], axis=1)
            first = 0
            for part in transformed(batch.column(1), h, rate, spm_rate):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, part.num_rows), *part.columns], names=["id", *part.schema.names])
                first += part.num_rows

    rows = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"), *draws(id_col, seed))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return done.withColumnRenamed("id", id_col)


def restored(rows: DataFrame, form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """rows with the text that each output was made of, in place of a column of that name; a narrow step.

    An output that lacks a sentinel of its form, as no output of ``fill_in_middle`` does, has no defined text.
    """
    slack(rows, [form_col, output_col], "restored")
    rows = rows.drop(name) if name not in (form_col, output_col) else rows
    plain = rows.select(column(output_col).alias("_output"), column(form_col).alias("_form"), F.struct(*(column(c).alias(f"_{i}") for i, c in enumerate(rows.columns))).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = np.array([FORMS.index(f) for f in batch.column(1).to_pylist()], dtype=np.int8)
            first = 0
            for part in rebuilt(batch.column(0), forms):
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, len(part)), part], names=["_row", "_text"])
                first += len(part)

    done = plain.mapInArrow(run, plain.select("_row").withColumn("_text", F.lit("")).schema)
    return done.select(*(F.col(f"_row._{i}").alias(c) for i, c in enumerate(rows.columns)), F.col("_text").alias(name))
