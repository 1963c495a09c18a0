"""Array files as Spark data sources: NPY, MAT of version 5, and FIF recordings, read by ranges of bytes.

``register(spark)`` adds the formats "npy", "mat" and "fif". Each reads a file, a folder or a pattern into rows (file, trial, channel, t, x). The
driver reads headers only; what the tasks get are ranges of at most ``splitBytes`` (32 MB by default), which they read and convert a piece at a
time, so a file of any size is read by many tasks and no task holds more than a piece of it. Options:

* ``axes``: what the axes of an array are, of trial, channel and t; by default "t", "channel,t" or "trial,channel,t" by their number.
* ``variable``: the variable of a MAT file, by default its first numeric one. A compressed variable is one range, since its bytes have no other beginning.
* FIF: samples are in physical units, t counts from the first sample of the file, skipped buffers are absent rows; only files of one part are read.

Paths may be URIs of any file system that pyarrow opens. Files of another format, or broken ones, are errors that name the file.
"""

from __future__ import annotations

import ast
import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, trial long, channel int, t int, x double"
SPLIT_BYTES, PIECE = 32 << 20, 1 << 18
AXES = {1: "t", 2: "channel,t", 3: "trial,channel,t"}

#: Number types of MAT elements, and the MAT elements that hold numbers of arrays.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_NUMERIC = 14, 15, range(6, 16)
#: FIF tags and number types.
FIF_NCHAN, FIF_SFREQ, FIF_CHANNEL, FIF_FIRST, FIF_BUFFER, FIF_SKIP = 200, 201, 203, 208, 300, 301
FIF_TYPES = {2: ">i2", 3: ">i4", 4: ">f4", 5: ">f8", 16: ">i2"}


@dataclass
class Span(InputPartition):
    """A range of an array's numbers: begin ... end - 1 of shape, from byte ``at`` of the file (or of the variable, if that is compressed)."""

    file: str
    at: int
    kind: str
    shape: tuple[int, ...]
    order: str
    axes: tuple[str, ...]
    begin: int
    end: int
    packed: tuple[int, int] | None = None


@dataclass
class Buffers(InputPartition):
    """FIF buffers (byte, number type, samples, first sample) of channels with these factors."""

    file: str
    buffers: list[tuple[int, str, int, int]]
    factors: list[float]


def opened(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def listed(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those whose name fits a pattern."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(inside)]
    folder, _, name = inside.rpartition("/")
    if any(c in name for c in "*?["):
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, name)]
    else:
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [inside] if info.is_file else [f.path for f in system.get_file_info(fs.FileSelector(inside)) if f.is_file and f.base_name[0] not in "._"]
    return [head + f for f in sorted(found)]


def npy_header(path: str) -> tuple[int, str, tuple[int, ...], str]:
    """(byte of the first number, number type, shape, order) of an NPY file."""
    with opened(path) as f:
        start = f.read(12)
        if len(start) < 10 or start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no NPY file")
        wide = start[6] > 1
        size, at = (struct.unpack("<I", start[8:12])[0], 12) if wide else (struct.unpack("<H", start[8:10])[0], 10)
        f.seek(at)
        about = ast.literal_eval(f.read(size).decode("utf-8" if start[6] > 2 else "latin1"))
    kind = np.dtype(about["descr"])
    if kind.kind not in "biuf":
        raise ValueError(f"{path} holds {kind}, not real numbers")
    return at + size, kind.str, tuple(about["shape"]), "F" if about["fortran_order"] else "C"


def _mat_tag(raw: bytes, at: int, end: str) -> tuple[int, int, int]:
    """(type, bytes, place of the data) of an element."""
    first, second = struct.unpack(end + "II", raw[at : at + 8])
    return (first & 0xFFFF, first >> 16, at + 4) if first >> 16 else (first, second, at + 8)


def mat_header(path: str, variable: str | None) -> tuple[int, str, tuple[int, ...], tuple[int, int] | None]:
    """(byte of the first number, number type, shape, (byte, bytes) of the compressed element if it is one) of a variable."""
    with opened(path) as f:
        head, total = f.read(128), f.size()
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise ValueError(f"{path} is no MAT file of version 5")
        end = "<" if head[126:128] == b"IM" else ">"
        at, names = 128, []
        while at + 8 <= total:
            f.seek(at)
            start = f.read(8)
            kind, size, _ = _mat_tag(start, 0, end)
            packed = None
            if kind == MAT_COMPRESSED:
                packed = (at + 8, size)
                raw = zlib.decompressobj().decompress(f.read(min(size, 1 << 16)), 1 << 14)
            else:
                raw = start + f.read(min(size, 1 << 14))
            inner = _mat_tag(raw, 0, end)
            if inner[0] == MAT_MATRIX:
                _, bytes_, p = _mat_tag(raw, inner[2], end)
                held = raw[p] if end == "<" else raw[p + 3]
                p += -(-bytes_ // 8) * 8
                _, bytes_, q = _mat_tag(raw, p, end)
                shape = struct.unpack(f"{end}{bytes_ // 4}i", raw[q : q + bytes_])
                p = p + 8 if q == p + 4 else q + -(-bytes_ // 8) * 8
                _, bytes_, q = _mat_tag(raw, p, end)
                name = raw[q : q + bytes_].decode("latin1")
                p = p + 8 if q == p + 4 else q + -(-bytes_ // 8) * 8
                names.append(name)
                if held in MAT_NUMERIC and (name == variable or variable is None):
                    number, _, q = _mat_tag(raw, p, end)
                    return (q if packed else at + q), end + MAT_TYPES[number], tuple(shape), packed
            at += 8 + size
    raise ValueError(f"{path} has no array {variable or 'of numbers'}; it holds {', '.join(names) or 'nothing'}")


def fif_header(path: str) -> tuple[list[tuple[int, str, int, int]], list[float], list[tuple[str, int]], float]:
    """(buffers, factors of the channels, their (name, kind), samples a second) of a recording: tags are walked, data is skipped."""
    buffers, factors, channels, sfreq, count, place = [], [], [], 0.0, 0, 0
    with opened(path) as f:
        at, total, first = 0, f.size(), None
        while 0 <= at and at + 16 <= total:
            f.seek(at)
            tag, kind, size, following = struct.unpack(">iiii", f.read(16))
            if first is None and tag != 100:
                raise ValueError(f"{path} is no FIF file")
            first = tag
            if tag == FIF_NCHAN:
                count = struct.unpack(">i", f.read(4))[0]
            elif tag == FIF_SFREQ:
                sfreq = struct.unpack(">f", f.read(4))[0]
            elif tag == FIF_CHANNEL:
                raw = f.read(96)
                _, _, what, scale, cal = struct.unpack(">iiiff", raw[:20])
                factors.append(float(scale) * float(cal))
                channels.append((raw[80:96].split(b"\0")[0].decode("latin1"), what))
            elif tag in (FIF_BUFFER, FIF_SKIP):
                if not count or len(factors) != count:
                    raise ValueError(f"{path} tells {len(factors)} of {count} channels before its data")
                if tag == FIF_SKIP:
                    skipped = struct.unpack(">i", f.read(4))[0]
                    place += skipped * (buffers[-1][2] if buffers else 0)
                else:
                    number = FIF_TYPES.get(kind)
                    if number is None:
                        raise ValueError(f"{path} holds numbers of type {kind}")
                    samples = size // np.dtype(number).itemsize // count
                    buffers.append((at + 16, number, samples, place))
                    place += samples
            if following < 0:
                break
            at = following if following > 0 else at + 16 + size
    return buffers, factors, channels, sfreq


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("an array source needs a path")
        self.path, self.options = options["path"], options
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def _spans(self, file: str, at: int, kind: str, shape: tuple[int, ...], order: str, packed=None) -> Iterator[Span]:
        axes = tuple(a.strip() for a in self.options.get("axes", AXES.get(len(shape), "")).split(","))
        if len(axes) != len(shape) or len(set(axes)) != len(axes) or not set(axes) <= {"trial", "channel", "t"}:
            raise ValueError(f"{file} has shape {shape}, which axes={','.join(axes)!r} do not fit")
        total = int(np.prod(shape))
        step = total if packed else max(1, self.split // np.dtype(kind).itemsize)
        for begin in range(0, total, max(step, 1)):
            yield Span(file, at, kind, shape, order, axes, begin, min(begin + step, total), packed)

    def read(self, part: Span | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a source without any range
            return
        size = np.dtype(part.kind).itemsize
        with opened(part.file) as f:
            if part.packed is None:
                f.seek(part.at + part.begin * size)
                take = f.read
            else:
                f.seek(part.packed[0])
                take = _Inflated(f, part.packed[1]).read
                take(part.at)
            for i in range(part.begin, part.end, PIECE):
                n = min(PIECE, part.end - i)
                raw = take(n * size)
                if len(raw) < n * size:
                    raise ValueError(f"{part.file} ends before its array")
                x = np.frombuffer(raw, dtype=part.kind)
                index = dict(zip(part.axes, np.unravel_index(np.arange(i, i + n), part.shape, order=part.order), strict=True))
                yield rows(part.file, index.get("trial", np.zeros(n)), index.get("channel", np.zeros(n)), index.get("t", np.zeros(n)), x)


def rows(file: str, trial, channel, t, x) -> pa.RecordBatch:
    n = len(x)
    name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([file])).cast(pa.string())
    columns = [name, *(pa.array(np.asarray(v).astype(k)) for v, k in ((trial, np.int64), (channel, np.int32), (t, np.int32), (x, np.float64)))]
    return pa.RecordBatch.from_arrays(columns, names=["file", "trial", "channel", "t", "x"])


class _Inflated:
    """A compressed range, read forwards."""

    def __init__(self, f, size: int) -> None:
        self.f, self.left, self.inflate, self.held = f, size, zlib.decompressobj(), b""

    def read(self, n: int) -> bytes:
        out = [self.held]
        have = len(self.held)
        while have < n and (self.left or self.inflate.unconsumed_tail):
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.f.read(min(self.left, 1 << 16))
                self.left -= len(raw)
                if not raw:
                    break
            out.append(self.inflate.decompress(raw, 1 << 20))
            have += len(out[-1])
        whole = b"".join(out)
        self.held = whole[n:]
        return whole[:n]


class _NpyReader(_Reader):
    def partitions(self) -> list[Span]:
        return [s for file in listed(self.path) for s in self._spans(file, *npy_header(file))]


class _MatReader(_Reader):
    def partitions(self) -> list[Span]:
        out = []
        for file in listed(self.path):
            at, kind, shape, packed = mat_header(file, self.options.get("variable"))
            out += self._spans(file, at, kind, shape, "F", packed)
        return out


class _FifReader(_Reader):
    def partitions(self) -> list[Buffers]:
        out = []
        for file in listed(self.path):
            buffers, factors, _, _ = fif_header(file)
            group, held = [], 0
            for b in buffers:
                size = b[2] * len(factors) * np.dtype(b[1]).itemsize
                if group and held + size > self.split:
                    out.append(Buffers(file, group, factors))
                    group, held = [], 0
                group.append(b)
                held += size
            if group:
                out.append(Buffers(file, group, factors))
        return out

    def read(self, part: Buffers | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        factors = np.array(part.factors)
        count = len(factors)
        with opened(part.file) as f:
            for at, kind, samples, first in part.buffers:
                f.seek(at)
                x = np.frombuffer(f.read(samples * count * np.dtype(kind).itemsize), dtype=kind).reshape(samples, count) * factors
                yield rows(part.file, np.zeros(x.size), np.tile(np.arange(count), samples), np.repeat(np.arange(first, first + samples), count), x.ravel())


class _Source(DataSource):
    reads = _NpyReader

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return self.reads(dict(self.options))


class Npy(_Source):
    @classmethod
    def name(cls) -> str:
        return "npy"


class Mat(_Source):
    reads = _MatReader

    @classmethod
    def name(cls) -> str:
        return "mat"


class Fif(_Source):
    reads = _FifReader

    @classmethod
    def name(cls) -> str:
        return "fif"


def register(spark: SparkSession) -> SparkSession:
    """Adds the formats to the session."""
    for source in (Npy, Mat, Fif):
        spark.dataSource.register(source)
    return spark


def find_events(x: DataFrame, channel: int) -> DataFrame:
    """(trial, sample, previous, event_id): where a trigger channel rises, from zero before its first sample.

    A sample meets the one before it by an equality of times, so no recording is sorted in one task.
    """
    level = x.where(F.col("channel") == channel).select("trial", "t", F.round("x").cast("int").alias("level"))
    before = level.select("trial", (F.col("t") + 1).alias("t"), F.col("level").alias("previous"))
    both = level.join(before, ["trial", "t"], "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    return both.where("level > previous").select("trial", F.col("t").cast("long").alias("sample"), "previous", F.col("level").alias("event_id"))
