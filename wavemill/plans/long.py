"""Signals that are too long for one task: packed blocks of time that stay where they are.

A trial is cut into blocks of ``block`` places for codes. A block's samples reach ``length - 1`` beyond its last place, so an atom that begins in
it ends in it. Samples and codes are tables bucketed by (trial, block): their joins and everything that is made of them need no
exchange. What travels are the borders, the first and last ``length - 1`` places of a block's codes, to the block beside it; a
round of any job here shuffles K (length - 1) numbers a border at most and nothing for a border without codes, however long blocks are.

Odd and even blocks are encoded in turn, each with its neighbours' present codes fixed. Two blocks that move at once are a whole block apart, so every
half round is a valid descent of the whole signal's objective. A block whose borders are as they were when it last came to rest
is not solved again. Sums and errors of the codes are corrected at the borders: they are those of the uncut signal.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import csc
from . import encode as E
from ..operators.shared import scratch

KEY = ["trial", "b"]
CODES = "trial long, b int, z binary, moved double, seen long"
BORDERS = "trial long, b int, side int, border binary"


@dataclass
class View:
    """One block with what its neighbours' codes reach into it."""

    x: np.ndarray
    z: np.ndarray
    left: np.ndarray
    right: np.ndarray
    last: bool

    @property
    def places(self) -> int:
        return self.z.shape[1]

    def residual(self, d: np.ndarray) -> np.ndarray:
        """The samples less all that codes of this block and its neighbours explain."""
        halo = d.shape[2] - 1
        r = csc.reconstruct(np.concatenate([self.left, self.z, self.right], axis=1), d)
        return self.x - r[:, halo : halo + self.x.shape[1]]

    def own(self, samples: np.ndarray, length: int) -> np.ndarray:
        """The samples that belong to this block and to no other."""
        return samples if self.last else samples[:, : samples.shape[1] - length + 1]


class LongSignal:
    """A long signal (trial, channel, t, x) over ``scale`` in blocks, and its codes, zeros at first.

    Every trial has ``times`` samples; absent ones are zeros. ``close`` (or the end of a with statement) deletes the tables.
    """

    def __init__(self, x: DataFrame, channels: int, times: int, length: int, block: int, scale: float = 1.0, buckets: int | None = None) -> None:
        if block < 2 * length:
            raise ValueError("a block must hold two atoms")
        if times < length:
            raise ValueError(f"the signal has {times} samples, an atom {length}")
        self.spark: SparkSession = x.sparkSession
        self.channels, self.times, self.length, self.block = channels, times, length, block
        self.valid = times - length + 1
        self.count = -(-self.valid // block)
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []
        self.atoms = 0
        self.signal = self._kept(self._blocks(x, scale), "x", parity=True)
        self.codes: list[str | None] = [None, None]

    def __enter__(self) -> LongSignal:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)

    # Tables

    def _kept(self, df: DataFrame, what: str, parity: bool = False) -> str:
        """df as a table in the shared folder, bucketed by trial and block; tasks that hold whole buckets write one file each."""
        name = f"wavemill_{what}_{uuid.uuid4().hex}"
        path = scratch(self.spark, name)
        writer = df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path)
        (writer.partitionBy("parity") if parity else writer).saveAsTable(name)
        self.tables.append(name)
        self.paths = getattr(self, "paths", {}) | {name: path}
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[name])
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.tables.remove(name)

    def _span(self):
        """First place of a block and the first behind it, as a function that tasks can hold."""
        block, valid = self.block, self.valid
        return lambda b: (b * block, min((b + 1) * block, valid))

    def _blocks(self, x: DataFrame, scale: float) -> DataFrame:
        """(trial, b, x, parity): the only shuffle of samples."""
        halo, block, count, channels = self.length - 1, self.block, self.count, self.channels
        first = F.greatest(F.lit(0), F.floor((F.col("t") - halo) / block)).cast("int")
        last = F.least(F.lit(count - 1), F.floor(F.col("t") / block)).cast("int")
        width = block + halo
        inside = x.where((F.col("t") >= 0) & (F.col("t") < self.times) & (F.col("channel") < channels))
        rows = inside.select("trial", F.explode(F.sequence(first, last)).alias("b"), "channel", "t", F.col("x").cast("double").alias("v"))
        rows = rows.select("trial", "b", (F.col("channel") * width + F.col("t") - F.col("b") * block).cast("int").alias("i"), "v")
        # A block without a sample is there too: its neighbours' codes reach into it.
        grid = x.select("trial").distinct().select("trial", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("b"), F.lit(-1).alias("i"), F.lit(0.0).alias("v"))
        packed = rows.unionByName(grid).repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.collect_list(F.struct("i", "v")).alias("at"))
        span = self._span()

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, out = batch.column(2), []
                bounds, pairs = lists.offsets.to_numpy(), lists.values
                place, value = (pairs.field(c).to_numpy(zero_copy_only=False)[pairs.offset :] for c in (0, 1))
                for b, i, j in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    lo, hi = span(b)
                    row = np.zeros(channels * width)
                    some = place[i:j] >= 0
                    row[place[i:j][some]] = value[i:j][some] / scale
                    out.append(np.ascontiguousarray(row.reshape(channels, width)[:, : hi - lo + halo]).tobytes())
                parity = pa.array(np.asarray(batch.column(1)) % 2).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), parity], names=["trial", "b", "x", "parity"])

        return packed.mapInArrow(lay, "trial long, b int, x binary, parity int")

    # Views of blocks

    def _borders(self, parity: int) -> DataFrame:
        """What blocks of a parity have at their ends, addressed to the blocks beside them; sides are 0 (left of the receiver) and 1."""
        if self.codes[parity] is None:
            return self.spark.createDataFrame([], BORDERS)
        halo, atoms, count = self.length - 1, self.atoms, self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trials, to, sides, out = [], [], [], []
                for trial, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    z = np.frombuffer(raw).reshape(atoms, -1)
                    for other, side, part in ((b + 1, 0, z[:, max(0, z.shape[1] - halo) :]), (b - 1, 1, z[:, :halo])):
                        if 0 <= other < count and part.any():
                            trials.append(trial), to.append(other), sides.append(side), out.append(np.ascontiguousarray(part).tobytes())
                columns = [pa.array(trials, pa.int64()), pa.array(to, pa.int32()), pa.array(sides, pa.int32()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["trial", "b", "side", "border"])

        return self.spark.table(self.codes[parity]).select("trial", "b", "z").mapInArrow(run, BORDERS)

    def views(self, parity: int, f, schema: str) -> DataFrame:
        """f(trial, b, View, kept columns of its codes) for each block of a parity, as rows; f gives a pandas frame.

        Only borders are exchanged: samples and codes are read by bucket.
        """
        own = self.spark.table(self.signal).where(F.col("parity") == parity).select("trial", "b", "x")
        if self.codes[parity] is None:
            own = own.withColumns({"z": F.lit(None).cast("binary"), "moved": F.lit(None).cast("double"), "seen": F.lit(None).cast("long")})
        else:
            own = own.join(self.spark.table(self.codes[parity]), KEY)
        atoms, halo, count, span = self.atoms, self.length - 1, self.count, self._span()

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            trial, b = int(left["trial"].iloc[0]), int(left["b"].iloc[0])
            lo, hi = span(b)
            raw = left["z"].iloc[0]
            sides = {int(s): np.frombuffer(r).reshape(atoms, -1) for s, r in zip(right["side"], right["border"], strict=True)}
            z = np.zeros((atoms, hi - lo)) if raw is None or len(raw) != 8 * atoms * (hi - lo) else np.frombuffer(raw).reshape(atoms, -1)
            before, after = (np.zeros((atoms, halo)) for _ in range(2))
            if 0 in sides:
                before[:, halo - sides[0].shape[1] :] = sides[0]
            if 1 in sides:
                after[:, : sides[1].shape[1]] = sides[1]
            view = View(np.frombuffer(left["x"].iloc[0]).reshape(-1, hi - lo + halo), z, before, after, b == count - 1)
            return f(trial, b, view, left.iloc[0])

        return own.groupBy(*KEY).cogroup(self._borders(1 - parity).groupBy(*KEY)).applyInPandas(run, schema)

    # Codes

    def _grown(self, atoms: int) -> None:
        """Codes for more atoms: new ones are zero."""
        if atoms == self.atoms:
            return
        old, self.atoms = self.atoms, atoms
        if old > atoms:
            self.forget()
        for parity, name in enumerate(self.codes):
            if name is None:
                continue

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    z = [np.frombuffer(r).reshape(old, -1) for r in pdf["z"]]
                    yield pdf.assign(z=[np.concatenate([a, np.zeros((atoms - old, a.shape[1]))]).tobytes() for a in z], seen=None)

            self.codes[parity] = self._kept(self.spark.table(name).mapInPandas(run, CODES), "z")
            self._drop(name)

    def forget(self) -> None:
        """All codes are zero again."""
        for name in self.codes:
            if name is not None:
                self._drop(name)
        self.codes = [None, None]

    def encode(self, encoder: E.Encoder, rounds: int = 60, settle: float = 1e-3, unbiased: bool = False) -> int:
        """New codes from the present ones; the rounds it took. It ends when a whole round moves nothing by more than ``settle``."""
        self._grown(len(encoder.d))
        d, reg, solver, positive, options = encoder.d, 0.0 if unbiased else encoder.reg, encoder.solver, encoder.positive, dict(encoder.options)
        halo, first = self.length - 1, [True, True]
        more = {"dtd": csc.gram(d)} if solver == "lgcd" else {}

        def solve(fresh: bool):
            def run(trial: int, b: int, v: View, row: pd.Series) -> pd.DataFrame:
                seen = zlib.crc32(v.left.tobytes() + v.right.tobytes())
                if not fresh and row["seen"] == seen:
                    return pd.DataFrame({"trial": [trial], "b": [b], "z": [v.z.tobytes()], "moved": [0.0], "seen": [seen]})
                around = csc.reconstruct(np.concatenate([v.left, np.zeros_like(v.z), v.right], axis=1), d)[:, halo : halo + v.x.shape[1]]
                new = csc.encode(v.x - around, d, reg, v.z, solver, positive, unbiased, **more, **options)
                moved = float(np.abs(new - v.z).max(initial=0.0))
                return pd.DataFrame({"trial": [trial], "b": [b], "z": [np.ascontiguousarray(new).tobytes()], "moved": [moved], "seen": [seen]})

            return run

        for i in range(rounds):
            for parity in range(min(2, self.count)):
                name = self._kept(self.views(parity, solve(first[parity]), CODES), "z")
                if self.codes[parity] is not None:
                    self._drop(self.codes[parity])
                self.codes[parity], first[parity] = name, False
            if self.count == 1:
                return 1
            both = self.spark.table(self.codes[0]).select("moved").unionByName(self.spark.table(self.codes[1]).select("moved"))
            if both.where(F.col("moved") > settle).isEmpty():
                return i + 1
        return rounds

    def put(self, z: DataFrame, atoms: int) -> None:
        """Takes the codes of a sparse table (trial, k, t, z) in place of the present ones."""
        self.forget()
        self.atoms, block, span = atoms, self.block, self._span()
        rows = z.where((F.col("t") >= 0) & (F.col("t") < self.valid)).select("trial", F.floor(F.col("t") / block).cast("int").alias("b"), "k", "t", F.col("z").cast("double").alias("z"))
        every = self.spark.table(self.signal).select("trial", "b", F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("double").alias("z"))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            lo, hi = span(int(pdf["b"].iloc[0]))
            dense, some = np.zeros((atoms, hi - lo)), pdf[pdf["k"].notna()]
            dense[some["k"].to_numpy(dtype=int), some["t"].to_numpy(dtype=int) - lo] = some["z"]
            return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "b": [pdf["b"].iloc[0]], "z": [dense.tobytes()], "moved": [0.0], "seen": [None]})

        packed = rows.unionByName(every).repartition(self.buckets, *KEY).groupBy(*KEY).applyInPandas(pack, CODES)
        self.codes = [self._kept(packed.where(F.col("b") % 2 == parity), "z") for parity in range(2)]

    def sparse(self) -> DataFrame:
        """(trial, k, t, z)."""
        parts = [self.spark.table(n).select("trial", "b", "z") for n in self.codes if n is not None]
        if not parts:
            return self.spark.createDataFrame([], "trial long, k int, t int, z double")
        atoms, block = self.atoms, self.block

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for trial, b, raw in zip(pdf["trial"], pdf["b"], pdf["z"], strict=True):
                    z = np.frombuffer(raw).reshape(atoms, -1)
                    k, t = np.nonzero(z)
                    yield pd.DataFrame({"trial": trial, "k": k.astype(np.int32), "t": (t + b * block).astype(np.int32), "z": z[k, t]})

        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.mapInPandas(run, "trial long, k int, t int, z double")

    # Sums over the uncut signal

    def _each(self, f, schema: str) -> DataFrame:
        out = self.views(0, f, schema)
        return out if self.count == 1 else out.unionByName(self.views(1, f, schema))

    def statistics(self, encoder: E.Encoder) -> E.Statistics:
        """Sums over all blocks: each pair of codes is counted in the block of its earlier one."""
        self._grown(len(encoder.d))
        d, length = encoder.d, self.length
        k, channels, _ = d.shape
        reg = np.broadcast_to(np.asarray(encoder.reg, dtype=float).reshape(-1), (k,))
        size = k * k * (2 * length - 1) + k * channels * length + 2 * k + 3

        def run(trial: int, b: int, v: View, _: pd.Series) -> pd.DataFrame:
            n, wide = v.places, np.concatenate([v.z, v.right], axis=1)
            ztz = np.zeros((k, k, 2 * length - 1))
            for lag in range(length):
                part = v.z @ wide[:, lag : lag + n].T
                ztz[:, :, length - 1 + lag] = part
                ztz[:, :, length - 1 - lag] = part.T
            ztx = np.zeros((k, channels, length))
            for i, t in zip(*np.nonzero(v.z), strict=True):
                ztx[i] += v.z[i, t] * v.x[:, t : t + length]
            x, r, l1 = v.own(v.x, length), v.own(v.residual(d), length), np.abs(v.z).sum(axis=1)
            sums = np.concatenate([ztz.ravel(), ztx.ravel(), np.count_nonzero(v.z, axis=1), l1, [np.sum(x * x), 0.5 * np.sum(r * r) + reg @ l1, float(v.last)]])
            return pd.DataFrame({"v": [sums.tobytes()]})

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for pdf in batches:
                for raw in pdf["v"]:
                    total += np.frombuffer(raw)
            yield pd.DataFrame({"i": np.arange(size), "v": total})

        got = self._each(run, "v binary").mapInPandas(summed, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # as large as the statistics
        return E.unpacked(got, k, channels, length)

    def worst_patch(self, d: np.ndarray | None) -> np.ndarray:
        """(P, length): the signal where the reconstruction misses most, across borders too; ties go to the first trial and start."""
        length, block, channels = self.length, self.block, self.channels
        if d is not None:
            self._grown(len(d))

        def run(trial: int, b: int, v: View, _: pd.Series) -> pd.DataFrame:
            r = v.residual(d) if d is not None else v.x
            e = np.convolve((r * r).sum(axis=0), np.ones(length), "valid")
            t = int(e.argmax())
            return pd.DataFrame({"trial": [trial], "t": [t + b * block], "e": [float(e[t])], "patch": [np.ascontiguousarray(v.x[:, t : t + length]).tobytes()]})

        best = self._each(run, "trial long, t long, e double, patch binary").orderBy(F.desc("e"), "trial", "t").limit(1).collect()
        if not best:
            raise ValueError("there is no trial to take a patch from")
        return np.frombuffer(best[0].patch, dtype=float).reshape(channels, length).copy()

    def lambda_max(self, d: np.ndarray, q: float = 1.0) -> np.ndarray:
        """(K,): as of the uncut signal, since every place is in one block with all of its samples."""
        blocks = self.spark.table(self.signal).select("trial", "x", F.lit(None).cast("binary").alias("w"), F.lit(None).cast("binary").alias("z"))
        return E.lambda_max(blocks, d, q)

    def random_patches(self, n: int, rng: np.random.RandomState) -> np.ndarray:
        """(n, P, length): patches at random places, cut where their blocks are."""
        return E.cut_patches(self.spark.table(self.signal).select("trial", "b", "x"), KEY, self.channels, self.length, n, rng)

    def energy(self) -> float:
        """Half the sum of all squares: the cost of no codes."""
        channels, length, count = self.channels, self.length, self.count

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own = [np.frombuffer(x).reshape(channels, -1) for x in pdf["x"]]
                own = [x if b == count - 1 else x[:, : x.shape[1] - length + 1] for x, b in zip(own, pdf["b"], strict=True)]
                yield pd.DataFrame({"v": [0.5 * sum(float(np.sum(x * x)) for x in own)]})

        return self.spark.table(self.signal).select("b", "x").mapInPandas(run, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]
