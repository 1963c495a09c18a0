"""Filters, resampling and spectra of series of any length, by blocks of time.

A series (trial, channel, t, x) has samples at t = 0 ... times - 1; absent ones are zeros. For a local filter a series is cut into blocks of
``block`` samples, each with the ``halo`` samples on both sides that its results need: only those travel twice. The last block takes what is left,
so every block is at least ``block`` long. Beyond its ends a series is continued by its point reflections. For spectra each
tapered window is a row, windows are transformed a batch at a time, and their squares are summed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import signal as S

SERIES = "trial long, channel int, t int, x double"
BLOCK = 1 << 16


def length_of(x: DataFrame, times: int | None) -> int:
    return times if times is not None else (x.agg(F.max("t")).first()[0] or 0) + 1


def by_blocks(x: DataFrame, times: int, block: int, halo: int, f: Callable[[np.ndarray, int, int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(t, x) = f(samples, begin, lo, hi) for each block lo ... hi - 1 of each series, as a series.

    samples begin at t = begin and hold halo samples on both sides of the block, reflected ones beyond the ends; a series that is no longer than the halo
    is continued as far as its reflection goes, by zeros after that.
    """
    count = max(1, times // block)
    if count > 1 and block <= halo:
        raise ValueError(f"blocks of {block} samples cannot hold a halo of {halo}")
    own = F.least(F.floor(F.col("t") / block), F.lit(count - 1)).cast("int")
    start = F.col("b") * block
    near = F.filter(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1), lambda i: (i >= 0) & (i < count) & ((i != F.col("b") - 1) | (F.col("t") - start < halo)) & ((i != F.col("b") + 1) | (start + block - F.col("t") <= halo)))
    inside = x.where((F.col("t") >= 0) & (F.col("t") < times)).select("trial", "channel", F.col("t").cast("int").alias("t"), F.col("x").cast("double").alias("x"))
    rows = inside.withColumn("b", own).withColumn("b", F.explode(near))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trial, channel, b = (pdf[c].iloc[0] for c in ("trial", "channel", "b"))
        lo, hi = int(b) * block, times if b == count - 1 else (int(b) + 1) * block
        begin, end = max(0, lo - halo), min(times, hi + halo)
        v = np.zeros(end - begin)
        v[pdf["t"].to_numpy() - begin] = pdf["x"]
        short = min(halo, len(v) - 1)
        zeros = np.zeros(halo - short)
        before = [zeros, 2 * v[0] - v[short:0:-1]] if lo == 0 else []
        after = [2 * v[-1] - v[-2 : -short - 2 : -1], zeros] if hi == times else []
        t, y = f(np.concatenate([*before, v, *after]), lo - halo, lo, hi)
        return pd.DataFrame({"trial": trial, "channel": channel, "t": t.astype(np.int32), "x": y})

    return rows.groupBy("trial", "channel", "b").applyInPandas(run, SERIES)


def fir(x: DataFrame, taps: np.ndarray, times: int | None = None, block: int = BLOCK) -> DataFrame:
    """Zero-phase filtering by an odd number of symmetric taps."""
    if len(taps) % 2 == 0:
        raise ValueError("taps must be odd")
    times = length_of(x, times)

    def run(v: np.ndarray, begin: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(lo, hi), S.convolved(v, taps)

    return by_blocks(x, times, max(block, len(taps)), len(taps) // 2, run)


def band(x: DataFrame, sfreq: float, low: float | None = None, high: float | None = None, taps: int = 101, times: int | None = None, block: int = BLOCK) -> DataFrame:
    """Passed between low and high (None: open)."""
    return fir(x, S.fir_taps(sfreq, low, high, taps), times, block)


def without_line(x: DataFrame, sfreq: float, freq: float, width: float = 1.0, times: int | None = None, block: int = BLOCK) -> DataFrame:
    """Without a narrow band around a frequency, by a filter that is long enough for its width."""
    return fir(x, S.notch_taps(sfreq, freq, width), times, block)


def resampled(x: DataFrame, sfreq: float, to: float, times: int | None = None, block: int = BLOCK, lobes: int = 16) -> DataFrame:
    """Each series at another rate: windowed-sinc interpolation, with a low pass at the lower rate's limit."""
    times = length_of(x, times)
    ratio, out = sfreq / to, max(1, round(times * to / sfreq))
    cut = min(1.0, 1.0 / ratio)
    reach = int(np.ceil(lobes / cut))

    def run(v: np.ndarray, begin: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        m = np.arange(int(np.ceil(lo / ratio)), min(out, int(np.ceil(hi / ratio))))
        place = m * ratio
        near = np.floor(place).astype(int)[:, None] + np.arange(1 - reach, reach + 1)[None, :]
        away = place[:, None] - near
        weight = np.sinc(cut * away) * (0.54 + 0.46 * np.cos(np.pi * np.clip(away / reach, -1, 1)))
        return m, (v[np.clip(near - begin, 0, len(v) - 1)] * weight).sum(axis=1) / weight.sum(axis=1)

    return by_blocks(x, times, max(block, reach + 2), reach + 1, run)


def windows(x: DataFrame, size: int, step: int, times: int) -> DataFrame:
    """(trial, channel, s, at): the samples (i, v) of each whole window that begins at a multiple of step."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (size - 1)) / step)).cast("int")
    last = F.least(F.lit((times - size) // step), F.floor(F.col("t") / step)).cast("int")
    rows = x.where((F.col("t") >= 0) & (F.col("t") < times)).withColumns({"first": first, "last": last}).where("first <= last")
    rows = rows.select("trial", "channel", F.explode(F.sequence("first", "last")).alias("s"), "t", F.col("x").cast("double").alias("v"))
    each = F.struct((F.col("t") - F.col("s") * step).cast("int").alias("i"), "v")
    return rows.groupBy("trial", "channel", "s").agg(F.collect_list(each).alias("at"))


def periodogram(x: DataFrame, size: int, step: int | None = None, taper: np.ndarray | None = None, times: int | None = None) -> DataFrame:
    """(trial, channel, f, power) for f = 0 ... size - 1: the averaged spectrum of tapered windows, half a window apart by default.

    Its mean over all frequencies is the variance of white noise. A window without a sample counts as zeros.
    """
    times = length_of(x, times)
    step, w = size // 2 if step is None else step, np.hamming(size) if taper is None else taper
    if times < size:
        raise ValueError("the series is shorter than a block")
    number = (times - size) // step + 1
    scale = number * float(np.sum(w * w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, pairs = lists.offsets.to_numpy(), lists.values
            place, value = (pairs.field(c).to_numpy(zero_copy_only=False)[pairs.offset :] for c in (0, 1))
            rows = np.zeros((batch.num_rows, size))
            rows[np.repeat(np.arange(batch.num_rows), np.diff(bounds)), place[bounds[0] : bounds[-1]]] = value[bounds[0] : bounds[-1]]
            power = np.abs(np.fft.fft(rows * w, axis=1)) ** 2
            keys, back = np.unique(np.stack([batch.column(i).to_numpy() for i in range(2)]), axis=1, return_inverse=True)
            sums = np.zeros((keys.shape[1], size))
            np.add.at(sums, back.ravel(), power)
            columns = [pa.array(np.repeat(keys[0], size)), pa.array(np.repeat(keys[1], size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(sums))), pa.array(sums.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["trial", "channel", "f", "power"])

    found = windows(x, size, step, times).select("trial", "channel", "at").mapInArrow(run, "trial long, channel int, f int, power double")
    return found.groupBy("trial", "channel", "f").agg((F.sum("power") / scale).alias("power"))


def ar_models(spectra: DataFrame, size: int, order: int) -> DataFrame:
    """(trial, channel, i, a, variance): Yule-Walker models of the spectra (trial, channel, f, power), which are ``size`` rows a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        power = np.zeros(size)
        power[pdf["f"]] = pdf["power"]
        a, variance = S.yule_walker(power, order)
        return pd.DataFrame({"trial": pdf["trial"].iloc[0], "channel": pdf["channel"].iloc[0], "i": np.arange(order, dtype=np.int32), "a": a, "variance": variance})

    return spectra.groupBy("trial", "channel").applyInPandas(run, "trial long, channel int, i int, a double, variance double")


def matched_windows(x: DataFrame, length: int, gap: int, times: int, chains: int = 8, max_iter: int = 500, temperature: float = 1.0, cooling: bool = True, seed: int = 0) -> DataFrame:
    """(trial, channel, chain, cost, starts) of the best of several chains of sliding window matching for each series; ties go to the first chain.

    Each chain of each series is a row, so that chains of one series run in different tasks; a series itself fits in a task. One that has not two windows
    has none.
    """
    from ..kernels.motifs import match_windows

    at = F.collect_list(F.struct(F.col("t").cast("int").alias("i"), F.col("x").cast("double").alias("v")))
    packed = x.where((F.col("t") >= 0) & (F.col("t") < times)).groupBy("trial", "channel").agg(at.alias("at"))
    each = packed.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    dealt = each.repartition("trial", "channel", "chain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for trial, channel, chain, at in zip(pdf["trial"], pdf["channel"], pdf["chain"], pdf["at"], strict=True):
                v = np.zeros(times)
                v[[p["i"] for p in at]] = [p["v"] for p in at]
                if times - length > 2 * gap:
                    _, starts, costs = match_windows(v, length, gap, max_iter=max_iter, temperature=temperature, cooling=cooling, seed=seed + int(chain))
                    out.append((trial, channel, chain, float(costs[-1]), starts.tolist()))
            yield pd.DataFrame(out, columns=["trial", "channel", "chain", "cost", "starts"])

    found = dealt.select("trial", "channel", "chain", "at").mapInPandas(run, "trial long, channel int, chain int, cost double, starts array<int>")
    best = found.groupBy("trial", "channel").agg(F.min_by(F.struct("chain", "cost", "starts"), F.struct("cost", "chain")).alias("best"))
    return best.select("trial", "channel", "best.*")
