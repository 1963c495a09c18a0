"""Recordings in Parquet, cleaned and cut into trials: chains of the preprocessing operators.

A recording is a long signal (trial, channel, t, x), an event table has rows (sample, event_id). Filters run on each series of a
channel; everything else is relational. With ``block`` filters and resampling go by blocks of so many samples (``operators.series``), for
recordings of any length; without it each series is one task's, and notches and resampling are those of its whole spectrum.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import tukey
from ..kernels import signal as S
from ..operators import preprocess as P
from ..operators import series
from .files import pick_trials, read_signal


def filtered(x: DataFrame, sfreq: float, notch: tuple[float, ...] = (), low: float | None = None, high: float | None = None, block: int | None = None, times: int | None = None) -> DataFrame:
    """x without narrow bands around the notch frequencies, passed between low and high (None: open); x itself if nothing is asked for."""
    if not notch and low is None and high is None:
        return x
    if block is not None:
        times = series.length_of(x, times)
        for f in notch:
            x = series.without_line(x, sfreq, f, times=times, block=block)
        return x if low is None and high is None else series.band(x, sfreq, low, high, times=times, block=block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = pdf["x"].to_numpy(dtype=float)
        for f in notch:
            v = S.notch(v, sfreq, f)
        if low is not None or high is not None:
            v = S.fir_filter(v, sfreq, low, high)
        return pdf.assign(x=v)

    rows = x.select("trial", "channel", "t", F.col("x").cast("double").alias("x"))
    return rows.groupBy("trial", "channel").applyInPandas(run, "trial long, channel int, t int, x double")


def resampled(x: DataFrame, sfreq: float, to: float, block: int | None = None, times: int | None = None) -> DataFrame:
    """Each series at another rate, by its spectrum or, in blocks, by interpolation."""
    if to == sfreq:
        return x
    if block is not None:
        return series.resampled(x, sfreq, to, times, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = S.resample(pdf["x"].to_numpy(dtype=float), max(1, round(len(pdf) * to / sfreq)))
        return pd.DataFrame({"trial": pdf["trial"].iloc[0], "channel": pdf["channel"].iloc[0], "t": range(len(v)), "x": v})

    return x.groupBy("trial", "channel").applyInPandas(run, "trial long, channel int, t int, x double")


def epochs(x: DataFrame, events: DataFrame, lo: int, hi: int, reject: float | None = None) -> DataFrame:
    """A trial for each event of a recording of one trial: samples lo to hi around it, trial = the event's sample.

    Events whose window leaves the recording are left out, and with ``reject`` those in which a channel spans more than that.
    """
    ends = x.agg(F.min("t").alias("first"), F.max("t").alias("last"))  # one row
    inside = events.select("sample").distinct().crossJoin(F.broadcast(ends)).where(f"sample + {lo} >= first AND sample + {hi} <= last").select("sample")
    around = inside.withColumn("o", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).select("sample", (F.col("o") - lo).cast("int").alias("o"), (F.col("sample") + F.col("o")).cast("int").alias("t"))
    cut = x.join(around, "t").select(F.col("sample").cast("long").alias("trial"), "channel", F.col("o").alias("t"), "x")
    if reject is None:
        return cut
    wild = cut.groupBy("trial", "channel").agg((F.max("x") - F.min("x")).alias("span")).where(F.col("span") > reject).select("trial").distinct()
    return cut.join(wild, "trial", "left_anti")


def tapered(x: DataFrame, times: int, alpha: float = 0.1) -> DataFrame:
    return x.withColumn("x", F.col("x") * tukey(F.col("t"), times, alpha, floor=None))


def load_data(
    spark: SparkSession,
    path: str,
    times: int,
    sfreq: float,
    n_splits: int = 10,
    events: DataFrame | None = None,
    epoch: tuple[int, int] | None = None,
    reject: float | None = None,
    notch: tuple[float, ...] = (),
    low: float | None = 2.0,
    high: float | None = None,
    to_sfreq: float | None = None,
    block: int | None = None,
) -> DataFrame:
    """A recording of ``times`` samples: filtered, resampled, cut into epochs or ``n_splits`` splits, tapered, over its deviation."""
    x = filtered(read_signal(spark, path), sfreq, notch, low, high, block, times)
    if to_sfreq is not None and to_sfreq != sfreq:
        x, times = resampled(x, sfreq, to_sfreq, block, times), max(1, round(times * to_sfreq / sfreq))
    if epoch is not None:
        if events is None:
            raise ValueError("epochs need events")
        x, size = epochs(x, events, *epoch, reject), epoch[1] - epoch[0] + 1
    else:
        x, size = P.split_signal(x, times, n_splits), times // n_splits
    return P.rescale(tapered(x, size))


def load_one_record(spark: SparkSession, path: str, sfreq: float, channels: list[int] | int | None = None, to_sfreq: float | None = None, notch: tuple[float, ...] = (60.0, 120.0), low: float | None = 2.0, high: float | None = None, block: int | None = None) -> DataFrame:
    """One recording: chosen channels, notches, a band, another rate."""
    x = read_signal(spark, path)
    x = x if channels is None else P.pick_channels(x, channels)
    x = filtered(x, sfreq, tuple(f for f in notch if f < sfreq / 2), low, high, block)
    return x if to_sfreq is None else resampled(x, sfreq, to_sfreq, block)


def load_records(spark: SparkSession, path: str, n_trials: int, seed: int = 0, equalise: str = "crop") -> DataFrame:
    """``n_trials`` recordings picked by a seeded hash, made of one length, over the deviation of them all."""
    return P.rescale(P.equalize(pick_trials(read_signal(spark, path), n_trials, seed), equalise))


def each_record(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """f(record over its own deviation, batch id) for each micro-batch of a stream of recordings, one file a batch; empty ones are skipped."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropna(subset=["trial", "channel", "t", "x"])
        if not rows.isEmpty():
            f(P.rescale(rows), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
