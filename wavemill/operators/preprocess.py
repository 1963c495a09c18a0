"""Splitting, tapering, scaling and reshaping of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as K
from ..functions.checks import needs


def split_signal(x: DataFrame, times: int, n_splits: int, taper: bool = False) -> DataFrame:
    """Trials of times // n_splits samples; the rest is dropped. Split s of trial n becomes trial n * n_splits + s."""
    size = times // n_splits
    out = x.where(F.col("t") < size * n_splits).select((F.col("trial") * n_splits + F.floor(F.col("t") / size)).cast("long").alias("trial"), "channel", (F.col("t") % size).cast("int").alias("t"), "x")
    return out.withColumn("x", F.col("x") * K.tukey(F.col("t"), size, 0.1, floor=None)) if taper else out


def as_univariate(x: DataFrame) -> DataFrame:
    """(trial, t, x) becomes a signal of one channel."""
    needs(x, ["trial", "t", "x"], ["channel"])
    return x.select("trial", F.lit(0).alias("channel"), "t", "x")


def as_multivariate(x: DataFrame) -> DataFrame:
    """(channel, t, x) becomes a signal of one trial."""
    needs(x, ["channel", "t", "x"], ["trial"])
    return x.select(F.lit(0).cast("long").alias("trial"), "channel", "t", "x")


def spread(x: DataFrame, total: int | None = None) -> DataFrame:
    """One row (std): the population deviation over everything, with ``total`` samples when zeros are left out."""
    if total is None:
        return x.agg(F.stddev_pop("x").alias("std"))
    s = x.agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    return s.select(F.sqrt(F.col("q") / total - (F.col("s") / total) * (F.col("s") / total)).alias("std"))


def rescale(x: DataFrame, total: int | None = None) -> DataFrame:
    """x divided by its deviation."""
    return x.crossJoin(F.broadcast(spread(x, total))).select("trial", "channel", "t", (F.col("x") / F.col("std")).alias("x"))  # one row


def taper(x: DataFrame, length: int, kind: str = "tukey", alpha: float = 0.5) -> DataFrame:
    """x times a Tukey (both ends 1e-9), Hamming or Blackman window."""
    shape = {"tukey": lambda: K.tukey(F.col("t"), length, alpha), "hamming": lambda: K.hamming(F.col("t"), length), "blackman": lambda: K.blackman(F.col("t"), length)}
    if kind not in shape:
        raise ValueError(f"kind must be one of {sorted(shape)}, not {kind!r}")
    return x.withColumn("x", F.col("x") * shape[kind]())


def pick_channels(x: DataFrame, channels: int | list[int]) -> DataFrame:
    """The first ``channels``, or those listed; a plain filter, pushed to the scan."""
    return x.where(F.col("channel") < channels) if isinstance(channels, int) else x.where(F.col("channel").isin(channels))


def equalize(x: DataFrame, how: str) -> DataFrame:
    """Trials of unequal length cut to the shortest ("crop") or filled with zeros to the longest ("zeropad")."""
    ends = x.groupBy("trial").agg(F.max("t").alias("last"))
    if how == "crop":
        return x.crossJoin(F.broadcast(ends.agg(F.min("last").alias("last")))).where("t <= last").drop("last")
    if how == "zeropad":
        last = ends.agg(F.max("last").alias("last"))
        pairs = x.select("trial", "channel").distinct().crossJoin(F.broadcast(last)).withColumn("t", F.explode(F.expr("sequence(0, last)"))).drop("last")
        return pairs.join(x, ["trial", "channel", "t"], "left").withColumn("x", F.coalesce("x", F.lit(0).cast(x.schema["x"].dataType)))
    raise ValueError(f"how must be crop or zeropad, not {how!r}")


def sliding_trials(x: DataFrame, times: int, size: int, overlap: int = 0, most: int | None = None) -> DataFrame:
    """Windows of ``size`` with ``overlap``, the first ``most`` of each trial: (trial, window, channel, t, x).

    Each sample is sent to the windows that hold it; their starts are arithmetic, so nothing is joined.
    """
    stride = size - overlap
    if stride < 1:
        raise ValueError("overlap must be below size")
    count = max(0, (times - size) // stride + 1)
    count = count if most is None else min(count, most)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (size - 1)) / stride).cast("int"))
    last = F.least(F.lit(count - 1), F.floor(F.col("t") / stride).cast("int"))
    inside = x.withColumn("lo", first).withColumn("hi", last).where("lo <= hi").withColumn("window", F.explode(F.sequence("lo", "hi")))
    return inside.select("trial", F.col("window").cast("int").alias("window"), "channel", (F.col("t") - F.col("window") * stride).cast("int").alias("t"), "x")


def lag_embedding(x: DataFrame, dim: int, lag: int = 1) -> DataFrame:
    """(trial, channel, t, i, x): sample t + i * lag for i < dim, where all of them exist."""
    at = x.withColumn("i", K.offsets(dim)).select("trial", "channel", (F.col("t") - F.col("i") * lag).alias("t"), "i", "x").where("t >= 0")
    whole = Window.partitionBy("trial", "channel", "t")
    return at.withColumn("n", F.count("*").over(whole)).where(F.col("n") == dim).drop("n")


def energy(x: DataFrame) -> DataFrame:
    """(trial, power): sum of squares of each trial."""
    return x.groupBy("trial").agg(F.sum(F.col("x") * F.col("x")).alias("power"))
