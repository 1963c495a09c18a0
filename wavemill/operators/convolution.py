"""Convolutions, correlations and sufficient statistics as equi-joins on a shifted time.

The generator that makes the shift stands on the row (``explode`` of a sequence), never in a joined table of lags: then the
optimiser sees an equality on (trial, time) and hashes on both. All sums are two-phase aggregations; their results are as small as
the dictionary. Dictionaries come from the driver, so Spark knows their size and picks the join; nothing is hinted.

Where atoms of a few channels meet a signal or a code, blocks of trials are sorted and widened a few thousand rows at a time
(``spread``), so that no task hashes the widened rows. With more than MOST_WIDE channels they stay rows, with the same results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lags, offsets
from ..kernels.sparse import Taps
from . import spread as S
from .spread import value_type


def grid(trials: DataFrame, channels: int, times: int) -> DataFrame:
    """All (trial, channel, t) of the trials."""
    return trials.select("trial").distinct().withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def dense(x: DataFrame, channels: int, times: int, trials: DataFrame | None = None) -> DataFrame:
    """x with its zeros."""
    full = grid(x if trials is None else trials, channels, times)
    return full.join(x, ["trial", "channel", "t"], "left").select("trial", "channel", "t", F.coalesce("x", F.lit(0).cast(x.schema["x"].dataType)).alias("x"))


#: Channels of a dictionary that blocks take at most.
MOST_WIDE = 32


def taps(d: DataFrame) -> Taps | None:
    """The dictionary (k, channel, l, d) on the driver, or None where it is empty or has too many channels."""
    channels = sorted(r.channel for r in d.select("channel").where("channel IS NOT NULL").distinct().limit(MOST_WIDE + 1).collect())
    if not channels or len(channels) > MOST_WIDE or value_type(d) is None:
        return None
    rows = d.select("k", "channel", "l", "d").where("k IS NOT NULL AND channel IS NOT NULL AND l IS NOT NULL AND d IS NOT NULL").collect()
    if not rows or min(r.l for r in rows) < 0:
        return None
    ks = sorted({r.k for r in rows})
    shape = (len(ks), max(r.l for r in rows) + 1, len(channels))
    value, there = np.zeros(shape, dtype=np.int64 if value_type(d) == "bigint" else float), np.zeros(shape, dtype=bool)
    for r in rows:
        at = ks.index(r.k), r.l, channels.index(r.channel)
        value[at] += r.d
        there[at] = True
    return Taps(np.array(ks), np.array(channels), value, there)


def blockwise(d: DataFrame, *of: tuple[DataFrame | None, str]) -> tuple[Taps, str] | None:
    """(taps, type of the sums) where blocks take the dictionary and these columns."""
    kind = value_type(d, *of)
    found = None if kind is None else taps(d)
    return None if found is None else (found, kind)


def reconstruct(z: DataFrame, d: DataFrame) -> DataFrame:
    """(trial, channel, t, x): the sum of the atoms at their activations; zeros are left out."""
    if (by := blockwise(d, (z, "z"))) is not None:
        return S.reconstructed(z, *by)
    shifted = z.join(d, "k").select("trial", "channel", (F.col("t") + F.col("l")).alias("t"), (F.col("z") * F.col("d")).alias("x"))
    return shifted.groupBy("trial", "channel", "t").agg(F.sum("x").alias("x"))


def reconstruct_univariate(z: DataFrame, d: DataFrame) -> DataFrame:
    """(trial, t, x) for atoms (k, l, d) of one channel."""
    return reconstruct(z, d.withColumn("channel", F.lit(0))).drop("channel")


def reconstruct_atoms(z: DataFrame, d: DataFrame) -> DataFrame:
    """(k, trial, channel, t, x): each atom's own part."""
    if (by := blockwise(d, (z, "z"))) is not None:
        return S.reconstructed_atoms(z, *by)
    shifted = z.join(d, "k").select("k", "trial", "channel", (F.col("t") + F.col("l")).alias("t"), (F.col("z") * F.col("d")).alias("x"))
    return shifted.groupBy("k", "trial", "channel", "t").agg(F.sum("x").alias("x"))


def residual(x: DataFrame, z: DataFrame, d: DataFrame) -> DataFrame:
    """(trial, channel, t, r): signal minus reconstruction, by a union and a sum instead of an outer join."""
    if (by := blockwise(d, (x, "x"), (z, "z"))) is not None:
        return S.residuals(x, z, *by)
    hat = reconstruct(z, d).withColumn("x", -F.col("x"))
    return x.select("trial", "channel", "t", "x").union(hat.select("trial", "channel", "t", "x")).groupBy("trial", "channel", "t").agg(F.sum("x").alias("r"))


def code_correlation(z: DataFrame, length: int) -> DataFrame:
    """ztz: (k, k2, dt, v) for |dt| < length."""
    left = z.withColumn("dt", lags(length)).select("trial", (F.col("t") + F.col("dt")).alias("t"), "k", "dt", "z")
    right = z.select("trial", "t", F.col("k").alias("k2"), F.col("z").alias("z2"))
    return left.join(right, ["trial", "t"]).groupBy("k", "k2", "dt").agg(F.sum(F.col("z") * F.col("z2")).alias("v"))


def signal_correlation(z: DataFrame, x: DataFrame, length: int) -> DataFrame:
    """ztX: (k, channel, l, v)."""
    left = z.withColumn("l", offsets(length)).select("trial", (F.col("t") + F.col("l")).alias("t"), "k", "l", "z")
    return left.join(x.select("trial", "channel", "t", "x"), ["trial", "t"]).groupBy("k", "channel", "l").agg(F.sum(F.col("z") * F.col("x")).alias("v"))


def atom_gram(d: DataFrame, length: int) -> DataFrame:
    """DtD: (k, k2, dt, v)."""
    left = d.withColumn("dt", lags(length)).select("channel", (F.col("l") + F.col("dt")).alias("l"), "k", "dt", "d")
    right = d.select("channel", "l", F.col("k").alias("k2"), F.col("d").alias("d2"))
    return left.join(right, ["channel", "l"]).groupBy("k", "k2", "dt").agg(F.sum(F.col("d") * F.col("d2")).alias("v"))


def rank1_gram(u: DataFrame, v: DataFrame, length: int) -> DataFrame:
    """DtD of atoms u (k, channel, u) x v (k, l, v): the product of two small correlations."""
    uu = u.join(u.select(F.col("k").alias("k2"), "channel", F.col("u").alias("u2")), "channel").groupBy("k", "k2").agg(F.sum(F.col("u") * F.col("u2")).alias("uu"))
    left = v.withColumn("dt", lags(length)).select((F.col("l") + F.col("dt")).alias("l"), "k", "dt", "v")
    vv = left.join(v.select(F.col("k").alias("k2"), "l", F.col("v").alias("v2")), "l").groupBy("k", "k2", "dt").agg(F.sum(F.col("v") * F.col("v2")).alias("vv"))
    return vv.join(uu, ["k", "k2"]).select("k", "k2", "dt", (F.col("uu") * F.col("vv")).alias("v"))


def convolve_statistics(ztz: DataFrame, d: DataFrame, length: int) -> DataFrame:
    """ztz * D: (k, channel, l, v) with v[k, p, t] = sum over k', m of ztz[k, k', t - m] D[k', p, m]."""
    other = d.select(F.col("k").alias("k2"), "channel", F.col("l").alias("m"), "d")
    joined = ztz.join(other, "k2").withColumn("l", F.col("m") + F.col("dt"))
    return joined.where((F.col("l") >= 0) & (F.col("l") < length)).groupBy("k", "channel", "l").agg(F.sum(F.col("v") * F.col("d")).alias("v"))


def convolve_statistics_rank1(ztz: DataFrame, u: DataFrame, v: DataFrame, length: int) -> DataFrame:
    """The same for D = u x v: the time join first, which is free of channels, then the channels."""
    other = v.select(F.col("k").alias("k2"), F.col("l").alias("m"), F.col("v").alias("atom"))
    times = ztz.join(other, "k2").withColumn("l", F.col("m") + F.col("dt")).where((F.col("l") >= 0) & (F.col("l") < length)).groupBy("k", "k2", "l").agg(F.sum(F.col("v") * F.col("atom")).alias("s"))
    return times.join(u.select(F.col("k").alias("k2"), "channel", "u"), "k2").groupBy("k", "channel", "l").agg(F.sum(F.col("s") * F.col("u")).alias("v"))


def atom_correlation(x: DataFrame, d: DataFrame, valid: int, value: str = "x") -> DataFrame:
    """(trial, k, t, c): correlation of the signal with each atom at the ``valid`` positions."""
    if (by := blockwise(d, (x, value))) is not None:
        return S.correlations(x.select("trial", "channel", "t", F.col(value).alias("x")), None, *by, valid)
    joined = x.join(d, "channel").withColumn("s", F.col("t") - F.col("l")).where((F.col("s") >= 0) & (F.col("s") < valid))
    return joined.groupBy("trial", "k", F.col("s").alias("t")).agg(F.sum(F.col(value) * F.col("d")).alias("c"))


def rank1_correlation(x: DataFrame, u: DataFrame, v: DataFrame, valid: int, value: str = "x") -> DataFrame:
    """The same for D = u x v; where blocks do not take it, channels are summed before the time join widens the rows."""
    full = u.join(v, "k").select("k", "channel", "l", (F.col("u") * F.col("v")).alias("d"))
    if (by := blockwise(full, (x, value))) is not None:
        return S.correlations(x.select("trial", "channel", "t", F.col(value).alias("x")), None, *by, valid)
    mixed = x.join(u, "channel").groupBy("trial", "k", "t").agg(F.sum(F.col(value) * F.col("u")).alias("x"))
    joined = mixed.join(v, "k").withColumn("s", F.col("t") - F.col("l")).where((F.col("s") >= 0) & (F.col("s") < valid))
    return joined.groupBy("trial", "k", F.col("s").alias("t")).agg(F.sum(F.col("x") * F.col("v")).alias("c"))


def residual_energy(x: DataFrame, z: DataFrame, d: DataFrame) -> DataFrame:
    """(trial, t, e): the squared residual of a sample, summed over channels."""
    if (by := blockwise(d, (x, "x"), (z, "z"))) is not None:
        return S.energies(x, z, *by)
    r = residual(x, z, d)
    return r.groupBy("trial", "t").agg(F.sum(F.col("r") * F.col("r")).alias("e"))


def residual_patch_error(x: DataFrame, z: DataFrame, d: DataFrame, length: int, times: int) -> DataFrame:
    """patch_error of the residual, from the signal: no residual is shuffled."""
    if (by := blockwise(d, (x, "x"), (z, "z"))) is not None:
        return S.patch_energies(x, z, *by, length, times - length)
    return patch_error(residual_energy(x, z, d), length, times)


def residual_correlation(z: DataFrame, x: DataFrame, d: DataFrame, length: int) -> DataFrame:
    """signal_correlation of the codes with the residual, from the signal."""
    if (by := blockwise(d, (x, "x"), (z, "z"))) is not None:
        x, z = (df.where("trial IS NOT NULL") for df in (x, z))  # they meet by their trials
        return S.code_products(x, z, *by, length).groupBy("k", "channel", "l").agg(F.sum("v").alias("v"))
    return signal_correlation(z, residual(x, z, d).withColumnRenamed("r", "x"), length)


def patch_error(r: DataFrame, length: int, times: int) -> DataFrame:
    """(trial, t, e) for 0 <= t <= times - length: squared residual over the patch that starts at t.

    Sparse residuals (trial, channel, t, r), or their energies (trial, t, e), are spread to the starts they belong to, by blocks, so no
    long trial is ever sorted in one task.
    """
    square = r if "e" in r.columns else r.select("trial", "t", (F.col("r") * F.col("r")).alias("e"))
    kind = value_type(square.withColumnRenamed("e", "d"), (square, "e"))
    if kind is not None:
        return S.spread_energies(square, kind, length, times - length)
    spread = square.withColumn("o", offsets(length)).withColumn("s", F.col("t") - F.col("o"))
    return spread.where((F.col("s") >= 0) & (F.col("s") <= times - length)).groupBy("trial", F.col("s").alias("t")).agg(F.sum("e").alias("e"))


def max_error_patch(r: DataFrame, x: DataFrame, length: int, times: int) -> DataFrame:
    """(channel, l, d): the signal in the patch of largest error; ties go to the first trial, then the first start."""
    return worst_patch(patch_error(r, length, times), x, length)


def worst_patch(errors: DataFrame, x: DataFrame, length: int) -> DataFrame:
    """The same from the errors (trial, t, e) of patches."""
    best = errors.orderBy(F.desc("e"), "trial", "t").limit(1).select(F.col("trial").alias("n0"), F.col("t").alias("t0"))
    at = best.withColumn("l", offsets(length)).select(F.col("n0").alias("trial"), (F.col("t0") + F.col("l")).alias("t"), "l")
    return x.join(F.broadcast(at), ["trial", "t"]).select("channel", "l", F.col("x").alias("d"))  # length rows


def constants(z: DataFrame, x: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ztz, ztX, XtX): all that a dictionary step needs."""
    return code_correlation(z, length), signal_correlation(z, x, length), x.agg(F.sum(F.col("x") * F.col("x")).alias("xtx"))


def running_patch_error(r: DataFrame, length: int, times: int) -> DataFrame:
    """patch_error over a dense residual by a framed window, for trials short enough to sort."""
    square = r.groupBy("trial", "t").agg(F.sum(F.col("r") * F.col("r")).alias("e"))
    frame = Window.partitionBy("trial").orderBy("t").rangeBetween(0, length - 1)
    return square.select("trial", "t", F.sum("e").over(frame).alias("e")).where(F.col("t") <= times - length)
