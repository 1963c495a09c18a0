"""Analysis of activations: epochs around events, surrogates, densities, energies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import blackman
from .quantiles import quantiles


def on_one_axis(z: DataFrame, times: int) -> DataFrame:
    """Codes of consecutive splits on one time axis: (k, sample, z)."""
    return z.select("k", (F.col("trial") * times + F.col("t")).cast("long").alias("sample"), "z")


def epoch_codes(axis: DataFrame, events: DataFrame, lo: int, hi: int) -> DataFrame:
    """(epoch, k, o, z) for lo <= o <= hi around each event (epoch, sample): an interval join.

    The window is exploded on the event, whose table is the smaller one, so the join is an equality on the sample.
    """
    around = events.withColumn("o", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).select("epoch", "o", (F.col("sample") + F.col("o")).cast("long").alias("sample"))
    return axis.join(around, "sample").select("epoch", "k", "o", "z")


def evoked(epochs: DataFrame, n_epochs: int) -> DataFrame:
    """(k, o, mean) over epochs, absent activations counted as zero."""
    return epochs.groupBy("k", "o").agg((F.sum("z") / float(n_epochs)).alias("mean"))


def surrogate_events(events: DataFrame, n_surrogates: int, samples: int, lo: int, hi: int, seed: int) -> DataFrame:
    """(surrogate, epoch, sample): for each surrogate as many random times as there are events, their windows inside the axis.

    A time is a hash of the event and the surrogate's number, so it is alike in every run and no table of times is drawn anywhere. The
    events are dealt over all cores first: they are few and small, and every one of them is hashed many times.
    """
    dealt = events.repartition(4 * events.sparkSession.sparkContext.defaultParallelism, "sample")
    each = dealt.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n_surrogates - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), "surrogate", "sample")), 1, 8), 16, 10).cast("long")
    return each.select("surrogate", "epoch", (F.lit(-min(lo, 0)) + drawn % (samples - max(hi, 0) + min(lo, 0))).cast("long").alias("sample"))


def surrogate_evoked(axis: DataFrame, events: DataFrame, lo: int, hi: int, n_events: int) -> DataFrame:
    """(surrogate, k, o, mean) for all surrogates in one job; events (surrogate, epoch, sample), ``n_events`` of each surrogate.

    Times meet the activations of their block of the axis, which is as wide as a window, and of the block behind it: a time is shuffled
    once and not once for each place of its window. There are far more times than activations, so those are hashed in the tasks; they
    grow with the axis and are never broadcast through the driver.
    """
    width = hi - lo + 1
    reached = F.explode(F.sequence(F.floor((F.col("sample") - hi) / width), F.floor((F.col("sample") - lo) / width)))
    near = axis.select(reached.alias("block"), "k", F.col("sample").alias("at"), "z").hint("shuffle_hash")
    times = events.select("surrogate", F.floor(F.col("sample") / width).alias("block"), "sample")
    met = times.join(near, "block").withColumn("o", (F.col("at") - F.col("sample")).cast("int")).where((F.col("o") >= lo) & (F.col("o") <= hi))
    sums = met.groupBy("surrogate", "k", "o").agg(F.sum("z").alias("s"))
    return sums.select("surrogate", "k", "o", (F.col("s") / float(n_events)).alias("mean"))


def evoked_thresholds(surrogates: DataFrame, atoms: DataFrame, ids: DataFrame, width: int, q: float) -> DataFrame:
    """(k, low, high): percentiles of each surrogate's minimum and maximum; positions without activation are zeros."""
    seen = surrogates.groupBy("surrogate", "k").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.count("*").alias("n"))
    every = ids.select("surrogate").distinct().crossJoin(F.broadcast(atoms.select("k").distinct())).join(seen, ["surrogate", "k"], "left")
    zero = F.coalesce("n", F.lit(0)) < width
    lo = F.when(zero, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(zero, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi"))
    return every.groupBy("k").agg(F.percentile(lo, q).alias("low"), F.percentile(hi, 1 - q).alias("high"))


def activation_density(z: DataFrame, bandwidth: int, share: float = 0.01) -> DataFrame:
    """(k, t, density): activations summed over trials, those above ``share`` of the atom's largest, smoothed by a Blackman window."""
    total = z.groupBy("k", "t").agg(F.sum("z").cast("double").alias("z"))
    top = total.groupBy("k").agg(F.max("z").alias("top"))
    kept = total.join(top, "k").where(F.col("z") > share * F.col("top")).select("k", "t", "z")
    half = bandwidth // 2
    moved = kept.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(bandwidth - 1)))).withColumn("w", blackman(F.col("o"), bandwidth))
    return moved.groupBy("k", (F.col("t") + F.col("o") - half).alias("t")).agg(F.sum(F.col("z") * F.col("w")).alias("density"))


def kernel_density(z: DataFrame, bandwidth: int) -> DataFrame:
    """(k, t, density): a Blackman kernel estimate of where an atom is active, each activation by its share of the atom's total; sums to one."""
    half, centre = bandwidth // 2, F.col("o")
    kernel = blackman(centre, bandwidth)
    whole = sum(0.42 - 0.5 * math.cos(2 * math.pi * o / (bandwidth - 1)) + 0.08 * math.cos(4 * math.pi * o / (bandwidth - 1)) for o in range(bandwidth))
    at = z.groupBy("k", "t").agg(F.sum("z").cast("double").alias("z"))
    share = at.join(at.groupBy("k").agg(F.sum("z").alias("all")), "k").withColumn("z", F.col("z") / F.col("all"))
    moved = share.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(bandwidth - 1))))
    return moved.groupBy("k", (F.col("t") + F.col("o") - half).alias("t")).agg(F.sum(F.col("z") * kernel / whole).alias("density"))


def box_energy(dense_z: DataFrame, width: int) -> DataFrame:
    """(trial, k, t, e): sum over the ``width`` samples that end at t."""
    frame = Window.partitionBy("trial", "k").orderBy("t").rowsBetween(1 - width, 0)
    return dense_z.select("trial", "k", "t", F.sum("z").over(frame).cast("double").alias("e"))


def log_ratio(e: DataFrame, baseline: int, floor: float = 1e-4) -> DataFrame:
    """(trial, k, t, ratio): log10 of the energy over its mean in the first ``baseline`` samples, both at least ``floor``."""
    # Over the same groups as ``box_energy``, so the energies are neither shuffled nor made again.
    base = F.avg(F.when(F.col("t") < baseline, F.col("e"))).over(Window.partitionBy("trial", "k"))
    based = e.withColumn("b", base).where("b IS NOT NULL")
    return based.select("trial", "k", "t", F.log10(F.greatest("e", F.lit(floor)) / F.greatest("b", F.lit(floor))).alias("ratio"))


def whiskers(ratio: DataFrame, second: int) -> DataFrame:
    """(k, part, q25, q50, q75) of baseline, evoked (0 to 1 s) and induced (1 to 2 s) samples; ``second`` samples make one, time 0 follows the baseline."""
    part = F.when(F.col("t") < second, "baseline").when(F.col("t") < 2 * second, "evoked").when(F.col("t") < 3 * second, "induced")
    named = ratio.withColumn("part", part).where("part IS NOT NULL").withColumnRenamed("part", "phase")
    found = quantiles(named, ["k", "phase"], "ratio", {f"q{q}": q / 100 for q in (25, 50, 75)})
    return found.withColumnRenamed("phase", "part")


def convergence_curve(trace: DataFrame) -> DataFrame:
    """(iter, seconds, gap): time so far and the objective's relative distance to the best; the trace is one row a half-step."""
    so_far = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    best = F.min("objective").over(Window.partitionBy())
    return trace.select("iter", F.sum("seconds").over(so_far).alias("seconds"), ((F.col("objective") - best) / best + 1e-6).alias("gap"))


def normalized_codes(z: DataFrame) -> DataFrame:
    """z over the largest |z| of its atom."""
    top = z.groupBy("k").agg(F.max(F.abs("z")).cast("double").alias("top"))
    return z.join(top, "k").select("trial", "k", "t", (F.col("z") / F.col("top")).alias("z"))


def geometric_mean(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.exp(F.avg(F.log(value))).alias("gmean"))


def window_distance(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, cost): mean squared distance over pairs of z-scored windows (*by, window, i, x), in closed form.

    The sum over pairs of |a - b|^2 is n sum |a|^2 - |sum a|^2: two aggregations instead of a join of all pairs.
    """
    by = by or []
    stats = windows.groupBy(*by, "window").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scored = windows.join(stats, [*by, "window"]).select(*by, "window", "i", ((F.col("x") - F.col("m")) / F.col("s")).alias("x"))
    by_i = scored.groupBy(*by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    cost = 2 * F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")) / F.max(F.col("n") * (F.col("n") - 1))
    return by_i.groupBy(*by).agg(cost.alias("cost"))
