"""Objectives, gradients, scaling and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import convolution as C
from . import spread as S
from .quantiles import quantiles


def _fit(x: DataFrame, z: DataFrame, d: DataFrame, none: int | None = 0) -> DataFrame:
    """One row (fit): half the squared residual."""
    return C.residual_energy(x, z, d).agg((F.coalesce(F.sum("e"), F.lit(none)) / 2).cast("double").alias("fit"))


def objective(x: DataFrame, z: DataFrame, d: DataFrame, reg: float, none: int | None = 0) -> DataFrame:
    """One row (objective): half the squared residual plus reg times the sum of |z|; ``none`` is what a sum over no rows is, null in SQL."""
    l1 = z.agg(F.coalesce(F.sum(F.abs("z")), F.lit(none)).cast("double").alias("l1"))
    return _fit(x, z, d, none).crossJoin(l1).select((F.col("fit") + reg * F.col("l1")).alias("objective"))  # one row each


def per_atom_objective(x: DataFrame, z: DataFrame, d: DataFrame, reg: DataFrame, none: int | None = 0) -> DataFrame:
    """The same with a regularisation (k, reg) for each atom, each on its own activations."""
    l1 = z.groupBy("k").agg(F.sum(F.abs("z")).alias("l1")).join(reg, "k").agg(F.coalesce(F.sum(F.col("l1") * F.col("reg")), F.lit(none).cast("double")).alias("l1"))
    return _fit(x, z, d, none).crossJoin(l1).select((F.col("fit") + F.col("l1")).alias("objective"))


def fast_objective(ztz: DataFrame, ztx: DataFrame, xtx: DataFrame, z: DataFrame, d: DataFrame, length: int, reg: float, none: int | None = 0) -> DataFrame:
    """The objective from the sufficient statistics alone."""
    quadratic = C.convolve_statistics(ztz, d, length).join(d, ["k", "channel", "l"]).agg(F.coalesce(F.sum(F.col("v") * F.col("d")), F.lit(0)).alias("q"))
    linear = ztx.join(d, ["k", "channel", "l"]).agg(F.coalesce(F.sum(F.col("v") * F.col("d")), F.lit(0)).alias("m"))
    l1 = z.agg(F.coalesce(F.sum(F.abs("z")), F.lit(none)).alias("l1"))
    value = (F.col("q") / 2).cast("double") - F.col("m") + F.col("xtx") / 2 + reg * F.col("l1")
    return quadratic.crossJoin(linear).crossJoin(xtx).crossJoin(l1).select(value.cast("double").alias("objective"))


def weighted_objective(x: DataFrame, z: DataFrame, d: DataFrame, w: DataFrame, reg: float, none: int | None = 0) -> DataFrame:
    """Univariate: half the squared residual, each sample by its weight w (trial, t, w), plus reg times the sum of z."""
    x, d = x.withColumn("channel", F.lit(0)), d.withColumn("channel", F.lit(0))
    if (by := C.blockwise(d, (x, "x"), (z, "z"), (w, "w"))) is not None:
        fit = S.energies(x, z, *by, w).agg((F.sum("e") / 2).cast("double").alias("fit"))
    else:
        r = C.residual(x, z, d).join(w, ["trial", "t"])
        fit = r.agg((F.sum(F.col("w") * F.col("r") * F.col("r")) / 2).cast("double").alias("fit"))
    l1 = z.agg(F.coalesce(F.sum("z"), F.lit(none)).cast("double").alias("l1"))
    return fit.crossJoin(l1).select((F.col("fit") + reg * F.col("l1")).alias("objective"))


def feasible_objective(x: DataFrame, z: DataFrame, d: DataFrame, reg: float, none: int | None = 0) -> DataFrame:
    """The objective after atoms are brought into the unit ball and their activations are scaled up instead."""
    norm = d.groupBy("k").agg(F.greatest(F.lit(1.0), F.sqrt(F.sum(F.col("d") * F.col("d")))).alias("norm"))
    inside = d.join(norm, "k").select("k", "channel", "l", (F.col("d") / F.col("norm")).alias("d"))
    scaled = z.join(norm, "k").select("trial", "k", "t", (F.col("z") * F.col("norm")).alias("z"))
    return objective(x, scaled, inside, reg, none)


def feasible_objective_univariate(x: DataFrame, z: DataFrame, d: DataFrame, reg: float, none: int | None = 0) -> DataFrame:
    """The same for signals (trial, t, x) and atoms (k, l, d) without channels."""
    one = lambda df: df.withColumn("channel", F.lit(0))
    return feasible_objective(one(x), z, one(d), reg, none)


def gradient_z(x: DataFrame, z: DataFrame, d: DataFrame, reg: float, valid: int) -> DataFrame:
    """(trial, k, t, g) where the residual reaches; elsewhere the gradient is reg."""
    if (by := C.blockwise(d, (x, "x"), (z, "z"))) is not None:
        c = S.correlations(x, z, *by, valid)
    else:
        c = C.atom_correlation(C.residual(x, z, d), d, valid, "r")
    return c.select("trial", "k", "t", (F.lit(reg) - F.col("c")).alias("g"))


def weighted_gradient_z(x: DataFrame, z: DataFrame, d: DataFrame, w: DataFrame, reg: float, valid: int) -> DataFrame:
    """The univariate gradient with sample weights w (trial, t, w)."""
    one = d.withColumn("channel", F.lit(0))
    x = x.withColumn("channel", F.lit(0))
    if (by := C.blockwise(one, (x, "x"), (z, "z"), (w, "w"))) is not None:
        c = S.correlations(x, z, *by, valid, w)
    else:
        c = C.atom_correlation(C.residual(x, z, one).join(w, ["trial", "t"]).withColumn("r", F.col("r") * F.col("w")), one, valid, "r")
    return c.select("trial", "k", "t", (F.lit(reg) - F.col("c")).alias("g"))


def gradient_d(ztz: DataFrame, ztx: DataFrame, d: DataFrame, length: int) -> DataFrame:
    """(k, channel, l, g) from the statistics."""
    first = C.convolve_statistics(ztz, d, length)
    return first.union(ztx.select("k", "channel", "l", -F.col("v"))).groupBy("k", "channel", "l").agg(F.sum("v").alias("g"))


def gradient_d_from_residual(x: DataFrame, z: DataFrame, d: DataFrame, length: int) -> DataFrame:
    """The same from the signal."""
    return C.residual_correlation(z, x, d, length).select("k", "channel", "l", (-F.col("v")).alias("g"))


def gradient_uv(g: DataFrame, u: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((k, channel, g), (k, l, g)) of rank-1 atoms from the gradient g of the full ones."""
    by_u = g.join(v, ["k", "l"]).groupBy("k", "channel").agg(F.sum(F.col("g") * F.col("v")).alias("g"))
    by_v = g.join(u, ["k", "channel"]).groupBy("k", "l").agg(F.sum(F.col("g") * F.col("u")).alias("g"))
    return by_u, by_v


def gradient_norm(gz: DataFrame, gd: DataFrame) -> DataFrame:
    """One row: the norm of the gradient in d plus that of the gradient in z over the rows given.

    Integers are squared and summed as decimals of 38 digits, since their squares soon need more than 64 bits.
    """

    def total(g: DataFrame) -> DataFrame:
        of = F.col("g").cast("decimal(19,0)") if g.schema["g"].dataType.simpleString() in S.INTEGERS else F.col("g")
        return g.agg(F.sqrt(F.coalesce(F.sum(of * of).cast("double"), F.lit(0.0))).alias("n"))

    return total(gd).select(F.col("n").alias("a")).crossJoin(total(gz)).select((F.col("a") + F.col("n")).alias("norm"))


def lambda_max(x: DataFrame, d: DataFrame, valid: int, trials: DataFrame, q: float = 1.0) -> DataFrame:
    """(k, lambda_max): the largest correlation of each atom, or its q-quantile over all positions, zeros included."""
    c = C.atom_correlation(x, d, valid)
    if q >= 1.0:
        seen = c.groupBy("k").agg(F.max("c").alias("m"), F.count("*").alias("n"))
        all_positions = trials.select("trial").distinct().agg((F.count("*") * valid).alias("total"))
        floor = F.when(F.col("n") < F.col("total"), F.greatest("m", F.lit(0).cast(c.schema["c"].dataType))).otherwise(F.col("m"))
        every = d.select("k").distinct().join(seen, "k", "left").crossJoin(all_positions)  # one row; an atom without overlap has zeros alone
        return every.select("k", F.coalesce(floor, F.lit(0)).cast("double").alias("lambda_max"))
    places = trials.agg((F.countDistinct("trial") * valid).alias("places"))  # one row
    seen = d.select("k").distinct().join(c.groupBy("k").agg(F.count("*").alias("seen")), "k", "left").crossJoin(places)
    zeros = seen.select("k", (F.col("places") - F.coalesce("seen", F.lit(0))).alias("n"))
    return quantiles(c, ["k"], "c", {"lambda_max": q}, zeros)


def explained_variance(z: DataFrame, d: DataFrame, channels: int, times: int, trials: DataFrame, unused: bool = True) -> DataFrame:
    """(k, variance, rank): population variance of each atom's part, implicit zeros counted, largest first; of atoms without activations, if ``unused``, and without trials 0."""
    if (by := C.blockwise(d, (z, "z"))) is not None:
        moments = S.atom_moments(z, *by)
    else:
        moments = C.reconstruct_atoms(z, d).select("k", F.col("x").alias("s"), (F.col("x") * F.col("x")).alias("q"))
    part = moments.groupBy("k").agg(F.sum("s").cast("double").alias("s"), F.sum("q").cast("double").alias("q"))
    count = trials.select("trial").distinct().agg((F.count("*") * (channels * times)).cast("double").alias("n"))
    every = d.select("k").distinct().join(part, "k", "left" if unused else "inner").fillna(0.0).crossJoin(count)
    value = F.when(F.col("n") > 0, F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))).otherwise(0.0)
    return every.select("k", value.alias("variance")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "k")))  # one row for each atom


def nnz_per_atom(z: DataFrame, d: DataFrame, valid: int, trials: DataFrame) -> DataFrame:
    """(k, nnz, density) of every atom, unused ones too; density is over the ``valid`` positions of all trials."""
    used = z.where("z <> 0").groupBy("k").agg(F.count("*").alias("nnz"))
    positions = trials.agg((F.countDistinct("trial") * float(valid)).alias("positions"))
    every = d.select("k").distinct().join(used, "k", "left").crossJoin(positions)  # one row
    nnz = F.coalesce("nnz", F.lit(0)).cast("long")
    return every.select("k", nnz.alias("nnz"), (nnz / F.col("positions")).alias("density"))


def cross_correlation_score(x: DataFrame, hat: DataFrame) -> DataFrame:
    """(trial, score): normalised correlation of each trial with its reconstruction."""
    both = x.select("trial", "channel", "t", "x", F.lit(None).cast(hat.schema["x"].dataType).alias("h")).unionByName(hat.select("trial", "channel", "t", F.lit(None).cast(x.schema["x"].dataType).alias("x"), F.col("x").alias("h")))
    row = both.groupBy("trial", "channel", "t").agg(F.coalesce(F.sum("x"), F.lit(0)).cast("double").alias("x"), F.coalesce(F.sum("h"), F.lit(0)).cast("double").alias("h"))
    return _score(row.select("trial", (F.col("x") * F.col("h")).alias("xh"), (F.col("x") * F.col("x")).alias("xx"), (F.col("h") * F.col("h")).alias("hh")))


def reconstruction_score(x: DataFrame, z: DataFrame, d: DataFrame) -> DataFrame:
    """cross_correlation_score of the signal and the codes' reconstruction, which is never shuffled."""
    if (by := C.blockwise(d, (x, "x"), (z, "z"))) is not None:
        return _score(S.score_sums(x, z, *by))
    return cross_correlation_score(x, C.reconstruct(z, d))


def _score(parts: DataFrame) -> DataFrame:
    s = parts.groupBy("trial").agg(*(F.sum(c).cast("double").alias(c) for c in ("xh", "xx", "hh")))
    return s.select("trial", F.when((F.col("xx") > 0) & (F.col("hh") > 0), F.col("xh") / F.sqrt(F.col("xx") * F.col("hh"))).alias("score"))


def ista_step(x: DataFrame, z: DataFrame, d: DataFrame, reg: float, step: float, valid: int) -> DataFrame:
    """z after one proximal gradient step, positive entries only."""
    if (by := C.blockwise(d, (x, "x"), (z, "z"))) is not None:
        both = S.correlations(x, z, *by, valid, codes=True)
        step_by = F.coalesce(-step * (F.lit(reg) - F.col("c")), F.lit(0.0))
        return both.select("trial", "k", "t", (F.coalesce(F.col("z").cast("double"), F.lit(0.0)) + step_by).alias("z")).where("z > 0")
    g = gradient_z(x, z, d, reg, valid)
    moved = z.select("trial", "k", "t", F.col("z").cast("double").alias("z")).unionByName(g.select("trial", "k", "t", (-step * F.col("g")).alias("z")))
    return moved.groupBy("trial", "k", "t").agg(F.sum("z").alias("z")).where("z > 0")
