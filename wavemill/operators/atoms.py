"""Projections and changes of form of dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def project_d(d: DataFrame) -> DataFrame:
    """Full atoms in the unit ball, with the norm each was divided by (1 inside the ball)."""
    norm = d.groupBy("k").agg(F.greatest(F.lit(1.0), F.sqrt(F.sum(F.col("d").cast("double") * F.col("d")))).alias("norm"))
    return d.join(norm, "k").select("k", "channel", "l", (F.col("d") / F.col("norm")).alias("d"), "norm")


def project_uv(u: DataFrame, v: DataFrame, constraint: str = "separate") -> tuple[DataFrame, DataFrame]:
    """Rank-1 atoms with u and v in their own unit balls ("separate") or [u, v] in one ("joint")."""
    square = lambda x, c: x.groupBy("k").agg(F.sum(F.col(c).cast("double") * F.col(c)).alias("q"))
    uu, vv = square(u, "u"), square(v, "v")
    if constraint == "joint":
        uu = vv = uu.union(vv).groupBy("k").agg(F.sum("q").alias("q"))
    elif constraint != "separate":
        raise ValueError(f"constraint must be separate or joint, not {constraint!r}")
    scale = lambda x, q, c: x.join(q, "k").withColumn(c, F.col(c) / F.greatest(F.lit(1.0), F.sqrt("q"))).drop("q")
    return scale(u, uu, "u"), scale(v, vv, "v")


def uv_to_full(u: DataFrame, v: DataFrame) -> DataFrame:
    """(k, channel, l, d) of u (k, channel, u) times v (k, l, v)."""
    return u.join(v, "k").select("k", "channel", "l", (F.col("u") * F.col("v")).alias("d"))


def flip_uv(u: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts with the sign that makes the largest |v| positive; ties go to the first sample."""
    peak = Window.partitionBy("k").orderBy(F.desc(F.abs("v")), "l")  # an atom's few samples
    sign = v.withColumn("r", F.row_number().over(peak)).where("r = 1").select("k", F.when(F.col("v") < 0, -1).otherwise(1).alias("sign"))
    return u.join(sign, "k").withColumn("u", F.col("u") * F.col("sign")).drop("sign"), v.join(sign, "k").withColumn("v", F.col("v") * F.col("sign")).drop("sign")


def dictionary_shape(d: DataFrame) -> DataFrame:
    """One row: atoms, channels, length."""
    return d.agg((F.max("k") + 1).alias("atoms"), (F.max("channel") + 1).alias("channels"), (F.max("l") + 1).alias("length"))


def chunk_dictionary(x: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Atoms cut from the signal at starts (k, trial, t0)."""
    at = starts.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select("k", "trial", (F.col("t0") + F.col("l")).cast("int").alias("t"), "l")
    return x.join(at, ["trial", "t"]).select("k", "channel", "l", F.col("x").alias("d"))
