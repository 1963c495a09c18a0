"""Exact quantiles by rank, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settled


def quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float], zeros: DataFrame | None = None) -> DataFrame:
    """(*by, one column for each of qs): linearly interpolated quantiles of ``value`` in each group.

    ``zeros`` (*by, n) counts samples of value zero that rows leaves out. Equal values are counted first; the counts are dealt over
    ranges of (group, value), so that a group of any size lies in many tasks, and the number of samples before each range, a small
    table, turns places inside a range into ranks.
    """
    counts = rows.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("n"))
    if zeros is not None:
        none = zeros.where("n > 0").select(*by, F.lit(0.0).alias("v"), F.col("n").cast("long").alias("n"))
        counts = counts.unionByName(none).groupBy(*by, "v").agg(F.sum("n").alias("n"))
    dealt = settled(counts.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))  # a row for each group and range
    order = Window.partitionBy(*by).orderBy("part")
    before = sums.select(
        *by,
        "part",
        F.coalesce(F.sum("in_part").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("in_part").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("n").over(inside)).join(before, [*by, "part"]).withColumn("upto", F.col("upto") + F.col("before"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    ends = []
    for name, q in qs.items():
        rank = F.floor(q * (F.col("total") - 1))
        ends += [at(rank).alias(f"{name}_lo"), at(rank + 1).alias(f"{name}_hi")]
    found = ranked.groupBy(*by, "total").agg(*ends)

    def between(name: str, q: float) -> Column:
        place = q * (F.col("total") - 1)
        below = F.floor(place)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(place > below, (below + 1 - place) * lo + (place - below) * hi).otherwise(lo).alias(name)

    return found.select(*by, *(between(name, q) for name, q in qs.items()))
