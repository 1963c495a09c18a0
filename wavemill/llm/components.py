"""Connected components of a distributed edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, written

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, class_id) of every id that has an edge; class_id is the smallest id of its component.

    In each round every vertex moves to the first of itself and its neighbours, edges are renamed and those inside a vertex vanish, so
    the edge table shrinks until none is left. "First" is the smallest id in even rounds, which takes a star in one, and the
    smallest of a hash in odd ones, which shortens any chain by a constant factor. A vertex's first neighbour is a minimum with
    partial sums, and what is joined back to it may be split where a vertex has many edges. Each round is written to the shared
    folder and the one before it is deleted: the plan stays short and a lost executor costs one round. Null ends and loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u > v").distinct()
    e = written(e, "edges")
    at = written(e.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("at", F.col("id")), "places")
    for i in range(MOST_ROUNDS):
        if e.isEmpty():
            break
        to = written(_firsts(e, i), "parents")
        left = e.join(to.select(F.col("w").alias("u"), F.col("p").alias("pu")), "u").select("v", "pu")
        both = left.join(to.select(F.col("w").alias("v"), F.col("p").alias("pv")), "v")
        edges_left = written(both.where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        moved = at.join(to.select(F.col("w").alias("at"), "p"), "at", "left")
        places = written(moved.select("id", F.coalesce("p", "at").alias("at")), "places")
        discard(e, at, to)
        e, at = edges_left, places
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    least = at.groupBy("at").agg(F.min("id").alias("class_id"))
    classes = written(at.join(least, "at").select("id", "class_id"), "classes")
    discard(e, at)
    return classes


def _firsts(edges: DataFrame, i: int) -> DataFrame:
    """(w, p): the first p of each vertex w and its neighbours in round i."""
    mixed = F.xxhash64("id", F.lit(i)) if i % 2 else F.lit(0).cast("long")
    ends = edges.select("u", "v").withColumn("id", F.explode(F.array("u", "v"))).withColumn("m", F.struct(mixed.alias("h"), "id"))
    return ends.withColumn("w", F.explode(F.array("u", "v"))).groupBy("w").agg(F.min("m").alias("m")).select("w", F.col("m.id").alias("p"))
