"""Sharding by jump consistent hashing: the key and the shard count decide, no ring table.

With one more shard only the rows that move into the new shard change place, one in ``shards + 1`` on average.
The jump runs in NumPy over whole Arrow batches; its key is the first 64 bits of the MD5 of the id's decimal text, so any
engine can repeat it. Texts are read once, for a narrow table of ids, sizes and checksums. Slots number the rows of a shard without gaps:
rows are counted by (shard, bucket) with partial sums, the small table of counts gives each bucket its first slot, and only one bucket is
ever sorted together.

A null id hashes as the text ``null``; a null text has size 1 and the checksum of no bytes; repeated rows each get a slot of
their own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import slack, written

#: Rows of a bucket, about; the number of buckets follows the number of rows.
BUCKET_ROWS = 20_000
#: The most rows that are alike which one task deals out at a time.
CHUNK = 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key (Lamping and Veach)."""
    key, out = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    at, new = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    while len(at):
        out[at] = new
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        new = ((new + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = new < shards
        at, new, key = at[on], new[on], key[on]
    return out


def _jump_udf(shards: int):
    @F.pandas_udf(T.IntegerType())
    def shard(key: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in key:
            yield pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def id_key(id_col: Column) -> Column:
    """64 bits of a row's id, as a signed long."""
    text = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, 16)
    return F.conv(text, 16, -10).cast("long")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row; a narrow step, no shuffle."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    slack(docs, [id_col], "assign_shards")
    return docs.withColumn(name, _jump_udf(shards)(id_key(F.col(f"`{id_col}`"))))


def slots(rows: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """rows with ``slot``, gapless from 0 in each shard, in the order of the first 60 bits of the MD5 of ``order``, then of ``order`` itself.

    Rows that are alike are counted before anything is shuffled and dealt out again, CHUNK at a time, once their slots are known; columns
    besides ``order`` and the shard must follow from ``order``. A bucket is a range of the MD5, so slots do not depend on how many there are.
    """
    text = F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in order))
    alike = rows.groupBy(*(f"`{c}`" for c in rows.columns)).agg(F.count("*").alias("_n"))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK)))
    alike = written(alike.withColumn("_key", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")).withColumn("_chunk", chunk), "slots")
    own = F.least(F.lit(CHUNK), F.col("_n") - F.col("_chunk") * CHUNK)
    bits = max(0, (alike.count() // BUCKET_ROWS).bit_length())
    alike = alike.withColumn("_n", own.cast("long")).withColumn("_bucket", F.shiftright("_key", 60 - bits))
    counts = alike.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(shard, "_bucket", before.alias("_first"))  # one row for each bucket, BUCKET_ROWS times fewer than rows
    inside = Window.partitionBy(shard, "_bucket").orderBy("_key", *(F.col(f"`{c}`") for c in order), "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(first, [shard, "_bucket"])
    placed = placed.withColumn("_at", F.col("_first") + F.col("_inside")).repartition("_key", "_chunk")  # a hot row's chunks part again
    return placed.withColumn("slot", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1))).select(*(f"`{c}`" for c in rows.columns), "slot")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slack(docs, [id_col, text_col], "shard_documents")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, shards, id_col), shards + 1, id_col, "grown_shard")
    return slots(rows, [id_col, "text_crc32", "size"]).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
