"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each round looks only at rows that the round before could not tell apart. Which keys are shared is counted exactly by an
aggregation with map-side partial sums, so a hot group is one row for each task; the scan of the next round asks a bitmap of about
eight bits a row, ``2**MOST_BITS`` at most, joined as a table of 64-bit words (a fixed bound, so it may be broadcast). A bit that
two keys share, as more do beyond that bound, only sends a row on to the next round: the last round compares whole SHA-256 digests and
decides alone.

Nulls count as empty texts, empty texts are equal to each other, A-Z are lower-cased and nothing else is. Of equal texts the
row with the largest id stays (a null id is smaller than any); rows that repeat both id and text are one document and share its
result. A text of any length is one value of one row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import slack

LEAST_BITS, MOST_BITS = 16, 26
PREFIX_CHARS = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text in which equality is judged."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _bits(rows: DataFrame) -> int:
    """Bits of a bitmap for so many rows, as a power of two."""
    return 1 << min(max((8 * rows.count()).bit_length(), LEAST_BITS), MOST_BITS)


def _word(bits: int) -> Column:
    return F.shiftright(F.pmod(F.xxhash64("key"), F.lit(bits)), 6).alias("word")


def _bit(bits: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {bits}) & 63 as int))")


def _survivors(docs: DataFrame, bits: int) -> DataFrame:
    """Rows that agree in their ``key`` with another row, and those that share a bit with such."""
    shared = docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = shared.groupBy(_word(bits)).agg(F.bit_or(_bit(bits)).alias("bits"))
    hit = docs.withColumn("word", _word(bits)).join(F.broadcast(bitmap), "word")  # at most 2**MOST_BITS / 64 rows of 16 bytes
    return hit.where(F.col("bits").bitwiseAND(_bit(bits)) != 0).drop("word", "bits")


def shared_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, keep_id, group_size) of every digest that more than one row has, by the three rounds."""
    slack(docs, [id_col, text_col], "exact_dedup")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    bits = _bits(docs)
    length = F.octet_length("text").cast("long")
    left = _survivors(rows.withColumn("key", length), bits)
    prefix = F.xxhash64(length, normalised(F.substring("text", 1, PREFIX_CHARS)))
    left = _survivors(left.withColumn("key", prefix), bits)
    full = left.select("id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    return full.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    groups = shared_digests(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    # The second key has both sides dealt anew, so the rows of a hot group can be split among tasks.
    second = F.xxhash64("digest").alias("second")
    return rows.select("*", second).join(groups.select("*", second), ["digest", "second"], "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
