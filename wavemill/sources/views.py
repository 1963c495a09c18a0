"""Tables of the star schema read as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH_2024 = 1704067200
HOURS = 720
EVENT_TYPES = 5
EMBEDDING = 64
FIRST_SHIPDAY = "1995-01-02"
SHIPDAYS = 2499


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of a low-cardinality column among its sorted distinct values; rows without a value are left out.

    The ranked values, few as they are, are broadcast: rows shuffled by a column of few values would meet in as many tasks, however many
    partitions there are.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = values.withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # one row for each distinct value
    return df.join(F.broadcast(ranked), column)


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial = user, channel = event type, t = hour, x = cents; zeros are left out.

    Events are dealt out before they are summed: nearly each one is a group of its own, so sums beside the scan would hold all events
    of a split, and a split may be as large as the writer of the file made its row groups. The amount is among the columns that events
    are dealt by so that the first and the second half of the sum, a table of groups each, stay tasks of their own.
    """
    hour = F.floor((F.unix_timestamp("ts") - EPOCH_2024) / 3600).cast("int").alias("t")
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", hour, F.round(F.col("value") * 100).cast("long").alias("cents"))
    dealt = dense_index(ev, "event_type", "channel").repartition("user_id", "t", "cents")
    return dealt.groupBy(F.col("user_id").alias("trial"), "channel", "t").agg(F.sum("cents").alias("x"))


def event_codes(spark: SparkSession, sf_dir: str, valid: int) -> DataFrame:
    """Integer spikes of two atoms: hours of positive totals, and the number of active channels in busy hours."""
    x = event_signal(spark, sf_dir)
    hour = x.groupBy("trial", "t").agg(F.sum("x").alias("s"), F.count("*").alias("n")).where(F.col("t") < valid)
    spikes = (F.lit(0), F.when(F.col("s") > 0, F.lit(1).cast("long"))), (F.lit(1), F.when(F.col("t") % 3 == 0, F.col("n")))
    both = F.array(*(F.struct(k.alias("k"), z.alias("z")) for k, z in spikes))  # one pass over the events for both atoms
    return hour.select("trial", "t", F.inline(both)).where("z IS NOT NULL").select("trial", "k", "t", "z")


def embedding_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial = vector, t = position, x = thousandths."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.posexplode("embedding").alias("t", "v"))
    return e.select("trial", "t", F.round(F.col("v").cast("double") * 1000).cast("long").alias("x"))


def embedding_codes(spark: SparkSession, sf_dir: str, valid: int) -> DataFrame:
    """Integer spikes where the signal is above 150 (atom 0) or below -150 (atom 1)."""
    x = embedding_signal(spark, sf_dir).where(F.col("t") < valid)
    return x.where("abs(x) > 150").select("trial", F.when(F.col("x") > 0, 0).otherwise(1).alias("k"), "t", F.lit(1).cast("long").alias("z"))


def shipping_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial; channel = return flag, t = day, x = quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.datediff(F.col("l_shipdate").cast("date"), F.lit(FIRST_SHIPDAY).cast("date")).alias("t"), F.col("l_quantity").cast("long").alias("q"))
    return dense_index(li, "l_returnflag", "channel").groupBy("channel", "t").agg(F.sum("q").alias("x")).select(F.lit(0).cast("long").alias("trial"), "channel", "t", "x")


def shipping_codes(spark: SparkSession, sf_dir: str, valid: int) -> DataFrame:
    """Integer spikes on days whose first quantity can be divided by 3 (atom 0), and twos on every fifth day (atom 1)."""
    x = shipping_signal(spark, sf_dir).where(f"channel = 0 AND t >= 0 AND t < {valid}")
    one = x.where("x % 3 = 0").select("trial", F.lit(0).alias("k"), "t", F.lit(1).cast("long").alias("z"))
    return one.unionByName(x.where("t % 5 = 0").select("trial", F.lit(1).alias("k"), "t", F.lit(2).cast("long").alias("z")))


def event_uv(spark: SparkSession, sf_dir: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of two integer atoms, of even and of odd users: counts by channel and by time of day, with signs that the amounts give."""
    x = event_signal(spark, sf_dir).where("t >= 0").select((F.col("trial") % 2).cast("int").alias("k"), "channel", (F.col("t") % length).cast("int").alias("l"), "x")
    u = x.groupBy("k", "channel").agg(F.sum(F.when(F.col("x") % 3 == 0, 2).otherwise(-1)).alias("u"))
    return u, x.groupBy("k", "l").agg(F.sum(F.when(F.col("x") % 2 == 0, 1).otherwise(-1)).alias("v"))


def event_atoms(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """Two integer atoms (k, channel, l, d), of even and of odd users."""
    x = event_signal(spark, sf_dir).where("t >= 0")
    height = F.when(F.col("x") % 2 == 0, 1 + F.col("t") % 3).otherwise(-1)
    return x.groupBy((F.col("trial") % 2).cast("int").alias("k"), "channel", (F.col("t") % length).cast("int").alias("l")).agg(F.sum(height).cast("long").alias("d"))


#: Integer atoms of length 6, by (atom); channel p carries them times p + 1, so each has rank one.
ATOM_TIMES = [[1, 2, 3, 3, 2, 1], [1, 1, 1, -1, -1, -1]]
LENGTH = 6


def integer_uv(spark: SparkSession, channels: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of the integer atoms."""
    u = spark.createDataFrame([(k, p, p + 1) for k in range(2) for p in range(channels)], "k int, channel int, u long")
    v = spark.createDataFrame([(k, l, x) for k, a in enumerate(ATOM_TIMES) for l, x in enumerate(a)], "k int, l int, v long")
    return u, v


def integer_atoms(spark: SparkSession, channels: int) -> DataFrame:
    """The full integer atoms."""
    rows = [(k, p, l, (p + 1) * x) for k, a in enumerate(ATOM_TIMES) for p in range(channels) for l, x in enumerate(a)]
    return spark.createDataFrame(rows, "k int, channel int, l int, d long")
