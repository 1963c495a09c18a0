"""Files of records, and results that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern: subject / data type / run of a recording's path.
RECORD = r"([^/]+)/([^/]+)/([^/]+?)(?:\.[^./]+)?$"


def scan_records(spark: SparkSession, path: str, pattern: str = RECORD) -> DataFrame:
    """(data_type, subject, runs) of the files below a folder: the listing alone, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = files.select(part(2).alias("data_type"), part(1).alias("subject"), part(3).alias("run")).where("subject <> ''")
    return rows.groupBy("data_type", "subject").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def pick_trials(x: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The signal of n trials in the order of a seeded hash, the same in every run."""
    chosen = x.select("trial").distinct().orderBy(F.xxhash64("trial", F.lit(seed)), "trial").limit(n)
    return x.join(chosen, "trial", "left_semi")


def read_long_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trial long, channel int, t int, x double").option("header", "true").csv(path)


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """A long signal; the bucket that ``write_signal`` adds is left out."""
    return spark.read.schema("trial long, channel int, t int, x double").parquet(path).select("trial", "channel", "t", "x")


def write_signal(x: DataFrame, path: str, partitions: int = 64) -> None:
    """Parquet, clustered by a bucket of the trial, so a filter on trials reads few files."""
    rows = x.withColumn("bucket", F.pmod(F.xxhash64("trial"), F.lit(partitions)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("trial", "channel", "t").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
