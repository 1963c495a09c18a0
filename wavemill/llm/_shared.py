"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset a local master, whose tasks run on this machine, gets a temporary folder; a cluster gets an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, as a URI."""
    where = shared_dir(spark)
    return f"{where if '://' in where else 'file://' + where}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made; whatever was made of them must be written itself."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def column(name: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks can run at once, where it has fewer: a small file is one split, and one task would do all the work."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow over all columns of df, whatever they are called; run's columns are taken in the order of the schema."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"_{i}" for i in range(batch.num_columns)])

    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    inside = StructType([StructField(f"_{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(named, inside).toDF(*schema.names)


def dealt_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join with a table that was summed up by key.

    A second key, of the same information, has both sides dealt anew, so that Spark may split the rows of a hot key among tasks.
    """
    second = F.xxhash64(*key)
    return left.withColumn("_second", second).join(right.withColumn("_second", second), [*key, "_second"]).drop("_second")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; used on executors for files that are not tables."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slack(df: DataFrame, names: list[str], of: str) -> None:
    """Raise a clear error when a needed column is missing."""
    if missing := [x for x in names if x not in df.columns]:
        raise ValueError(f"{of}: no column {', '.join(missing)}")
