"""Cutting the lineage of iterative plans, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, as the checkpoint folder too.

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


def scratch(spark: SparkSession, name: str) -> str:
    """The URI of a folder of this name in the shared folder."""
    where = shared_folder(spark)
    return f"{where if '://' in where else 'file://' + where}/{name}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``scratch`` named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
