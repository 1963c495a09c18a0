"""Online dictionary learning from a stream of trials."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import encode as E
from ..plans.learn import Learned
from ..plans.model import OnlineCDL


def trial_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of long signal rows from Parquet files, so many a batch; unreadable files are skipped."""
    schema = "trial long, channel int, t int, x double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("ignoreCorruptFiles", "true").parquet(path)


def learn_stream(stream: DataFrame, model: OnlineCDL, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that takes each micro-batch as a step of ``model`` and keeps its state as a table.

    The state (statistics, uses of atoms, worst patch, dictionary, last batch id) is one row in a folder of its own for each batch; a batch that is run again
    after a failure starts from the state before it, so its effect is the same as once.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        restore(spark, model, state, batch_id)
        rows = batch.dropna(subset=["trial", "channel", "t"])
        if rows.isEmpty():
            return
        model.partial_fit(rows)
        store(spark, model, state, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def store(spark: SparkSession, model: OnlineCDL, path: str, batch_id: int) -> None:
    s, got = model.state, model.learned
    row = {"ztz": s.ztz.tolist(), "ztx": s.ztx.tolist(), "xtx": s.xtx, "d": model._d.tolist(), "full": got.d.tolist(), "reg": np.ravel(got.reg).tolist(), "cost": s.cost, "l1": s.l1.tolist(), "used": s.used.tolist(), "error": s.error, "patch": None if s.patch is None else s.patch.tolist()}
    spark.createDataFrame([(batch_id, json.dumps(row))], "batch_id long, state string").write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")


def restore(spark: SparkSession, model: OnlineCDL, path: str, before: int) -> None:
    """Puts the newest state older than a batch into the model; without one the model starts anew."""
    try:
        rows = spark.read.schema("batch_id long, state string").option("recursiveFileLookup", "true").parquet(path)
        found = rows.where(F.col("batch_id") < before).orderBy(F.desc("batch_id")).limit(1).collect()
    except Exception as error:  # the folder does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = []
    if not found:
        if before:
            return
        model.state = model._d = model.learned = None
        return
    s = json.loads(found[0].state)
    ztz, ztx = np.array(s["ztz"]), np.array(s["ztx"])
    patch = None if s["patch"] is None else np.array(s["patch"])
    model.state = E.Statistics(ztz, ztx, s["xtx"], np.ones(len(ztz), int), np.array(s["l1"]), s["cost"], 0, np.array(s["used"]), patch, s["error"])
    model._d = np.array(s["d"])
    reg = np.array(s["reg"]) if len(s["reg"]) > 1 else np.array(s["reg"][0])
    trace = model.learned.trace if model.learned else []
    model.learned = Learned(np.array(s["full"]), None, reg, trace)


def windowed_energy(stream: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, channel, power, n) of an event stream (ts, channel, x), with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), "channel").agg(F.sum(F.col("x") * F.col("x")).alias("power"), F.count("*").alias("n"))
