"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Seconds between collections of garbage in many short steps.
COLLECT_AFTER = 5.0
_collected = float("-inf")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is made only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, wait: float = 0.0) -> DataFrame:
    """Write to the shared folder and read again, so that lineage stays short and executors may be lost.

    Garbage is collected after it, unless that was done less than ``wait`` seconds ago.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    collect_garbage(spark, wait)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def short_cut(df: DataFrame, name: str) -> DataFrame:
    """:func:`cut` for many short steps, which share a collection of garbage."""
    return cut(df, name, COLLECT_AFTER)


def collect_garbage(spark: SparkSession, wait: float = 0.0) -> None:
    """Shuffle files go when the driver's garbage collector finds their plans unused."""
    global _collected
    if time.monotonic() - _collected >= wait:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def free(*frames: DataFrame) -> None:
    """Delete the tables behind frames that :func:`cut` returned; nothing may read them any more."""
    for df in frames:
        if "cut_path" in vars(df):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df.cut_path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
