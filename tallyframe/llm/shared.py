"""What the operators share: the cluster's shared folder and table reading."""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, free, shared_dir  # noqa: F401

#: Bytes of a batch that Spark hands to a Python worker, and of text that is worked on together.
BATCH = 4 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when only the driver's path has it, and hand them small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(":")
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, parts)])


def text_blocks(batches, text_at: int = 1, most: int = BATCH):
    """Arrow batches cut, without copying, into row groups of about ``most`` bytes of text (column ``text_at``)."""
    for b in batches:
        wide = pa.types.is_large_string(b.schema.field(text_at).type)
        column = b.column(text_at)
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted size is within ``rows``, else leave the shuffle join."""
    return F.broadcast(df) if small_enough(df, rows) else df
