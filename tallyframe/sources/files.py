"""One entry point for all formats, and the engine's own Parquet layout."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..matrix import CountMatrix
from . import hdf5, text_formats
from .errors import LayoutError

SUFFIXES = (
    (".h5ad", hdf5.read_h5ad),
    (".loom", hdf5.read_loom),
    (".h5", hdf5.read_10x_h5),
    (".csv", text_formats.read_csv),
    (".dge.txt", text_formats.read_dge),
    (".dge.txt.gz", text_formats.read_dge),
)


def read_data(spark: SparkSession, path: str, **kw) -> CountMatrix:
    """The reader for a path: a folder is the Parquet layout or 10x files, else by suffix."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        return read_parquet(spark, path) if text_formats.exists(spark, f"{path}/coo") else text_formats.read_10x(spark, path, **kw)
    for suffix, reader in SUFFIXES:
        if path.endswith(suffix):
            return reader(spark, path, **kw)
    raise LayoutError(f"no reader for {path}")


def write_parquet(m: CountMatrix, path: str) -> None:
    """Coordinates and both dimension tables."""
    m.coo.write.parquet(f"{path}/coo")
    m.cells.write.parquet(f"{path}/cells")
    m.features.write.parquet(f"{path}/features")


def read_parquet(spark: SparkSession, path: str) -> CountMatrix:
    return CountMatrix(*(spark.read.parquet(f"{path}/{x}") for x in ("coo", "cells", "features")))
