"""HDF5-based formats, for installations that have h5py.

The layouts: a 10x file (group of indptr, indices, data, shape), the plain
``/counts`` group with row and column names, AnnData's ``X``, and Loom's dense
matrix.  Entries and names are read in blocks by the executors as Arrow
batches, so the file must lie in a folder that they share; the driver reads
sizes and attributes only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import CountMatrix
from .errors import MissingLibrary
from .names import convert_counts


def h5py_file(path: str):
    """The file at ``path``, to be used in a ``with`` block; groups and slices are read by indexing."""
    try:
        import h5py
    except ImportError as e:
        raise MissingLibrary("reading HDF5 files needs h5py") from e
    return h5py.File(path, "r")


def text(values) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def expand(ptr: np.ndarray, index: np.ndarray, data: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """1-based (column, row, value) of compressed columns ``start`` and on: column c has ``index[ptr[c] - ptr[0] : ptr[c + 1] - ptr[0]]``."""
    ptr = np.asarray(ptr, np.int64)
    column = np.repeat(np.arange(start + 1, start + len(ptr)), np.diff(ptr))
    return column, np.asarray(index, np.int64) + 1, np.asarray(data, float)


def dense_entries(block: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """1-based (column, row, value) of what is not zero in rows ``start`` and on of a dense matrix."""
    row, column = np.nonzero(block)
    return column + 1, row + 1 + start, np.asarray(block[row, column], float)


def blocks(spark: SparkSession, n: int, step: int, read: Callable, schema: str) -> DataFrame:
    """What ``read(first, end)`` gives (columns of ``schema``) for blocks of ``step`` of n rows, a few blocks a task."""

    def run(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in read(s, min(s + step, n))], [f.split()[0] for f in schema.split(", ")])

    return spark.range(0, n, step, max(1, min(10_000, n // step))).mapInArrow(run, schema)


def name_table(spark: SparkSession, path: str, dataset: str, key: str, opener, step: int = 1 << 16) -> DataFrame:
    """(key, name) of a stored list of names, numbered from 1."""
    with opener(path) as f:
        n = len(f[dataset])

    def read(a: int, e: int):
        with opener(path) as f:
            return np.arange(a + 1, e + 1), text(f[dataset][a:e])

    return blocks(spark, n, step, read, f"{key} long, name string")


def read_sparse(spark: SparkSession, path: str, group: str, rows: str, columns: str, by_cells: bool, unique_features: bool = True, step: int = 1024, opener=h5py_file) -> CountMatrix:
    """A compressed sparse group; its columns are cells when ``by_cells``, else features."""
    with opener(path) as f:
        n = len(f[group]["indptr"]) - 1

    def read(a: int, e: int):
        with opener(path) as f:
            g = f[group]
            ptr = g["indptr"][a : e + 1]
            return expand(ptr, g["indices"][ptr[0] : ptr[-1]], g["data"][ptr[0] : ptr[-1]], a)

    coo = blocks(spark, n, step, read, "cell_id long, feature_id long, value double" if by_cells else "feature_id long, cell_id long, value double")
    outer, inner = ("cell_id", "feature_id") if by_cells else ("feature_id", "cell_id")
    tables = {outer: name_table(spark, path, columns, outer, opener), inner: name_table(spark, path, rows, inner, opener)}
    return convert_counts(coo.select("cell_id", "feature_id", "value"), tables["cell_id"], tables["feature_id"], unique_features)


def read_10x_h5(spark: SparkSession, path: str, dataset: str = "/mm10", unique_features: bool = True, opener=h5py_file) -> CountMatrix:
    """The columns of the stored matrix are cells."""
    with opener(path) as f:
        genes = "gene_names" if "gene_names" in f[dataset] else "features/name"
    return read_sparse(spark, path, dataset, f"{dataset}/{genes}", f"{dataset}/barcodes", True, unique_features, opener=opener)


def read_h5(spark: SparkSession, path: str, dataset: str = "/counts", unique_features: bool = True, opener=h5py_file) -> CountMatrix:
    """A compressed matrix of features by cells with ``rownames`` and ``colnames``."""
    return read_sparse(spark, path, dataset, f"{dataset}/rownames", f"{dataset}/colnames", True, unique_features, opener=opener)


def read_h5ad(spark: SparkSession, path: str, unique_features: bool = True, opener=h5py_file) -> CountMatrix:
    """AnnData's X, in either orientation."""
    with opener(path) as f:
        kind = f["X"].attrs.get("encoding-type", f["X"].attrs.get("h5sparse_format"))
        by_cells = "csr" in text([kind])[0]
    cells, features = "obs/_index", "var/_index"
    return read_sparse(spark, path, "X", features if by_cells else cells, cells if by_cells else features, by_cells, unique_features, opener=opener)


def read_frame(spark: SparkSession, path: str, group: str = "obs", step: int = 1 << 16, opener=h5py_file) -> DataFrame:
    """(id, ...) a stored table: its index, then its columns in order.

    A column with a ``categories`` attribute, or with one in the group
    ``__categories``, holds codes; code -1 is null.
    """
    with opener(path) as f:
        g = f[group]
        index = text([g.attrs.get("_index", "_index")])[0]
        order = [index, *text(g.attrs.get("column-order", []))]
        levels = {c: text(g["__categories"][c][:]) for c in order if "__categories" in g and c in g["__categories"]}
        n = len(g[index])
        kinds = {c: "string" if c in levels or g[c].dtype.kind in "SOU" else "double" if g[c].dtype.kind == "f" else "boolean" if g[c].dtype.kind == "b" else "long" for c in order}

    def column(g, c: str, a: int, e: int):
        values = g[c][a:e]
        if c in levels:
            return [levels[c][v] if v >= 0 else None for v in np.asarray(values).tolist()]
        return text(values) if kinds[c] == "string" else np.asarray(values).astype({"double": float, "boolean": bool, "long": np.int64}[kinds[c]])

    def read(a: int, e: int):
        with opener(path) as f:
            return np.arange(a + 1, e + 1), *(column(f[group], c, a, e) for c in order)

    # Names of columns may hold anything, so they are set afterwards.
    plain = blocks(spark, n, step, read, ", ".join(["id long", *(f"c{i} {kinds[c]}" for i, c in enumerate(order))]))
    return plain.toDF("id", *order)


def read_loom(spark: SparkSession, path: str, barcode_names: str = "CellID", feature_names: str = "Gene", unique_names: bool = True, step: int = 100, opener=h5py_file) -> CountMatrix:
    """A dense matrix of features by cells, scanned by blocks of rows; zeros are dropped."""
    with opener(path) as f:
        n = f["matrix"].shape[0]

    def read(a: int, e: int):
        with opener(path) as f:
            return dense_entries(np.asarray(f["matrix"][a:e]), a)

    coo = blocks(spark, n, step, read, "cell_id long, feature_id long, value double")
    cells, features = name_table(spark, path, f"col_attrs/{barcode_names}", "cell_id", opener), name_table(spark, path, f"row_attrs/{feature_names}", "feature_id", opener)
    m = convert_counts(coo, cells, features, unique_names)
    if unique_names:
        from ..functions.labels import make_unique

        m = CountMatrix(m.coo, make_unique(m.cells.select(F.col("cell_id").alias("id"), "name")).withColumnRenamed("id", "cell_id"), m.features)
    return m
