"""Normalisation and scaling of stored entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import CenteredMatrix, CountMatrix
from .stats import feature_stats


def row_norm(m: CountMatrix, scale_factor: float = 1.0) -> CountMatrix:
    """``scale_factor * v / row sum``; a row whose sum is 0 gets nulls."""
    sums = m.coo.groupBy("cell_id").agg(F.sum("value").alias("__sum"))
    rows = m.coo.join(sums, "cell_id")
    return m.with_coo(rows.select("cell_id", "feature_id", F.try_divide(scale_factor * F.col("value").cast("double"), F.col("__sum").cast("double")).alias("value")))


def log_norm(m: CountMatrix, scale_factor: float = 1.0) -> CountMatrix:
    """``log(1 + row_norm)``."""
    r = row_norm(m, scale_factor)
    return r.with_coo(r.coo.withColumn("value", F.log1p("value")))


def normalize_cells(m: CountMatrix, method: str = "lognormalize", scale_factor: float = 1.0, dtype: str = "double") -> CountMatrix:
    """``lognormalize`` or ``relativecounts``, as double or float."""
    known = {"lognormalize": log_norm, "relativecounts": row_norm}
    if method not in known:
        raise ValueError(f"unknown normalization method: {method}")
    if dtype not in ("double", "float"):
        raise ValueError(f"unknown dtype: {dtype}")
    r = known[method](m, scale_factor)
    return r.with_coo(r.coo.withColumn("value", F.col("value").cast(dtype)))


def scale_features(m: CountMatrix, scale_max: float | None = None, features: DataFrame | None = None) -> CenteredMatrix:
    """Entries divided by their feature's deviation, clipped above, with ``mu = mean / deviation``.

    Implicit zeros stay implicit (their centred value is ``-mu``).  A constant
    feature has no deviation: its entries and mu are 0.
    """
    if features is not None:
        m = m.select_features(features)
    s = feature_stats(m).select("feature_id", F.sqrt("var").alias("sd"), "mean")
    mu = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    s = s.withColumn("mu", mu)
    v = F.when(F.col("sd") > 0, F.col("value") / F.col("sd")).otherwise(0.0)
    if scale_max is not None:
        v = F.least(v, F.lit(float(scale_max)) + F.col("mu"))
    scaled = m.coo.join(s, "feature_id").select("cell_id", "feature_id", v.alias("value"))
    return CenteredMatrix(m.with_coo(scaled), s.select("feature_id", "mu"))
