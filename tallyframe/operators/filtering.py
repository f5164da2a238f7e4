"""Filters of cells and features, shares of feature groups, alignment by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import CountMatrix


def filter_features(m: CountMatrix, min_cells: int = 0) -> CountMatrix:
    """features that at least ``min_cells`` cells express (value above 0)."""
    if min_cells <= 0:
        return m
    n = m.coo.groupBy("feature_id").agg(F.count_if(F.col("value") > 0).alias("n"))
    return m.select_features(n.filter(F.col("n") >= min_cells))


def filter_cells(m: CountMatrix, min_features: int = 0, min_feature_count: int = 0, min_umi: int = 0) -> CountMatrix:
    """cells with at least ``min_features`` features above ``min_feature_count`` and, if asked for, a sum above ``min_umi``."""
    if min_features <= 0 and min_umi <= 0:
        return m
    n = m.coo.groupBy("cell_id").agg(F.count_if(F.col("value") > min_feature_count).alias("n"), F.sum("value").alias("umi"))
    keep = F.col("n") >= min_features
    if min_umi > 0:
        keep &= F.col("umi") > min_umi
    if min_features <= 0:
        # Cells without entries have a sum of 0 and are above no positive limit.
        keep = F.col("umi") > min_umi
    return m.select_cells(n.filter(keep))


def filter_counts(m: CountMatrix, min_cells: int = 0, min_features: int = 0, min_feature_count: int = 0, min_umi: int = 0) -> CountMatrix:
    """cells first, then features on the surviving cells."""
    return filter_features(filter_cells(m, min_features, min_feature_count, min_umi), min_cells)


def percentage_features(m: CountMatrix, pattern: str, regex: bool = True) -> DataFrame:
    """(cell_id, share) of counts in features whose name matches; null for a cell without counts."""
    hit = F.col("name").rlike(pattern) if regex else F.col("name").contains(pattern)
    own = m.coo.join(m.features.select("feature_id", hit.alias("hit")), "feature_id")
    sums = own.groupBy("cell_id").agg(F.sum(F.when(F.col("hit"), F.col("value")).otherwise(0)).alias("s"), F.sum("value").alias("t"))
    return m.cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.try_divide(F.col("s").cast("double"), F.col("t").cast("double")).alias("share"))


def align_labels(m: CountMatrix, labels: DataFrame) -> DataFrame:
    """(cell_id, label) for labels given by cell name; cells without a label, and unknown names, are left out."""
    return m.cells.join(labels.select("name", "label"), "name").select("cell_id", "label")


def merge_datasets(parts: dict[str, CountMatrix], min_features: int = 0, min_umi: int = 0) -> DataFrame:
    """(cell, feature, value) over several matrices, by names, with the union of features.

    Each part may be filtered first; cell names get their dataset's name as prefix.
    """
    out = None
    for name, m in parts.items():
        m = filter_cells(m, min_features=min_features, min_umi=min_umi)
        cells = m.cells.select("cell_id", F.concat_ws("-", F.lit(name), "name").alias("cell"))
        rows = m.coo.join(cells, "cell_id").join(m.features.select("feature_id", F.col("name").alias("feature")), "feature_id").groupBy("cell", "feature").agg(F.sum("value").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
