"""From triplets and names to a matrix: sums of duplicates, clean names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import make_unique
from ..matrix import CountMatrix


def clean_features(features: DataFrame, unique: bool = True) -> DataFrame:
    """Feature names with "-" for "_", told apart when ``unique``."""
    rows = features.select("feature_id", F.translate("name", "_", "-").alias("name"))
    if not unique:
        return rows
    return make_unique(rows.withColumnRenamed("feature_id", "id")).withColumnRenamed("id", "feature_id")


def convert_counts(coo: DataFrame, cells: DataFrame, features: DataFrame, unique_features: bool = True) -> CountMatrix:
    """A count matrix of (cell_id, feature_id, value); repeated coordinates add up, zeros go.

    Values must be whole numbers: a fraction is an error.
    """
    whole = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long")).otherwise(F.raise_error(F.lit("counts must be whole numbers")).cast("long"))
    rows = coo.select("cell_id", "feature_id", whole.alias("value")).groupBy("cell_id", "feature_id").agg(F.sum("value").alias("value")).filter("value <> 0")
    return CountMatrix(rows, cells, clean_features(features, unique_features))


def numbered(coo: DataFrame, n_cells: int, n_features: int) -> CountMatrix:
    """A matrix whose names are cell-1, cell-2, ... and gene-1, gene-2, ..."""
    spark = coo.sparkSession
    cells = spark.range(1, n_cells + 1).select(F.col("id").alias("cell_id"), F.concat(F.lit("cell-"), F.col("id").cast("string")).alias("name"))
    features = spark.range(1, n_features + 1).select(F.col("id").alias("feature_id"), F.concat(F.lit("gene-"), F.col("id").cast("string")).alias("name"))
    return convert_counts(coo, cells, features)
