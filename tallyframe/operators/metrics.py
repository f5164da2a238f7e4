"""Quality of embeddings: agreement of neighbourhoods, alignment of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import short_cut as cut
from .neighbours import METRICS, nearest_neighbours, same_among_nearest, usable


def agreement(x: DataFrame, y: DataFrame, k: int = 15, metric: str = "euclidean", include_self: bool = True) -> DataFrame:
    """One row, mean over cells of the Jaccard index of the k nearest neighbours in two embeddings."""
    a, b = (nearest_neighbours(v, k, metric, include_self).select("cell_id", "neighbour_id") for v in (x, y))
    shared = a.join(b, ["cell_id", "neighbour_id"]).groupBy("cell_id").agg(F.count("*").alias("i"))
    every = x.select("cell_id").join(y.select("cell_id"), "cell_id").join(shared, "cell_id", "left").select(F.coalesce("i", F.lit(0)).alias("i"))
    return every.agg(F.avg(F.col("i") / (2 * k - F.col("i")).cast("double")).alias("agreement"))


def alignment(vectors: DataFrame, datasets: DataFrame, k: int | None = None, metric: str = "euclidean") -> DataFrame:
    """(dataset, alignment): how well each data set mixes with the others among k neighbours, itself aside.

    Every data set is thinned to the size of the smallest, by a hash of the id.
    k defaults to 1 % of the cells, at least 10.  A single data set is aligned.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    rows = vectors.join(datasets, "cell_id")
    sizes = rows.groupBy("dataset").agg(F.count("*").alias("n"))
    small, n_sets, total = sizes.agg(F.min("n"), F.count("*"), F.sum("n")).first()
    if not n_sets:
        return sizes.select("dataset", F.lit(1.0).alias("alignment"))
    if n_sets == 1:
        return sizes.select("dataset", F.lit(1.0).alias("alignment"))
    order = Window.partitionBy("dataset").orderBy(F.md5(F.col("cell_id").cast("string")), "cell_id")
    some = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= small).drop("r")
    k = k or max(10, min(total // 100, small * n_sets - 1))
    k = min(k, small * n_sets - 1)
    tags = sizes.select(F.col("dataset").alias("of"), F.row_number().over(Window.orderBy("dataset")).cast("long").alias("tag"))
    tags = cut(tags, "datasets")
    # Each cell's neighbours of its own data set are counted where they are found; n k rows are never made.
    tagged = cut(usable(some, "dataset").join(tags, F.col("dataset").eqNullSafe(F.col("of"))).select("cell_id", "vector", "tag"), "vectors")
    found = same_among_nearest(tagged, k, metric)
    inside = F.when(F.col("of").isNotNull(), F.col("same")).otherwise(0)
    same = found.join(tags, "tag").groupBy(F.col("of").alias("dataset")).agg((F.sum(inside) / F.lit(float(small))).alias("x"))
    share = k / n_sets
    return same.select("dataset", (1 - (F.col("x") - share) / (k - share)).alias("alignment"))
