"""The data behind the usual plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import CountMatrix
from ..operators.linalg import LinearEmbedding
from ..operators.normalize import row_norm
from ..operators.stats import label_grid


def highest_expressed(m: CountMatrix, n: int = 10, drop: DataFrame | None = None) -> DataFrame:
    """V1: (feature_id, mean, rank): mean percentage of a cell's counts, the ``n`` largest; ``drop`` names features to leave out."""
    sums = row_norm(m, 100.0).coo.groupBy("feature_id").agg(F.sum("value").alias("s"))
    rows = m.features.select("feature_id") if drop is None else m.features.select("feature_id").join(drop.select("feature_id"), "feature_id", "left_anti")
    mean = rows.join(sums, "feature_id", "left").crossJoin(F.broadcast(m.n_cells())).select("feature_id", (F.coalesce("s", F.lit(0.0)) / F.col("n_cells")).alias("mean"))
    return mean.orderBy(F.desc("mean"), "feature_id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "feature_id")))


def loadings(e: LinearEmbedding, dims: int = 6, nfeatures: int = 10) -> DataFrame:
    """V2: (pc, rank, feature_id, value): the largest loadings by size."""
    order = Window.partitionBy("pc").orderBy(F.desc(F.abs("value")), "feature_id")
    return e.loadings.filter(F.col("pc") <= dims).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nfeatures).select("pc", "rank", "feature_id", "value")


def scatter(e: LinearEmbedding) -> DataFrame:
    """V3: (cell_id, x, y): the first two coordinates."""
    return e.coordinates.filter("pc <= 2").groupBy("cell_id").agg(F.max(F.when(F.col("pc") == 1, F.col("value"))).alias("x"), F.max(F.when(F.col("pc") == 2, F.col("value"))).alias("y"))


def elbow(e: LinearEmbedding) -> DataFrame:
    """V4: (pc, share): running share of the sum of deviations."""
    running = F.sum("stdev").over(Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0))
    total = e.stdev.agg(F.sum("stdev").alias("t"))
    return e.stdev.withColumn("run", running).crossJoin(F.broadcast(total)).select("pc", (F.col("run") / F.col("t")).alias("share"))


def group_values(m: CountMatrix, labels: DataFrame, features: DataFrame, group: int) -> DataFrame:
    """V5: (feature_id, in_group, cell_id, value) of chosen features, zeros included."""
    cells = m.cells.join(labels, "cell_id").select("cell_id", (F.col("label") == group).alias("in_group"))
    grid = cells.crossJoin(F.broadcast(features.select("feature_id").distinct()))
    return grid.join(m.coo, ["cell_id", "feature_id"], "left").select("feature_id", "in_group", "cell_id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def violin(m: CountMatrix, labels: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """V6: (feature_id, label, zeros, positive, mean, quantiles): the distribution over all cells of a label.

    Quantiles interpolate linearly.  Cells without an entry are one value, 0,
    with their number as its frequency; an aggregate keeps each different
    value of a feature and label once, with a count.
    """
    own = m.coo.join(labels, "cell_id").select("feature_id", "label", F.col("value").cast("double").alias("value"))
    v = own.groupBy("feature_id", "label").agg(F.count_if(F.col("value") > 0).alias("positive"), F.count("*").alias("stored"), F.sum("value").alias("s"))
    rows = label_grid(m, labels).join(v, ["feature_id", "label"], "left")
    blank = rows.select("feature_id", "label", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("stored", F.lit(0))).cast("long").alias("times"))
    shape = own.withColumn("times", F.lit(1).cast("long")).unionByName(blank).groupBy("feature_id", "label").agg(F.percentile("value", F.array(*map(F.lit, probs)), F.col("times")).alias("quantiles"))
    up = F.coalesce("positive", F.lit(0).cast("long"))
    out = rows.join(shape, ["feature_id", "label"])
    return out.select("feature_id", "label", (F.col("n") - up).alias("zeros"), up.alias("positive"), (F.coalesce("s", F.lit(0)) / F.col("n")).alias("mean"), "quantiles")
