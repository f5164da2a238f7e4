"""Means and variances that count implicit zeros, label counts, agreement scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import CountMatrix


def moments(v: Column) -> list[Column]:
    """Aggregates k, avg and m2 (sum of squared deviations) of the stored values; null without any."""
    return [F.count(v).cast("double").alias("k"), F.avg(v).alias("avg"), (F.var_pop(v) * F.count(v)).alias("m2")]


def with_zeros(n: Column) -> tuple[Column, Column]:
    """(mean, m2) of n values of which k are stored (columns of :func:`moments`) and the rest are 0.

    Deviations are merged, not raw squares, so that large means cost no digits.
    """
    k, avg, m2 = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("k", "avg", "m2"))
    return F.try_divide(avg * k, n), m2 + F.coalesce(F.try_divide(avg * avg * k * (n - k), n), F.lit(0.0))


def sample_var(m2: Column, n: Column) -> Column:
    """Sample variance; null for fewer than two."""
    return F.when(n > 1, m2 / (n - 1))


def feature_stats(m: CountMatrix, f: Callable[[Column], Column] | None = None) -> DataFrame:
    """A1, A3: (feature_id, mean, var) over all cells; ``f`` maps values first and 0 to 0."""
    v = F.col("value").cast("double") if f is None else f(F.col("value").cast("double"))
    sums = m.coo.select("feature_id", v.alias("v")).groupBy("feature_id").agg(*moments(F.col("v")))
    rows = m.features.select("feature_id").join(sums, "feature_id", "left").crossJoin(F.broadcast(m.n_cells()))
    n = F.col("n_cells").cast("double")
    mean, m2 = with_zeros(n)
    return rows.select("feature_id", mean.alias("mean"), sample_var(m2, n).alias("var"))


def label_grid(m: CountMatrix, labels: DataFrame) -> DataFrame:
    """(feature_id, label, n): every feature with every label and the label's number of cells."""
    sizes = m.cells.join(labels, "cell_id").groupBy("label").agg(F.count("*").alias("n"))
    return m.features.select("feature_id").crossJoin(F.broadcast(sizes))


def class_stats(m: CountMatrix, labels: DataFrame) -> DataFrame:
    """A2: (feature_id, label, n, mean, var) for every feature and label."""
    sums = m.coo.join(labels, "cell_id").groupBy("feature_id", "label").agg(*moments(F.col("value").cast("double")))
    rows = label_grid(m, labels).join(sums, ["feature_id", "label"], "left")
    n = F.col("n").cast("double")
    mean, m2 = with_zeros(n)
    return rows.select("feature_id", "label", "n", mean.alias("mean"), sample_var(m2, n).alias("var"))


def log_vmr(m: CountMatrix) -> DataFrame:
    """A4: (feature_id, log1p of the mean, log of variance over mean); null where a logarithm has no value."""
    return feature_stats(m).select("feature_id", F.log1p("mean").alias("log_mean"), F.ln(F.try_divide("var", "mean")).alias("log_vmr"))


def count_labels(labels: DataFrame) -> DataFrame:
    """A5: (label, n) for every label from 1 to the largest; labels below 1 are an error."""
    lo, hi = labels.agg(F.min("label"), F.max("label")).first()
    if lo is not None and lo < 1:
        raise ValueError("labels start at 1")
    every = labels.sparkSession.range(1, (hi or 0) + 1).select(F.col("id").cast("int").alias("label"))
    return every.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_counts(m: CountMatrix, labels: DataFrame, thresh_min: float = 0) -> DataFrame:
    """(feature_id, label, n, above): how many cells of a class have a value above the threshold."""
    hits = m.coo.filter(F.col("value") > thresh_min).join(labels, "cell_id").groupBy("feature_id", "label").agg(F.count("*").alias("above"))
    return label_grid(m, labels).join(hits, ["feature_id", "label"], "left").select("feature_id", "label", "n", F.coalesce("above", F.lit(0).cast("long")).alias("above"))


def log_means(m: CountMatrix, labels: DataFrame, log: bool = False) -> DataFrame:
    """(feature_id, label, log2(1 + mean) in the class, and in the rest); ``log``: values are log1p'd."""
    v = F.expm1(F.col("value").cast("double")) if log else F.col("value").cast("double")
    sums = m.coo.join(labels, "cell_id").groupBy("feature_id", "label").agg(F.sum(v).alias("s"))
    rows = label_grid(m, labels).join(sums, ["feature_id", "label"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    total = rows.groupBy("feature_id").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rows = rows.join(total, "feature_id")
    rest = F.try_divide(F.col("ts") - F.col("s"), (F.col("tn") - F.col("n")).cast("double"))
    two = F.log(F.lit(2.0))
    return rows.select("feature_id", "label", (F.log1p(F.col("s") / F.col("n")) / two).alias("mean_in"), (F.log1p(F.greatest(rest, F.lit(0.0))) / two).alias("mean_rest"))


def purity(pairs: DataFrame) -> DataFrame:
    """One row, purity of (cluster, class) rows: the share that is in its cluster's largest class."""
    n = pairs.groupBy("cluster", "class").count().groupBy("cluster").agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    return n.agg(F.try_divide(F.sum("most").cast("double"), F.sum("n").cast("double")).alias("purity"))
