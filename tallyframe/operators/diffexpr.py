"""Differential expression: rank-sum and t tests for every feature and class, and marker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_two_sided, t_two_sided
from ..matrix import CountMatrix
from .stats import class_counts, label_grid, log_means, moments, sample_var, with_zeros


def rank_sums(m: CountMatrix, labels: DataFrame) -> DataFrame:
    """M1, M2: (feature_id, label, n, n_all, r, ties): rank sum of the class and sum of t^3 - t over ties.

    Ranks are average ranks over all labelled cells.  Only stored values are
    ranked; the block of zeros enters as a count between the negative and the
    positive values.
    """
    cells = m.cells.select("cell_id").join(labels, "cell_id")
    # Equal values of a class are counted first: what is ranked within a feature is its distinct values, not its cells.
    rows = m.coo.filter("value <> 0").join(labels, "cell_id").groupBy("feature_id", "value", "label").agg(F.count("*").alias("c"))
    rows = rows.withColumn("t", F.sum("c").over(Window.partitionBy("feature_id", "value")))
    upto = Window.partitionBy("feature_id").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("low", F.sum("c").over(upto) - F.col("t") + 1)
    total = cells.agg(F.count("*").alias("n_all"))
    c = F.col("c")
    per_value = c * (F.pow(F.col("t").cast("double"), 2) - 1.0)  # summed over the classes of a value: t^3 - t
    per_feature = rows.groupBy("feature_id").agg(F.sum(c).alias("nz"), F.sum(F.when(F.col("value") < 0, c).otherwise(0)).alias("neg"), F.sum(per_value).alias("ties"))
    # A class's stored ranks, without the zeros that precede its positive values.
    stored = rows.groupBy("feature_id", "label").agg(F.sum(c * (F.col("low") + (F.col("t") - 1) / 2.0)).alias("r"), F.sum(c).alias("k"), F.sum(F.when(F.col("value") > 0, c).otherwise(0)).alias("up"))
    grid = label_grid(m, labels).crossJoin(F.broadcast(total))
    grid = grid.join(per_feature, "feature_id", "left").join(stored, ["feature_id", "label"], "left").fillna(0, ["nz", "neg", "ties", "r", "k", "up"])
    zeros = (F.col("n_all") - F.col("nz")).cast("double")
    r = F.col("r") + F.col("up") * zeros + (F.col("n") - F.col("k")) * (F.col("neg") + (zeros + 1) / 2.0)
    ties = F.col("ties") + F.when(zeros > 0, F.pow(zeros, 3) - zeros).otherwise(0.0)
    return grid.select("feature_id", "label", "n", "n_all", r.alias("r"), ties.alias("ties"))


def wilcoxon_z(n1: Column, n: Column, r: Column, ties: Column) -> Column:
    """M3: z of the second group's U with continuity correction; null without variance.

    M4: U belongs to the rest, so a feature that is higher in the class has a
    negative z.
    """
    n1, n = n1.cast("double"), n.cast("double")
    n2 = n - n1
    u = n1 * n2 + n1 * (n1 + 1) / 2 - r
    mu = n1 * n2 / 2
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(ties, n * (n - 1)))
    return F.when(var > 1e-12 * n1 * n2 * n, (u - 0.5 * F.signum(u - mu) - mu) / F.sqrt(var))


def wilcoxon(m: CountMatrix, labels: DataFrame) -> DataFrame:
    """M5: (feature_id, label, score) one-vs-rest for all classes in one pass."""
    s = rank_sums(m, labels)
    return s.select("feature_id", "label", wilcoxon_z(F.col("n"), F.col("n_all"), F.col("r"), F.col("ties")).alias("score"))


def welch(m: CountMatrix, labels: DataFrame) -> DataFrame:
    """M6, M7: (feature_id, label, score, df): Welch's t of the class against the rest, whose moments merge those of the other classes."""
    sums = m.coo.join(labels, "cell_id").groupBy("feature_id", "label").agg(*moments(F.col("value").cast("double")))
    n = F.col("n").cast("double")
    mean, m2 = with_zeros(n)
    rows = label_grid(m, labels).join(sums, ["feature_id", "label"], "left").select("feature_id", "label", n.alias("n1"), mean.alias("mean"), m2.alias("q1"))
    # Of the rest: size, mean, and the deviations within and between its classes.
    every = F.collect_list(F.struct("label", "n1", "mean", "q1")).over(Window.partitionBy("feature_id"))
    others = F.filter(every, lambda x: x["label"] != F.col("label"))
    total = lambda f: F.aggregate("others", F.lit(0.0), lambda acc, x: acc + f(x))
    rows = rows.withColumn("others", others).withColumn("n2", total(lambda x: x["n1"]))
    rows = rows.withColumn("mean2", F.try_divide(total(lambda x: x["n1"] * x["mean"]), F.col("n2")))
    between = total(lambda x: x["q1"] + x["n1"] * (x["mean"] - F.col("mean2")) * (x["mean"] - F.col("mean2")))
    rows = rows.withColumn("q2", between)
    a, b = sample_var(F.col("q1"), F.col("n1")) / F.col("n1"), F.try_divide(sample_var(F.col("q2"), F.col("n2")), F.col("n2"))
    rows = rows.select("feature_id", "label", (F.col("mean") - F.col("mean2")).alias("d"), a.alias("a"), b.alias("b"), "n1", "n2")
    a, b = F.col("a"), F.col("b")
    t = F.try_divide(F.col("d"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    return rows.select("feature_id", "label", t.alias("score"), F.when(t.isNotNull(), F.coalesce(df, F.lit(1.0))).alias("df"))


def prefilter_markers(m: CountMatrix, labels: DataFrame, logfc_threshold: float = 0.25, min_pct: float = 0.1, min_diff_pct: float | None = None, only_pos: bool = False, log: bool = False) -> DataFrame:
    """M8: (feature_id, label, logfc) of the pairs worth testing; all limits are strict, shares have 3 digits."""
    c = class_counts(m, labels)
    total = c.groupBy("feature_id").agg(F.sum("above").alias("ta"), F.sum("n").alias("tn"))
    c = c.join(total, "feature_id")
    share = lambda a, n: F.bround(F.try_divide(a.cast("double"), n.cast("double")), 3)
    c = c.select("feature_id", "label", share(F.col("above"), F.col("n")).alias("p1"), share(F.col("ta") - F.col("above"), F.col("tn") - F.col("n")).alias("p2"))
    keep = F.greatest("p1", "p2") > min_pct
    if min_diff_pct is not None:
        keep &= F.abs(F.col("p1") - F.col("p2")) > min_diff_pct
    kept = c.filter(F.col("p1").isNotNull() & F.col("p2").isNotNull() & keep).select("feature_id", "label")
    fc = log_means(m, labels, log).select("feature_id", "label", (F.col("mean_in") - F.col("mean_rest")).alias("logfc"))
    return kept.join(fc, ["feature_id", "label"]).filter((F.col("logfc") if only_pos else F.abs("logfc")) > logfc_threshold)


def find_markers(m: CountMatrix, labels: DataFrame, method: str = "wilcoxon", log: bool = False, selection: DataFrame | None = None) -> DataFrame:
    """M9: (feature_id, group, score, pval, logfc) for all feature and class pairs, or those of ``selection``."""
    if method == "wilcoxon":
        scores = wilcoxon(m, labels).withColumn("df", F.lit(None).cast("double"))
    elif method == "t":
        scores = welch(m, labels)
    else:
        raise ValueError(f"unknown method: {method}")
    fc = log_means(m, labels, log).select("feature_id", "label", (F.col("mean_in") - F.col("mean_rest")).alias("logfc"))
    rows = scores.join(fc, ["feature_id", "label"])
    if selection is not None:
        rows = rows.join(selection.select("feature_id", "label"), ["feature_id", "label"], "left_semi")
    p = normal_two_sided("score") if method == "wilcoxon" else t_two_sided("score", "df")
    return rows.withColumn("pval", p).select("feature_id", F.col("label").alias("group"), "score", "pval", "logfc")


def filter_rank_markers(de: DataFrame, pval_thresh: float = 1e-2, count: int | None = None, rankby_abs: bool = False) -> DataFrame:
    """Per group the markers with a p-value below the limit, ranked by (score, logfc) descending, at most ``count``."""
    by = F.abs("score") if rankby_abs else F.col("score")
    order = Window.partitionBy("group").orderBy(by.desc(), F.desc("logfc"), "feature_id")
    rows = de.filter((F.col("pval") < pval_thresh) & ~F.isnan("pval")).withColumn("rank", F.row_number().over(order))
    return rows if count is None else rows.filter(F.col("rank") <= count)


def find_all_markers(m: CountMatrix, labels: DataFrame, method: str = "wilcoxon", log: bool = False, **kw) -> DataFrame:
    """Preselect pairs, test them, and rank what is significant."""
    return filter_rank_markers(find_markers(m, labels, method, log, prefilter_markers(m, labels, log=log, **kw)))
