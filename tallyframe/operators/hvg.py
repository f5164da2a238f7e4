"""Highly variable features."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import cut_width
from ..matrix import CountMatrix
from ..storage import short_cut as cut
from .normalize import row_norm
from .stats import feature_stats

#: Points at which the local regression is fitted: quantiles, and an even spacing for sparse ends.  Between them it is
#: cubic, with the fitted values and slopes.
KNOTS, EVEN = 64, 16


def dispersion(m: CountMatrix) -> DataFrame:
    """H3: log(var / mean) of relative counts; 0 without a mean, -inf without a variance."""
    s = feature_stats(row_norm(m))
    metric = F.when(F.col("mean") == 0, 0.0).when(F.coalesce("var", F.lit(0.0)) == 0, float("-inf")).otherwise(F.ln(F.col("var") / F.col("mean")))
    return s.select("feature_id", metric.alias("metric"))


def mean_var_plot(m: CountMatrix, num_bins: int = 20) -> DataFrame:
    """H4: z-score of the dispersion within bins of equal width of log1p(mean); 0 where undefined.

    A feature with a mean but no variance leaves its whole bin undefined.
    """
    s = feature_stats(row_norm(m)).withColumn("x", F.log1p("mean"))
    d = F.when(F.col("mean") == 0, 0.0).when(F.coalesce("var", F.lit(0.0)) == 0, F.lit(None)).otherwise(F.ln(F.col("var") / F.col("mean")))
    s = cut_width(s.withColumn("d", d), "x", num_bins)
    by_bin = s.groupBy("bin").agg(F.avg("d").alias("avg"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d").isNull()).alias("holes"))
    z = F.when((F.col("holes") == 0) & (F.col("sd") > 0), (F.col("d") - F.col("avg")) / F.col("sd")).otherwise(0.0)
    return s.join(F.broadcast(by_bin), "bin").select("feature_id", z.alias("metric"))


def saunders(m: CountMatrix, alpha: float = 0.1) -> DataFrame:
    """H5: excess of log10(var) over a Poisson model, 0 for features within its bounds."""
    n_cells, n_genes = m.shape()
    trx = m.coo.groupBy("cell_id").agg(F.sum("value").alias("trx"))
    nolan = trx.agg(F.avg(1.0 / F.col("trx")).alias("nolan"))
    q = NormalDist().inv_cdf(1 - alpha / n_genes / 2)
    s = feature_stats(row_norm(m)).crossJoin(F.broadcast(nolan))
    far = F.col("var") / F.col("nolan") > F.col("mean") + q * F.sqrt(F.col("mean") * F.col("nolan") / n_cells)
    metric = F.when(far & (F.col("mean") > 0), F.log10("var") - F.log10(F.col("mean") * F.col("nolan"))).otherwise(0.0)
    return s.select("feature_id", metric.alias("metric"))


def loess_at_knots(points: DataFrame, span: float, knots: int = KNOTS) -> list[tuple[float, float, float]]:
    """(x, value, slope) of local quadratic, tricube-weighted fits of (x, y) at quantiles of x and at EVEN - 1 points between its ends.

    Each knot's bandwidth and weighted moments are aggregates over all points;
    only the moments of the knots come to the driver.
    """
    probs = [i / (knots - 1) for i in range(knots)]
    found = points.agg(F.percentile("x", probs).alias("q")).first().q
    if not found:
        return []
    at = sorted({*found, *(found[0] + (found[-1] - found[0]) * i / EVEN for i in range(1, EVEN))})
    spark = points.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, float(k)) for i, k in enumerate(at)], "k int, at double"))
    pairs = points.crossJoin(grid).withColumn("u", F.col("x") - F.col("at"))
    wide = pairs.groupBy("k").agg(F.percentile(F.abs("u"), span).alias("h"))
    w = F.pow(1 - F.pow(F.abs(F.col("u")) / F.col("h"), 3), 3)
    near = pairs.join(F.broadcast(wide), "k").filter((F.abs("u") < F.col("h")) & (F.col("h") > 0)).withColumn("w", w)
    sums = near.groupBy("k").agg(*(F.sum(F.col("w") * F.pow("u", i)).alias(f"s{i}") for i in range(5)), *(F.sum(F.col("w") * F.pow("u", i) * F.col("y")).alias(f"t{i}") for i in range(3))).collect()
    out = []
    for r in sorted(sums, key=lambda r: r.k):
        a = np.array([[r[f"s{i + j}"] for j in range(3)] for i in range(3)])
        t = np.array([r[f"t{i}"] for i in range(3)])
        value, slope, _ = np.linalg.lstsq(a, t, rcond=1e-12)[0].tolist()
        out.append((at[r.k], value, slope))
    return out


def blend(x: Column, line: list[tuple[float, float, float]]) -> Column:
    """The cubic between neighbouring knots that has their values and slopes; null stays null."""
    pieces = []
    for (a, fa, da), (b, fb, db) in zip(line, line[1:]):
        h = b - a
        pieces.append((a, 1 / h, fa, h * da, 3 * (fb - fa) - h * (2 * da + db), 2 * (fa - fb) + h * (da + db)))
    after = F.array(*(F.lit(a) for a, *_ in line[1:-1])).cast("array<double>")
    at = F.size(F.filter(after, lambda a: a < x)) + 1
    start, per, c0, c1, c2, c3 = (F.element_at(F.array(*map(F.lit, column)), at) for column in zip(*pieces))
    t = (x - start) * per
    return F.when(x.isNotNull(), c0 + t * (c1 + t * (c2 + t * c3)))


def vst(m: CountMatrix, span: float = 0.5) -> DataFrame:
    """H2: variance of values standardised by the deviation expected at their mean, clipped at sqrt(cells).

    The expectation is a local regression of log10(sd) on log10(mean) over the
    features that vary, fitted at knots and cubic between them.
    """
    n_cells = m.cells.count()
    s = cut(feature_stats(m), "feature-stats")
    line = loess_at_knots(s.filter("var > 0").select(F.log10("mean").alias("x"), F.log10(F.sqrt("var")).alias("y")), span)
    if len(line) < 2:
        return s.select("feature_id", F.lit(0.0).alias("metric"))
    fit = blend(F.log10("mean"), line)
    s = s.select("feature_id", "mean", F.when(F.col("var") > 0, F.pow(F.lit(10.0), fit)).alias("sd"))
    top = float(np.sqrt(n_cells))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(top))
    rows = m.coo.filter("value <> 0").join(s.filter("sd > 0"), "feature_id").withColumn("z", z)
    sums = rows.groupBy("feature_id").agg(F.count("*").alias("nz"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    zero = -F.col("mean") / F.col("sd")
    nz, n = F.coalesce("nz", F.lit(0)), F.lit(float(n_cells))
    total = F.coalesce("s", F.lit(0.0)) + (n - nz) * zero
    square = F.coalesce("ss", F.lit(0.0)) + (n - nz) * zero * zero
    metric = F.coalesce(F.when(F.col("sd") > 0, (square - total * total / n) / (n - 1)), F.lit(0.0))
    return s.join(sums, "feature_id", "left").select("feature_id", metric.alias("metric"))


def find_variable_features(m: CountMatrix, nfeatures: int = 2000, method: str = "vst", **kw) -> DataFrame:
    """H1: (feature_id, metric, rank), the best ``nfeatures`` by metric; ties go to the smaller id."""
    known = {"vst": vst, "dispersion": dispersion, "meanvarplot": mean_var_plot, "saunders": saunders}
    if method not in known:
        raise ValueError(f"unknown method: {method}")
    best = known[method](m, **kw).orderBy(F.desc("metric"), "feature_id").limit(nfeatures)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("metric"), "feature_id")))
