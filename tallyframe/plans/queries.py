"""One query for each operator that SQL can express, with its SQL, and the others without.

Keys are operator ids.  Floating-point columns are rounded to six digits in
both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as fl
from ..matrix import CountMatrix
from ..operators import approximate, diffexpr, filtering, graph, hvg, linalg, metrics, neighbours, normalize, stats, umap
from ..sources import names, registry
from ..storage import free
from ..streaming import windowed_counts
from . import adapters as a
from . import plots
from .adapters import DENSE, EVENTS, VECTOR_COO, VECTORS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 15


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r6(*columns: str):
    """The columns rounded, without negative zeros."""
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


# Sources


@query("S16", f"WITH {DENSE} SELECT feature_id, CASE WHEN n = 1 THEN name ELSE name || '.' || (n - 1) END AS name FROM (SELECT feature_id, replace(name, '_', '-') AS name, row_number() OVER (PARTITION BY replace(name, '_', '-') ORDER BY feature_id) AS n FROM features)")
def s16(spark, sf):
    return names.convert_counts(*(getattr(a.cust_part(spark, sf), x) for x in ("coo", "cells", "features"))).features


@query("S17", "SELECT 'cell-' || i AS name FROM unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS r(i)")
def s17(spark, sf):
    m = a.cust_part(spark, sf)
    return names.numbered(m.coo, *m.shape()).cells.select("name")


@query("S18", "SELECT n_name AS name, 'nation-' || n_nationkey AS file FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def s18(spark, sf):
    nation, region = a.table(spark, sf, "nation"), a.table(spark, sf, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("collection"), F.col("n_name").alias("name"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("file"), F.lit("").alias("url"))
    return registry.Registry.empty(spark).add(rows).datasets("ASIA").select("name", "file")


@query("S19", "SELECT r_name AS collection, count(*) AS n_datasets FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s19(spark, sf):
    nation, region = a.table(spark, sf, "nation"), a.table(spark, sf, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("collection"), F.col("n_name").alias("name"), F.lit("").alias("file"), F.lit("").alias("url"))
    return registry.Registry.empty(spark).add(rows).collections()


@query("S22", f"""WITH {DENSE}, few AS (SELECT cell_id, feature_id, value FROM coo JOIN (SELECT cell_id FROM coo GROUP BY 1 HAVING count(CASE WHEN value > 0 THEN 1 END) >= 30) USING (cell_id)),
sup AS (SELECT l_suppkey AS cell_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2),
sold AS (SELECT s.* FROM sup s JOIN (SELECT cell_id FROM sup GROUP BY 1 HAVING count(CASE WHEN value > 0 THEN 1 END) >= 30) USING (cell_id)),
both_sets AS (SELECT 'buy-' || c.name AS cell, feature_id, value FROM few JOIN cells c USING (cell_id) UNION ALL SELECT 'sell-' || s_name, feature_id, value FROM sold JOIN supplier ON s_suppkey = cell_id)
SELECT cell, f.name AS feature, CAST(sum(value) AS BIGINT) AS value FROM both_sets JOIN features f USING (feature_id) GROUP BY 1, 2""")
def s22(spark, sf):
    return filtering.merge_datasets({"buy": a.cust_part(spark, sf), "sell": a.supp_part(spark, sf)}, min_features=30)


# Filters


@query("F1", f"WITH {DENSE}, keep AS (SELECT feature_id FROM coo WHERE value > 0 GROUP BY 1 HAVING count(*) >= 2) SELECT feature_id, count(*) AS nnz, CAST(sum(value) AS BIGINT) AS total FROM coo JOIN keep USING (feature_id) GROUP BY 1")
def f1(spark, sf, matrix=a.cust_part):
    return filtering.filter_features(matrix(spark, sf), 2).coo.groupBy("feature_id").agg(F.count("*").alias("nnz"), F.sum("value").alias("total"))


@query("F2", f"WITH {DENSE}, keep AS (SELECT cell_id FROM coo GROUP BY 1 HAVING count(CASE WHEN value > 10 THEN 1 END) >= 15 AND sum(value) > 500) SELECT c.cell_id, c.name FROM cells c JOIN keep USING (cell_id)")
def f2(spark, sf):
    return filtering.filter_cells(a.cust_part(spark, sf), min_features=15, min_feature_count=10, min_umi=500).cells


@query("F3", f"""WITH {DENSE}, kc AS (SELECT cell_id FROM coo GROUP BY 1 HAVING count(CASE WHEN value > 0 THEN 1 END) >= 20 AND sum(value) > 500),
x AS (SELECT * FROM coo JOIN kc USING (cell_id)), kf AS (SELECT feature_id FROM x WHERE value > 0 GROUP BY 1 HAVING count(*) >= 20)
SELECT cell_id, feature_id, value FROM x JOIN kf USING (feature_id)""")
def f3(spark, sf):
    return filtering.filter_counts(a.cust_part(spark, sf), min_cells=20, min_features=20, min_umi=500).coo.select("cell_id", "feature_id", "value")


@query("F4", f"WITH {DENSE} SELECT c.cell_id, round(s.s / s.t, 6) AS share FROM cells c LEFT JOIN (SELECT cell_id, CAST(sum(CASE WHEN regexp_matches(f.name, 'e[a-m]') THEN value ELSE 0 END) AS DOUBLE) AS s, CAST(sum(value) AS DOUBLE) AS t FROM coo JOIN features f USING (feature_id) GROUP BY 1) s ON s.cell_id = c.cell_id")
def f4(spark, sf, matrix=a.cust_part):
    return filtering.percentage_features(matrix(spark, sf), "e[a-m]").select("cell_id", *r6("share"))


@query("F5", f"WITH {DENSE} SELECT cell_id, feature_id, value FROM coo WHERE feature_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def f5(spark, sf, matrix=a.cust_part):
    keep = a.table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("feature_id"))
    return matrix(spark, sf).select_features(keep).coo.select("cell_id", "feature_id", "value")


@query("F6", "SELECT c_custkey AS cell_id, length(c_mktsegment) AS label FROM customer WHERE c_acctbal > 0")
def f6(spark, sf):
    labels = a.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_name").alias("name"), F.length("c_mktsegment").cast("long").alias("label"))
    return filtering.align_labels(a.cust_part(spark, sf), labels)


# Normalisation

NORM = "n AS (SELECT cell_id, feature_id, {scale} * value / CAST(sum(value) OVER (PARTITION BY cell_id) AS DOUBLE) AS value FROM coo)"
STATS = """st AS (SELECT f.feature_id, coalesce(s.s, 0.0) / t.n AS mean, greatest((coalesce(s.ss, 0.0) - coalesce(s.s, 0.0) * coalesce(s.s, 0.0) / t.n) / (t.n - 1), 0.0) AS var
  FROM features f LEFT JOIN (SELECT feature_id, sum(CAST(value AS DOUBLE)) AS s, sum(CAST(value AS DOUBLE) * value) AS ss FROM {coo} GROUP BY 1) s ON s.feature_id = f.feature_id
  CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells) t)"""


@query("N1", f"WITH {DENSE}, {NORM.format(scale='1.0')} SELECT cell_id, feature_id, round(value, 6) AS value FROM n")
def n1(spark, sf):
    return normalize.row_norm(a.cust_part(spark, sf)).coo.select("cell_id", "feature_id", *r6("value"))


@query("N2", f"WITH {DENSE}, {NORM.format(scale='10000.0')} SELECT cell_id, feature_id, round(ln(1 + value), 6) AS value FROM n")
def n2(spark, sf):
    return normalize.log_norm(a.cust_part(spark, sf), 1e4).coo.select("cell_id", "feature_id", *r6("value"))


@query("N3", f"WITH {DENSE}, {NORM.format(scale='1.0')} SELECT cell_id, feature_id, round(ln(1 + value), 6) AS value FROM n")
def n3(spark, sf, matrix=a.cust_part):
    return normalize.normalize_cells(matrix(spark, sf)).coo.select("cell_id", "feature_id", *r6("value"))


@query("N4", f"WITH {DENSE}, {STATS.format(coo='coo')} SELECT cell_id, feature_id, round(CASE WHEN var > 0 THEN least(value / sqrt(var), 10 + mean / sqrt(var)) ELSE least(0.0, 10.0) END, 6) AS value FROM coo JOIN st USING (feature_id)")
def n4(spark, sf, matrix=a.cust_part):
    return normalize.scale_features(matrix(spark, sf), 10).matrix.coo.select("cell_id", "feature_id", *r6("value"))


@query("N5", f"WITH {DENSE}, {STATS.format(coo='coo')} SELECT feature_id, round(CASE WHEN var > 0 THEN mean / sqrt(var) ELSE 0.0 END, 6) AS mu FROM st WHERE feature_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def n5(spark, sf, matrix=a.cust_part):
    keep = a.table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("feature_id"))
    return normalize.scale_features(matrix(spark, sf), features=keep).mu.select("feature_id", *r6("mu"))


@query("N6", f"WITH {EVENTS}, {STATS.format(coo='coo')} SELECT c.cell_id, s.feature_id, round(CASE WHEN var > 0 THEN coalesce(value, 0) / sqrt(var) - mean / sqrt(var) ELSE 0.0 END, 6) + 0.0 AS value FROM cells c CROSS JOIN st s LEFT JOIN coo x ON x.cell_id = c.cell_id AND x.feature_id = s.feature_id")
def n6(spark, sf):
    return normalize.scale_features(a.user_event(spark, sf)).densify().select("cell_id", "feature_id", *r6("value"))


# Aggregations


@query("A1", f"WITH {DENSE}, {STATS.format(coo='coo')} SELECT feature_id, round(mean, 6) AS mean, round(var, 6) AS var FROM st")
def a1(spark, sf, matrix=a.cust_part):
    return stats.feature_stats(matrix(spark, sf)).select("feature_id", *r6("mean", "var"))


CLASS = """sizes AS (SELECT label, count(*) AS n FROM cells JOIN labels USING (cell_id) GROUP BY 1),
cs AS (SELECT f.feature_id, z.label, z.n, coalesce(s.s, 0.0) AS s, coalesce(s.ss, 0.0) AS ss, coalesce(s.above, 0) AS above, coalesce(s.es, 0.0) AS es FROM features f CROSS JOIN sizes z
  LEFT JOIN (SELECT feature_id, label, sum(CAST(value AS DOUBLE)) AS s, sum(CAST(value AS DOUBLE) * value) AS ss, count(CASE WHEN value > 0 THEN 1 END) AS above, sum(exp(value / 50.0) - 1) AS es FROM coo JOIN labels USING (cell_id) GROUP BY 1, 2) s ON s.feature_id = f.feature_id AND s.label = z.label)"""


@query("A2", f"WITH {DENSE}, {CLASS} SELECT feature_id, label, n, round(s / n, 6) AS mean, round(greatest((ss - s * s / n) / (n - 1), 0.0), 6) AS var FROM cs")
def a2(spark, sf, matrix=a.cust_part):
    return stats.class_stats(matrix(spark, sf), a.segment_labels(spark, sf)).select("feature_id", "label", "n", *r6("mean", "var"))


@query("A3", f"WITH {DENSE}, x AS (SELECT cell_id, feature_id, ln(1 + value) AS value FROM coo), {STATS.format(coo='x')} SELECT feature_id, round(mean, 6) AS mean, round(var, 6) AS var FROM st")
def a3(spark, sf, matrix=a.cust_part):
    return stats.feature_stats(matrix(spark, sf), F.log1p).select("feature_id", *r6("mean", "var"))


@query("A4", f"WITH {DENSE}, {STATS.format(coo='coo')} SELECT feature_id, round(ln(1 + mean), 6) AS log_mean, CASE WHEN mean > 0 AND var > 0 THEN round(ln(var / mean), 6) + 0.0 END AS log_vmr FROM st")
def a4(spark, sf, matrix=a.cust_part):
    return stats.log_vmr(matrix(spark, sf)).select("feature_id", *r6("log_mean", "log_vmr"))


@query("A5", "SELECT CAST(i AS INTEGER) AS label, count(c_custkey) AS n FROM unnest(range(1, (SELECT max(c_nationkey) + 2 FROM customer))) AS r(i) LEFT JOIN customer ON c_nationkey + 1 = i GROUP BY 1")
def a5(spark, sf):
    return stats.count_labels(a.table(spark, sf, "customer").select((F.col("c_nationkey") + 1).alias("label")))


@query("A6", f"WITH {DENSE}, {CLASS} SELECT feature_id, label, n, above FROM cs")
def a6(spark, sf, matrix=a.cust_part):
    return stats.class_counts(matrix(spark, sf), a.segment_labels(spark, sf))


LOG_MEANS = "lm AS (SELECT feature_id, label, ln(1 + {s} / n) / ln(2.0) AS mean_in, ln(1 + greatest((sum({s}) OVER w - {s}) / (sum(n) OVER w - n), 0.0)) / ln(2.0) AS mean_rest FROM cs WINDOW w AS (PARTITION BY feature_id))"


@query("A7", f"WITH {DENSE}, {CLASS}, {LOG_MEANS.format(s='s')} SELECT feature_id, label, round(mean_in, 6) AS mean_in, round(mean_rest, 6) AS mean_rest FROM lm")
def a7(spark, sf, matrix=a.cust_part):
    return stats.log_means(matrix(spark, sf), a.segment_labels(spark, sf)).select("feature_id", "label", *r6("mean_in", "mean_rest"))


@query("A8", f"WITH {DENSE}, {CLASS}, {LOG_MEANS.format(s='es')} SELECT feature_id, label, round(mean_in, 6) AS mean_in, round(mean_rest, 6) AS mean_rest FROM lm")
def a8(spark, sf, matrix=a.cust_part):
    m = matrix(spark, sf)
    return stats.log_means(m.with_coo(m.coo.withColumn("value", F.col("value") / 50.0)), a.segment_labels(spark, sf), log=True).select("feature_id", "label", *r6("mean_in", "mean_rest"))


@query("A9", "SELECT round(sum(most) / sum(n), 6) AS purity FROM (SELECT max(n) AS most, sum(n) AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY c_nationkey)")
def a9(spark, sf):
    return stats.purity(a.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_mktsegment").alias("class"))).select(*r6("purity"))


# Feature selection

#: P(|Z| > |z|) from the all-positive series of the error function, and P(|T| > |t|) from that of the incomplete beta function.
NORMAL_P = """CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2)
  * list_sum(list_transform(range(0, 200), lambda i: exp(2 * i * ln(2.0) + (2 * i + 1) * ln(abs({z}) / sqrt(2.0)) - lgamma(2 * i + 2) + lgamma(i + 1)))) END"""
T_P = """CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0 WHEN abs({t}) > 9 THEN 0.0 ELSE 1 - exp(0.5 * ln({t} * {t} / ({df} + {t} * {t})) + {df} / 2 * ln({df} / ({df} + {t} * {t})) - ln(0.5) - lgamma(0.5) - lgamma({df} / 2) + lgamma(0.5 + {df} / 2))
  * list_sum(list_transform(range(0, 400), lambda i: exp(lgamma(0.5 + {df} / 2 + i) - lgamma(0.5 + {df} / 2) + lgamma(1.5) - lgamma(1.5 + i) + i * ln({t} * {t} / ({df} + {t} * {t}))))) END"""

RELATIVE = f"{NORM.format(scale='1.0')}, {STATS.format(coo='n')}"
DISPERSION = "CASE WHEN mean = 0 THEN 0.0 WHEN var = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(var / mean) END"


@query("H1", f"WITH {DENSE}, {RELATIVE}, d AS (SELECT feature_id, {DISPERSION} AS metric FROM st), r AS (SELECT feature_id, round(metric, 6) AS metric, CAST(row_number() OVER (ORDER BY metric DESC, feature_id) AS INTEGER) AS rank FROM d) SELECT * FROM r WHERE rank <= 100")
def h1(spark, sf):
    return hvg.find_variable_features(a.cust_part(spark, sf), 100, "dispersion").select("feature_id", *r6("metric"), "rank")


#: Local quadratic fits at 64 quantiles and 15 points between the ends: bandwidths, weighted moments, values and slopes by Cramer's rule, and cubics between.
FITTED = f"""{STATS.format(coo='coo')}, pts AS (SELECT log10(mean) AS x, log10(sqrt(var)) AS y FROM st WHERE var > 0),
kn AS (SELECT unnest(quantile_cont(x, [i / 63.0 for i in range(0, 64)])) AS kx FROM pts UNION SELECT lo + (hi - lo) * i / 16 FROM (SELECT min(x) AS lo, max(x) AS hi FROM pts), range(1, 16) r(i)),
h AS (SELECT kx, quantile_cont(abs(x - kx), 0.5) AS h FROM pts CROSS JOIN kn GROUP BY kx),
w AS (SELECT kx, x - kx AS u, y, pow(1 - pow(abs(x - kx) / h, 3), 3) AS w FROM pts CROSS JOIN h WHERE abs(x - kx) < h),
mo AS (SELECT kx, sum(w) AS a, sum(w * u) AS b, sum(w * u * u) AS c, sum(w * u * u * u) AS d, sum(w * u * u * u * u) AS e, sum(w * y) AS p, sum(w * u * y) AS q, sum(w * u * u * y) AS r FROM w GROUP BY kx),
kf AS (SELECT kx, (p * (c * e - d * d) - b * (q * e - d * r) + c * (q * d - c * r)) / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)) AS f,
  (a * (q * e - d * r) - p * (b * e - c * d) + c * (b * r - q * c)) / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)) AS g FROM mo),
sg AS (SELECT kx AS x0, f AS f0, g AS g0, lead(kx) OVER (ORDER BY kx) AS x1, lead(f) OVER (ORDER BY kx) AS f1, lead(g) OVER (ORDER BY kx) AS g1, row_number() OVER (ORDER BY kx) AS i FROM kf),
ft AS (SELECT feature_id, mean, pow(10, (2 * t * t * t - 3 * t * t + 1) * f0 + (t * t * t - 2 * t * t + t) * h * g0 + (3 * t * t - 2 * t * t * t) * f1 + (t * t * t - t * t) * h * g1) AS sd FROM (SELECT s.feature_id, s.mean, f0, f1, g0, g1, x1 - x0 AS h, (log10(s.mean) - x0) / (x1 - x0) AS t FROM st s JOIN sg ON s.var > 0 AND x1 IS NOT NULL AND log10(s.mean) <= x1 AND (log10(s.mean) > x0 OR i = 1)))"""


@query("H2", f"""WITH {DENSE}, {FITTED}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
z AS (SELECT t.feature_id, count(*) AS nz, sum(least((value - mean) / sd, sqrt(n))) AS s, sum(pow(least((value - mean) / sd, sqrt(n)), 2)) AS ss FROM coo o JOIN ft t USING (feature_id) CROSS JOIN n WHERE value <> 0 GROUP BY 1),
k AS (SELECT f.feature_id, n, coalesce(s, 0) + (n - coalesce(nz, 0)) * (-mean / sd) AS t, coalesce(ss, 0) + (n - coalesce(nz, 0)) * (mean / sd) * (mean / sd) AS q FROM features f LEFT JOIN ft USING (feature_id) LEFT JOIN z USING (feature_id) CROSS JOIN n)
SELECT feature_id, round(coalesce((q - t * t / n) / (n - 1), 0.0), 6) AS metric FROM k""")
def h2(spark, sf, matrix=a.cust_part):
    return hvg.vst(matrix(spark, sf)).select("feature_id", *r6("metric"))


@query("H3", f"WITH {DENSE}, {RELATIVE} SELECT feature_id, round({DISPERSION}, 6) AS metric FROM st")
def h3(spark, sf):
    return hvg.dispersion(a.cust_part(spark, sf)).select("feature_id", *r6("metric"))


BINS = " ".join(f"WHEN x > {'lo - (hi - lo) / 1000' if i == 1 else f'lo + (hi - lo) * {i - 1} / 20'} AND x <= {'hi + (hi - lo) / 1000' if i == 20 else f'lo + (hi - lo) * {i} / 20'} THEN {i}" for i in range(1, 21))


@query("H4", f"""WITH {DENSE}, {RELATIVE}, d AS (SELECT feature_id, ln(1 + mean) AS x, CASE WHEN mean = 0 THEN 0.0 WHEN var = 0 THEN NULL ELSE ln(var / mean) END AS d FROM st),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM d), b AS (SELECT feature_id, d, CASE WHEN hi = lo THEN 1 {BINS} ELSE 0 END AS bin FROM d CROSS JOIN e),
g AS (SELECT bin, avg(d) AS m, stddev_samp(d) AS sd, count(*) - count(d) AS holes FROM b GROUP BY 1)
SELECT feature_id, round(CASE WHEN holes = 0 AND sd > 0 THEN (d - m) / sd ELSE 0.0 END, 6) + 0.0 AS metric FROM b JOIN g USING (bin)""")
def h4(spark, sf):
    return hvg.mean_var_plot(a.cust_part(spark, sf)).select("feature_id", *r6("metric"))


@query("H5", f"""WITH RECURSIVE {DENSE}, {RELATIVE}, no AS (SELECT avg(1.0 / t) AS nolan FROM (SELECT sum(value) AS t FROM coo GROUP BY cell_id)),
bi AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(8 AS DOUBLE) AS hi UNION ALL SELECT i + 1, CASE WHEN p > 0.1 / (SELECT count(*) FROM features) THEN mid ELSE lo END, CASE WHEN p > 0.1 / (SELECT count(*) FROM features) THEN hi ELSE mid END FROM (SELECT *, {{p}} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE i < 60))),
q AS (SELECT lo AS q FROM bi WHERE i = 60)
SELECT feature_id, round(CASE WHEN var / nolan > mean + q * sqrt(mean * nolan / (SELECT count(*) FROM cells)) AND mean > 0 THEN log10(var) - log10(mean * nolan) ELSE 0.0 END, 6) + 0.0 AS metric FROM st CROSS JOIN no CROSS JOIN q""".replace("{p}", NORMAL_P.format(z="mid")))
def h5(spark, sf):
    return hvg.saunders(a.cust_part(spark, sf)).select("feature_id", *r6("metric"))


# Linear algebra

CENTER = f"{VECTOR_COO}, mu AS (SELECT feature_id, sum(value) / (SELECT count(*) FROM cells) AS mu FROM coo GROUP BY 1)"


@query("E1", f"WITH {CENTER} SELECT cell_id, round(sum((value - mu) * (feature_id / 64.0)), 6) + 0.0 AS value FROM coo JOIN mu USING (feature_id) GROUP BY 1")
def e1(spark, sf):
    c = linalg.centered_copy(a.vector_matrix(spark, sf))
    return linalg.centered_times(c, c.mu.select("feature_id", (F.col("feature_id") / 64.0).alias("x"))).select("cell_id", *r6("value"))


@query("E2", f"WITH {CENTER} SELECT feature_id, round(sum((value - mu) * ((cell_id % 7) / 7.0)), 6) + 0.0 AS value FROM coo JOIN mu USING (feature_id) GROUP BY 1")
def e2(spark, sf):
    m = a.vector_matrix(spark, sf)
    return linalg.centered_adjoint_times(linalg.centered_copy(m), m.cells.select("cell_id", ((F.col("cell_id") % 7) / 7.0).alias("x"))).select("feature_id", *r6("value"))


@query("E3", f"WITH {CENTER}, c AS (SELECT cell_id, feature_id, value - mu AS x FROM coo JOIN mu USING (feature_id)) SELECT p.feature_id AS i, q.feature_id AS j, round(sum(p.x * q.x), 6) + 0.0 AS value FROM c p JOIN c q ON p.cell_id = q.cell_id AND p.feature_id <= q.feature_id GROUP BY 1, 2")
def e3(spark, sf):
    return linalg.gram(linalg.centered_copy(a.vector_matrix(spark, sf))).select("i", "j", *r6("value"))


@query("E4", f"WITH {EVENTS} SELECT p.feature_id AS i, q.feature_id AS j, CAST(2 * sum(p.value * q.value) AS DOUBLE) AS value FROM coo p JOIN coo q ON p.cell_id = q.cell_id GROUP BY 1, 2")
def e4(spark, sf):
    coo = a.user_event(spark, sf).coo
    return linalg.multiply(coo.select(F.col("feature_id").alias("i"), F.col("cell_id").alias("k"), "value"), coo.select(F.col("cell_id").alias("k"), F.col("feature_id").alias("j"), "value"), 2.0).select("i", "j", "value")


#: The ten leading eigenvectors of the Gram matrix: it is squared 30 times, which leaves the projector on the first, and
#: that one is taken out before the next.  eig has pc, s2 and v with its largest entry by size made positive.
EIGEN = f"""{CENTER}, ce AS (SELECT cell_id, feature_id, value - mu AS x FROM coo JOIN mu USING (feature_id)),
gr AS (SELECT p.feature_id AS i, q.feature_id AS j, sum(p.x * q.x) AS x FROM ce p JOIN ce q USING (cell_id) GROUP BY 1, 2),
gm AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(x ORDER BY j) AS r FROM gr GROUP BY 1)),
it AS (SELECT 0 AS step, 0 AS pc, g, g AS m, CAST(NULL AS DOUBLE[]) AS v, CAST(NULL AS DOUBLE) AS s2 FROM gm UNION ALL
  SELECT step + 1, pc + CAST(v IS NOT NULL AS INTEGER), CASE WHEN v IS NULL THEN g ELSE h END, CASE WHEN v IS NULL THEN list_transform(m, lambda a: list_transform(a, lambda y: y / t)) ELSE h END, v, s2
  FROM (SELECT *, CASE WHEN v IS NULL THEN list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) END AS t,
      CASE WHEN v IS NOT NULL THEN list_transform(range(1, len(g) + 1), lambda i: list_transform(range(1, len(g) + 1), lambda j: g[i][j] - s2 * v[i] * v[j])) END AS h
    FROM (SELECT step, pc, g, m, v, list_dot_product(v, list_transform(g, lambda a: list_dot_product(a, v))) AS s2
      FROM (SELECT step, pc, g, m, list_transform(w, lambda y: y / sqrt(list_dot_product(w, w))) AS v
        FROM (SELECT step, pc, g, CASE WHEN step % 31 < 30 THEN list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) END AS m,
            CASE WHEN step % 31 = 30 THEN m[list_position(d, list_max(d))] END AS w
          FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM it WHERE pc < 10)))))),
eig AS (SELECT pc, s2, list_transform(v, lambda y: y * sign(v[list_position(list_transform(v, lambda z: abs(z)), list_max(list_transform(v, lambda z: abs(z))))])) AS v FROM it WHERE v IS NOT NULL),
dev AS (SELECT pc, sqrt(s2 / ((SELECT count(*) FROM cells) - 1)) AS stdev FROM eig),
load AS (SELECT pc, i AS feature_id, v[i] AS value FROM eig, range(1, 65) r(i)),
coord AS (SELECT cell_id, pc, sum(x * value) AS value FROM ce JOIN load USING (feature_id) GROUP BY 1, 2)"""


def products(spark, sf, beta: float) -> DataFrame:
    """2 A'A + beta C for users by kinds of event; C has counts of users by pairs of kinds, and a row that A'A lacks."""
    coo = a.user_event(spark, sf).coo
    left, right = coo.select(F.col("feature_id").alias("i"), F.col("cell_id").alias("k"), "value"), coo.select(F.col("cell_id").alias("k"), F.col("feature_id").alias("j"), "value")
    c = left.join(right.drop("value"), "k").groupBy("i", "j").agg(F.count("*").alias("value"))
    c = c.unionByName(c.filter("i = 1").select(F.lit(0).cast("long").alias("i"), "j", "value"))
    return linalg.multiply(left, right, 2.0, beta, c).select("i", "j", F.col("value").cast("double").alias("value"))


PRODUCTS = f"""WITH {EVENTS}, p AS (SELECT p.feature_id AS i, q.feature_id AS j, CAST(2 * sum(p.value * q.value) AS DOUBLE) AS value, count(*) AS n FROM coo p JOIN coo q ON p.cell_id = q.cell_id GROUP BY 1, 2),
c AS (SELECT i, j, n FROM p UNION ALL SELECT 0, j, n FROM p WHERE i = 1)
SELECT CAST(i AS BIGINT) AS i, j, sum(value) AS value FROM (SELECT i, j, value FROM p UNION ALL SELECT i, j, CAST({{beta}} * n AS DOUBLE) FROM c) GROUP BY 1, 2"""


@query("E4_beta_half", PRODUCTS.format(beta=0.5))
def e4_beta_half(spark, sf):
    return products(spark, sf, 0.5)


@query("E4_beta_one", PRODUCTS.format(beta=1.0))
def e4_beta_one(spark, sf):
    return products(spark, sf, 1.0)


def embedded(spark, sf) -> linalg.LinearEmbedding:
    return linalg.embedding(linalg.centered_copy(a.vector_matrix(spark, sf)), 10)


def principal(spark, sf) -> tuple[linalg.CenteredMatrix, linalg.LinearEmbedding]:
    c = linalg.centered_copy(a.vector_matrix(spark, sf))
    return c, linalg.embedding(c, 64)


@query("E5_variance", f"WITH {VECTOR_COO} SELECT round(sum(v), 6) AS variance FROM (SELECT var_samp(value) AS v FROM coo GROUP BY feature_id)")
def e5_variance(spark, sf):
    """The squares of all deviations add up to the variance of all features."""
    return principal(spark, sf)[1].stdev.agg(F.sum(F.col("stdev") * F.col("stdev")).alias("variance")).select(*r6("variance"))


@query("E5_products", "SELECT CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, CAST(p = q AS DOUBLE) AS loadings, CAST(p = q AS DOUBLE) AS coordinates FROM range(1, 65) x(p), range(1, 65) y(q)")
def e5_products(spark, sf):
    """Loadings are orthonormal, and coordinates orthogonal with the deviations as lengths."""
    c, e = principal(spark, sf)
    n = c.matrix.n_cells().select((F.col("n_cells") - 1).alias("m"))
    inner = lambda t, key: t.select(key, F.col("pc").alias("p"), F.col("value").alias("x")).join(t.select(key, F.col("pc").alias("q"), F.col("value").alias("y")), key).groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    dev = lambda k: e.stdev.select(F.col("pc").alias(k), F.col("stdev").alias(f"d{k}"))
    own = inner(e.coordinates, "cell_id").join(dev("p"), "p").join(dev("q"), "q").crossJoin(n).select("p", "q", (F.col("s") / (F.col("dp") * F.col("dq") * F.col("m"))).alias("coordinates"))
    return inner(e.loadings, "feature_id").withColumnRenamed("s", "loadings").join(own, ["p", "q"]).select("p", "q", *r6("loadings", "coordinates"))


@query("E5_residual", f"WITH {VECTOR_COO} SELECT feature_id, CAST(p AS INTEGER) AS pc, 0.0 AS residual FROM features CROSS JOIN range(1, 65) x(p)")
def e5_residual(spark, sf):
    """What is left of G v - s^2 v, over the sum of all s^2: loadings are eigenvectors of the Gram matrix."""
    c, e = principal(spark, sf)
    g = linalg.gram(c)
    both = g.unionByName(g.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    v = e.loadings.select(F.col("feature_id").alias("j"), "pc", F.col("value").alias("x"))
    gv = both.join(v, "j").groupBy(F.col("i").alias("feature_id"), "pc").agg(F.sum(F.col("value") * F.col("x")).alias("gv"))
    s2 = e.stdev.crossJoin(c.matrix.n_cells()).select("pc", (F.col("stdev") * F.col("stdev") * (F.col("n_cells") - 1)).alias("s2"))
    total = s2.agg(F.sum("s2").alias("total"))
    return gv.join(e.loadings, ["feature_id", "pc"]).join(s2, "pc").crossJoin(total).select("feature_id", "pc", ((F.col("gv") - F.col("s2") * F.col("value")) / F.col("total")).alias("residual")).select("feature_id", "pc", *r6("residual"))


@query("E5", f"WITH RECURSIVE {EIGEN} SELECT pc, round(stdev, 6) AS stdev FROM dev")
def e5(spark, sf):
    return embedded(spark, sf).stdev.select("pc", *r6("stdev"))


@query("E8", f"WITH RECURSIVE {EIGEN} SELECT pc, round(sqrt(s2), 6) AS value FROM eig")
def e8(spark, sf):
    """The iterative solver, even where one pass would do."""
    c = linalg.centered_copy(a.vector_matrix(spark, sf))
    rows, ids, mu = linalg.solver_input(c)
    values, _ = linalg.truncated_svd(rows, ids, mu, 10, direct=0)
    free(rows)
    return spark.createDataFrame([(p + 1, float(x)) for p, x in enumerate(values)], "pc int, value double").select("pc", *r6("value"))


@query("E9", f"WITH RECURSIVE {EIGEN} SELECT cell_id, pc, round(value, 6) + 0.0 AS value FROM coord")
def e9(spark, sf):
    return embedded(spark, sf).coordinates.select("cell_id", "pc", *r6("value"))


@query("E12", f"""WITH RECURSIVE {EIGEN}, r AS (SELECT pc, s AS sign, CAST(row_number() OVER (PARTITION BY pc, s ORDER BY -s * value, feature_id) AS INTEGER) AS rank, feature_id, value FROM load, (VALUES (1), (-1)) u(s) WHERE pc <= 5)
SELECT pc, sign, rank, feature_id, round(value, 6) + 0.0 AS value FROM r WHERE rank <= 10""")
def e12(spark, sf):
    return linalg.top_loadings(embedded(spark, sf), 10, 5).select("pc", "sign", "rank", "feature_id", *r6("value"))


# Graphs

DISTANCE = "sqrt(list_sum(list_transform(list_zip(p.e, q.e), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))))"
NN = f"{VECTORS}, d AS (SELECT p.cell_id, q.cell_id AS neighbour_id, {DISTANCE} AS distance FROM v p CROSS JOIN v q), nn AS (SELECT cell_id, neighbour_id, distance, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d QUALIFY rank <= {K})"
SNN = f"{NN}, s AS (SELECT x.cell_id AS src, y.cell_id AS dst, count(*) AS x FROM nn x JOIN nn y USING (neighbour_id) GROUP BY 1, 2), snn AS (SELECT src, dst, x / CAST({2 * K} - x AS DOUBLE) AS weight FROM s WHERE x / CAST({2 * K} - x AS DOUBLE) > 1.0 / 15)"


def knn(spark, sf):
    return neighbours.nearest_neighbours(a.vectors(spark, sf), K)


def snn(spark, sf):
    return neighbours.jaccard_index(knn(spark, sf), K)


@query("G1", f"WITH {NN} SELECT cell_id, neighbour_id, rank, round(distance, 6) AS distance FROM nn")
def g1(spark, sf):
    return knn(spark, sf).select("cell_id", "neighbour_id", "rank", *r6("distance"))


@query("G1_approximate", f"SELECT count(*) AS cells, {K} * count(*) AS neighbours, true AS enough FROM embeddings")
def g1_approximate(spark, sf):
    """Whether nine in ten of the exact neighbours are among what it finds."""
    v = a.vectors(spark, sf)
    found = approximate.approximate_neighbours(v, K)
    right = found.select("cell_id", "neighbour_id").join(knn(spark, sf).select("cell_id", "neighbour_id", F.lit(1).alias("right")), ["cell_id", "neighbour_id"], "left")
    return right.agg(F.countDistinct("cell_id").alias("cells"), F.count("*").alias("neighbours"), (F.sum("right") >= 0.9 * F.count("*")).alias("enough"))


@query("G2", f"WITH v AS (SELECT vec_id AS cell_id, embedding[1:16] AS e FROM embeddings), d AS (SELECT p.cell_id, q.cell_id AS neighbour_id, {DISTANCE} AS distance FROM v p CROSS JOIN v q WHERE p.cell_id <> q.cell_id), nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d) SELECT cell_id, neighbour_id, rank, round(distance, 6) AS distance FROM nn WHERE rank <= {K}")
def g2(spark, sf):
    return neighbours.nearest_neighbours(a.vectors(spark, sf), K, include_self=False, dims=16).select("cell_id", "neighbour_id", "rank", *r6("distance"))


@query("E10_weights", f"""WITH RECURSIVE {VECTORS}, d AS (SELECT p.cell_id, q.cell_id AS neighbour_id, {DISTANCE} AS distance FROM v p CROSS JOIN v q WHERE p.cell_id <> q.cell_id), nn AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbour_id) <= {K}),
c AS (SELECT cell_id, list(distance ORDER BY distance) AS d, coalesce(min(CASE WHEN distance > 0 THEN distance END), 0.0) AS rho, avg(distance) AS mean FROM nn GROUP BY 1),
bi AS (SELECT cell_id, d, rho, 0 AS i, CAST(0 AS DOUBLE) AS lo, (list_max(d) - rho) / ln({K} / log2({K})) AS hi FROM c UNION ALL SELECT cell_id, d, rho, i + 1, CASE WHEN t >= log2({K}) THEN lo ELSE mid END, CASE WHEN t >= log2({K}) THEN mid ELSE hi END
  FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0.0) / mid))) AS t FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE i < 60))),
sg AS (SELECT cell_id, c.rho, greatest(hi, 1e-3 * CASE WHEN c.rho > 0 THEN mean ELSE (SELECT avg(distance) FROM nn) END) AS sigma FROM bi JOIN c USING (cell_id) WHERE i = 60),
di AS (SELECT cell_id, neighbour_id, exp(-greatest(distance - rho, 0.0) / sigma) AS w FROM nn JOIN sg USING (cell_id)),
bo AS (SELECT cell_id AS src, neighbour_id AS dst, w AS a, CAST(0 AS DOUBLE) AS b FROM di UNION ALL SELECT neighbour_id, cell_id, CAST(0 AS DOUBLE), w FROM di)
SELECT src, dst, round(max(a) + max(b) - max(a) * max(b), 6) AS weight FROM bo GROUP BY 1, 2""")
def e10_weights(spark, sf):
    nn = neighbours.nearest_neighbours(a.vectors(spark, sf), K, include_self=False)
    return umap.fuzzy_weights(nn).select("src", "dst", *r6("weight"))


@query("E10")
def e10(spark, sf):
    return umap.umap(a.vectors(spark, sf)).select("cell_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"))


@query("G3", f"WITH {NN}, x AS (SELECT * FROM nn WHERE rank <= 5 + cell_id % 10), s AS (SELECT p.cell_id AS src, q.cell_id AS dst, count(*) AS x FROM x p JOIN x q USING (neighbour_id) GROUP BY 1, 2), k AS (SELECT cell_id AS dst, count(*) AS k FROM x GROUP BY 1), w AS (SELECT src, dst, x / CAST(2 * k - x AS DOUBLE) AS weight FROM s JOIN k USING (dst)) SELECT src, dst, round(weight, 6) AS weight FROM w WHERE weight > 1.0 / 15")
def g3(spark, sf):
    return neighbours.jaccard_index(knn(spark, sf).filter("rank <= 5 + cell_id % 10")).select("src", "dst", *r6("weight"))


@query("G4", f"WITH {SNN} SELECT src, dst, round(weight, 6) AS weight FROM snn")
def g4(spark, sf):
    return snn(spark, sf).select("src", "dst", *r6("weight"))


@query("G5", f"WITH {SNN} SELECT src, count(*) AS degree, round(sum(weight), 6) AS weight FROM snn GROUP BY 1")
def g5(spark, sf):
    return neighbours.shared_nearest_neighbours(a.vectors(spark, sf), K).groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight")).select("src", "degree", *r6("weight"))


@query("G6")
def g6(spark, sf):
    return graph.cluster(snn(spark, sf))


LABELLED = f"{SNN}, l AS (SELECT cell_id AS node, label FROM v), e AS (SELECT * FROM snn WHERE src <> dst), w AS (SELECT src AS node, sum(weight) AS weight FROM e GROUP BY 1), cw AS (SELECT label, sum(coalesce(weight, 0)) AS weight FROM l LEFT JOIN w USING (node) GROUP BY 1)"


def vector_labels(spark, sf):
    return a.vectors(spark, sf).select(F.col("cell_id").alias("node"), "label")


@query("A10", f"WITH {LABELLED} SELECT round((SELECT sum(weight) FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst WHERE a.label = b.label) / (SELECT sum(weight) FROM e) - 0.8 * (SELECT sum(weight * weight) FROM cw) / ((SELECT sum(weight) FROM e) * (SELECT sum(weight) FROM e)), 6) AS modularity")
def a10(spark, sf):
    return graph.modularity(snn(spark, sf), vector_labels(spark, sf), 0.8).select(*r6("modularity"))


@query("G8", f"""WITH {SNN}, l AS (SELECT cell_id AS node, CASE WHEN cell_id % 9 = 0 THEN 1000 + cell_id ELSE label END AS label FROM v), z AS (SELECT label, count(*) AS n FROM l GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, round(avg(weight), 9) AS w FROM snn JOIN l a ON a.node = src JOIN l b ON b.node = dst JOIN z x ON x.label = a.label JOIN z y ON y.label = b.label WHERE src <> dst AND x.n <= 1 AND y.n > 1 GROUP BY 1, 2),
t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM p)
SELECT node, CAST(coalesce(b, label) AS BIGINT) AS label FROM l LEFT JOIN t ON a = label AND r = 1""")
def g8(spark, sf):
    labels = vector_labels(spark, sf).withColumn("label", F.when(F.col("node") % 9 == 0, 1000 + F.col("node")).otherwise(F.col("label").cast("long")))
    return graph.group_singletons(labels, snn(spark, sf))


NN16 = f"u AS (SELECT vec_id AS cell_id, embedding[1:32] AS e FROM embeddings), d2 AS (SELECT p.cell_id, q.cell_id AS neighbour_id, {DISTANCE} AS distance FROM u p CROSS JOIN u q), nn2 AS (SELECT cell_id, neighbour_id, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbour_id) AS rank FROM d2 QUALIFY rank <= {K})"


@query("G9", f"WITH {NN}, {NN16}, s AS (SELECT v.cell_id, count(y.cell_id) AS i FROM v LEFT JOIN nn x ON x.cell_id = v.cell_id LEFT JOIN nn2 y ON y.cell_id = x.cell_id AND y.neighbour_id = x.neighbour_id GROUP BY 1) SELECT round(avg(i / CAST({2 * K} - i AS DOUBLE)), 6) AS agreement FROM s")
def g9(spark, sf):
    v = a.vectors(spark, sf).select("cell_id", "vector")
    return metrics.agreement(v, v.withColumn("vector", F.slice("vector", 1, 32)), K).select(*r6("agreement"))


@query("G10", f"""WITH {VECTORS}, n AS (SELECT min(n) AS small, count(*) AS sets, sum(n) AS total FROM (SELECT label, count(*) AS n FROM v GROUP BY 1)),
s AS (SELECT cell_id, e, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(cell_id AS VARCHAR)), cell_id) AS r FROM v) CROSS JOIN n WHERE r <= small),
d AS (SELECT p.cell_id, p.label AS a, q.label AS b, row_number() OVER (PARTITION BY p.cell_id ORDER BY {DISTANCE}, q.cell_id) AS r FROM s p CROSS JOIN s q WHERE p.cell_id <> q.cell_id),
k AS (SELECT CAST(greatest(10, least(total // 100, small * sets - 1)) AS DOUBLE) AS k, CAST(sets AS DOUBLE) AS sets, small FROM n),
x AS (SELECT a, count(CASE WHEN a = b THEN 1 END) / CAST(any_value(small) AS DOUBLE) AS x, any_value(k) AS k, any_value(sets) AS sets FROM d CROSS JOIN k WHERE r <= k GROUP BY 1)
SELECT a AS dataset, round(1 - (x - k / sets) / (k - k / sets), 6) AS alignment FROM x""")
def g10(spark, sf):
    v = a.vectors(spark, sf)
    return metrics.alignment(v.select("cell_id", "vector"), v.select("cell_id", F.col("label").alias("dataset"))).select("dataset", *r6("alignment"))


@query("G11", f"WITH {SNN} SELECT src AS node, round(sum(weight), 6) AS weight FROM snn WHERE src <> dst GROUP BY 1")
def g11(spark, sf):
    return graph.network(snn(spark, sf)).select("node", *r6("weight"))


@query("G12", f"WITH {LABELLED} SELECT label, round(weight, 6) AS weight FROM cw")
def g12(spark, sf):
    return graph.class_weights(snn(spark, sf), vector_labels(spark, sf)).select("label", *r6("weight"))


# Differential expression

RANKS = f"""{CLASS}, al AS (SELECT count(*) AS n_all FROM cells JOIN labels USING (cell_id)),
f AS (SELECT x.feature_id, l.label, c.cell_id, coalesce(o.value, 0) AS v FROM features x CROSS JOIN cells c JOIN labels l ON l.cell_id = c.cell_id LEFT JOIN coo o ON o.cell_id = c.cell_id AND o.feature_id = x.feature_id),
t AS (SELECT feature_id, label, v, rank() OVER (PARTITION BY feature_id ORDER BY v) AS lo, count(*) OVER (PARTITION BY feature_id, v) AS t FROM f),
rs AS (SELECT feature_id, label, sum(lo + (t - 1) / 2.0) AS r FROM t GROUP BY 1, 2),
ti AS (SELECT feature_id, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM t GROUP BY 1),
rk AS (SELECT c.feature_id, c.label, c.n, n_all, r, ties FROM cs c JOIN rs ON rs.feature_id = c.feature_id AND rs.label = c.label JOIN ti ON ti.feature_id = c.feature_id CROSS JOIN al)"""
Z = """zz AS (SELECT feature_id, label, CASE WHEN s2 > 1e-12 * n1 * n2 * nn THEN (u - 0.5 * sign(u - mu) - mu) / sqrt(s2) END AS z FROM (SELECT *, n1 * n2 + n1 * (n1 + 1) / 2 - r AS u, n1 * n2 / 2 AS mu, n1 * n2 / 12 * ((nn + 1) - ties / (nn * (nn - 1))) AS s2 FROM (SELECT feature_id, label, CAST(n AS DOUBLE) AS n1, CAST(n_all - n AS DOUBLE) AS n2, CAST(n_all AS DOUBLE) AS nn, r, ties FROM rk)))"""


@query("M1", f"WITH {DENSE}, {RANKS} SELECT feature_id, label, n, n_all, CAST(r AS DOUBLE) AS r, ties FROM rk")
def m1(spark, sf, matrix=a.cust_part):
    return diffexpr.rank_sums(matrix(spark, sf), a.segment_labels(spark, sf))


@query("M3", f"WITH {DENSE}, {RANKS}, {Z} SELECT feature_id, label, round(z, 6) + 0.0 AS score FROM zz")
def m3(spark, sf, matrix=a.cust_part):
    return diffexpr.wilcoxon(matrix(spark, sf), a.segment_labels(spark, sf)).select("feature_id", "label", *r6("score"))


WELCH = """wt AS (SELECT feature_id, label, s / n1 - s2 / n2 AS d, v1 / n1 AS a, v2 / n2 AS b, n1, n2 FROM (SELECT *, greatest((ss - s * s / n1) / (n1 - 1), 0.0) AS v1, greatest((ss2 - s2 * s2 / n2) / (n2 - 1), 0.0) AS v2 FROM
  (SELECT feature_id, label, s, ss, CAST(n AS DOUBLE) AS n1, sum(s) OVER w - s AS s2, sum(ss) OVER w - ss AS ss2, CAST(sum(n) OVER w - n AS DOUBLE) AS n2 FROM cs WINDOW w AS (PARTITION BY feature_id)))),
tt AS (SELECT feature_id, label, d / nullif(sqrt(a + b), 0) AS score, CASE WHEN a + b > 0 THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) END AS df FROM wt)"""


@query("M6", f"WITH {DENSE}, {CLASS}, {WELCH} SELECT feature_id, label, round(score, 6) + 0.0 AS score, round(df, 6) AS df FROM tt")
def m6(spark, sf, matrix=a.cust_part):
    return diffexpr.welch(matrix(spark, sf), a.segment_labels(spark, sf)).select("feature_id", "label", *r6("score", "df"))


FILTERED = f"""{LOG_MEANS.format(s='s')}, pc AS (SELECT feature_id, label, round_even(above / CAST(n AS DOUBLE), 3) AS p1, round_even((sum(above) OVER w - above) / CAST(sum(n) OVER w - n AS DOUBLE), 3) AS p2 FROM cs WINDOW w AS (PARTITION BY feature_id)),
sel AS (SELECT feature_id, label, mean_in - mean_rest AS logfc FROM pc JOIN lm USING (feature_id, label) WHERE greatest(p1, p2) > 0.02 AND abs(mean_in - mean_rest) > 0.25)"""


@query("M8", f"WITH {DENSE}, {CLASS}, {FILTERED} SELECT feature_id, label, round(logfc, 6) AS logfc FROM sel")
def m8(spark, sf):
    return diffexpr.prefilter_markers(a.cust_part(spark, sf), a.segment_labels(spark, sf), min_pct=0.02).select("feature_id", "label", *r6("logfc"))


@query("M9", f"""WITH {DENSE}, {RANKS}, {Z}, {LOG_MEANS.format(s='s')} SELECT feature_id, label AS "group", round(z, 6) + 0.0 AS score, round({NORMAL_P.format(z='z')}, 6) + 0.0 AS pval, round(mean_in - mean_rest, 6) + 0.0 AS logfc FROM zz JOIN lm USING (feature_id, label)""")
def m9(spark, sf, matrix=a.cust_part):
    return diffexpr.find_markers(matrix(spark, sf), a.segment_labels(spark, sf)).select("feature_id", "group", *r6("score", "pval", "logfc"))


@query("M10", f"""WITH {DENSE}, {CLASS}, {WELCH}, {LOG_MEANS.format(s='s')}, pv AS (SELECT feature_id, label, score, {T_P.format(t='score', df='df')} AS pval, mean_in - mean_rest AS logfc FROM tt JOIN lm USING (feature_id, label)),
x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, logfc DESC, feature_id) AS rank FROM pv WHERE pval < 0.01)
SELECT feature_id, label AS "group", round(score, 6) AS score, round(pval, 6) + 0.0 AS pval, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 50""")
def m10(spark, sf, matrix=a.cust_part):
    de = diffexpr.find_markers(matrix(spark, sf), a.segment_labels(spark, sf), method="t")
    return diffexpr.filter_rank_markers(de, count=50).select("feature_id", "group", *r6("score", "pval"), "rank")


@query("M11", f"""WITH {DENSE}, {RANKS}, {Z}, {FILTERED}, pv AS (SELECT feature_id, label, z, {NORMAL_P.format(z='z')} AS pval, logfc FROM zz JOIN sel USING (feature_id, label))
SELECT feature_id, label AS "group", round(z, 6) AS score, round(pval, 6) + 0.0 AS pval, round(logfc, 6) AS logfc, CAST(row_number() OVER (PARTITION BY label ORDER BY z DESC, logfc DESC, feature_id) AS INTEGER) AS rank FROM pv WHERE pval < 0.01""")
def m11(spark, sf):
    return diffexpr.find_all_markers(a.cust_part(spark, sf), a.segment_labels(spark, sf), min_pct=0.02).select("feature_id", "group", *r6("score", "pval", "logfc"), "rank")


# Utilities


@query("U1", """WITH r AS (SELECT p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part),
used AS (SELECT DISTINCT regexp_extract(name, '^(.*)\\.([1-9][0-9]{0,8})$', 1) AS name, CAST(nullif(regexp_extract(name, '\\.([1-9][0-9]{0,8})$', 1), '') AS BIGINT) AS k FROM r),
room AS (SELECT name, unnest(range(1, max(n) + 1 + (SELECT count(*) FROM used u WHERE u.k IS NOT NULL AND u.name = r.name))) AS k FROM r GROUP BY name),
free AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS n FROM room ANTI JOIN (SELECT * FROM used WHERE k IS NOT NULL) u USING (name, k))
SELECT id, CASE WHEN r.n = 0 THEN r.name ELSE r.name || '.' || free.k END AS name FROM r LEFT JOIN free ON free.name = r.name AND free.n = r.n""")
def u1(spark, sf):
    return fl.make_unique(a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("U2", "SELECT p_partkey AS id, p_size AS v, CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS INTEGER) AS position FROM part")
def u2(spark, sf):
    return fl.counting_sort(a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v")))


@query("U3", "WITH f AS (SELECT c_nationkey AS label, CAST(row_number() OVER (ORDER BY min(c_custkey)) AS INTEGER) AS dense FROM customer GROUP BY 1) SELECT c_custkey AS id, c_nationkey AS label, dense FROM customer JOIN f ON c_nationkey = label")
def u3(spark, sf):
    return fl.relabel(a.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label")))


@query("U4", "SELECT c_custkey AS id, CASE WHEN c_acctbal > -500 AND c_acctbal <= 0 THEN 1 WHEN c_acctbal > 0 AND c_acctbal <= 2500.5 THEN 2 WHEN c_acctbal > 2500.5 AND c_acctbal <= 8000 THEN 3 ELSE 0 END AS bin FROM customer")
def u4(spark, sf):
    return a.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), fl.interval(F.col("c_acctbal"), [0, -500, 8000, 2500.5]).alias("bin"))


@query("U5", f"WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), p AS (SELECT p_partkey AS id, p_retailprice AS x, lo, hi FROM part CROSS JOIN e) SELECT id, CASE WHEN hi = lo THEN 1 {BINS} ELSE 0 END AS bin FROM p")
def u5(spark, sf):
    return fl.cut_width(a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x")), "x", 20).select("id", "bin")


@query("U5_frequency", "WITH e AS (SELECT quantile_cont(p_retailprice, [i / 10.0 for i in range(0, 11)]) AS q FROM part) SELECT p_partkey AS id, CAST(CASE WHEN p_retailprice = q[1] THEN 1 ELSE len([b for b in q if b < p_retailprice]) END AS INTEGER) AS bin FROM part CROSS JOIN e")
def u5_frequency(spark, sf):
    return fl.cut_frequency(a.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x")), "x", 11).select("id", "bin")


@query("U6", "SELECT n_name AS name, CAST(i AS INTEGER) AS copy FROM nation, unnest(range(1, 4)) AS r(i)")
def u6(spark, sf):
    return fl.rep_each(a.table(spark, sf, "nation").select(F.col("n_name").alias("name")), 3)


@query("U7", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def u7(spark, sf):
    return fl.tied_rank(a.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), "l_quantity", "l_suppkey").select("l_orderkey", "l_linenumber", "rank")


@query("U8", "SELECT l_suppkey, l_partkey, l_quantity FROM (SELECT l_suppkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey) AS r FROM lineitem) WHERE r = 1")
def u8(spark, sf):
    return fl.arg_max(a.table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


# Data behind plots


@query("V1", f"WITH {DENSE}, {NORM.format(scale='100.0')}, m AS (SELECT f.feature_id, coalesce(sum(n.value), 0.0) / (SELECT count(*) FROM cells) AS mean FROM features f LEFT JOIN n ON n.feature_id = f.feature_id WHERE f.feature_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY 1) SELECT feature_id, round(mean, 6) AS mean, CAST(row_number() OVER (ORDER BY mean DESC, feature_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 10")
def v1(spark, sf, matrix=a.cust_part):
    drop = a.table(spark, sf, "part").filter("p_size = 1").select(F.col("p_partkey").alias("feature_id"))
    return plots.highest_expressed(matrix(spark, sf), 10, drop).select("feature_id", *r6("mean"), "rank")


@query("V2", f"""WITH RECURSIVE {EIGEN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY pc ORDER BY abs(value) DESC, feature_id) AS INTEGER) AS rank FROM load WHERE pc <= 6)
SELECT pc, rank, feature_id, round(value, 6) + 0.0 AS value FROM r WHERE rank <= 10""")
def v2(spark, sf):
    return plots.loadings(embedded(spark, sf), 6, 10).select("pc", "rank", "feature_id", *r6("value"))


@query("V3", f"WITH RECURSIVE {EIGEN} SELECT cell_id, round(max(CASE WHEN pc = 1 THEN value END), 6) + 0.0 AS x, round(max(CASE WHEN pc = 2 THEN value END), 6) + 0.0 AS y FROM coord GROUP BY 1")
def v3(spark, sf):
    return plots.scatter(embedded(spark, sf)).select("cell_id", *r6("x", "y"))


@query("V4", f"WITH RECURSIVE {EIGEN} SELECT pc, round(sum(stdev) OVER (ORDER BY pc) / (SELECT sum(stdev) FROM dev), 6) AS share FROM dev")
def v4(spark, sf):
    return plots.elbow(embedded(spark, sf)).select("pc", *r6("share"))


@query("V5", f"WITH {DENSE} SELECT f.feature_id, l.label = 1 AS in_group, c.cell_id, coalesce(o.value, 0) AS value FROM (SELECT feature_id FROM coo GROUP BY 1 ORDER BY sum(value) DESC, feature_id LIMIT 3) f CROSS JOIN cells c JOIN labels l ON l.cell_id = c.cell_id LEFT JOIN coo o ON o.cell_id = c.cell_id AND o.feature_id = f.feature_id")
def v5(spark, sf):
    m = a.cust_part(spark, sf)
    top = m.coo.groupBy("feature_id").agg(F.sum("value").alias("t")).orderBy(F.desc("t"), "feature_id").limit(3)
    return plots.group_values(m, a.segment_labels(spark, sf), top, 1)


@query("V6", f"""WITH {DENSE}, {CLASS}, f AS (SELECT x.feature_id, l.label, coalesce(o.value, 0) AS v FROM features x CROSS JOIN cells c JOIN labels l ON l.cell_id = c.cell_id LEFT JOIN coo o ON o.cell_id = c.cell_id AND o.feature_id = x.feature_id),
q AS (SELECT feature_id, label, quantile_cont(CAST(v AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM f GROUP BY 1, 2)
SELECT feature_id, label, n - above AS zeros, above AS positive, round(s / n, 6) AS mean, round(q[1], 6) AS lower, round(q[2], 6) AS middle, round(q[3], 6) AS upper FROM cs JOIN q USING (feature_id, label)""")
def v6(spark, sf, matrix=a.cust_part):
    rows = plots.violin(matrix(spark, sf), a.segment_labels(spark, sf))
    return rows.select("feature_id", "label", "zeros", "positive", *r6("mean"), *((F.round(F.col("quantiles")[i], 6) + 0.0).alias(name) for i, name in enumerate(("lower", "middle", "upper"))))


# Extension


@query("X1", "SELECT date_trunc('hour', ts) AS window_start, user_id AS cell, event_type AS feature, count(*) AS value FROM events GROUP BY 1, 2, 3")
def x1(spark, sf):
    return windowed_counts(a.table(spark, sf, "events"))
