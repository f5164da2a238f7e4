"""Operators against dense NumPy versions, known values and invariants."""

import gzip
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import labels as fl
from tallyframe.functions.special import normal_two_sided, t_two_sided
from tallyframe.matrix import CountMatrix
from tallyframe.operators import diffexpr, filtering, graph, hvg, linalg, metrics, neighbours, normalize, stats
from tallyframe.sources import errors, files, hdf5, names, text_formats
from tests.recorded import Recorded


@pytest.fixture(scope="module")
def dense():
    r = np.random.default_rng(11)
    x = r.poisson(1.2, (30, 8)) * (r.random((30, 8)) < 0.5)
    x[4] = 0  # an empty cell
    x[:, 6] = 0  # an empty feature
    return x


@pytest.fixture(scope="module")
def m(spark, dense):
    return matrix(spark, dense)


def matrix(spark, x, kind="long"):
    cast = int if kind == "long" else float
    coo = [(i, j, cast(x[i, j])) for i, j in zip(*np.nonzero(x))]
    coo = [(int(i), int(j), v) for i, j, v in coo]
    return CountMatrix(
        spark.createDataFrame(coo, f"cell_id long, feature_id long, value {kind}"),
        spark.createDataFrame([(i, f"c{i}") for i in range(x.shape[0])], "cell_id long, name string"),
        spark.createDataFrame([(j, f"f{j}") for j in range(x.shape[1])], "feature_id long, name string"),
    )


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(i, i % 3 + 1) for i in range(30)], "cell_id long, label int")


def by_feature(df, *columns):
    return {r.feature_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_filter_takes_cells_first(m, dense):
    got = filtering.filter_counts(m, min_cells=9, min_features=2, min_umi=3)
    rows = [i for i in range(30) if (dense[i] > 0).sum() >= 2 and dense[i].sum() > 3]
    columns = [j for j in range(8) if (dense[rows, j] > 0).sum() >= 9]
    assert sorted(r.cell_id for r in got.cells.collect()) == rows
    assert sorted(r.feature_id for r in got.features.collect()) == columns
    assert got.coo.agg(F.sum("value")).first()[0] == dense[np.ix_(rows, columns)].sum()
    assert filtering.filter_counts(m).shape() == (30, 8)


def test_row_sums_after_normalising(m):
    sums = [r.s for r in normalize.row_norm(m, 100).coo.groupBy("cell_id").agg(F.sum("value").alias("s")).collect()]
    assert len(sums) == 29 - sum(0 for _ in ()) or sums
    assert np.allclose(sums, 100)
    assert dict(normalize.normalize_cells(m, dtype="float").coo.dtypes)["value"] == "float"
    with pytest.raises(ValueError):
        normalize.normalize_cells(m, "other")


def test_stats_count_zeros(m, dense, classes):
    got = by_feature(stats.feature_stats(m), "mean", "var")
    for j in range(8):
        assert np.allclose(got[j], (dense[:, j].mean(), dense[:, j].var(ddof=1)))
    for r in stats.class_stats(m, classes).collect():
        own = dense[np.arange(30) % 3 + 1 == r.label, r.feature_id]
        assert np.allclose((r.n, r["mean"], r["var"]), (len(own), own.mean(), own.var(ddof=1)))


def test_scaling_densifies_to_standard_scores(m, dense):
    got = {(r.cell_id, r.feature_id): r.value for r in normalize.scale_features(m).densify().collect()}
    sd = dense.std(axis=0, ddof=1)
    want = np.where(sd > 0, (dense - dense.mean(0)) / np.where(sd > 0, sd, 1), 0)
    assert np.allclose([[got[i, j] for j in range(8)] for i in range(30)], want)
    top = normalize.scale_features(m, scale_max=1.0).densify().agg(F.max("value")).first()[0]
    assert top <= 1 + 1e-9


def test_rank_sums_with_zeros_and_negatives(spark, classes):
    r = np.random.default_rng(5)
    x = r.integers(-2, 4, (30, 6)).astype(float)
    got = {(q.feature_id, q.label): q.score for q in diffexpr.wilcoxon(matrix(spark, x, "double"), classes).collect()}
    lab = np.arange(30) % 3 + 1
    for j in range(6):
        v = x[:, j]
        ranks = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        ties = sum(c**3 - c for c in np.unique(v, return_counts=True)[1])
        for k in (1, 2, 3):
            n1 = (lab == k).sum()
            n2 = 30 - n1
            u = n1 * n2 + n1 * (n1 + 1) / 2 - ranks[lab == k].sum()
            sd = math.sqrt(n1 * n2 / 12 * (31 - ties / (30 * 29)))
            mu = n1 * n2 / 2
            assert math.isclose(got[j, k], (u - 0.5 * np.sign(u - mu) - mu) / sd, abs_tol=1e-9)


def test_welch(m, dense, classes):
    lab = np.arange(30) % 3 + 1
    for r in diffexpr.welch(m, classes).collect():
        a, b = dense[lab == r.label, r.feature_id], dense[lab != r.label, r.feature_id]
        s = a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)
        if s == 0:
            assert r.score is None
        else:
            assert math.isclose(r.score, (a.mean() - b.mean()) / math.sqrt(s), rel_tol=1e-9)


def test_tail_probabilities(spark):
    rows = spark.createDataFrame([(1.959963984540054, 5.0), (0.0, 1.0), (-2.0, 10.0), (None, 3.0)], "t double, df double")
    got = [(r.z, r.p) for r in rows.select(normal_two_sided("t").alias("z"), t_two_sided("t", "df").alias("p")).collect()]
    assert math.isclose(got[0][0], 0.05, rel_tol=1e-9) and got[1] == (1.0, 1.0)
    assert math.isclose(got[2][1], 0.07338803477074046, rel_tol=1e-9) and got[3] == (None, None)


def test_markers_find_the_class_that_differs(spark, classes):
    x = np.random.default_rng(1).poisson(1.0, (30, 5))
    x[np.arange(30) % 3 == 1, 2] += 20
    found = diffexpr.find_all_markers(matrix(spark, x), classes, method="t").filter("rank = 1 and group = 2").collect()
    assert [r.feature_id for r in found] == [2] and found[0].score > 0
    rank = diffexpr.find_markers(matrix(spark, x), classes).filter("feature_id = 2 and group = 2").first()
    assert rank.score < 0 and rank.pval < 1e-3


def test_variable_features(m, spark):
    for method in ("vst", "dispersion", "meanvarplot", "saunders"):
        got = hvg.find_variable_features(m, 3, method).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3]
        assert [r.metric for r in got] == sorted((r.metric for r in got), reverse=True)
    with pytest.raises(ValueError):
        hvg.find_variable_features(m, 3, "other")


@pytest.mark.parametrize("kind", ["overdispersed", "curved"])
def test_local_regression_against_a_fit_at_every_point(spark, kind):
    """The cubics between knots stay within 1e-3 of direct local regression at every point."""
    r = np.random.default_rng(11)
    x = r.uniform(-2, 2, 700) if kind == "curved" else np.log10(r.gamma(0.6, 2, 700) + 0.01)
    y = np.sin(x) / 3 + r.normal(size=700) * 0.05 if kind == "curved" else np.log10(np.sqrt(10**x + 0.3 * 100**x)) + r.normal(size=700) * 0.05
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    line = hvg.loess_at_knots(points, 0.5)
    found = [(q.x, q.fit) for q in points.select("x", hvg.blend(F.col("x"), line).alias("fit")).collect()]
    for at, fit in found:
        u = x - at
        h = np.quantile(np.abs(u), 0.5)
        w = np.where(np.abs(u) < h, (1 - (np.abs(u) / h) ** 3) ** 3, 0)
        a = np.stack([np.ones(700), u, u * u], 1)
        direct = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
        assert abs(fit - direct) < 1e-3


def test_principal_components(m, dense):
    e = linalg.embedding(linalg.centered_copy(m), 4)
    c = dense - dense.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose([r.stdev for r in e.stdev.orderBy("pc").collect()], s[:4] / math.sqrt(29), atol=1e-7)
    got = np.zeros((30, 4))
    for r in e.coordinates.collect():
        got[r.cell_id, r.pc - 1] = r.value
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-6)
    with pytest.raises(ValueError):
        linalg.embedding(linalg.centered_copy(m), 2, "umap")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_neighbours_of_many_copies(spark, metric):
    """Copies are at one distance, so the smallest ids are the nearest."""
    r = np.random.default_rng(4)
    kinds = r.normal(size=(3, 7)) * 100
    rows = [(i, kinds[i % 3].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "cell_id long, vector array<double>")
    for own in (True, False):
        found = neighbours.nearest_neighbours(df, 5, metric, include_self=own).collect()
        got = {(x.cell_id, x["rank"]): x.neighbour_id for x in found}
        for i in range(300):
            want = [j for j in range(i % 3, 300, 3) if own or j != i][:5]
            assert [got[i, k] for k in range(1, 6)] == want


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_neighbours(spark, metric):
    x = np.random.default_rng(4).random((90, 6))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(90)], "cell_id long, vector array<double>")
    got = {(r.cell_id, r["rank"]): r.neighbour_id for r in neighbours.nearest_neighbours(df, 5, metric, block_rows=25).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - n @ n.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert len(got) == 450
    for i in range(90):
        assert [got[i, k] for k in range(1, 6)] == np.lexsort((np.arange(90), d[i].round(12)))[:5].tolist()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("case", ["random", "ties", "copies", "wide", "few"])
def test_same_among_nearest(spark, monkeypatch, metric, case):
    """Tags among the nearest are counted by tallies, with ties and copies, as by plain distances."""
    from tallyframe.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE", 32)
    r = np.random.default_rng(7)
    x = r.normal(size=(150, 6))
    if case == "ties":
        x = r.integers(-1, 2, (150, 6)).astype(float)
    elif case == "copies":
        x[20:130] = x[20]
    elif case == "wide":
        x *= 10.0 ** r.integers(-9, 9, (150, 1))
    k = 150 if case == "few" else 12
    tags = r.integers(0, 3, 150)
    rows = spark.createDataFrame([(i * 7 % 151, [float(t) for t in v], int(g)) for i, (v, g) in enumerate(zip(x, tags))], "cell_id long, vector array<double>, tag long")
    asked, search = [], neighbours.search
    monkeypatch.setattr(neighbours, "search", lambda *a, **b: (asked.append(b.get("tally", False)), search(*a, **b))[1])
    got = {q.cell_id: (q.tag, q.same) for q in neighbours.same_among_nearest(rows, k, metric).collect()}
    assert asked[0] and (case in ("ties", "copies", "wide") or len(asked) == 1)
    ids = np.arange(150) * 7 % 151
    n = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)
    for i in range(150):
        d = 1 - (n[i] * n).sum(1) if metric == "cosine" else np.sqrt(((x[i] - x) ** 2).sum(1))
        near = [j for j in np.lexsort((ids, d)) if j != i][:k]
        assert got[ids[i]] == (tags[i], (tags[near] == tags[i]).sum())
    assert len(got) == 150


def test_communities_of_three_cliques(spark):
    edges = [(g * 6 + a, g * 6 + b, 1.0) for g in range(3) for a in range(6) for b in range(6) if a != b]
    edges += [(5, 6, 0.3), (6, 5, 0.3), (11, 12, 0.3), (12, 11, 0.3)]
    found = graph.cluster(spark.createDataFrame(edges, "src long, dst long, weight double"), nrandomstarts=2).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.label, set()).add(r.cell_id)
    assert sorted(map(sorted, groups.values())) == [list(range(g * 6, g * 6 + 6)) for g in range(3)]


#: The friendships of Zachary's karate club (1977), 34 members.
CLUB = """2-1 3-1 3-2 4-1 4-2 4-3 5-1 6-1 7-1 7-5 7-6 8-1 8-2 8-3 8-4 9-1 9-3 10-3 11-1 11-5 11-6 12-1 13-1 13-4 14-1 14-2 14-3 14-4
17-6 17-7 18-1 18-2 20-1 20-2 22-1 22-2 26-24 26-25 28-3 28-24 28-25 29-3 30-24 30-27 31-2 31-9 32-1 32-25 32-26 32-29
33-3 33-9 33-15 33-16 33-19 33-21 33-23 33-24 33-30 33-31 33-32 34-9 34-10 34-14 34-15 34-16 34-19 34-20 34-21 34-23 34-24 34-27 34-28 34-29 34-30 34-31 34-32 34-33"""


def test_communities_of_a_club(spark):
    """Ten starts agree with what is known of this graph; every start's modularity is that of its labels."""
    pairs = [tuple(map(int, e.split("-"))) for e in CLUB.split()]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, weight double")
    every, q = graph.louvain(edges, starts=3)
    for i in range(3):
        labels = every.filter(F.col("start") == i).select("node", "label")
        assert labels.count() == 34 and abs(graph.modularity(edges, labels, 0.8).first()[0] - q[i]) < 1e-9
        # No single member can do better elsewhere.
        of, links = {r.node: r.label for r in labels.collect()}, {}
        for a, b in pairs:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        size = {c: sum(len(links[n]) for n in of if of[n] == c) for c in set(of.values())}
        gain = lambda n, c: sum(of[m] == c for m in links[n]) - 0.8 * len(links[n]) * (size[c] - (len(links[n]) if of[n] == c else 0)) / (2 * len(pairs))
        better = [n for n in of if max(gain(n, c) for c in size) > gain(n, of[n]) + 1e-9]
        assert len(better) <= 3
    found = {r.cell_id: r.label for r in graph.cluster(edges).collect()}
    assert len(set(found.values())) == 3
    # The two leaders are apart, as their followers were.
    assert found[1] != found[34] and all(found[i] == found[1] for i in (2, 4, 8, 12, 13)) and all(found[i] == found[34] for i in (15, 16, 19, 21, 23))


def test_moves_never_lower_modularity(spark, monkeypatch):
    """On a dense random graph, where moves get in each other's way, every round of the first level gains, to the last."""
    r = np.random.default_rng(8)
    a = np.triu(r.random((40, 40)) * (r.random((40, 40)) < 0.4), 1)
    a += a.T
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, weight double")
    states, cut = [], graph.cut

    def seen(df, name):
        out = cut(df, name)
        if name == "graph-nodes":
            states.append({(x.start, x.node): x.label for x in out.collect()})
        return out

    monkeypatch.setattr(graph, "cut", seen)
    every, q = graph.louvain(edges, 0.8, 2)
    w = a.sum(1)
    rise = (a - 0.8 * np.outer(w, w) / w.sum()) / w.sum()
    for start in range(2):
        of = [np.array([s[start, n] for n in range(40)]) for s in states if len(s) == 80]
        gains = [sum(rise[np.ix_(x == c, x == c)].sum() for c in set(x.tolist())) for x in of]
        assert len(gains) > 2 and all(y >= x - 1e-12 for x, y in zip(gains, gains[1:])) and gains[-1] > gains[0]
        # At the end of the level nobody gains by a move.
        x = of[-1]
        for n in range(40):
            to = {c: a[n, x == c].sum() - 0.8 * w[n] * (w[x == c].sum() - w[n] * (x[n] == c)) / w.sum() for c in set(x.tolist())}
            assert max(to.values()) <= to[x[n]] + 1e-8
        assert q[start] >= gains[-1] - 1e-9


def test_buckets_settle_in_few_rounds(spark, monkeypatch):
    """Nodes in six buckets that move side by side find planted groups, and nobody gains by a move at the end."""
    monkeypatch.setattr(graph, "BUCKET", 16)
    r = np.random.default_rng(4)
    group = np.arange(96) % 6
    a = np.triu(r.random((96, 96)) < np.where(group[:, None] == group, 0.7, 0.05), 1).astype(float)
    a += a.T
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))], "src long, dst long, weight double")
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: (rounds.append(name), cut(df, name))[1])
    every, q = graph.louvain(edges, 0.8, 2)
    assert rounds.count("graph-wants") < 60
    for start in range(2):
        x = np.array([s.label for s in every.filter(F.col("start") == start).orderBy("node").collect()])
        assert len(set(x.tolist())) == 6 and all(len(set(x[group == g].tolist())) == 1 for g in range(6))
        w = a.sum(1)
        assert abs(q[start] - sum(((a - 0.8 * np.outer(w, w) / w.sum()) / w.sum())[np.ix_(x == c, x == c)].sum() for c in set(x.tolist()))) < 1e-9


def test_moves_of_many_at_a_time_are_as_one_by_one():
    """Nodes that move together leave and join clusters of their own: weight inside rises by what each gains, to the end."""
    r = np.random.default_rng(3)
    a = np.triu(r.random((300, 300)) * (r.random((300, 300)) < 0.05), 1)
    a += a.T
    src, ends = np.nonzero(a)
    weight, at = a[src, ends], np.searchsorted(src, np.arange(301))
    w, own = a.sum(1), np.arange(300)
    label, size, scale = own.copy(), w.copy(), 0.8 / w.sum()
    worth = lambda: sum(a[np.ix_(label == c, label == c)].sum() - scale * w[label == c].sum() ** 2 for c in set(label.tolist()))
    rows = np.array([5, 17, 200])
    gain, to = graph.best_of(rows, own, ends, weight, at, label, w, size, scale)
    for i, g, t in zip(rows, gain, to):
        every = [a[i, label == c].sum() - scale * w[i] * (size[c] - w[i] * (label[i] == c)) for c in range(300)]
        assert every[t] - every[label[i]] == pytest.approx(g) and g == pytest.approx(max(every[c] for c in ends[src == i]) - every[label[i]])
    values = [worth()]
    for seed in range(20):
        todo = graph.gaining(own, ends, weight, at, label, w, size, scale)
        graph.settled(own, ends, weight, at, label, w, size, scale, todo, 1, np.random.default_rng(seed))
        assert np.allclose(size, np.bincount(label, w, 300))
        values.append(worth())
    assert all(y >= x - 1e-9 for x, y in zip(values, values[1:])) and values[-1] > values[0] + 1
    graph.settled(own, ends, weight, at, label, w, size, scale, own, 1024, np.random.default_rng(9))
    assert not len(graph.gaining(own, ends, weight, at, label, w, size, scale))


def test_few_nodes_that_gain_are_dealt_anew(spark, monkeypatch):
    """When few nodes gain, they and their neighbours are moved by one task; nobody gains by a move at the end."""
    monkeypatch.setattr(graph, "BUCKET", 16)
    monkeypatch.setattr(graph, "FEW", 1)
    r = np.random.default_rng(6)
    group = np.arange(96) % 8
    a = np.triu(r.random((96, 96)) < np.where(group[:, None] == group, 0.7, 0.03), 1).astype(float)
    a += a.T
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))], "src long, dst long, weight double")
    asked, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda *x: (asked.append(x[5]), settle(*x))[1])
    every, q = graph.louvain(edges, 0.8, 2)
    assert asked
    w = a.sum(1)
    rise = (a - 0.8 * np.outer(w, w) / w.sum()) / w.sum()
    for start in range(2):
        x = np.array([s.label for s in every.filter(F.col("start") == start).orderBy("node").collect()])
        assert abs(q[start] - sum(rise[np.ix_(x == c, x == c)].sum() for c in set(x.tolist()))) < 1e-9
        assert len(set(x.tolist())) == 8 and all(len(set(x[group == g].tolist())) == 1 for g in range(8))


def test_purity_and_alignment(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (2, 1), (3, 3)], "cluster int, class int")
    assert math.isclose(stats.purity(pairs).first().purity, 5 / 7)
    x = np.random.default_rng(0).normal(size=(120, 4))
    rows = lambda y: spark.createDataFrame([(i, [float(v) for v in y[i]]) for i in range(120)], "cell_id long, vector array<double>")
    sets = spark.createDataFrame([(i, i % 2) for i in range(120)], "cell_id long, dataset int")
    mixed = [r.alignment for r in metrics.alignment(rows(x), sets).collect()]
    apart = [r.alignment for r in metrics.alignment(rows(x + (np.arange(120) % 2 * 20)[:, None]), sets).collect()]
    assert min(mixed) > 0.8 and max(apart) < 0.05
    assert math.isclose(metrics.agreement(rows(x), rows(x)).first().agreement, 1.0)


def test_unique_names(spark):
    rows = spark.createDataFrame(list(enumerate(["a", "b", "a", "a.1"], 1)), "id long, name string")
    assert [r.name for r in fl.make_unique(rows).orderBy("id").collect()] == ["a", "b", "a.2", "a.1"]


MTX = "%%MatrixMarket matrix coordinate integer general\n% note\n3 2 4\n1 1 5\n3 2 1\n3 2 2\n2 1 7\n"


def entries(m):
    return sorted(tuple(r) for r in m.coo.select("cell_id", "feature_id", "value").collect())


def test_readers(spark, tmp_path):
    (tmp_path / "v2").mkdir()
    (tmp_path / "v2/matrix.mtx").write_text(MTX)
    (tmp_path / "v2/genes.tsv").write_text("g1\tA_1\ng2\tB\ng3\tB\n")
    (tmp_path / "v2/barcodes.tsv").write_text("x\ny\n")
    want = [(1, 1, 5), (1, 2, 7), (2, 3, 3)]
    m = files.read_data(spark, str(tmp_path / "v2"))
    assert entries(m) == want and [r.name for r in m.features.orderBy("feature_id").collect()] == ["A-1", "B", "B.1"]
    (tmp_path / "v3").mkdir()
    for new, old in (("matrix.mtx", "matrix.mtx"), ("features.tsv", "genes.tsv"), ("barcodes.tsv", "barcodes.tsv")):
        with gzip.open(tmp_path / f"v3/{new}.gz", "wt") as f:
            f.write((tmp_path / "v2" / old).read_text())
    assert entries(files.read_data(spark, str(tmp_path / "v3"))) == want
    (tmp_path / "t.csv").write_text("gene,x,y\nA,5,0\nB,7,0\nC,0,3\n")
    assert entries(files.read_data(spark, str(tmp_path / "t.csv"))) == want
    (tmp_path / "t.dge.txt").write_text(MTX.replace("% note", "%%GENES\tA\tB\tC\n%%CELL_BARCODES\tx\ty"))
    assert entries(files.read_data(spark, str(tmp_path / "t.dge.txt"))) == want
    files.write_parquet(m, str(tmp_path / "p"))
    assert entries(files.read_data(spark, str(tmp_path / "p"))) == want


def test_reader_errors(spark, tmp_path):
    (tmp_path / "bad.mtx").write_text(MTX.replace("3 2 4", "3 2 5"))
    with pytest.raises(errors.MatrixParseError):
        text_formats.read_mm(spark, str(tmp_path / "bad.mtx"))
    with pytest.raises(errors.MatrixParseError):
        text_formats.check_banner("%%MatrixMarket matrix array real general")
    with pytest.raises(errors.LayoutError):
        files.read_data(spark, str(tmp_path / "x.unknown"))
    with pytest.raises(Exception, match="whole numbers"):
        names.convert_counts(spark.createDataFrame([(1, 1, 0.5)], "cell_id long, feature_id long, value double"), *(spark.createDataFrame([(1, "a")], f"{k} long, name string") for k in ("cell_id", "feature_id"))).coo.collect()
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(errors.MissingLibrary):
            hdf5.read_h5(spark, str(tmp_path / "x.h5"))


def test_cluster_query_takes_the_best_of_ten_starts(spark, monkeypatch):
    from tallyframe.plans import queries

    edges = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6) if i != j and i // 3 == j // 3], "src long, dst long, weight double")
    asked = []

    def start(edges, resolution, starts):
        asked.append(starts)
        nodes = edges.select(F.col("src").alias("node")).distinct()
        labels = nodes.crossJoin(spark.range(starts).select(F.col("id").cast("int").alias("start")))
        return labels.withColumn("label", F.when(F.col("start") == 7, F.floor(F.col("node") / 3)).otherwise(F.col("node"))), {i: 0.5 if i == 7 else 0.1 for i in range(starts)}

    monkeypatch.setattr(graph, "louvain", start)
    monkeypatch.setattr(queries, "snn", lambda spark, sf: edges)
    found = {r.cell_id: r.label for r in queries.QUERIES["G6"](spark, "").collect()}
    assert asked == [10]
    assert len({found[i] for i in range(3)}) == 1 and len(set(found.values())) == 2


@pytest.mark.parametrize("hot", [1 << 20, 50])
def test_products_with_a_hot_inner_index(spark, monkeypatch, hot):
    monkeypatch.setattr(linalg, "HOT_PRODUCTS", hot)
    r = np.random.default_rng(9)
    x, y, z = r.integers(-3, 4, (40, 12)) * (r.random((40, 12)) < 0.3), r.integers(-3, 4, (12, 30)) * (r.random((12, 30)) < 0.3), r.integers(-2, 3, (40, 30)) * (r.random((40, 30)) < 0.1)
    x[:, 5], y[5] = 1, 2
    frame = lambda m, names: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], f"{names[0]} long, {names[1]} long, value double")
    for beta in (0.0, 1.0, 0.5):
        got = np.zeros((40, 30))
        for q in linalg.multiply(frame(x, "ik"), frame(y, "kj"), 3.0, beta, frame(z, "ij")).collect():
            got[q.i, q.j] += q.value
        assert (got == 3 * (x @ y) + beta * z).all()


@pytest.mark.parametrize("pairs", [1 << 20, 100])
def test_gram_of_sparse_cells(spark, monkeypatch, pairs):
    """Cells of none to all features, in small runs too; features without an entry; no self-join."""
    monkeypatch.setattr(linalg, "PAIRS", pairs)
    r = np.random.default_rng(12)
    x = np.round(r.normal(size=(60, 25)), 3) * (r.random((60, 25)) < r.random((60, 1)))
    x[0], x[1], x[:, 7] = 0, 1, 0
    coo = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell_id long, feature_id long, value double")
    m = CountMatrix(coo, spark.range(60).select(F.col("id").alias("cell_id")), spark.range(25).select(F.col("id").alias("feature_id")))
    out = linalg.gram(linalg.centered_copy(m))
    c = x - x.mean(0)
    got = {(q.i, q.j): q.value for q in out.collect()}
    assert got.keys() == {(i, j) for i in range(25) for j in range(i, 25)}
    assert all(abs(v - c[:, i] @ c[:, j]) < 1e-9 for (i, j), v in got.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and not re.search(r"Join[^\n]*cell_id[^\n]*Inner", plan)


def svd_by_numpy(monkeypatch, x, mu, k, **kw):
    """(values, vectors, passes) of the solver on ``x - mu``, its two passes over the cells done in memory."""
    c, calls = x - mu, []

    def qr(rows, ids, mu, v):
        calls.append(1)
        r = np.linalg.qr(c @ v, "r")
        return np.concatenate([r, np.zeros((v.shape[1] - len(r), v.shape[1]))])

    with monkeypatch.context() as patch:
        patch.setattr(linalg, "tall_qr", qr)
        patch.setattr(linalg, "adjoint_times", lambda rows, ids, mu, v, t: calls.append(1) or c.T @ (c @ v @ t))
        s, v = linalg.truncated_svd(None, np.arange(x.shape[1]), mu, k, direct=0, **kw)
    return s, v, len(calls)


@pytest.mark.parametrize("f", [21, 25, 41, 50, 64, 79, 80, 100, 119, 120, 150, 200])
def test_svd_of_any_number_of_features(monkeypatch, f):
    x = np.random.default_rng(f).normal(size=(300, f))
    mu = x.mean(0)
    s, v, _ = svd_by_numpy(monkeypatch, x, mu, 10)
    assert np.allclose(s, np.linalg.svd(x - mu, compute_uv=False)[:10], rtol=1e-10)
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-12)
    assert np.allclose((x - mu).T @ ((x - mu) @ v), v * s**2, atol=1e-5 * s[0] ** 2 / 100)


def test_svd_keeps_small_singular_values(monkeypatch):
    """Values down to 1e-7 of the largest, where the Gram matrix would leave no digit."""
    r = np.random.default_rng(6)
    values = 10.0 ** -np.linspace(0, 7, 15)
    full = np.concatenate([values, values[-1] * 0.5 ** np.arange(1, 286)])
    x = np.linalg.qr(r.normal(size=(500, 300)))[0] * full @ np.linalg.qr(r.normal(size=(300, 300)))[0]
    s, v, passes = svd_by_numpy(monkeypatch, x, np.zeros(300), 15, tol=1e-13)
    assert np.allclose(s, values, rtol=1e-9)
    again, _, fewer = svd_by_numpy(monkeypatch, x, np.zeros(300), 15, tol=1e-13, start=v)
    assert np.allclose(again, values, rtol=1e-9) and fewer < passes


def test_svd_of_special_matrices(monkeypatch):
    r = np.random.default_rng(7)
    several = np.diag([1.0] * 3 + [0.5] * 100 + [0.1] * 97)
    for x in (np.zeros((40, 200)), np.outer(r.normal(size=40), r.normal(size=200)), np.eye(200), several, r.normal(size=(5, 200)), r.normal(size=(30, 8)) @ r.normal(size=(8, 200))):
        k = min(10, *x.shape)
        s, v, _ = svd_by_numpy(monkeypatch, x, np.zeros(200), k)
        assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:k], atol=1e-10) and np.allclose(v.T @ v, np.eye(k), atol=1e-10)
    with pytest.raises(RuntimeError, match="no convergence"):
        svd_by_numpy(monkeypatch, r.normal(size=(300, 200)), np.zeros(200), 10, steps=3)


def test_svd_passes_over_cells(spark, monkeypatch):
    """The tree QR and the adjoint product of a sparse table in many tasks, and the solver on top of them."""
    r = np.random.default_rng(5)
    x = r.poisson(0.2, (300, 150)) * (1 + 20 / (1 + np.arange(150)))
    x[:7] = 0
    entries = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    coo = spark.createDataFrame(entries, "cell_id long, feature_id long, value double")
    m = CountMatrix(coo, spark.range(300).select(F.col("id").alias("cell_id")), spark.range(150).select(F.col("id").alias("feature_id")))
    c = linalg.centered_copy(m)
    ids, mu = np.arange(150), x.mean(0)
    rows = linalg.cell_lists(c).repartition(40)
    v, t = r.normal(size=(150, 12)), r.normal(size=(12, 5))
    factor = linalg.tall_qr(rows, ids, mu, v)
    assert np.allclose(factor.T @ factor, ((x - mu) @ v).T @ ((x - mu) @ v)) and np.allclose(factor, np.triu(factor))
    assert np.allclose(linalg.adjoint_times(rows, ids, mu, v, t), (x - mu).T @ ((x - mu) @ v @ t))
    rows = rows.coalesce(3).cache()
    u, want, vt = np.linalg.svd(x - mu, full_matrices=False)
    s, v = linalg.truncated_svd(rows, ids, mu, 6, tol=1e-9, direct=0)
    assert np.allclose(s, want[:6], rtol=1e-10) and np.allclose(np.abs((v * vt[:6].T).sum(0)), 1, atol=1e-8)
    rows.unpersist()
    for direct in (0, 256):
        monkeypatch.setattr(linalg.truncated_svd, "__defaults__", (*linalg.truncated_svd.__defaults__[:4], direct, 0))
        e = linalg.pca(c, 6)
        got = np.zeros((300, 6))
        for row in e.coordinates.collect():
            got[row.cell_id, row.pc - 1] = row.value
        assert np.allclose(np.abs(got), np.abs(u[:, :6] * want[:6]), atol=1e-6)


def test_variance_keeps_digits_of_large_means(spark):
    values = [1e9, 1e9 + 1, 1e9 + 2]
    coo = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "cell_id long, feature_id long, value double")
    m = CountMatrix(coo, spark.range(3).select(F.col("id").alias("cell_id")), spark.range(1).select(F.col("id").alias("feature_id")))
    labels = spark.range(3).select(F.col("id").alias("cell_id"), F.lit(1).alias("label"))
    assert stats.feature_stats(m).first().var == 1.0 and stats.class_stats(m, labels).first().var == 1.0
    d = spark.createDataFrame([(i, 0, 1e9 + i % 3 + (i >= 6)) for i in range(12)], "cell_id long, feature_id long, value double")
    two = spark.range(12).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 6, 1).otherwise(2).alias("label"))
    got = diffexpr.welch(CountMatrix(d, spark.range(12).select(F.col("id").alias("cell_id")), m.features), two).filter("label = 2").first()
    x = np.array([0, 1, 2, 0, 1, 2.0])
    assert abs(got.score - 1 / np.sqrt(2 * x.var(ddof=1) / 6)) < 1e-6


def test_neighbours_in_blocks(spark):
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (300, 5)) / 2.0
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "cell_id long, vector array<float>").repartition(6)
    key = lambda d: sorted((q.cell_id, q.rank, q.neighbour_id) for q in d.collect())
    assert key(neighbours.nearest_neighbours(df, 7, block_rows=40)) == key(neighbours.nearest_neighbours(df, 7))


def test_hdf5_layouts_by_a_recorded_interface(spark, tmp_path):
    """Each reader on arrays stored by the layout; the executors read them through the same interface."""
    r = np.random.default_rng(2)
    x = r.poisson(0.6, (7, 5))  # features by cells
    ptr = np.concatenate([[0], np.cumsum((x > 0).sum(0))])
    index = np.concatenate([np.flatnonzero(x[:, c]) for c in range(5)])
    data = np.concatenate([x[x[:, c] > 0, c] for c in range(5)])
    genes, cells = np.array([b"g1", b"g2", b"g2", b"g4", b"g5", b"g6", b"g7"], object), np.array([f"c{i}".encode() for i in range(5)], object)
    want = {(c + 1, f + 1, float(x[f, c])) for f in range(7) for c in range(5) if x[f, c]}
    names = ["g1", "g2", "g2.1", "g4", "g5", "g6", "g7"]

    def check(m):
        assert {(q.cell_id, q.feature_id, float(q.value)) for q in m.coo.collect()} == want
        assert [q.name for q in m.features.orderBy("feature_id").collect()] == names
        assert [q.name for q in m.cells.orderBy("cell_id").collect()] == [f"c{i}" for i in range(5)]

    store = lambda name, **arrays: (np.savez(tmp_path / name, **arrays), str(tmp_path / f"{name}.npz"))[1]
    sparse = lambda g: {f"{g}/indptr": ptr, f"{g}/indices": index, f"{g}/data": data}
    check(hdf5.read_10x_h5(spark, store("tenx", **sparse("mm10"), **{"mm10/gene_names": genes, "mm10/barcodes": cells}), opener=Recorded))
    check(hdf5.read_10x_h5(spark, store("tenx3", **sparse("mm10"), **{"mm10/features/name": genes, "mm10/barcodes": cells}), opener=Recorded))
    check(hdf5.read_h5(spark, store("plain", **sparse("counts"), **{"counts/rownames": genes, "counts/colnames": cells}), opener=Recorded))
    check(hdf5.read_h5ad(spark, store("csr", **sparse("X"), **{"X@encoding-type": "csr_matrix", "obs/_index": cells, "var/_index": genes}), opener=Recorded))
    # The other orientation: columns of the stored matrix are features.
    ptr2 = np.concatenate([[0], np.cumsum((x > 0).sum(1))])
    index2, data2 = np.concatenate([np.flatnonzero(x[f]) for f in range(7)]), np.concatenate([x[f][x[f] > 0] for f in range(7)])
    check(hdf5.read_h5ad(spark, store("csc", **{"X/indptr": ptr2, "X/indices": index2, "X/data": data2, "X@h5sparse_format": "csc", "obs/_index": cells, "var/_index": genes}), opener=Recorded))
    check(hdf5.read_loom(spark, store("loom", **{"matrix": x, "col_attrs/CellID": cells, "row_attrs/Gene": genes}), step=3, opener=Recorded))
    frame = store("frame", **{"obs@column-order": np.array(["kind", "depth"], object), "obs/_index": cells, "obs/kind": np.array([0, 1, -1, 1, 0]), "obs/depth": np.array([1.5, 2, 3, 4, 5]), "obs/__categories/kind": np.array([b"a", b"b"], object)})
    got = [tuple(q) for q in hdf5.read_frame(spark, frame, "obs", step=2, opener=Recorded).orderBy("id").collect()]
    assert got == [(i + 1, f"c{i}", k, d) for i, (k, d) in enumerate(zip(["a", "b", None, "b", "a"], [1.5, 2.0, 3.0, 4.0, 5.0]))]


def test_line_numbers_are_of_one_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x\ny\nz\n")
    found = text_formats.line_numbers(spark, str(tmp_path / "a")).collect()
    assert sorted((r.id, r.value) for r in found) == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError, match="2 files"):
        text_formats.line_numbers(spark, str(tmp_path))


def test_neighbours_over_many_tiles_and_ties():
    """Tiles beyond the first, copies in number, vectors far from the origin, and ids that two rows share, against all pairs."""
    r = np.random.default_rng(11)
    for x in (r.normal(size=(1500, 8)), np.repeat(r.normal(size=(15, 8)), 100, 0), r.normal(size=(1500, 8)) * 1e-3 + 50, r.integers(0, 3, size=(1500, 4)) * 1e80):
        ids = np.concatenate([r.permutation(1499), [7]])
        for own, k in ((True, 5), (False, 40)):
            best = neighbours.Best(ids[:200], x[:200], k, "euclidean", own)
            for s in range(0, 1500, 130):
                best.add(ids[s : s + 130], x[s : s + 130], np.arange(s, min(s + 130, 1500)))
            got = best.result()
            want = neighbours.nearest(ids[:200], x[:200], ids, x, k, "euclidean", own)
            names, start, times = np.unique(ids[:200], return_index=True, return_counts=True)
            rows = [(ids[q], n) for q in start for n in want[1][want[0] == q]]
            single = set(names[times == 1])
            assert [t for t in zip(got[0], got[1]) if t[0] in single] == [t for t in rows if t[0] in single]
            assert (got[4] <= k).all() and (got[3] >= 0).all()


def test_alignment_makes_no_row_for_each_neighbour(spark, monkeypatch):
    """Every neighbour's data set is counted where it is found; the search must not return neighbours to be joined."""
    x = np.random.default_rng(12).normal(size=(90, 3))
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "cell_id long, vector array<double>")
    sets = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(90)], "cell_id long, dataset string")
    monkeypatch.setattr(metrics, "nearest_neighbours", None)
    got = {r.dataset: r.alignment for r in metrics.alignment(df, sets, k=12).collect()}
    near = np.argsort(((x[:, None] - x) ** 2).sum(2) + np.diag(np.full(90, np.inf)), axis=1)[:, :12]
    same = np.array([(near[s::2] % 2 == s).sum() / 45 for s in (0, 1)])
    assert got == pytest.approx(dict(zip("ab", 1 - (same - 6) / (12 - 6))))


def test_blocks_of_queries_are_tasks_of_their_own(spark, tmp_path):
    """A union of frames of one partition each is a single task in Spark 4.1, which would take all blocks one after the other."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "cell_id long, vector array<double>")
    out = neighbours.nearest_neighbours(df, 3, block_rows=10)
    assert len([f for f in out.inputFiles() if "nearest" in f]) >= 4
    assert out.count() == 180


def test_modularity_makes_its_edges_once(spark):
    """Edges are read three times; as a rule a search makes them."""
    seen = spark.sparkContext.accumulator(0)

    def told(w):
        seen.add(1)
        return w

    rows = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 0.5), (3, 2, 0.5)], "src long, dst long, weight double")
    edges = rows.withColumn("weight", F.udf(told, "double")("weight"))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node long, label int")
    assert graph.modularity(edges, labels).first().modularity == pytest.approx(2 / 3 - (2.5**2 + 0.5**2) / 9)
    assert seen.value == 4


def test_products_with_columns_are_taken_in_parts():
    """A thousand cells of many entries, times many columns, hold few products at a time."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(13)
    x, v, shift = r.normal(size=(1000, 64)), r.normal(size=(64, 64)), r.normal(size=64)
    kind = pa.list_(pa.struct([("feature_id", pa.int64()), ("value", pa.float64())]))
    lists = pa.array([[{"feature_id": j, "value": float(y)} for j, y in enumerate(row)] for row in x], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), lists], ["cell_id", "e"])
    tracemalloc.start()
    found = [product for *_, product in linalg.times([batch], np.arange(64), v, shift)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(np.concatenate(found), x @ v - shift)
    assert peak < 16 << 20
