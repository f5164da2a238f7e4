"""Neighbour weights against their definition, and layouts by the neighbours that they keep."""

import math

import numpy as np
import pytest

from tallyframe.operators import neighbours, umap


def frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "cell_id long, vector array<double>")


def plain_scale(d, all_mean):
    """rho and sigma of one cell's distances, by many halvings from a wide interval."""
    rho = min((x for x in d if x > 0), default=0.0)
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid == 0 or sum(math.exp(-max(x - rho, 0) / mid) for x in d) >= math.log2(len(d)):
            hi = mid
        else:
            lo = mid
    return rho, max(hi, 1e-3 * (sum(d) / len(d) if rho > 0 else all_mean))


def test_scales_and_weights(spark):
    r = np.random.default_rng(2)
    lists = [r.random(15) * 3, np.zeros(15), np.full(15, 2.0), np.concatenate([np.zeros(5), r.random(10)]), np.array([1.0] * 8 + [2.0] * 7), r.random(15) * 1e-6]
    rows = [(i, (i + 1 + j) % 40, float(x)) for i, d in enumerate(lists) for j, x in enumerate(d)]
    nn = spark.createDataFrame(rows, "cell_id long, neighbour_id long, distance double")
    all_mean = sum(x for *_, x in rows) / len(rows)
    want = {i: plain_scale(list(map(float, d)), all_mean) for i, d in enumerate(lists)}
    got = {x.cell_id: (x.rho, x.sigma) for x in umap.local_scales(nn).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9) for i in want)
    one = {(i, j): math.exp(-max(x - want[i][0], 0) / want[i][1]) for i, j, x in rows}
    weights = {(x.src, x.dst): x.weight for x in umap.fuzzy_weights(nn).collect()}
    pairs = {p for i, j in one for p in ((i, j), (j, i))}
    assert weights.keys() == pairs
    for i, j in pairs:
        a, b = one.get((i, j), 0), one.get((j, i), 0)
        assert weights[i, j] == pytest.approx(a + b - a * b, abs=1e-9) and weights[i, j] == weights[j, i]


def test_scales_are_sought_once_by_arrays(spark):
    """A cell's scale takes one pass over arrays in tasks; both directions of an edge come from it."""
    rows = [(i, (i + j) % 50, float(j)) for i in range(50) for j in range(1, 16 if i else 2)]
    out = umap.fuzzy_weights(spark.createDataFrame(rows, "cell_id long, neighbour_id long, distance double"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow cell_id") + plan.count("MapInArrow halved") == 1, plan
    assert out.count() == len({p for i, j, _ in rows for p in ((i, j), (j, i))})


def test_only_edges_of_hubs_are_drawn(spark, monkeypatch):
    """In a round edges are ranked for cells with more than EDGES edges alone; no other edge is left out."""
    monkeypatch.setattr(umap, "BUCKET", 20)
    edges = [(i, (i + j) % 60, 0.5) for i in range(60) for j in (1, 2, 58, 59)] + [(0, j, 0.1) for j in range(3, 58)]
    weights = spark.createDataFrame(edges, "src long, dst long, weight double")
    start = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(60)], "cell_id long, coordinates array<double>")
    asked, lots = [], umap.lots
    monkeypatch.setattr(umap, "lots", lambda some, seed: (asked.append({x.src for x in some.select("src").distinct().collect()}), lots(some, seed))[1])
    for most, hubs in ((100, []), (30, [{0}] * 2)):
        monkeypatch.setattr(umap, "EDGES", most)
        asked.clear()
        assert umap.layout(weights, start, nepochs=4, rounds=2).count() == 60 and asked == hubs
    assert lots(weights, 0).count() == 59 * 4 + 30


@pytest.mark.parametrize("bucket", [8192, 12])
def test_all_edges_of_a_hub_take_part(spark, monkeypatch, bucket):
    """A cell with more than EDGES edges is pulled by each of them: between two far groups that pull alike it stays in the middle."""
    monkeypatch.setattr(umap, "EDGES", 2)
    monkeypatch.setattr(umap, "BUCKET", bucket)
    weights = spark.createDataFrame([(0, j, 1.0 - j / 100) for j in range(1, 42)] + [(1, 2, 0.5)], "src long, dst long, weight double")
    dealt = [(x.src, e.dst, e.weight) for x in umap.lots(weights, 3).collect() for e in x.edges]
    assert sorted(dealt) == sorted(map(tuple, weights.collect()))
    assert max(len(x.edges) for x in umap.lots(weights, 3).collect()) == 21
    start = spark.createDataFrame([(0, [0.0, 0.0])] + [(j, [20.0 if j % 2 else -20.0, 0.0]) for j in range(1, 42)], "cell_id long, coordinates array<double>")
    found = {r.cell_id: r.coordinates for r in umap.layout(weights, start, nepochs=60).collect()}
    assert len(found) == 42 and abs(found[0][0]) < 6 and found[3] == [20.0, 0.0]


def test_curve():
    for d in (0.001, 0.1, 0.3, 0.8):
        a, b = umap.curve(d)
        x = np.linspace(0, 3, 300)[1:]
        off = lambda a, b: ((1 / (1 + a * x ** (2 * b)) - np.where(x < d, 1, np.exp(d - x))) ** 2).sum()
        assert all(off(a, b) <= off(a * u, b * v) + 1e-12 for u in (0.99, 1, 1.01) for v in (0.99, 1, 1.01))


@pytest.mark.parametrize("bucket", [8192, 60])
def test_layout_keeps_neighbours(spark, monkeypatch, bucket):
    """Five clusters stay apart and most of a cell's neighbours stay near, with all cells in one task or in several."""
    monkeypatch.setattr(umap, "BUCKET", bucket)
    monkeypatch.setattr(umap, "EDGES", 12)
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(40, 8)) * 0.5 + r.normal(size=8) * 4 for _ in range(5)])
    kind = np.repeat(range(5), 40)
    found = {q.cell_id: q.coordinates for q in umap.umap(frame(spark, x), nneighbours=12, metric="euclidean", nepochs=150).collect()}
    z = np.array([found[i] for i in range(200)])
    assert z.shape == (200, 2) and np.isfinite(z).all()
    near = [np.argsort(d, 1)[:, 1:11] for d in (((y[:, None] - y[None]) ** 2).sum(2) for y in (x, z))]
    assert (kind[near[1]] == kind[:, None]).mean() > 0.97
    assert np.mean([len(set(p) & set(q)) / 10 for p, q in zip(*near)]) > 0.3
    if bucket == 8192:
        again = {q.cell_id: q.coordinates for q in umap.umap(frame(spark, x), nneighbours=12, metric="euclidean", nepochs=150).collect()}
        assert found == again


def test_layout_of_few_and_odd_cells(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (None, [1.0, 2.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "cell_id long, vector array<double>")
    out = umap.umap(v, 3, nneighbours=2, nepochs=10).collect()
    assert sorted(r.cell_id for r in out) == [1, 2, 3, 7] and all(len(r.coordinates) == 3 for r in out)
    assert umap.umap(v.limit(0), nepochs=5).count() == 0
    # Such rows are nobody's neighbours either.
    nn = neighbours.nearest_neighbours(v, 8)
    assert {(r.cell_id, r.neighbour_id) for r in nn.collect()} == {(i, j) for i in (1, 2, 3, 7) for j in (1, 2, 3, 7)}
    with pytest.raises(Exception, match="different lengths"):
        neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "cell_id long, vector array<double>"), 1).collect()
