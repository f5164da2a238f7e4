"""Approximate neighbours: recall against the exact ones, and bounded leaves where copies abound."""

import numpy as np
import pytest

from tallyframe.operators import approximate, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "cell_id long, vector array<double>").repartition(4)


def sets(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cell_id, set()).add(r.neighbour_id)
    return out


@pytest.mark.parametrize("metric, kind", [("euclidean", "uniform"), ("cosine", "clusters")])
def test_recall(spark, metric, kind):
    r = np.random.default_rng(1)
    x = r.random((1500, 12)) if kind == "uniform" else np.concatenate([r.normal(size=(150, 30)) + r.normal(size=30) * 6 for _ in range(10)])
    v = frame(spark, x)
    found = approximate.approximate_neighbours(v, 10, metric, leaf=100, include_self=kind == "uniform").collect()
    exact = sets(neighbours.nearest_neighbours(v, 10, metric, include_self=kind == "uniform").collect())
    got = sets(found)
    assert got.keys() == exact.keys() and all(len(s) == 10 for s in got.values())
    assert sum(len(got[i] & exact[i]) for i in exact) >= 0.95 * 10 * len(exact)
    # Distances are exact, ranks follow them, and a cell is its own first neighbour or none.
    for q in found[::97]:
        y, z = x[q.cell_id], x[q.neighbour_id]
        d = 1 - y @ z / np.linalg.norm(y) / np.linalg.norm(z) if metric == "cosine" else np.linalg.norm(y - z)
        assert q.distance == pytest.approx(d, abs=1e-9)
    assert {q["rank"] for q in found} == set(range(1, 11))
    assert all((q.cell_id == q.neighbour_id) == (kind == "uniform" and q["rank"] == 1) for q in found if q["rank"] == 1 or q.cell_id == q.neighbour_id)


def test_copies_make_no_large_leaf(spark):
    """A third of all cells are copies; their leaf is dealt out, and each still finds copies."""
    r = np.random.default_rng(2)
    x = r.normal(size=(1800, 6))
    x[:600] = x[0]
    v = frame(spark, x)
    leaves = approximate.forest(v, "euclidean", 4, 50, 1)
    assert leaves.count() == 4 * 1800
    assert max(q["count"] for q in leaves.groupBy("tree", "node", "piece").count().collect()) <= 4 * 50
    found = approximate.approximate_neighbours(v, 8, include_self=False, leaf=50, rounds=1).collect()
    assert all(q.distance == 0 and q.neighbour_id < 600 for q in found if q.cell_id < 600)
    exact = sets(neighbours.nearest_neighbours(v.filter("cell_id >= 600"), 8, include_self=False).collect())
    got = sets(q for q in found if q.cell_id >= 600)
    assert sum(len(got[i] & exact[i]) for i in exact) >= 0.85 * 8 * len(exact)


def test_few_cells(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (None, [1.0, 2.0]), (5, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "cell_id long, vector array<double>")
    for own in (True, False):
        got = sets(approximate.approximate_neighbours(v, 5, include_self=own).collect())
        assert got == {i: {j for j in (1, 2, 3) if own or i != j} for i in (1, 2, 3)}
    assert sets(approximate.approximate_neighbours(v, 1).collect()) == {1: {1}, 2: {2}, 3: {3}}
    assert approximate.approximate_neighbours(v.limit(0), 3).count() == 0
    assert sets(approximate.approximate_neighbours(v, 2, dims=1, include_self=False).collect())[1] == {2, 3}
    with pytest.raises(ValueError):
        approximate.approximate_neighbours(v, 2, "manhattan")


def plain_jaccard(nn, k, prune):
    sets = {}
    for c, j in nn:
        sets.setdefault(c, set()).add(j)
    out = {}
    for s, p in sets.items():
        for d, q in sets.items():
            x = len(p & q)
            n = len(q) if k is None else k
            if x and x / (n + (n - x)) > prune:
                out[s, d] = x / (n + (n - x))
    return out


@pytest.mark.parametrize("k, prune", [(None, 1 / 15), (12, 1 / 15), (12, 0.3), (None, 0.2), (12, 0.0), (12, 0.5)])
def test_shared_neighbours_with_hubs(spark, monkeypatch, k, prune):
    """Some neighbours that most cells have; cells that share hubs only, some by exactly the least number."""
    r = np.random.default_rng(3)
    rows = set()
    for c in range(150):
        many = r.permutation(6)[: r.integers(0, 6)]
        rows |= {(c, int(j)) for j in many} | {(c, int(j)) for j in r.integers(10, 400, 12 - len(many) if k else r.integers(0, 8))}
    nn = spark.createDataFrame(sorted(rows), "cell_id long, neighbour_id long")
    want = plain_jaccard(rows, k, prune)
    for hot in (10, 1000):
        monkeypatch.setattr(neighbours, "HOT", hot)
        got = {(q.src, q.dst): q.weight for q in neighbours.jaccard_index(nn, k, prune).collect()}
        assert got == pytest.approx(want)


def test_a_hub_of_all_cells_makes_no_pairs(spark):
    """Everyone has one neighbour in common and little else; all pairs would be nine million rows."""
    rows = spark.range(3000).selectExpr("id as cell_id", "explode(array(-1, id, id + 5000, 10000 + id div 3)) as neighbour_id")
    out = neighbours.jaccard_index(rows, 4, 1 / 4)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert out.count() == 3000 * 3
    own = {q.x: q["count"] for q in out.selectExpr("weight as x").groupBy("x").count().collect()}
    assert own == {1.0: 3000, 1 / 3: 6000}


@pytest.mark.parametrize("own", [True, False])
def test_neighbours_that_others_do_not_lead_to(spark, own):
    """Of vectors of many unrelated components too few neighbours are found; then all cells are searched exactly."""
    v = frame(spark, np.random.default_rng(4).normal(size=(3000, 64)))
    got = sets(approximate.approximate_neighbours(v, 15, include_self=own, leaf=64, trees=1, rounds=1).collect())
    exact = sets(neighbours.nearest_neighbours(v, 15, include_self=own).collect())
    assert sum(len(got[i] & exact[i]) for i in exact) >= 0.9 * 15 * 3000
