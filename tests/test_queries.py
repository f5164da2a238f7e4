"""Every matrix query against its SQL in DuckDB, on the smallest tables."""

import inspect
import math
import os

import duckdb
import pytest

from tallyframe.plans import adapters
from tallyframe.plans.adapters import DENSE, SPARSE
from tallyframe.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(x, y):
    if isinstance(x, float) and isinstance(y, (int, float)):
        return x == y or math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)
    return x == y


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in at) for r in rows]
    # Floats may differ in the last digit, so other columns lead the order.
    return sorted(rows, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name not in ORACLES:
        return
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = ordered(rows, df.columns), ordered(got.fetchall(), columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(same, x, y)), (x, y)


@pytest.mark.parametrize("name", [n for n, f in QUERIES.items() if "matrix" in inspect.signature(f).parameters])
def test_query_with_empty_cells_and_features(spark, duck, name):
    """The same on a matrix of few line items, where many cells and features have no entry."""
    assert DENSE in ORACLES[name]
    df = QUERIES[name](spark, SF, matrix=adapters.cust_part_sparse)
    got = duck.execute(ORACLES[name].replace(DENSE, SPARSE))
    a, b = ordered(df.collect(), df.columns), ordered(got.fetchall(), [d[0] for d in got.description])
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(same, x, y)), (x, y)
