"""The pipeline's stages against plain versions, and the numbered queries against their SQL."""

import hashlib
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from tallyframe.llm import queries, toxicity

from . import brute
from .conftest import CLASHING, DATA, HARD


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    rest = stages["toxicity"](spark, docs, small)
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert pairs(rest) == [(i, t) for i, t in pairs(docs) if scores[i] < toxicity.THRESHOLD]
    kept = stages["line_dedup"](spark, rest, small)
    assert dict(pairs(kept)) == brute.line_dedup(pairs(rest))
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    one = stages["ngram_jaccard_join"](spark, kept, small)
    assert [i for i, _ in pairs(one)] == [i for i, (_, c) in sorted(brute.jaccard_components(pairs(kept)).items()) if i == c]
    clean = stages["benchmark_decontamination"](spark, one, small)
    items = pq.read_table(f"{small}/benchmark.parquet")["text"].to_pylist()
    assert [i for i, _ in pairs(clean)] == [i for i, t in pairs(one) if not any(brute.overlaps(t, q) for q in items)]
    assert rest.columns == kept.columns == one.columns == clean.columns == docs.columns
    whole = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in pairs(clean)}


def test_stages_take_any_rows_and_columns(spark, small, hard, empty):
    for docs, n in ((hard, len(HARD)), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() <= n
            if name != "byte_bpe":
                assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    sf = f"{DATA}/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in queries.ORACLES:
        assert rows and len(df.columns) > 2
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert values(got.fetchall(), columns) == values(rows, df.columns)


def test_the_rest_works_when_this_subpackage_is_deleted(tmp_path):
    """A copy of the repository without the llm folders and the pipeline lists and runs its other queries."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    assert not (copy / "tallyframe" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = e.queries()
assert "H3" in names and not any(k.startswith("op") or k == "pipeline" for k in names) and set(e.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert names["U6"](spark, "{DATA}/sf0.001").count() == 75 and e.entry(spark).columns
"""
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_works_without_this_subpackage(monkeypatch):
    for k in [k for k in sys.modules if k.startswith("tallyframe.llm") or k == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, k)
    find = __spark_entry__.importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda n, *a: None if n in ("tallyframe.llm", "corpus_pipeline") else find(n, *a))
    found = __spark_entry__.queries()
    assert "H3" in found and not any(k.startswith("op") or k == "pipeline" for k in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
