"""Exact top-k inner-product search by tiled matrix products.

Queries are dealt into blocks of bounded size.  For each block one pass goes
over all vectors: every task multiplies the block with tiles of its own
shard, selects the best k per tile and keeps a running list per query; the
per-task lists are then merged in a two-level tree.  A block's result is
written before the next block starts, so the driver holds one block at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free

SCALE = 1024
EXACT = 2.0**53
OUT = "query_id long, part int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector whose components are all finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def by_length(ids: pa.Array, lists: pa.Array):
    """(ids, matrix of floor(1024 x)) for each vector length in a batch, ids ascending."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    ends = np.cumsum(n)
    ids = ids.to_numpy(zero_copy_only=False)
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        at = (ends[rows] - d)[:, None] + np.arange(d)[None, :]
        yield int(d), ids[rows], flat[at]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; raises where one does not fit."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], dtype=object).reshape(c.shape).T
    return np.array(exact, dtype=object).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, valid: np.ndarray, k: int):
    """Per row the k best by (score descending, id ascending)."""
    order = np.lexsort((ids, -scores, ~valid), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, scores, valid))


def tile_best(q_ids, q, c_ids, c, k):
    """The k best of one tile (ids ascending) for each query: (ids, scores, valid), each [queries, <=k]."""
    scores = products(q, c)
    valid = q_ids[:, None] != c_ids[None, :]
    grid = np.broadcast_to(c_ids[None, :], scores.shape)
    span = len(c_ids)
    if span > k:
        low = scores.min(initial=0)
        if (float(scores.max(initial=0)) - float(low) + 2) * span < 2**62:
            key = np.where(valid, scores - low + 1, 0) * span + (span - 1 - np.arange(span))[None, :]
            at = np.argpartition(key, span - k, axis=1)[:, span - k :]
            grid, scores, valid = (np.take_along_axis(x, at, 1) for x in (grid, scores, valid))
    return best(np.array(grid), scores, np.array(valid), k)


def searcher(block: dict, k: int, tile: int):
    """A mapInArrow function that searches one broadcast block of queries."""

    def run(batches):
        queries, kept = block.value, {}
        for b in batches:
            for s in range(0, b.num_rows, tile):
                part = b.slice(s, tile)
                for d, ids, c in by_length(part.column(0), part.column(1)):
                    if d not in queries:
                        continue
                    q_ids, q = queries[d]
                    new = tile_best(q_ids, q, ids, c, k)
                    if d in kept:
                        new = best(*(np.concatenate([x, y], 1) for x, y in zip(kept[d], new)), k)
                    kept[d] = new
        me = TaskContext.get().partitionId()
        for d, (ids, scores, valid) in kept.items():
            q_ids = np.broadcast_to(queries[d][0][:, None], ids.shape)[valid]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.full(len(q_ids), me, np.int32)), pa.array(ids[valid]), pa.array(scores[valid])], ["query_id", "part", "vec_id", "score"])

    return run


def merge(lists: DataFrame, k: int, fan_in: int = 64) -> DataFrame:
    """Tree-merge per-task lists: first within groups of tasks, then per query."""
    order = (F.desc("score"), F.asc("vec_id"))
    some = lists.withColumn("grp", (F.col("part") / fan_in).cast("int"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "grp").orderBy(*order))).filter(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, is_query, k: int = 10, block_rows: int = 4096, tile_rows: int = 1024) -> DataFrame:
    """The ``k`` best partners of every query row among all other rows.

    ``vectors``: vec_id long, embedding array of float or double; other
    columns are ignored.  ``is_query``: a Column that is true for queries.
    Score: integer inner product of floor(1024 x); ties go to the smaller id.

    Null ids, null vectors and vectors with null or non-finite components take
    no part.  Vectors are only scored against vectors of their own length.
    Every row is a candidate of its own, so a vec_id in several rows can be
    returned several times; rows with a query's vec_id are that query's own
    and no candidates of it.  Equal query rows are one query; different ones
    with one vec_id share one list.  Empty input gives an empty result.  A
    score beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = rows.filter(is_query).distinct()
    blocks = max(1, -(-queries.count() // block_rows))
    dealt = cut(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")
    out = None
    for b in range(blocks):
        held = {}
        got = dealt.filter(F.col("block") == b).select("vec_id", "embedding").toArrow().combine_chunks()
        for batch in got.to_batches():
            held.update((d, (ids, q)) for d, ids, q in by_length(batch.column(0), batch.column(1)))
        block = spark.sparkContext.broadcast(held)
        found = cut(merge(rows.mapInArrow(searcher(block, k, tile_rows), OUT), k), "topk")
        block.destroy()
        out = found if out is None else out.unionByName(found)
    free(dealt)
    return out
