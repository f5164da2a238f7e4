"""Approximate nearest neighbours: a forest of random projections, then rounds over neighbours of neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import free
from ..storage import short_cut as cut
from .neighbours import METRICS, OUT, matrix, nearest, search, usable

#: Slices of a node at a level, at most; nodes whose bounds are broadcast, at most.
SLICES, BROADCAST_NODES = 16, 100_000
#: Members of a cell's meeting from each side, and the share of all neighbours that a round must improve for another.
SIDE, WORTH = 16, 1e-2
#: Cells that are searched exactly to tell how many neighbours were found, and the share below which all are.
JUDGED, TARGET = 1000, 0.93


def unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def forest(v: DataFrame, metric: str, trees: int, leaf: int, seed: int) -> DataFrame:
    """(cell_id, tree, node, piece), cut: the leaf of every cell in every tree.

    A tree deals the cells of a node by quantiles of a random projection, one
    for each tree and level, into at most SLICES equal slices, until a slice
    has about ``leaf`` cells.  Where copies make a leaf larger than four times
    that, it is dealt by hash into pieces, as one copy is as good as another.
    """
    n = v.count()
    ratio = max(1.0, n / leaf)
    levels = max(1, math.ceil(math.log(ratio) / math.log(SLICES) - 1e-9))
    slices = max(1, math.ceil(ratio ** (1 / levels) - 1e-9))

    def project(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column(1)), metric)
            random = np.random.default_rng(seed).normal(size=(x.shape[1], trees * levels))
            rows = (x @ random).reshape(len(x) * trees, levels)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(x))), pa.array(list(rows), pa.list_(pa.float64()))], ["cell_id", "tree", "at"])

    keys = cut(v.mapInArrow(project, "cell_id long, tree int, at array<double>").withColumn("node", F.lit(0).cast("long")), "forest")
    for level in range(levels if slices > 1 else 0):
        at = F.col("at")[level]
        bounds = keys.groupBy("tree", "node").agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000).alias("bounds"))
        if trees * slices**level <= BROADCAST_NODES:
            bounds = F.broadcast(bounds)
        into = F.size(F.filter("bounds", lambda x: x < at))
        old, keys = keys, cut(keys.join(bounds, ["tree", "node"]).select("cell_id", "tree", "at", (F.col("node") * slices + into).alias("node")), "forest")
        free(old)
    large = cut(keys.groupBy("tree", "node").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * leaf).select("tree", "node", F.ceil(F.col("n") / (2 * leaf)).alias("pieces")), "forest-large")
    dealt = F.broadcast(large) if large.count() <= BROADCAST_NODES else large
    out = cut(keys.join(dealt, ["tree", "node"], "left").select("cell_id", "tree", "node", F.pmod(F.xxhash64("cell_id", "tree"), F.coalesce("pieces", F.lit(1))).alias("piece")), "forest-leaves")
    free(keys, large)
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """(cell_id, near): the k nearest different neighbours of (cell_id, neighbour_id, distance), as (distance, neighbour_id) in order."""
    lists = found.groupBy("cell_id").agg(F.collect_set(F.struct("distance", "neighbour_id")).alias("near"))
    return lists.select("cell_id", F.slice(F.array_sort("near"), 1, k).alias("near"))


def rows_of(graph: DataFrame) -> DataFrame:
    return graph.select("cell_id", F.posexplode("near").alias("rank", "e")).select("cell_id", F.col("e.neighbour_id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"), F.col("e.distance").alias("distance"))


def leaf_search(k: int, metric: str):
    def run(table):
        ids, x = table.column("cell_id").to_numpy(), matrix(table.column("vector").combine_chunks())
        row, found, distance = nearest(ids, x, ids, x, k, metric, False)
        return pa.table({"cell_id": pa.array(ids[row]), "neighbour_id": pa.array(found), "distance": pa.array(distance)})

    return run


def meeting(metric: str):
    """A mapInArrow function: of each list of members (id, reach, vector) the pairs that are nearer than one's reach."""

    def run(batches):
        for b in batches:
            out = [[], [], []]
            lists = b.column(0)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            ids, reach, x = flat.field("id").to_numpy(zero_copy_only=False), flat.field("reach").to_numpy(zero_copy_only=False), matrix(flat.field("vector"))
            ends = np.cumsum(n)
            # Meetings of one size are worked on together.
            for size in np.unique(n[n > 1]):
                at = (ends[n == size] - size)[:, None] + np.arange(size)[None, :]
                p, q = (z.ravel() for z in np.nonzero(~np.eye(size, dtype=bool)))
                for s in range(0, len(at), max(1, 1 << 18 >> int(size * size).bit_length())):
                    some = at[s : s + max(1, 1 << 18 >> int(size * size).bit_length())]
                    y, z = unit(x[some[:, p].ravel()], metric), unit(x[some[:, q].ravel()], metric)
                    d = 1 - (y * z).sum(1) if metric == "cosine" else np.sqrt(((y - z) ** 2).sum(1))
                    i, j = some[:, p].ravel(), some[:, q].ravel()
                    keep = (d < reach[i]) & (ids[i] != ids[j])
                    for o, part in zip(out, (ids[i][keep], ids[j][keep], d[keep])):
                        o.append(part)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["cell_id", "neighbour_id", "distance"])

    return run


def refined(graph: DataFrame, v: DataFrame, metric: str, k: int, seed: int) -> DataFrame:
    """``graph`` after one round in which each cell's nearest cells, and some that it is a near one of, meet in pairs.

    A cell that very many have as a neighbour meets SIDE of those, drawn anew
    in each round, so no meeting is larger than 2 SIDE + 1.
    """
    edges = rows_of(graph)
    order = Window.partitionBy("neighbour_id").orderBy(F.xxhash64("cell_id", "neighbour_id", F.lit(seed)), "cell_id")
    ahead = edges.filter(F.col("rank") <= SIDE).select(F.col("cell_id").alias("host"), F.col("neighbour_id").alias("id"))
    behind = edges.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SIDE).select(F.col("neighbour_id").alias("host"), F.col("cell_id").alias("id"))
    members = ahead.unionByName(behind).unionByName(graph.select(F.col("cell_id").alias("host"), F.col("cell_id").alias("id"))).distinct()
    reach = F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["distance"])
    told = v.select("cell_id", "vector").join(graph.select("cell_id", reach.alias("reach")), "cell_id").select(F.col("cell_id").alias("id"), "reach", "vector")
    meetings = members.join(told, "id").groupBy("host").agg(F.collect_list(F.struct("id", "reach", "vector")).alias("members")).select("members")
    return best(edges.select("cell_id", "neighbour_id", "distance").unionByName(meetings.mapInArrow(meeting(metric), OUT)), k)


def recall(graph: DataFrame, v: DataFrame, k: int, metric: str, seed: int) -> float:
    """The share of the exact neighbours of at most JUDGED cells, drawn by hash, that ``graph`` has or that are no nearer than its last."""
    some = v.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(JUDGED)
    exact = search(v, k, metric, False, None, False, "cell_id long, neighbour_id long, rank int, distance double", some)
    found = graph.select("cell_id", F.transform("near", lambda e: e["neighbour_id"]).alias("ids"), F.size("near").alias("n"), F.element_at("near", -1)["distance"].alias("last")) if k else graph
    right = exact.join(found, "cell_id", "left").agg(F.avg(F.coalesce(F.array_contains("ids", F.col("neighbour_id")) | ((F.col("n") >= k) & (F.col("last") <= F.col("distance"))), F.lit(False)).cast("double"))).first()[0]
    return 1.0 if right is None else right


def approximate_neighbours(vectors: DataFrame, k: int, metric: str = "euclidean", include_self: bool = True, dims: int | None = None, trees: int = 12, leaf: int = 256, rounds: int = 6, seed: int = 1) -> DataFrame:
    """G1 at scale: (cell_id, neighbour_id, rank, distance) of about the k nearest; distances are exact.

    Candidates are the cells that share a leaf of some tree (:func:`forest`).
    Then up to ``rounds`` rounds look among neighbours of neighbours, until a
    round improves hardly any.  Only cells of one leaf or one meeting are ever
    compared in pairs, and both are bounded.  Ids must be unique; cells without
    a usable vector take no part.

    Where neighbours are hard to tell from others (vectors of many unrelated
    components), neighbours of neighbours lead nowhere.  Some cells are
    therefore searched exactly at the end; if less than TARGET of their
    neighbours were found, all cells are.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    v = cut(usable(vectors.select("cell_id", (F.slice("vector", 1, dims) if dims else F.col("vector")).alias("vector"))), "vectors")
    others = k - 1 if include_self else k
    leaves = forest(v, metric, trees, leaf, seed)
    found = leaves.join(v, "cell_id").groupBy("tree", "node", "piece").applyInArrow(leaf_search(max(1, others), metric), OUT)
    # A cell alone in its leaves still takes part in meetings.
    lists = v.select("cell_id").join(best(found, max(1, others)), "cell_id", "left").select("cell_id", F.coalesce("near", F.array().cast("array<struct<distance:double,neighbour_id:bigint>>")).alias("near"))
    graph = cut(lists, "approximate")
    free(leaves)
    for r in range(rounds):
        new = cut(v.select("cell_id").join(refined(graph, v, metric, max(1, others), seed + r), "cell_id", "left").select("cell_id", F.coalesce("near", F.array().cast("array<struct<distance:double,neighbour_id:bigint>>")).alias("near")), "approximate")
        seen = rows_of(new).join(rows_of(graph).select("cell_id", "neighbour_id"), ["cell_id", "neighbour_id"], "left_anti").count()
        total = new.agg(F.sum(F.size("near"))).first()[0] or 0
        free(graph)
        graph = new
        if seen <= WORTH * total:
            break
    if others and recall(graph, v, others, metric, seed) < TARGET:
        free(graph)
        return search(v, k, metric, include_self, None, False, "cell_id long, neighbour_id long, rank int, distance double")
    if not include_self:
        return rows_of(graph)
    own = v.select("cell_id", F.col("cell_id").alias("neighbour_id"), F.lit(0.0).alias("distance"))
    rows = own.unionByName(rows_of(graph).select("cell_id", "neighbour_id", "distance")) if others else own
    return rows_of(best(rows, k))
