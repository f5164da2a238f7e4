"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free


def connected(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node it reaches.

    Null ends and loops are ignored, repeated edges count once; nodes without
    an edge are not returned.  Each round is written to the shared folder, and
    a round that changes nothing ends the loop.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs, name)
    before = None
    for _ in range(most):
        # Large star: each node links its larger neighbours to its smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(low, "u")
        small = up.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, pairs = pairs, cut(small, name)
        free(old)
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    tops = pairs.select(F.col("v").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    out = cut(roots.unionByName(tops.select("node", F.col("node").alias("component"))), name)
    free(pairs)
    return out
