"""Uniform manifold approximation and projection: fuzzy neighbour weights and a layout in few dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import free
from ..storage import short_cut as cut
from .neighbours import nearest_neighbours, usable

#: Halvings of the interval in which a cell's scale is sought, and the least scale as a share of the mean distance.
HALVINGS, LEAST_SCALE = 60, 1e-3
#: Cells that a task lays out together, edges of a part of a cell at most (cells with more have several parts), cells that a round's random cells are drawn from.
BUCKET, EDGES, POOL = 8192, 256, 4096
#: Random cells that push for each edge that pulls, and the largest step in a direction.
PUSHES, CLIP = 5, 4.0


def halved(batches):
    """A mapInArrow function: (cell_id, d, rho, goal, most, least) to (cell_id, rho, sigma), see :func:`local_scales`.

    All cells of a batch halve their intervals at once; terms are added in the order of ``d``.
    """
    for b in batches:
        d = b.column(1)
        n = d.value_lengths().to_numpy(zero_copy_only=False)
        rho, goal, most, least = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
        # Missing neighbours are infinitely far and add nothing.
        away = np.full((len(n), n.max(initial=0)), np.inf)
        away[np.arange(away.shape[1]) < n[:, None]] = d.flatten().to_numpy(zero_copy_only=False)
        away = np.ascontiguousarray(np.maximum(away - rho[:, None], 0.0).T)
        lo, hi = np.zeros(len(n)), most.copy()
        for _ in range(HALVINGS):
            middle = (lo + hi) / 2
            some = np.where(middle > 0, middle, 1.0)
            total = np.zeros(len(n))
            for x in away:
                total += np.exp(-x / some)
            enough = (middle <= 0) | (total >= goal)
            lo, hi = np.where(enough, lo, middle), np.where(enough, middle, hi)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.maximum(hi, least))], ["cell_id", "rho", "sigma"])


def local_scales(nn: DataFrame) -> DataFrame:
    """(cell_id, rho, sigma) from (cell_id, neighbour_id, distance): a cell's least positive distance and its scale.

    sigma solves sum(exp(-max(0, d - rho) / sigma)) = log2(k) over the k
    neighbours, by halving an interval that surely holds it.  It is at least
    LEAST_SCALE of the cell's mean distance, or of the mean of all where the
    cell has distance 0 only.  One aggregate over each cell's k distances.
    """
    rows = nn.groupBy("cell_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    everywhere = nn.agg(F.avg("distance").alias("all_mean"))
    k = F.size("d").cast("double")
    rho = F.coalesce(F.array_min(F.filter("d", lambda x: x > 0)), F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(everywhere)).select("cell_id", "d", "all_mean", rho.alias("rho"), F.log2(k).alias("goal"), k.alias("k"))
    # At this scale every term is at least log2(k) / k.
    most = F.when(F.col("k") > 2, (F.array_max("d") - F.col("rho")) / F.log(F.col("k") / F.col("goal"))).otherwise(F.array_max("d"))
    mean = F.aggregate("d", F.lit(0.0), lambda t, x: t + x) / F.col("k")
    least = LEAST_SCALE * F.when(F.col("rho") > 0, mean).otherwise(F.col("all_mean"))
    return rows.select("cell_id", "d", "rho", "goal", F.greatest(most, F.lit(0.0)).alias("most"), least.alias("least")).mapInArrow(halved, "cell_id long, rho double, sigma double")


def fuzzy_weights(nn: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions: a + b - a b of the two directed weights exp(-max(0, d - rho) / sigma).

    ``nn`` (cell_id, neighbour_id, distance) has no cell as its own neighbour.
    Both directions of a pair meet in one aggregate by pair, so that a cell
    which very many have as a neighbour makes no large group.
    """
    scales = local_scales(nn)
    away = F.greatest(F.col("distance") - F.col("rho"), F.lit(0.0))
    one = F.when(F.col("sigma") > 0, F.exp(-away / F.col("sigma"))).otherwise((away == 0).cast("double"))
    directed = nn.join(scales, "cell_id").select("cell_id", "neighbour_id", one.alias("w"))
    # Both from one row, so that scales are sought once.
    way = lambda src, dst, a, b: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), a.alias("a"), b.alias("b"))
    both = directed.select(F.inline(F.array(way("cell_id", "neighbour_id", F.col("w"), F.lit(0.0)), way("neighbour_id", "cell_id", F.lit(0.0), F.col("w")))))
    return both.groupBy("src", "dst").agg(F.max("a").alias("a"), F.max("b").alias("b")).select("src", "dst", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^(2 b)), fitted to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    at, damp = np.array([0.0, 0.0]), 1e-2

    def off(at):
        return 1 / (1 + np.exp(at[0]) * x ** (2 * np.exp(at[1]))) - want

    for _ in range(200):
        now = off(at)
        slope = np.stack([(off(at + h) - off(at - h)) / 2e-6 for h in 1e-6 * np.eye(2)], 1)
        new = at - np.linalg.solve(slope.T @ slope + damp * np.eye(2), slope.T @ now)
        if (off(new) ** 2).sum() < (now**2).sum():
            at, damp = new, damp / 3
        else:
            damp *= 3
    return float(np.exp(at[0])), float(np.exp(at[1]))


def moved(x: np.ndarray, pulls, pool: np.ndarray, n: int, rates: np.ndarray, a: float, b: float, rng, cell: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``x`` after one epoch for each rate; pulls: (place in x, place in x or -1, where it stands, weight), by place.

    The k-th edges that all rows drew make a step together, so that a row takes its
    edges one by one and sees the others' last steps.  Rows of one ``cell`` are its
    parts: each takes its own edges, and an epoch ends with all in their middle.
    Random cells are drawn from ``first``, the first parts in ``x``, as often as
    their share of all ``n`` cells, else from ``pool``.
    """
    own, other, there, weight = pulls
    parts = np.bincount(cell)
    shared = np.flatnonzero(parts[cell] > 1)
    dims = range(x.shape[1])
    # A coordinate at a time: short last axes are slow.
    x, there, pool = ([np.ascontiguousarray(y[:, c]) for c in dims] for y in (x, there, pool))
    size, spare = len(first), len(pool[0])
    first = first if size else np.zeros(1, int)
    for rate in rates:
        drawn = np.flatnonzero(rng.random(len(own)) < weight)
        nth = np.arange(len(drawn)) - np.searchsorted(own[drawn], own[drawn])
        for k in range(nth.max(initial=-1) + 1):
            s = drawn[nth == k]
            i, j = own[s], other[s]
            inside = j >= 0
            j = np.maximum(j, 0)
            d = [x[c][i] - np.where(inside, x[c][j], there[c][s]) for c in dims]
            q = sum(y * y for y in d)
            some = np.maximum(q, 1e-300)
            pull = np.where(q > 0, -2 * a * b * some ** (b - 1) / (1 + a * some**b), 0.0)
            steps = [np.clip(pull * y, -CLIP, CLIP) for y in d]
            far = rng.integers(n, size=(len(s), PUSHES))
            inside, near, spread = far < size, first[np.minimum(far, max(0, size - 1))], far % spare
            d = [x[c][i][:, None] - np.where(inside, x[c][near], pool[c][spread]) for c in dims]
            q = sum(y * y for y in d)
            push = np.where(q > 0, 2 * b / ((0.001 + q) * (1 + a * q**b)), 0.0)
            for c in dims:
                x[c][i] += rate * (steps[c] + np.clip(push * d[c], -CLIP, CLIP).sum(1))
        if len(shared):
            for y in x:
                y[shared] = (np.bincount(cell[shared], y[shared], len(parts)) / parts)[cell[shared]]
    return np.stack(x, 1)


def mover(held, n: int, rates: np.ndarray, a: float, b: float, seeds: list[int]):
    """An applyInArrow function: a bucket's cells after one round and how many parts of them it has, from rows (src, part, dst, weight, coordinates); parts of cells have no dst."""

    def round_of(key, table):
        src, part, dst = (table.column(c).to_numpy() for c in ("src", "part", "dst"))
        at = table.column("coordinates").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(src), -1)
        weight = table.column("weight").to_numpy()
        cell = np.isnan(dst) if dst.dtype.kind == "f" else np.zeros(len(src), bool)
        order = np.flatnonzero(cell)
        order = order[np.lexsort((part[order], src[order]))]
        x = at[order].copy()
        ids, begins, of = np.unique(src[order], return_index=True, return_inverse=True)
        edge = np.flatnonzero(~cell)
        to = dst[edge].astype(np.int64)
        edge = edge[np.lexsort((to, part[edge], src[edge]))]
        to = dst[edge].astype(np.int64)
        place = np.minimum(np.searchsorted(ids, to), max(0, len(ids) - 1))
        local = np.where(ids[place] == to, begins[place], -1)
        # A row's number among the parts of all cells.
        most = int(part.max(initial=0)) + 1
        own = np.searchsorted(of * most + part[order], np.searchsorted(ids, src[edge]) * most + part[edge])
        rng = np.random.default_rng([*seeds, key[0].as_py()])
        x = moved(x, (own, local, at[edge], weight[edge]), held.value, n, rates, a, b, rng, of, np.flatnonzero(part[order] == 0))
        out = [pa.array(ids), pa.array(np.full(len(ids), key[0].as_py(), np.int32)), pa.array(np.bincount(of, minlength=len(ids))), pa.array(list(x[begins]), pa.list_(pa.float64()))]
        return pa.table(out, ["cell_id", "bucket", "parts", "coordinates"])

    return round_of


def lots(edges: DataFrame, seed: int) -> DataFrame:
    """(src, lot, edges): all edges (src, dst, weight) of a cell, dealt at random into EDGES lots, or as many as it has edges if fewer.

    The i-th edges of a cell's lots are those of its i-th part.
    """
    order = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
    dealt = edges.withColumn("r", F.row_number().over(order) - 1)
    one = F.sort_array(F.collect_list(F.struct("r", "dst", "weight")))
    return dealt.groupBy("src", F.pmod("r", F.lit(EDGES)).alias("lot")).agg(one.alias("edges"))


def layout(weights: DataFrame, start: DataFrame, min_dist: float = 0.3, nepochs: int | None = None, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(cell_id, coordinates), cut: cells of ``start`` (cell_id, coordinates) drawn together by ``weights`` (src, dst, weight).

    Stochastic gradient descent in rounds.  In a round each task has a bucket
    of cells with their edges and where the other ends stood when the round
    began; its own cells move epoch by epoch, pulled along edges in proportion
    to their weights and pushed away from cells drawn at random.  A cell with
    more than EDGES edges has several parts, over which all its edges are dealt
    anew in each round; parts may be in different tasks and end in their middle.
    Epochs are 500 up to 10,000 cells and 200 beyond, if not given.
    """
    spark = weights.sparkSession
    edges, now = cut(weights.filter("weight > 0"), "umap-weights"), cut(start.select("cell_id", "coordinates"), "umap-layout")
    n = now.count()
    nepochs = nepochs if nepochs is not None else 500 if n <= 10_000 else 200
    buckets = max(1, -(-n // BUCKET))
    # One bucket knows where all cells stand at any time.
    rounds = max(1, min(rounds, nepochs)) if buckets > 1 else 1
    a, b = curve(min_dist)
    hubs = cut(edges.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > EDGES).select("src", F.ceil(F.col("n") / EDGES).cast("int").alias("parts")), "umap-hubs")
    # Only edges of hubs are dealt; all others are in a cell's one part.
    few, many = edges, None
    if not hubs.isEmpty():
        few, many = cut(edges.join(hubs, "src", "left_anti"), "umap-few"), cut(edges.join(hubs, "src", "left_semi"), "umap-many")
    bounds = np.linspace(0, nepochs, rounds + 1).round().astype(int)
    for r in range(rounds if n else 0):
        rates = 1 - np.arange(bounds[r], bounds[r + 1]) / nepochs
        seen = now.orderBy(F.xxhash64("cell_id", F.lit(seed + r)), "cell_id").limit(POOL).collect()
        held = spark.sparkContext.broadcast(np.array([x.coordinates for x in seen]))
        alone = F.lit(0).alias("part")
        some = few.select("src", alone, "dst", "weight")
        own = now.select(F.col("cell_id").alias("src"), alone, "coordinates")
        if many is not None:
            each = lots(many, seed + r).select("src", F.posexplode("edges").alias("part", "e"))
            some = some.unionByName(each.select("src", "part", "e.dst", "e.weight"))
            own = now.withColumnRenamed("cell_id", "src").join(hubs, "src", "left")
            own = own.select("src", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "coordinates")
        ends = some.join(now.select(F.col("cell_id").alias("dst"), "coordinates"), "dst").select("src", "part", "dst", "weight", "coordinates")
        own = own.select("src", "part", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), "coordinates")
        key = F.when(F.col("part") == 0, F.xxhash64("src")).otherwise(F.xxhash64("src", "part"))
        rows = ends.unionByName(own).withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int"))
        new = rows.groupBy("bucket").applyInArrow(mover(held, n, rates, a, b, [seed, r]), "cell_id long, bucket int, parts long, coordinates array<double>")
        if many is not None and buckets > 1:
            # The middle of all parts, added up in the order of buckets.
            new = new.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "parts", "coordinates"))).alias("s"), F.sum("parts").alias("parts"))
            middle = [F.aggregate("s", F.lit(0.0), lambda t, y: t + y["parts"] * F.get(y["coordinates"], F.lit(c))) / F.col("parts") for c in range(held.value.shape[1])]  # noqa: B023
            new = new.select("cell_id", F.array(*middle).alias("coordinates"))
        old, now = now, cut(new.select("cell_id", "coordinates"), "umap-layout")
        held.destroy()
        free(old)
    free(edges, hubs, *(x for x in (few, many) if many is not None))
    return now


def first_layout(vectors: DataFrame, ncomponents: int) -> DataFrame:
    """(cell_id, coordinates): the leading principal components, the widest scaled to 10, with a little noise by id."""
    from ..matrix import CountMatrix
    from .linalg import centered_copy, embedding

    coo = vectors.select("cell_id", F.posexplode("vector").alias("d", "x")).select("cell_id", F.col("d").cast("long").alias("feature_id"), F.col("x").cast("double").alias("value"))
    e = embedding(centered_copy(CountMatrix(coo, vectors.select("cell_id"), coo.select("feature_id").distinct())), ncomponents)
    wide = e.coordinates.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pc", "value"))), lambda s: s["value"]).alias("c"))
    most = e.coordinates.agg(F.max(F.abs("value")).alias("most"))
    noise = lambda i: F.pmod(F.xxhash64("cell_id", i), F.lit(1 << 20)) / float(1 << 20) * 1e-3
    pad = F.array_repeat(F.lit(0.0), ncomponents)
    scaled = F.transform(F.slice(F.concat("c", pad), 1, ncomponents), lambda x, i: 10 * F.coalesce(F.try_divide(x, F.col("most")), F.lit(0.0)) + noise(i))
    return wide.crossJoin(F.broadcast(most)).select("cell_id", scaled.alias("coordinates"))


def umap(vectors: DataFrame, ncomponents: int = 2, dims: int | None = None, metric: str = "cosine", nneighbours: int = 30, min_dist: float = 0.3, nepochs: int | None = None, seed: int = 0) -> DataFrame:
    """(cell_id, coordinates), an embedding of (cell_id, vector) in ``ncomponents`` dimensions.

    ``dims`` takes the first components of the vectors only; the metric is
    ``cosine`` or ``euclidean``.  The result depends on ``seed`` and on nothing
    else that is random.  Cells without a usable vector take no part.
    """
    v = usable(vectors.select("cell_id", (F.slice("vector", 1, dims) if dims else F.col("vector")).alias("vector")))
    nn = cut(nearest_neighbours(v, nneighbours, metric, include_self=False), "umap-neighbours")
    out = layout(fuzzy_weights(nn), first_layout(v, ncomponents), min_dist, nepochs, seed=seed)
    free(nn)
    return out
