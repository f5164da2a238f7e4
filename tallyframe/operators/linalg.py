"""Products with sparse and centred matrices, Gram matrices, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import CenteredMatrix, CountMatrix
from ..storage import free
from ..storage import short_cut as cut

#: Cells that a task multiplies at a time, rows of a partial product that travel together, and partial products added by one task.
CELLS, ROWS, FAN_IN = 1024, 256, 32
#: Products of one inner index before they are dealt on a grid, and such indices that are broadcast, at most.
HOT_PRODUCTS, BROADCAST_ROWS = 1 << 20, 100_000
#: Products of entries of one cell that a task adds up at a time.
PAIRS = 1 << 20
#: Products of entries with columns that a task holds at a time.
PRODUCTS = 1 << 17
#: Features up to which the whole matrix is factored in one pass.
DIRECT = 256


def multiply(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """(i, j, value) of alpha * A B + beta * C from A (i, k, value), B (k, j, value) and C (i, j, value).

    An inner index with more than HOT_PRODUCTS products is dealt on a grid: its
    entries of A by row and those of B by column, so that every task has one
    block of its products.  With beta 0, C counts nowhere.
    """
    left, right = a.select("i", "k", F.col("value").alias("x")), b.select("k", "j", F.col("value").alias("y"))
    count = lambda df, name: df.groupBy("k").agg(F.count("*").alias(name))
    hot = count(left, "p").join(count(right, "q"), "k").select("k", F.ceil(F.sqrt(F.col("p") * F.col("q") / HOT_PRODUCTS)).cast("int").alias("grid")).filter("grid > 1")
    hot = cut(hot, "hot-inner")
    n = hot.count()
    if n:
        dealt = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        one, every = F.coalesce("grid", F.lit(1)), F.sequence(F.lit(0), F.coalesce("grid", F.lit(1)) - 1)
        left = left.join(dealt, "k", "left").select("i", "k", "x", F.pmod(F.xxhash64("i"), one).cast("int").alias("row"), F.explode(every).alias("column"))
        right = right.join(dealt, "k", "left").select("k", "j", "y", F.pmod(F.xxhash64("j"), one).cast("int").alias("column"), F.explode(every).alias("row"))
    else:
        free(hot)
    rows = left.join(right, ["k", "row", "column"] if n else ["k"]).select("i", "j", (alpha * (F.col("x") * F.col("y"))).alias("value"))
    if beta and c is not None:
        rows = rows.unionByName(c.select("i", "j", (beta * F.col("value")).alias("value")))
    return rows.groupBy("i", "j").agg(F.sum("value").alias("value"))


def centered_times(c: CenteredMatrix, v: DataFrame) -> DataFrame:
    """(cell_id, value) of C v for v (feature_id, x), every cell included."""
    shift = c.mu.join(v, "feature_id").agg(F.coalesce(F.sum(F.col("mu") * F.col("x")), F.lit(0.0)).alias("shift"))
    sums = c.matrix.coo.join(v, "feature_id").groupBy("cell_id").agg(F.sum(F.col("value") * F.col("x")).alias("s"))
    rows = c.matrix.cells.select("cell_id").join(sums, "cell_id", "left").crossJoin(F.broadcast(shift))
    return rows.select("cell_id", (F.coalesce("s", F.lit(0.0)) - F.col("shift")).alias("value"))


def centered_adjoint_times(c: CenteredMatrix, v: DataFrame) -> DataFrame:
    """(feature_id, value) of C' v for v (cell_id, x), every feature included."""
    total = v.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))
    sums = c.matrix.coo.join(v, "cell_id").groupBy("feature_id").agg(F.sum(F.col("value") * F.col("x")).alias("s"))
    rows = c.mu.join(sums, "feature_id", "left").crossJoin(F.broadcast(total))
    return rows.select("feature_id", (F.coalesce("s", F.lit(0.0)) - F.col("mu") * F.col("total")).alias("value"))


def entry_products(batches, most: int):
    """(i, j, sum of products) with i <= j for runs of cells (cell_id, list of entries), a run having about ``most`` products.

    A cell with more products than that is taken some of its entries at a time.
    """
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def added(parts):
        i, j, x = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((j, i))
        i, j, x = i[order], j[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(i) else np.zeros(0, int)
        return [i[first], j[first], np.add.reduceat(x, first) if len(first) else x]

    for b in batches:
        lists = b.column(1)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        feature, value = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        # Every entry meets all entries of its cell; runs of entries with about ``most`` such pairs.
        size, start = np.repeat(n, n), np.repeat(np.cumsum(n) - n, n)
        done = np.concatenate([[0], np.cumsum(size)])
        s = 0
        while s < len(size):
            e = max(s + 1, int(np.searchsorted(done, done[s] + most, "right")) - 1)
            left = np.repeat(np.arange(s, e), size[s:e])
            right = np.arange(len(left)) - np.repeat(done[s:e] - done[s], size[s:e]) + np.repeat(start[s:e], size[s:e])
            keep = feature[left] <= feature[right]
            left, right = left[keep], right[keep]
            kept = added([kept, [feature[left], feature[right], value[left] * value[right]]])
            if len(kept[0]) > most:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["i", "j", "value"])
                kept = [x[:0] for x in kept]
            s = e
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["i", "j", "value"])


def gram(c: CenteredMatrix) -> DataFrame:
    """(i, j, value) of C' C for i <= j, from sums of products within cells and rank-one corrections.

    A task adds up the products of its own cells before any are shuffled, and
    makes the corrections of its features from all means and sums (16 bytes a
    feature), so that neither cells nor features are joined with themselves.
    """
    m = c.matrix
    own = c.mu.join(m.coo.groupBy("feature_id").agg(F.sum("value").alias("s")), "feature_id", "left").select("feature_id", F.col("mu").cast("double").alias("mu"), F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s")).toArrow()
    ids, mu, s = (own[x].to_numpy() for x in ("feature_id", "mu", "s"))
    order = np.argsort(ids)
    held, n = m.coo.sparkSession.sparkContext.broadcast((ids[order], mu[order], s[order])), m.cells.count()

    def corrections(batches):
        ids, mu, s = held.value
        for b in batches:
            for at in np.searchsorted(ids, b.column(0).to_numpy(zero_copy_only=False)):
                value = n * mu[at] * mu[at:] - s[at] * mu[at:] - mu[at] * s[at:]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), ids[at])), pa.array(ids[at:]), pa.array(value)], ["i", "j", "value"])

    schema = "i long, j long, value double"
    products = cell_lists(c).mapInArrow(lambda batches: entry_products(batches, PAIRS), schema)
    shifts = m.features.select("feature_id").join(c.mu.select("feature_id"), "feature_id", "left_semi").mapInArrow(corrections, schema)
    return products.unionByName(shifts).groupBy("i", "j").agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class LinearEmbedding:
    """coordinates (cell_id, pc, value), stdev (pc, stdev), loadings (feature_id, pc, value); pc from 1."""

    coordinates: DataFrame
    stdev: DataFrame
    loadings: DataFrame


def flip_signs(v: np.ndarray) -> np.ndarray:
    """Each column's largest entry by size is positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def cell_lists(c: CenteredMatrix) -> DataFrame:
    """(cell_id, e): every cell with the list of its entries (feature_id, value)."""
    entries = c.matrix.coo.groupBy("cell_id").agg(F.collect_list(F.struct("feature_id", F.col("value").cast("double").alias("value"))).alias("e"))
    return c.matrix.cells.select("cell_id").join(entries, "cell_id", "left")


def times(batches, ids: np.ndarray, v: np.ndarray, shift: np.ndarray):
    """(cell ids, entries' cell, feature and value, A V - shift) of some cells at a time, for the rows of :func:`cell_lists`."""
    for b in batches:
        for s in range(0, b.num_rows, CELLS):
            part = b.slice(s, CELLS)
            lists = part.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(n)), n)
            feature = np.searchsorted(ids, flat.field(0).to_numpy(zero_copy_only=False))
            value = flat.field(1).to_numpy(zero_copy_only=False)
            product = np.tile(-shift, (len(n), 1))
            step = max(1, PRODUCTS // max(1, v.shape[1]))
            for e in range(0, len(row), step):
                np.add.at(product, row[e : e + step], value[e : e + step, None] * v[feature[e : e + step]])
            yield part.column(0), row, feature, value, product


def tree(parts: DataFrame, tasks: int, added, schema: str) -> DataFrame:
    """Rows (start, part, data) of ``tasks`` tasks, reduced by ``added`` to one row for each start, FAN_IN at a time."""
    while tasks > 1:
        parts = parts.groupBy("start", (F.col("part") / FAN_IN).cast("int").alias("up")).applyInArrow(added, schema)
        tasks = -(-tasks // FAN_IN)
    return parts


def one_row(start: int, part: int, data: np.ndarray):
    return {"start": pa.array([start], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())}


PARTIAL = "start int, part int, data binary"


def tall_qr(rows: DataFrame, ids: np.ndarray, mu: np.ndarray, v: np.ndarray) -> np.ndarray:
    """R (m x m) with A V = Q R for orthonormal Q, by a tree of QR steps over the rows of A V; V has m columns.

    A task folds the rows that it has into one R as it reads them; Rs of
    several tasks are stacked and folded again.  Nothing is squared, so small
    singular values of A V keep all their digits.
    """
    m = v.shape[1]
    held = rows.sparkSession.sparkContext.broadcast((ids, v, mu @ v))

    def fold(r, more):
        r = np.linalg.qr(np.concatenate([r, more]), "r")
        return np.concatenate([r, np.zeros((m - len(r), m))])

    def partial(batches):
        r = np.zeros((m, m))
        for *_, product in times(batches, *held.value):
            r = fold(r, product)
        yield pa.RecordBatch.from_pydict(one_row(0, TaskContext.get().partitionId(), r))

    def added(key, table):
        r = np.zeros((m, m))
        for x in table.column("data").to_pylist():
            r = fold(r, np.frombuffer(x).reshape(m, m))
        return pa.table(one_row(key[0].as_py(), key[1].as_py(), r))

    r = np.zeros((m, m))
    for found in tree(rows.mapInArrow(partial, PARTIAL), rows.rdd.getNumPartitions(), added, PARTIAL).collect():
        r = fold(r, np.frombuffer(found.data).reshape(m, m))
    held.destroy()
    return r


def adjoint_times(rows: DataFrame, ids: np.ndarray, mu: np.ndarray, v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A' (A V T) in one pass, A V T being formed cell by cell; features x columns of T.

    Left vectors are never stored: a task makes those of its cells again from
    V and T, so that a lost executor costs no more than its tasks.
    """
    held = rows.sparkSession.sparkContext.broadcast((ids, v, mu @ v, t))
    width, n = t.shape[1], len(ids)

    def partial(batches):
        ids, v, shift, t = held.value
        # The last row adds up the left vectors, for the shift by the means.
        total = np.zeros((len(ids) + 1, t.shape[1]))
        for _, row, feature, value, product in times(batches, ids, v, shift):
            left = product @ t
            np.add.at(total, feature, value[:, None] * left[row])
            total[-1] += left.sum(0)
        me = TaskContext.get().partitionId()
        for s in range(0, len(total), ROWS):
            yield pa.RecordBatch.from_pydict(one_row(s, me, total[s : s + ROWS]))

    def added(key, table):
        return pa.table(one_row(key[0].as_py(), key[1].as_py(), sum(np.frombuffer(x) for x in table.column("data").to_pylist())))

    total = np.zeros((n + 1, width))
    for r in tree(rows.mapInArrow(partial, PARTIAL), rows.rdd.getNumPartitions(), added, PARTIAL).collect():
        piece = np.frombuffer(r.data).reshape(-1, width)
        total[r.start : r.start + len(piece)] += piece
    held.destroy()
    return total[:-1] - np.outer(mu, total[-1])


def orthonormal(x: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns that span what is left of ``x`` beside ``basis``, directions shorter than ``least`` left out."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > least]
    # Short directions were mostly rounding along the basis before they were scaled up.
    for _ in range(2):
        u = np.linalg.qr(u - basis @ (basis.T @ u))[0]
    return u


def truncated_svd(rows: DataFrame, ids: np.ndarray, mu: np.ndarray, k: int, tol: float = 1e-8, start: np.ndarray | None = None, blocks: int = 6, steps: int = 200, direct: int = DIRECT, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The leading k singular values of the centred matrix and its right singular vectors (features x k).

    Block Golub-Kahan bidiagonalisation with thick restarts.  The right basis P
    is with the driver (features x at most ``blocks`` (k + 10) columns), left
    vectors are with the cells.  A step is two passes: the tree QR of A P,
    whose factor R holds all singular values of A on the basis, and A' Q for
    the left directions Q that the newest columns added.  What of A' Q lies
    outside the basis is the residual of every Ritz triplet and the next block;
    it never has more columns than features are left.  When the basis is full,
    the leading Ritz vectors and the residual block start the next one.

    It ends when every |A' u - s v| is at most ``tol`` times the largest s, and
    raises an error if ``steps`` do not suffice.  ``start`` (features x any)
    are directions to begin with, such as those of an earlier run.  At most
    ``direct`` features, or a block that would span half of them, take one
    pass: the tree QR of the matrix itself.
    """
    f, width = len(ids), k + 10
    if f <= max(direct, 2 * width):
        _, s, vt = np.linalg.svd(tall_qr(rows, ids, mu, np.eye(f)))
        return s[:k], vt[:k].T
    first = np.random.default_rng(seed).normal(size=(f, width))
    if start is not None:
        first[:, : min(width, start.shape[1])] = start[:, :width]
    old, new = np.zeros((f, 0)), np.linalg.qr(first)[0]
    for _ in range(steps):
        basis = np.concatenate([old, new], 1)
        r = tall_qr(rows, ids, mu, basis)
        x, s, vt = np.linalg.svd(r)
        tiny = 4 * np.finfo(float).eps * basis.shape[1] ** 0.5 * max(s[0], 1e-300)
        # Left directions of the newest columns beside those of the older ones, and their combination of A P.
        had, had_s, _ = np.linalg.svd(r[:, : old.shape[1]], full_matrices=False)
        left = orthonormal(r[:, old.shape[1] :], had[:, had_s > tiny], tiny)
        if left.shape[1]:
            rank = s > tiny
            z = adjoint_times(rows, ids, mu, basis, vt[rank].T @ ((x[:, rank].T @ left) / s[rank][:, None]))
            for _ in range(2):
                z = z - basis @ (basis.T @ z)
            residual = np.linalg.norm(z @ (left.T @ x[:, :k]), axis=0)
        if not left.shape[1] or residual.max() <= tol * s[0]:
            return s[:k], basis @ vt[:k].T
        more = orthonormal(z, basis, tiny)
        if not more.shape[1]:
            return s[:k], basis @ vt[:k].T
        old, new = (basis, more) if basis.shape[1] + more.shape[1] <= blocks * width else (basis @ vt[:width].T, more)
    raise RuntimeError(f"no convergence of {k} singular values to {tol} in {steps} steps")


def solver_input(c: CenteredMatrix) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """What :func:`truncated_svd` takes: the cells' rows, cut, and the features' ids, ascending, with their means."""
    own = c.mu.select("feature_id", F.col("mu").cast("double").alias("mu")).toArrow()
    ids, mu = own["feature_id"].to_numpy(), own["mu"].to_numpy()
    order = np.argsort(ids)
    return cut(cell_lists(c), "cell-rows"), ids[order], mu[order]


def pca(c: CenteredMatrix, npcs: int = 50, tol: float = 1e-8, start: np.ndarray | None = None) -> LinearEmbedding:
    """Coordinates U S, deviations S / sqrt(cells - 1) and loadings V, with fixed signs.

    ``npcs`` is limited by the matrix's smaller side.  No further centring is
    done; of the features only means and k loadings each pass through the driver.
    """
    spark = c.matrix.coo.sparkSession
    rows, ids, mu = solver_input(c)
    n = rows.count()
    k = min(npcs, len(ids), n)
    s, v = truncated_svd(rows, ids, mu, k, tol, start) if k else (np.zeros(0), np.zeros((len(ids), 0)))
    free(rows)
    v = flip_signs(v) if k else v
    table = pa.table({"feature_id": pa.array(np.repeat(ids, k), pa.int64()), "pc": pa.array(np.tile(np.arange(1, k + 1), len(ids)), pa.int32()), "value": pa.array(v.ravel(), pa.float64())})
    loadings = spark.createDataFrame(table)
    held = spark.sparkContext.broadcast((ids, v, mu @ v))

    def project(batches):
        for cells, *_, product in times(batches, *held.value):
            m = product.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells.to_numpy(zero_copy_only=False), m)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(cells))), pa.array(product.ravel())], ["cell_id", "pc", "value"])

    coordinates = cell_lists(c).mapInArrow(project, "cell_id long, pc int, value double")
    stdev = spark.createDataFrame([(p + 1, float(s[p]) / max(1, n - 1) ** 0.5) for p in range(k)], "pc int, stdev double")
    return LinearEmbedding(coordinates, stdev, loadings)


def embedding(c: CenteredMatrix, ncomponents: int = 50, method: str = "pca") -> LinearEmbedding:
    """Only principal components are known."""
    if method != "pca":
        raise ValueError(f"unknown method: {method}")
    return pca(c, ncomponents)


def top_loadings(e: LinearEmbedding, nfeatures: int = 20, dims: int = 5) -> DataFrame:
    """(pc, sign, rank, feature_id, value): the largest and the smallest loadings of each component."""
    rows = e.loadings.filter(F.col("pc") <= dims)
    up = rows.withColumn("sign", F.lit(1)).withColumn("rank", F.row_number().over(Window.partitionBy("pc").orderBy(F.desc("value"), "feature_id")))
    down = rows.withColumn("sign", F.lit(-1)).withColumn("rank", F.row_number().over(Window.partitionBy("pc").orderBy("value", "feature_id")))
    return up.unionByName(down).filter(F.col("rank") <= nfeatures).select("pc", "sign", "rank", "feature_id", "value")


def centered_copy(m: CountMatrix) -> CenteredMatrix:
    """The matrix with its feature means as shift."""
    from .stats import feature_stats

    return CenteredMatrix(m.with_coo(m.coo.withColumn("value", F.col("value").cast("double"))), feature_stats(m).select("feature_id", F.col("mean").alias("mu")))
