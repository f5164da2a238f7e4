"""Compression of vectors to codes: product quantisation with tree search of the codebooks.

Vectors of integers are cut into equal parts, and each part is replaced by the
index of its nearest codebook entry.  Codebooks are learnt by rounds over all
vectors: every task assigns its rows and adds up the parts of each entry; only
those sums, a few numbers for each part and entry, leave the task.  The nearest
entry is found by a vantage-point tree over the entries of a part position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are assigned at a time, and entries that a leaf of a tree has at most.
ROWS, LEAF = 4096, 2
#: Rows of labels that may be broadcast (a few bytes each).
BROADCAST_ROWS = 200_000


def floor_root(x: np.ndarray) -> np.ndarray:
    """The integer part of the square root of int64 values; rounding of the float root is set right."""
    r = np.sqrt(x.astype(float)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def ceil_root(x: np.ndarray) -> np.ndarray:
    r = floor_root(x)
    return r + (r * r < x)


def squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = rows - entry
    return np.einsum("ij,ij->i", d, d)


class VantageTree:
    """Nearest entries of one codebook, exactly; ties go to the lower index.

    A node's vantage entry is compared with every row that comes to it.  Its
    two children hold the nearer and the farther half of the other entries,
    with the least and the largest distance from the vantage entry, rounded
    down and up.  By the triangle inequality a child can be passed over only
    where those bounds are *strictly* farther than the best so far, so that an
    equally near entry of a lower index is never missed.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self.node(np.arange(len(entries)))

    def node(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids, None
        # The entry that is farthest from the mean spreads the others' distances.
        centre = self.entries[ids].astype(float).mean(0)
        vantage = ids[((self.entries[ids] - centre) ** 2).sum(1).argmax()]
        rest = ids[ids != vantage]
        d = squared(self.entries[rest], self.entries[vantage])
        order = np.argsort(d, kind="stable")
        halves = np.array_split(order, 2)
        return np.array([vantage]), [(int(floor_root(d[h].min(keepdims=True))[0]), int(ceil_root(d[h].max(keepdims=True))[0]), self.node(rest[h])) for h in halves if len(h)]

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, as int64."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        index = np.full(len(rows), len(self.entries))
        if len(rows):
            self.visit(self.root, rows, np.arange(len(rows)), best, index)
        return index, best

    def visit(self, node, rows, at, best, index):
        own, children = node
        d = None
        for e in own:
            d = squared(rows[at], self.entries[e])
            better = (d < best[at]) | ((d == best[at]) & (e < index[at]))
            best[at[better]], index[at[better]] = d[better], e
        if not children:
            return
        low, high = floor_root(d), ceil_root(d)
        # Each row goes first where its own distance from the vantage entry lies.
        near = low <= (children[0][1] + children[-1][0]) // 2
        for first, chosen in ((0, near), (-1, ~near)):
            mine = np.flatnonzero(chosen)
            for lo, hi, child in (children if first == 0 else children[::-1]):
                reach = ceil_root(best[at[mine]])
                open_ = (low[mine] - hi <= reach) & (lo - high[mine] <= reach)
                if open_.any():
                    self.visit(child, rows, at[mine[open_]], best, index)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of rows with a vector whose components are all finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding", "label").filter(F.col("embedding").isNotNull() & ~bad)


def integers(lists: pa.Array, width: int | None) -> np.ndarray:
    """The rows of a list column as int64 floor(SCALE x); all must have the same length, which PARTS divides."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(n[0]) if width is None else width
    if (n != width).any() or width % PARTS:
        raise ValueError(f"vectors must have one length that is a multiple of {PARTS}; found {sorted({width, *n.tolist()})[:3]}")
    x = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    # Squared distances of whole vectors must fit into 64 bits.
    if x.size and 4.0 * np.abs(x).max() ** 2 * width >= 2.0**62:
        raise OverflowError("components are too large for exact squared distances in 64 bits")
    return x.astype(np.int64).reshape(len(lists), width)


def first_vectors(rows: DataFrame, n: int) -> list:
    """The vectors of the ``n`` smallest vec_ids, ascending, null last; of several rows of one id the smallest vector.

    Each task names its own n smallest ids, so that no more than those are
    shuffled; then the vectors of the n smallest of all are looked up.
    """

    def smallest(batches):
        kept, null = np.zeros(0, np.int64), False
        for b in batches:
            ids = b.column(0)
            null = null or ids.null_count > 0
            kept = np.unique(np.concatenate([kept, ids.drop_null().to_numpy(zero_copy_only=False)]))[:n]
        yield pa.RecordBatch.from_arrays([pa.array([*kept.tolist(), *[None] * null], pa.int64())], ["own"])

    ids = rows.select("vec_id").mapInArrow(smallest, "own long").distinct().orderBy(F.asc_nulls_last("own")).limit(n)
    found = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("own"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return [r.embedding for r in sorted(found.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))]


def parts_of(x: np.ndarray) -> np.ndarray:
    """[parts, rows, width of a part]."""
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def trained_codebooks(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """[parts, entries, width] after ``rounds`` passes over all rows; None where there are no rows.

    A pass that changes nothing is the last, as all later ones would give the same.
    """
    first = first_vectors(rows, entries)
    if not first:
        return None
    width = len(first[0])
    books = parts_of(integers(pa.array(first, pa.list_(pa.float64())), width))
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast(books)

        def sums(batches, held=held):
            books = held.value
            trees = [VantageTree(b) for b in books]
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                for s in range(0, b.num_rows, ROWS):
                    for p, part in enumerate(parts_of(integers(b.column(0).slice(s, ROWS), width))):
                        index, _ = trees[p](part)
                        np.add.at(total[p], index, part)
                        count[p] += np.bincount(index, minlength=count.shape[1])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        own = rows.select("embedding").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        own = own.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = books.copy()
        for r in own.collect():
            new[r.part, r.entry, r.at] = r.x // r.n
        held.destroy()
        if (new == books).all():
            break
        books = new
    return books


def encoder(held, label_type):
    """A mapInArrow function: (embedding, vec_id, label) to (vec_id, label, code, error)."""

    def run(batches):
        books = held.value
        trees = [VantageTree(b) for b in books]
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                some = b.slice(s, ROWS)
                x = parts_of(integers(some.column(0), books.shape[0] * books.shape[2]))
                index, error = (np.array(v) for v in zip(*(t(p) for t, p in zip(trees, x))))
                digits = index.T.astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(codes, pa.string()), pa.array(error.sum(0))], ["vec_id", label_type, "code", "error"])

    return run


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together.

    Labels of so many rows that no more than ``most`` labels can have them are
    joined by broadcast, so that none of them makes a large group; the others
    are joined by a shuffle.
    """
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    found = sums.agg(F.sum("rows").alias("rows"), F.count("*").alias("labels")).first()
    total, labels = found.rows or 0, found.labels
    least = 1 if labels <= most else -(-total // most)
    common = sums.filter(F.col("rows") >= least).select(F.col("label").alias("own"), "label_error")
    out = coded.join(F.broadcast(common), F.col("label").eqNullSafe(F.col("own")), "left")
    if least > 1:
        rare = sums.filter(F.col("rows") < least).select(F.col("label").alias("other"), F.col("label_error").alias("rest"))
        some = out.filter("label_error is null").drop("own", "label_error").join(rare, F.col("label").eqNullSafe(F.col("other"))).withColumnRenamed("rest", "label_error")
        out = out.filter("label_error is not null").drop("own").unionByName(some.drop("other"))
    return out.drop("own")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row of (vec_id, embedding, label).

    Null vectors and vectors with null or non-finite components take no part;
    vectors of different lengths, of a length that 8 does not divide or of
    components too large for 64 bits raise an error.  Each position's codebook
    starts with the parts of the 16 smallest vec_ids (a vec_id of several rows
    counts once, by its smallest vector; null comes last), or of all if there
    are fewer.  Repeated rows and null ids are encoded row by row; null labels
    are one label.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    kind = rows.schema["label"].dataType.simpleString()
    books = trained_codebooks(rows, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    held = spark.sparkContext.broadcast(books)
    coded = rows.select("embedding", "vec_id", "label").mapInArrow(encoder(held, "label"), f"vec_id long, label {kind}, code string, error long")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
