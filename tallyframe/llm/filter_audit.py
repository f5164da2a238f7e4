"""Filter interaction audit by products with incidence matrices.

Which of the five filters a document fails is a mask of five bits, so all that
any order of filters can do to a part of the corpus is told by a histogram of
32 masks.  The histograms of all documents, of those of good quality and of the
toxic ones are the rows of a matrix; its products with integer matrices of
32 masks x 600 columns (every order and step) count what each step keeps and
removes, what had gone before it, and what only its filter would find.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Least words; least per cent of distinct words; most per cent of capital letters; characters of markup and code.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKUP = 100, 80, 10, "[#$%&*|]"
CAPITAL = "[A-Z]"
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """The bits of filters A to D (1, 2, 4, 8) that ``text`` fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit(CAPITAL))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(MARKUP))
    return sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))


def mask_histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, cut.

    Texts are read once; what is shuffled is an id, a digest and a mask a
    document.  A text's first document is told by its digest *and* id, so
    that a text which a third of all documents share makes no large group.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = cut(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "audit-rows")
    known = rows.filter("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    known = known.join(first, ["doc_id", "digest"], "left").join(told, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    known = known.select("part", (F.col("mask") + copy).alias("mask"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    unknown = rows.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("bad"))
    both = known.unionByName(unknown).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))
    out = cut(both, "audit-masks")
    free(rows)
    return out


def incidence() -> dict[str, np.ndarray]:
    """The 32 x 600 matrices: 1 where a mask is counted in the column of an order and step (orders by name, then steps)."""
    out = {name: np.zeros((MASKS, len(ORDERS) * STEPS), np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    for p, order in enumerate(ORDERS):
        before = 0
        for s, name in enumerate(order):
            own, at = 1 << FILTERS.index(name), p * STEPS + s
            for mask in range(MASKS):
                out["kept"][mask, at] = not mask & (before | own)
                out["removed"][mask, at] = bool(mask & own) and not mask & before
                out["redundant"][mask, at] = bool(mask & own) and bool(mask & before)
                out["unique_fails"][mask, at] = mask == own
            before |= own
    return out


def counted(batches):
    """A mapInArrow function: (part, list of (mask, n, good, toxic)) to the rows of :data:`OUT`."""
    matrices = incidence()
    names = np.array([o[s] for o in ORDERS for s in range(STEPS)])
    #: Columns x filters, and filters x columns: sums over all columns of a filter, given to each of them.
    of = (names[:, None] == np.array(list(FILTERS))[None, :]).astype(np.int64)
    orders, steps = pa.array([o for o in ORDERS for _ in range(STEPS)]), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
    for b in batches:
        for s in range(0, b.num_rows, 64):
            part = b.slice(s, 64)
            n, lists = part.num_rows, part.column(1)
            flat = lists.flatten()
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            stacked = np.zeros((3, n, MASKS), np.int64)
            for k, name in enumerate(("n", "good", "toxic")):
                stacked[k, row, flat.field("mask").to_numpy(zero_copy_only=False)] = flat.field(name).to_numpy(zero_copy_only=False)
            documents, good, toxic = stacked
            removed = documents @ matrices["removed"]
            columns = [documents @ matrices["kept"], removed, documents @ matrices["redundant"], documents @ matrices["unique_fails"], good @ matrices["removed"], toxic @ matrices["removed"], removed @ of @ of.T]
            width = removed.shape[1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(n), width))), orders.take(pa.array(np.tile(np.arange(width), n))), pa.array(np.tile(steps, n)), *(pa.array(c.ravel()) for c in columns)],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (value of ``lang``), order of the filters and step, as in :data:`OUT`.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic; other
    columns of any name are ignored.  Filters, by what fails: A under 100
    words; B fewer than 80 % distinct words; C over 10 % capital letters A-Z;
    D any of ``#$%&*|``; E a smaller doc_id has the same text.

    A null text is an empty one, a null lang the part "".  A null doc_id has
    no smaller one, is no copy's first and has no labels.  Rows that share a
    doc_id count one by one; with the same text none is the other's copy.  A
    doc_id with several rows of labels is good (toxic) if one of them says
    so; null labels say nothing.  An empty table gives an empty result.
    """
    hist = mask_histograms(docs, labels)
    stacked = hist.groupBy("part").agg(F.collect_list(F.struct(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))).alias("masks"))
    return stacked.mapInArrow(counted, OUT)
