"""Quality of texts by naive Bayes support vectors.

A text is the set of its n-grams: of one to three bytes; of one to five words,
each told only by how far back the same word stands; and of one and two words,
each told only by its shape.  Of n-grams of words it also counts what share of
the text they make.  Each indicator is scaled by the logarithm of the ratio of
its frequencies in the two classes, counted over *all* labelled texts, and a
linear hinge-loss model on the scaled indicators is fitted by dual coordinate
descent on a bounded sample of them.  A logistic curve, fitted on margins of
texts that the model had not seen, turns a margin into a probability.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, maybe_broadcast, text_blocks
from .words import ODD, split_words

#: Labelled texts on which the hinge-loss model is fitted, at most; the class ratios come from all of them.
TRAIN_TEXTS = 4000
#: Labels that may be broadcast to the texts (12 bytes each).
BROADCAST_ROWS = 1_000_000
#: Added to all counts; cost of a violated margin; passes at most and the change of a dual variable at which they end; folds.
SMOOTHING, COST, EPOCHS, TOLERANCE, FOLDS = 1.0, 1.0, 50, 1e-4, 5
THRESHOLD = 0.7

#: Buckets of n-grams of three bytes, in bits.
TRIPLE_BITS = 17
#: Letters' case (none, first only, all, mixed) x a digit x last character (other, .,;:, !?, other ASCII sign); lengths.
SHAPES, LENGTHS = 4 * 2 * 4, (2, 4, 8, 16)
#: Distances at which a word may stand again, and words of an n-gram of such distances.
BACK, RUN = 4, 5
#: Shares of a text's n-grams from which one has an indicator of its own.
SHARES = (1 / 64, 1 / 16, 1 / 4)

PAIRS_AT, TRIPLES_AT = 256, 256 + 65536
WORDS_AT = TRIPLES_AT + (1 << TRIPLE_BITS)
SHAPE2_AT = SHAPES * (len(LENGTHS) + 1)
RUNS_AT = [SHAPE2_AT + SHAPES * SHAPES + sum((BACK + 1) ** k for k in range(1, o)) for o in range(1, RUN + 1)]
WORD_KINDS = RUNS_AT[-1] + (BACK + 1) ** RUN
FEATURES = WORDS_AT + WORD_KINDS * (1 + len(SHARES))

ASCII = [chr(b) if b < 128 else "" for b in range(256)]
UPPER, DIGIT = (np.array([bool(c) and f(c) for c in ASCII]) for f in (str.isupper, str.isdigit))
LETTER = np.array([not c or c.isalpha() for c in ASCII])
ENDING = np.array([0 if not c or c.isalnum() else 1 if c in ".,;:" else 2 if c in "!?" else 3 for c in ASCII])


def word_kinds(data: np.ndarray, hashes: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(shapes, shapes with lengths, distances back) of all words of a run of texts."""
    held = [np.concatenate([[0], np.cumsum(table[data])]) for table in (UPPER, DIGIT, LETTER)]
    upper, digits, letters = (c[ends] - c[starts] for c in held)
    case = np.where(upper == 0, 0, np.where((upper == letters) & (upper > 1), 2, np.where((upper == 1) & UPPER[data[starts]], 1, 3)))
    shape = (case * 2 + (digits > 0)) * 4 + ENDING[data[ends - 1]]
    long_shape = shape * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, ends - starts, "right")
    first = np.repeat(at[:-1], np.diff(at))
    back = np.zeros(len(hashes), np.int64)
    for k in range(BACK, 0, -1):
        same = np.flatnonzero((hashes[k:] == hashes[:-k]) & (first[k:] == first[:-k])) + k
        back[same] = k
    return shape, long_shape, back


def word_features(shape: np.ndarray, long_shape: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The ids of the n-grams of words in one text, and of those that make a large share of it."""
    n = len(shape)
    ids = [long_shape, SHAPE2_AT + shape[:-1] * SHAPES + shape[1:]]
    run = np.zeros(n, np.int64)
    for o in range(1, min(RUN, n) + 1):
        run = run[: n - o + 1] * (BACK + 1) + back[o - 1 :]
        ids.append(RUNS_AT[o - 1] + run)
    count = np.bincount(np.concatenate(ids), minlength=WORD_KINDS)
    found = np.flatnonzero(count)
    count = count[found]
    return WORDS_AT + np.concatenate([found, *((k + 1) * WORD_KINDS + found[count >= max(2, share * n)] for k, share in enumerate(SHARES))])


def text_features(column: pa.Array):
    """For each text of a string array the ids of its different n-grams (int64); null counts as empty."""
    mark = np.zeros(WORDS_AT, np.int64)
    for data, hashes, at, starts, ends in split_words(column):
        # Texts of a run are kept apart by one blank each.
        n = len(at) - 1
        kinds = word_kinds(data, hashes, at, starts, ends)
        sizes = pc.binary_length(column.slice(0, n)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + (n > 1))])[:n]
        column = column.slice(n)
        one = data.astype(np.int64)
        two = PAIRS_AT + (one[:-1] << 8 | one[1:])
        three = TRIPLES_AT + (((one[:-2] << 16 | one[1:-1] << 8 | one[2:]).astype(np.uint64) * np.uint64(ODD)) >> np.uint64(64 - TRIPLE_BITS)).astype(np.int64)
        for i in range(n):
            a, e = first[i], first[i] + sizes[i]
            ids = np.concatenate([one[a:e], two[a : max(a, e - 1)], three[a : max(a, e - 2)]])
            order = np.arange(len(ids))
            mark[ids] = order
            ids = ids[mark[ids] == order]
            w = slice(at[i], at[i + 1])
            yield np.concatenate([ids, word_features(*(k[w] for k in kinds))]) if at[i] < at[i + 1] else ids


@dataclass(frozen=True)
class Model:
    """weights [FEATURES] and bias of the margin; slope and offset of the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log-count ratios from counts [2, FEATURES] of texts of label 1 and 0 with a feature."""
    p = counts + SMOOTHING
    p = np.log(p) - np.log(p.sum(1, keepdims=True))
    return p[0] - p[1]


def hinge_fit(texts: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights of the indicators and bias by dual coordinate descent; y is 1 or -1."""
    w, bias, dual, rng = np.zeros(len(ratios)), 0.0, np.zeros(len(texts)), np.random.default_rng(0)
    scaled = [ratios[x] for x in texts]
    norm = [float(v @ v) + 1.0 for v in scaled]
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(texts)):
            slack = y[i] * (float(w[texts[i]] @ scaled[i]) + bias) - 1
            new = min(max(dual[i] - slack / norm[i], 0.0), cost)
            if (change := new - dual[i]) != 0:
                w[texts[i]] += change * y[i] * scaled[i]
                bias += change * y[i]
                dual[i] = new
                most = max(most, abs(change))
        if most < TOLERANCE:
            break
    return w * ratios, bias


def logistic_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps on smoothed targets."""
    up = (y > 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    x = np.stack([margins, np.ones(len(y))], 1)
    at = np.array([1.0, 0.0])

    def loss(at):
        z = x @ at
        return np.logaddexp(0, z).sum() - target @ z

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(texts: list[np.ndarray], labels: list[int], counts: np.ndarray) -> Model:
    """The model of a sample of texts (n-gram ids) and labels; ``counts`` are those of all labelled texts.

    With fewer than two texts of a label the score of every text is the smoothed
    share of label 1.
    """
    y = np.where(np.array(labels, int) == 1, 1, -1)
    up = int((y > 0).sum())
    if min(up, len(y) - up) < 2:
        share = (up + 1) / (len(y) + 2)
        return Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    weights, bias = hinge_fit(texts, y, log_ratios(counts))
    # Margins of texts that neither the ratios nor the weights have seen; folds share out both labels.
    fold = np.empty(len(y), int)
    for side in (y > 0, y < 0):
        fold[side] = np.arange(side.sum()) % min(FOLDS, up, len(y) - up)
    margins = np.empty(len(y))
    for k in range(fold.max() + 1):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        left = counts.copy()
        for i in own:
            left[0 if y[i] > 0 else 1][texts[i]] -= 1
        w, b = hinge_fit([texts[i] for i in rest], y[rest], log_ratios(left))
        margins[own] = [w[texts[i]].sum() + b for i in own]
    return Model(weights, bias, *logistic_fit(margins, y))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((text, y) of the texts that may be learnt from, (doc_id, y)): crc32(doc_id as text) mod 4 is not 2."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    return docs.select("doc_id", "text").join(maybe_broadcast(known, BROADCAST_ROWS), "doc_id").select("text", "y"), known


def class_counts(rows: DataFrame) -> np.ndarray:
    """[2, FEATURES]: texts of label 1 and of label 0 in (text, y) that have a feature."""

    def run(batches):
        counts = np.zeros((2, FEATURES), np.int64)
        for b in batches:
            for t in text_blocks([b], 0):
                for y, ids in zip(t.column(1).to_pylist(), text_features(t.column(0))):
                    counts[0 if y == 1 else 1][ids] += 1
        found = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[0, found]), pa.array(counts[1, found])], ["feature", "up", "down"])

    own = rows.mapInArrow(run, "feature int, up long, down long").groupBy("feature").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    found = own.toArrow()
    counts = np.zeros((2, FEATURES), np.int64)
    counts[:, found["feature"].to_numpy()] = found["up"].to_numpy(), found["down"].to_numpy()
    return counts


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality).

    Class counts are over all labelled texts, added up by tasks; their number
    is fixed.  The hinge-loss model is fitted in one task on at most ``most``
    texts, taken by a hash of their ids.  Labels other than 0 and 1 say
    nothing; a doc_id with several labels is of label 1 if one of them is.
    """
    rows, known = labelled(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(class_counts(rows))

    def features(batches):
        for b in batches:
            for t in text_blocks([b], 1):
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(2), pa.array([x.astype(np.int32) for x in text_features(t.column(1))], pa.list_(pa.int32()))], ["doc_id", "y", "ids"])

    def run(batches):
        found = sorted((i, y, x) for b in batches for i, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(tuple, b.column(2).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([np.array(x, np.int64) for *_, x in found], [y for _, y, _ in found], held.value))], pa.binary())], ["model"])

    some = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(features, "doc_id long, y int, ids array<int>")
    # The model is kept in the shared folder, so that a lost executor does not cost a second fit.
    fitted = cut(sample.repartition(1).mapInArrow(run, "model binary"), "quality-model").collect()
    held.destroy()
    return pickle.loads(fitted[0].model) if fitted else fit([], [], np.zeros((2, FEATURES), np.int64))


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text).

    score is the probability of label 1; predicted is 1 from ``threshold`` on.
    held_out tells that crc32(doc_id as text) mod 4 is 2 (false for a null
    doc_id).  Null and empty texts get the score of a text without any n-gram;
    repeated rows stay repeated; other columns are ignored; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in batches:
            for t in text_blocks([b], 1):
                margins = np.array([model.weights[ids].sum() for ids in text_features(t.column(1))]) + model.bias
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(model.probability(margins))], ["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
