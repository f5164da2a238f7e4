"""The quality classifier: n-grams and scores against plain loops, the fit by its optimality, labels held out."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import quality

from .brute import LOW
from .conftest import CLASHING, DATA, HARD

ODD = 0x9E3779B97F4A7C15


def plain_features(text):
    """The set of n-gram ids of one text, by loops over its bytes and words."""
    b = (text or "").encode()
    out = set(b) | {256 + x * 256 + y for x, y in zip(b, b[1:])}
    out |= {quality.TRIPLES_AT + (((x << 16 | y << 8 | z) * ODD) % 2**64 >> 47) for x, y, z in zip(b, b[1:], b[2:])}
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    low = [w.decode().translate(LOW) for w in words]
    shapes, long_shapes, back = [], [], []
    for i, w in enumerate(words):
        upper = sum(65 <= c <= 90 for c in w)
        letters = sum(c >= 128 or chr(c).isalpha() for c in w)
        case = 0 if not upper else 2 if upper == letters and upper > 1 else 1 if upper == 1 and 65 <= w[0] <= 90 else 3
        last = w[-1]
        ending = 0 if last >= 128 or chr(last).isalnum() else 1 if chr(last) in ".,;:" else 2 if chr(last) in "!?" else 3
        shapes.append((case * 2 + any(48 <= c <= 57 for c in w)) * 4 + ending)
        long_shapes.append(shapes[-1] * 5 + sum(len(w) >= x for x in (2, 4, 8, 16)))
        back.append(next((k for k in range(1, 5) if i >= k and low[i - k] == low[i]), 0))
    grams = long_shapes + [quality.SHAPE2_AT + x * 32 + y for x, y in zip(shapes, shapes[1:])]
    for o in range(1, 6):
        grams += [quality.RUNS_AT[o - 1] + sum(d * 5 ** (o - 1 - j) for j, d in enumerate(back[i : i + o])) for i in range(len(words) - o + 1)]
    for g, n in Counter(grams).items():
        out.add(quality.WORDS_AT + g)
        out |= {quality.WORDS_AT + (k + 1) * quality.WORD_KINDS + g for k, share in enumerate((1 / 64, 1 / 16, 1 / 4)) if n >= max(2, share * len(words))}
    return out


TEXTS = [None, "", " ", "a", "Of Of of OF of", "one two one two, one two", "THE!! END!! 4711 x9 McDonald é été É naïve %%% | $5.", "\n\n tab\tnew\nline \x0b\x0c", "long " * 3000, "w" * 5000, *(t for _, t in HARD)]


def test_features_against_loops():
    for texts in (TEXTS, TEXTS[:1], TEXTS[4:5], [], TEXTS * 3):
        found = list(quality.text_features(pa.array(texts, pa.string())))
        assert len(found) == len(texts)
        for t, ids in zip(texts, found):
            assert len(set(ids.tolist())) == len(ids)
            assert set(ids.tolist()) == plain_features(t)
    sliced = pa.array(["x y", *TEXTS], pa.string()).slice(5, 4)
    assert [set(i.tolist()) for i in quality.text_features(sliced)] == [plain_features(t) for t in sliced.to_pylist()]
    assert max(max(plain_features(t), default=0) for t in TEXTS) < quality.FEATURES


def test_hinge_fit_reaches_the_optimum():
    rng = np.random.default_rng(1)
    texts = [np.unique(rng.integers(0, 60, 12)) for _ in range(120)]
    y = np.where(np.array([(x < 20).sum() - (x > 40).sum() for x in texts]) + rng.normal(size=120) * 2 > 0, 1, -1)
    ratios = rng.normal(size=60)
    weights, bias = quality.hinge_fit(texts, y, ratios, cost=0.5)
    w = np.divide(weights, ratios)
    margin = np.array([weights[x].sum() for x in texts]) + bias
    primal = 0.5 * (w @ w + bias * bias) + 0.5 * np.maximum(0, 1 - y * margin).sum()
    for _ in range(200):
        dw, db = rng.normal(size=60) * 0.02, rng.normal() * 0.02
        other = np.array([((w + dw) * ratios)[x].sum() for x in texts]) + bias + db
        assert primal <= 0.5 * ((w + dw) @ (w + dw) + (bias + db) ** 2) + 0.5 * np.maximum(0, 1 - y * other).sum() + 0.02


def test_log_ratios():
    counts = np.array([[3, 0, 1], [1, 1, 1]])
    total = counts.sum(1) + 3
    assert np.allclose(quality.log_ratios(counts), [math.log((counts[0][i] + 1) / total[0] / ((counts[1][i] + 1) / total[1])) for i in range(3)])


def held(i, k=2):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == k


def test_scores_and_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    told = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: (r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(i) for i, r in rows.items())
    for lang in ("en", "de", "fr", "es"):
        own = [i for i in told if held(i) and texts[i][1] == lang]
        assert sum(rows[i].predicted == 1 for i in own if told[i] == 1) >= 0.99 * sum(told[i] == 1 for i in own)
        assert sum(rows[i].predicted == 0 for i in own if told[i] == 0) >= 0.95 * sum(told[i] == 0 for i in own)
    # The scores are those of a plain loop over the n-grams of the text.
    for i in sorted(texts)[::400]:
        margin = sum(model.weights[k] for k in plain_features(texts[i][0])) + model.bias
        assert rows[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-9)
    # Prose that no table holds is left alone, and is junk once it is made so.
    prose = "The river had risen in the night, and by morning the lower fields were under water. Nobody in the village could remember a spring like it; even the old miller, who was ninety, shook his head."
    made = [prose, prose + " Call +1 (415) 555-0100 or write to ann@example.org.", prose.upper().replace(" ", "!! "), " | ".join(prose.split()), " ".join(w + s for w, s in zip(prose.split(), ["%%%", "&&&", "$$$", "***"] * 20)), "river " * 60]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert [r.predicted for r in sorted(quality.quality(frame, model).collect())] == [1, 1, 0, 0, 0, 0]


def test_class_counts_are_over_all_learnable_texts(spark, make_docs):
    texts = [f"common word{i} " * (i % 5 + 1) for i in range(300)]
    labels = spark.createDataFrame([(i + 1, i % 3 > 0) for i in range(300)] + [(None, True), (7, True)], "doc_id long, q boolean").selectExpr("doc_id", "cast(q as int) as quality")
    rows, _ = quality.labelled(make_docs(texts), labels)
    found = quality.class_counts(rows.repartition(7))
    want = np.zeros((2, quality.FEATURES), int)
    for i, t in enumerate(texts):
        if not held(i + 1):
            want[0 if i % 3 > 0 or i + 1 == 7 else 1][list(plain_features(t))] += 1
    assert (found == want).all() and found.sum() > 0


def test_any_rows_and_labels(spark, hard, empty):
    labels = spark.createDataFrame([(i, q) for i in range(1, 12) for q in (0, 1, None)], "doc_id long, quality int")
    none = labels.limit(0)
    for known in (labels, none, labels.filter("quality = 1")):
        model = quality.train(hard, known)
        out = quality.quality(hard, model).collect()
        assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if dict(HARD).get(r.doc_id, "?") in (None, "")}) == 1
        assert quality.quality(empty, model).count() == 0
    assert quality.train(empty, labels).probability(np.zeros(1))[0] == 0.5
    assert set(CLASHING) <= set(hard.columns)
