"""Filter audit, vector codes and the quality classifier against plain versions."""

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import filter_audit, vector_codes

from .brute import WORD
from .conftest import CLASHING


def plain_audit(docs, labels):
    """{(part, order, step): counts} by running every order over every document; docs: (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, x in labels if i is not None and x == 1}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        f = set()
        f |= {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        fails.append((lang or "", i, f))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            rest = own
            for s, k in enumerate(order):
                gone = [(i, f) for i, f in rest if k in f]
                rest = [(i, f) for i, f in rest if k not in f]
                shapley[k] += len(gone)
                out[part, "".join(order), s + 1] = [len(rest), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for p, order, s in [x for x in out if x[0] == part]:
            out[p, order, s].append(shapley[order[s - 1]])
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "GAMMA", "delta", "été", "日本", "x|y", "DELTA", "é", "nbsp in"]
    docs = [(i if i % 11 else None, " ".join(rng.choice([*words, f"w{rng.randrange(400)}", f"v{rng.randrange(400)}"]) for _ in range(rng.choice([3, 99, 100, 140]))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en") for i in range(20)] + [docs[5], (5, "another", "en"), (7, None, None), (8, "", "fr"), (9, None, "fr")] + [(200, " ".join(f"u{i}" for i in range(200)), "en"), (201, "A" + "b" * 9, "en"), (202, "AA" + "b" * 17, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 120, 2), 5, 5, 5, None, 9999]]
    extra = "".join(f", {c} string" for c in (*CLASHING, "mask", "digest", "first", "good", "n"))
    d = spark.createDataFrame([(*r, *(["x"] * (len(CLASHING) + 5))) for r in docs], "doc_id long, text string, lang string" + extra)
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as part", "2 as good"))
    got = {tuple(r)[:3]: list(r)[3:] for r in found.collect()}
    assert got == plain_audit(docs, labels)


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_matrices():
    m = filter_audit.incidence()
    assert all(x.shape == (32, 600) for x in m.values())
    # What a step gets it keeps or removes, and the last step keeps what fails nothing.
    assert (m["kept"][:, 4::5].sum(1) > 0).tolist() == [i == 0 for i in range(32)]
    assert (m["removed"].reshape(32, 120, 5).sum(2) == (np.arange(32) > 0)[:, None]).all()


def plain_codes(rows, rounds=6):
    """{(vec_id, code, error, label_error, digest): times} by plain loops; rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    w = len(kept[0][1]) // 8
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:16]]
    books = [[v[p * w : p * w + w] for v in seeds] for p in range(8)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            own = [(nearest(books[p], v[p * w : p * w + w])[1], v[p * w : p * w + w]) for _, v, _ in kept]
            for k in {k for k, _ in own}:
                mine = [x for j, x in own if j == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, label_error = [], Counter()
    for i, v, y in kept:
        found = [nearest(books[p], v[p * w : p * w + w]) for p in range(8)]
        error = sum(d for d, _ in found)
        label_error[y] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    return Counter((i, c, e, label_error[y], digest) for i, c, e, y in out)


def vector_frame(spark, rows, extra=()):
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], "vec_id long, embedding array<float>, label int" + "".join(f", {c} string" for c in extra))


@pytest.mark.parametrize("n", [1, 5, 40, 300])
def test_vector_codes_against_loops(spark, n):
    rng = random.Random(n)
    # Few different values, so that distances tie; ids in no order, some of them repeated or null.
    rows = [(rng.choice([None, *range(-20, n)]) if k % 9 == 0 else 3 * k - 50, [rng.choice([-0.5, -0.3, 0.0, 0.25, 0.7]) for _ in range(16)], rng.choice([None, 1, 2, 3])) for k in range(n)]
    rows = [*rows, *rows[: n // 3], (7, None, 1), (8, [0.1] * 15 + [None], 1), (9, [float("nan")] * 16, 2), (10, [float("inf")] * 16, None), (None, None, None)]
    rng.shuffle(rows)
    extra = ("code", "error", "own", "rows", "part", "entry", "label_error")
    found = vector_codes.compress(vector_frame(spark, rows, extra).repartition(5))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert Counter(tuple(r) for r in found.collect()) == plain_codes(as_float)


def test_vector_codes_of_nothing_and_of_odd_lengths(spark):
    assert vector_codes.compress(vector_frame(spark, [])).count() == 0
    assert vector_codes.compress(vector_frame(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for rows in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="vectors must have one length|too large"):
            vector_codes.compress(vector_frame(spark, rows)).collect()


def test_label_errors_of_more_labels_than_are_broadcast(spark):
    rows = [(i, c, e, y) for i, (c, e, y) in enumerate([("a", k % 7, k % 50 if k % 3 else None) for k in range(400)])]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    totals = Counter()
    for _, _, e, y in rows:
        totals[y] += e
    for most in (5, 1000):
        found = vector_codes.with_label_error(coded, most).collect()
        assert sorted((r.vec_id, r.label_error) for r in found) == [(i, totals[y]) for i, _, _, y in rows]


small_ints = st.integers(-6, 6)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3).flatmap(lambda w: st.tuples(st.lists(st.lists(small_ints, min_size=w, max_size=w), min_size=1, max_size=40), st.lists(st.lists(small_ints, min_size=w, max_size=w), min_size=1, max_size=30))))
def test_vantage_tree_finds_the_first_nearest(both):
    entries, rows = (np.array(x, np.int64) for x in both)
    index, d = vector_codes.VantageTree(entries)(rows)
    all_d = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (index == all_d.argmin(1)).all() and (d == all_d.min(1)).all()


@given(st.lists(st.integers(0, 2**62), min_size=1))
def test_roots_are_exact(values):
    x = np.array(values, np.int64)
    assert vector_codes.floor_root(x).tolist() == [math.isqrt(v) for v in values]
    assert vector_codes.ceil_root(x).tolist() == [math.isqrt(v) + (math.isqrt(v) ** 2 < v) for v in values]
