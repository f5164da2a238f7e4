"""Operators that compare documents: 1, 3, 9, 10, and connected components."""

import gc
import itertools
import random
import weakref

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import components, decontaminate, jaccard_join, line_dedup, queries, topk

from . import brute


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=3):
    r = random.Random(seed)
    out = []
    for n in [1, 3, 4, 5, 6, 9, 12, 20, 35, 60, 120, 300, 900]:
        base = words(r, n)
        out.append(" ".join(base))
        for changes in (0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(changes):
                p = r.randrange(len(w))
                w[p : p + r.randrange(2)] = [f"new{r.randrange(99)}"]
            out.append(" ".join(w).upper() if changes == 0 else " ".join(w))
        tail = base + words(r, max(1, n // 7))
        out.append(" ".join(tail))
    r.shuffle(out)
    return out


def test_jaccard_matches_all_pairs(make_docs):
    docs = [(i * 7 % 1009, t) for i, t in enumerate(near_copies(), 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make_docs(docs)).collect()}
    assert got == brute.jaccard_components(docs)


def test_part_signatures_are_complete():
    """Sets at the similarity share a signature, whatever their sizes and differences."""
    r = np.random.default_rng(5)
    bands = jaccard_join.Bands()
    for _ in range(1500):
        n = int(r.integers(1, 220))
        both = r.integers(0, 2**64, n, np.uint64)
        # The most members either side may have besides.
        spare = int(r.integers(0, n * 5 // 4 - n + 1))
        left = int(r.integers(0, spare + 1))
        own = r.integers(0, 2**64, spare, np.uint64)
        x, y = np.unique(np.concatenate([both, own[:left]])), np.unique(np.concatenate([both, own[left:]]))
        if np.array_equal(x, y):
            continue
        assert set(bands.signatures(x).tolist()) & set(bands.signatures(y).tolist()), (len(x), len(y), n)


def test_jaccard_of_repeated_rows(make_docs):
    """A thousand rows of each of two near texts are two nodes and one link."""
    base = [f"v{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    docs = [(i, " ".join(base)) for i in range(1000)] + [(1000 + i % 7, near) for i in range(1000)] + [(5000, "quite another text of some words")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(make_docs(docs).repartition(5)).collect()}
    assert got == {(i, 0) for i in range(1007)} | {(5000, 5000)}


def test_jaccard_of_hot_signatures(make_docs, monkeypatch):
    """A large group of near copies is dealt over several stars and stays one component, chains included."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    r = random.Random(8)
    docs = []
    for size in (20, 90):
        base = words(r, size, 5000)
        for i in range(300):
            w = list(base)
            w[r.randrange(size)] = f"new{i}"
            docs.append(" ".join(w))
    docs = list(enumerate(docs + near_copies(9), 1))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(make_docs(docs)).collect()}
    assert got == brute.jaccard_components(docs)


def test_unrelated_small_sets_share_no_signature():
    r = np.random.default_rng(6)
    bands = jaccard_join.Bands()
    for n in (8, 15, 25, 40):
        seen = {}
        for _ in range(2000):
            for x in bands.signatures(np.unique(r.integers(0, 2**64, n, np.uint64))).tolist():
                seen[x] = seen.get(x, 0) + 1
        assert max(seen.values()) <= 4, n


def test_rare_members_are_complete():
    """Similar sets share one of their rarest members, whatever is known of how common they are."""
    r = np.random.default_rng(6)
    known = np.unique(r.integers(0, 2**64, 4000, np.uint64))
    for often in (r.integers(2, 9, len(known)), np.full(len(known), 2)):
        for _ in range(500):
            n = int(r.integers(1, 200))
            spare = int(r.integers(0, n // 4 + 1))
            left = int(r.integers(0, spare + 1))
            both, own = np.concatenate([r.choice(known, n // 2, False), r.integers(0, 2**64, n - n // 2, np.uint64)]), r.integers(0, 2**64, spare, np.uint64)
            x, y = np.unique(np.concatenate([both, own[:left]])), np.unique(np.concatenate([both, own[left:]]))
            first = jaccard_join.rarest(x, known, often, 4, 5)
            assert len(first) == len(x) // 5 + 1
            assert set(first.tolist()) & set(jaccard_join.rarest(y, known, often, 4, 5).tolist())
    assert len(jaccard_join.rarest(x, known[:0], often[:0], 4, 5)) == len(x) // 5 + 1


def test_jaccard_of_a_common_template(make_docs, monkeypatch):
    """Texts that share a template and link with nothing make no pairs; near copies among them still link."""
    monkeypatch.setattr(jaccard_join, "SAMPLE", 4)
    r = random.Random(12)
    template = words(r, 70, 10**6)
    docs = [(i, " ".join(template + words(r, 30, 10**6))) for i in range(600)]
    for i in range(0, 600, 60):
        w = docs[i][1].split()
        w[80] = "another"
        docs.append((1000 + i, " ".join(w)))
    made = []
    plain = jaccard_join.open_pairs
    monkeypatch.setattr(jaccard_join, "open_pairs", lambda left, *a: made.append((left.count(), (out := plain(left, *a)).count())) or out)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(make_docs(docs)).collect()}
    assert got == brute.jaccard_components(docs)
    [(nodes, pairs)] = made
    assert nodes > 500 and pairs <= 10


def test_open_pairs_deal_each_table_once(spark, make_docs, monkeypatch):
    """Both sides of the join by rare members are one exchange, and repeated rows and whole components cost no further one."""
    r = random.Random(5)
    passages = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(40)]
    texts = [" ".join(r.sample(passages, 6)) for _ in range(60)]
    docs = make_docs(list(enumerate(texts + [t + " more" for t in texts])))
    rows = docs.select("doc_id", "text")
    sizes = rows.mapInArrow(jaccard_join.measure(5), "doc_id long, n_shingles long, node long, sketch array<long>")
    classes = sizes.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").cast("int").alias("n"), F.first("sketch").alias("sketch"))
    plans, plain = {}, jaccard_join.cut

    def watched(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return plain(df, name)

    monkeypatch.setattr(jaccard_join, "cut", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        jaccard_join.open_pairs(classes.select("node", F.col("node").alias("c")), rows, classes, 5, 4, 5).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["rare"].count("Exchange hashpartitioning") == 1
    assert "ReusedExchange" in plans["open-pairs"]


def test_jaccard_edge_cases(hard, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(hard).collect()))
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (7, 1, 7), (8, 1, 8), (9, 1, 9)]
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(5, 5), (None, 3), (3, None)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.node: x.component for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    for x in set(itertools.chain(*real)):
        top[x] = x
    for _ in top:
        before = dict(top)
        for a, b in real:
            top[a] = top[b] = min(top[a], top[b])
        if top == before:
            break
    assert got == top
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_hit_every_allowed_window():
    n, wrong = decontaminate.WINDOW, decontaminate.WRONG
    for holes in itertools.combinations(range(n), wrong):
        assert any(not {s + o for o in m} & set(holes) for m in decontaminate.MASKS for s in range(n - m[-1])), holes
    for n in range(8, n):
        for hole in range(n):
            assert any(hole not in {s + o for o in m} for m in decontaminate.MASKS for s in range(n - m[-1])), (n, hole)


def test_decontamination_matches_every_alignment(spark, make_docs):
    r = random.Random(9)
    items = [(i, " ".join(words(r, n, 5000))) for i, n in enumerate([2, 4, 5, 6, 7, 8, 10, 12, 13, 14, 20, 40])]
    docs = []
    for _, text in items:
        for changes in (0, 1, 2, 3, 6):
            w = text.split()
            for p in r.sample(range(len(w)), min(changes, len(w))):
                w[p] = "other"
            cut = r.randrange(len(w) // 3 + 1)
            docs.append(" ".join(words(r, 30, 5000)) + " " + ", ".join(w[cut:]).title() + "! " + " ".join(words(r, 20, 5000)))
    docs += [" ".join(words(r, 200, 5000)) for _ in range(20)]
    for block, size in ((1000, 1 << 20), (5, 1 << 20), (1000, 300)):
        got = decontaminate.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), block_items=block, block_bytes=size)
        found = {(x.doc_id, x.item_id) for x in got.collect()}
        assert found == {(i + 1, k) for i, d in enumerate(docs) for k, q in items if brute.overlaps(d, q)}
    assert len(found) > 15


def test_decontamination_of_repetitive_texts(spark, make_docs):
    """Item and text of one word, or of a few in turn, many thousand times, end in seconds with all words found."""
    long = "again " * 20_000
    turns = "now and then " * 7_000
    items = [(1, long), (2, turns), (3, "again " * 9 + "once " + "again " * 30)]
    docs = [long, "x " * 50 + turns, "again " * 25_000, "again " * 60]
    got = {(x.doc_id, x.item_id): (x.overlap_words, x.equal_words) for x in decontaminate.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (20_000,) * 2, (1, 3): (40, 39), (2, 2): (21_000,) * 2, (3, 1): (20_000,) * 2, (3, 3): (40, 39), (4, 1): (60, 60), (4, 3): (40, 39)}


def test_differences():
    r = np.random.default_rng(7)
    for n in (3, 2000):
        p, q = np.unique(r.integers(50, 9000, n)), np.unique(r.integers(0, 4000, n))
        assert np.array_equal(decontaminate.differences(p, q), np.unique(p[:, None] - q[None, :]))


def test_decontamination_edge_cases(spark, hard, empty):
    items = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (None, "one two three four five", "e"), (4, "long " * 20, "e"), (5, "nobody knows this", "e")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(hard, items).collect()}
    assert got == {(7, 4)}
    assert decontaminate.contaminated(hard, items.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0


def repeated_lines(seed):
    r = random.Random(seed)
    passage = [" ".join(words(r, r.randrange(1, 30))) for _ in range(9)]
    docs = []
    for _ in range(30):
        lines = [" ".join(words(r, r.randrange(0, 25))) for _ in range(r.randrange(1, 8))]
        for _ in range(r.randrange(3)):
            a = r.randrange(len(passage))
            at = r.randrange(len(lines) + 1)
            lines[at:at] = passage[a : r.randrange(a, len(passage)) + 1]
        if r.random() < 0.3:
            lines.insert(r.randrange(len(lines)), r.choice(["", "   "]))
        docs.append("\n".join(lines))
    return docs


def test_line_dedup_matches_every_run(make_docs):
    docs = list(enumerate([t for s in range(3) for t in repeated_lines(s)], 1))
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(make_docs(docs)).collect()}
    assert got == brute.line_dedup(docs)
    assert sum(got[i] != t for i, t in docs) > 5


def test_line_dedup_edge_cases(hard, empty, make_docs):
    out = line_dedup.deduplicate(hard, count="lost")
    assert out.columns == [*hard.columns, "lost"]
    assert sorted(map(str, out.drop("lost").collect())) == sorted(map(str, hard.collect()))
    assert line_dedup.deduplicate(hard).columns == [*hard.columns, "n_removed_"]
    assert line_dedup.deduplicate(empty).count() == 0
    # Within one text the first of two runs stays; identical rows lose the same lines.
    line = " ".join(f"v{i}" for i in range(60))
    got = [r.text for r in line_dedup.deduplicate(make_docs([(1, f"{line}\nx\n{line}"), (1, f"{line}\nx\n{line}")])).collect()]
    assert got == [f"{line}\nx"] * 2


def test_line_dedup_is_native(make_docs):
    plan = line_dedup.deduplicate(make_docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")


def test_topk_matches_all_scores(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(r.integers(-3, 4, 8) / 4)], "s", "r") for i in range(1, 400)]
    got = sorted(tuple(x) for x in topk.exact_topk(vectors(spark, rows).repartition(7), "vec_id % 100 = 0", 10, block_rows=2, tile_rows=64).collect())
    e = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v, *_ in rows}
    want = []
    for q in (100, 200, 300):
        best = sorted(((-int(e[q] @ e[i]), i) for i in e if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_topk_of_repeated_rows_equals_the_sql(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(r.integers(-3, 4, 4) / 4)], "", "") for i in r.integers(1, 40, 300) * 10]
    df = vectors(spark, rows + rows[:50])
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((q, k, i, s) for q, k, i, s in con.execute("SELECT query_id, rank, vec_id, score FROM (" + queries.OP10_SQL + ")").fetchall())
    assert sorted(tuple(x) for x in topk.exact_topk(df, "vec_id % 100 = 0", 10, block_rows=3).collect()) == want


def test_topk_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 2.0], "", ""), (1, [1.0, 0.5], "", ""), (1, [1.0, 0.5], "", ""), (2, None, "", ""), (3, [nan, 1.0], "", ""), (4, [inf, 1.0], "", ""), (5, [None, 1.0], "", ""), (None, [1.0, 1.0], "", ""), (6, [1.0], "", ""), (200, None, "", "")]
    got = [tuple(r) for r in topk.exact_topk(vectors(spark, rows), "vec_id % 100 = 0").collect()]
    assert got == [(100, 1, 1, 2 * 1024**2), (100, 2, 1, 2 * 1024**2)]
    assert topk.exact_topk(vectors(spark, []), "vec_id % 100 = 0").count() == 0


def test_one_block_of_items_is_held_at_a_time(spark, make_docs, monkeypatch):
    """Ten blocks: each one's items are gone from the driver, and its broadcast destroyed, before the next is made."""
    live, most, plain = weakref.WeakSet(), [], decontaminate.Items.__init__

    def watched(self, *a):
        gc.collect()
        most.append(len(live))
        live.add(self)
        plain(self, *a)

    monkeypatch.setattr(decontaminate.Items, "__init__", watched)
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for i in range(10)]
    docs = [f"before {items[i % 10][1]} after" if i % 3 == 0 else "nothing of the kind is in this text at all" for i in range(30)]
    got = decontaminate.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), block_items=1).collect()
    assert {(r.doc_id - 1, r.item_id) for r in got} == {(i, i % 10) for i in range(0, 30, 3)}
    assert len(most) > 5 and max(most) <= 1
