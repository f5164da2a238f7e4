"""N-gram Jaccard join with PartEnum signatures.

Texts become sets of hashed word shingles.  Sets are put in size bands whose
ends differ by the similarity; within a band (and from a band to the next) a
Jaccard bound is a Hamming bound k.  The hash domain is cut into parts, and
subsets of parts are enumerated so that two sets within k share a signature:
for k <= 6 every subset that leaves out k of the parts is a signature, and for
larger k every single part of k + 1 and some spare ones, so that the number of
signatures stays a fraction of the set; sets that leave more parts empty than
are spare sign subsets too.

Copies of one set are a class with one node.  Nodes that share a signature
are linked to the first node of that signature (a star); signatures of very
many nodes are dealt over several stars, whose first nodes are linked in turn.
Sizes and sketches tell which links are possible.  Of a node's possible links
the likeliest is verified exactly first; what that leaves in different
components is verified next.  Nodes of signatures that still span components
sign again, each with its rarest members, at least one of which two similar
sets share: texts with a common template meet in signatures, but not in these.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .shared import cut, free, small_enough
from .words import docs_words, mix

SHINGLE = 5
#: Similarity as a fraction, so that every comparison is exact.
NUM, DEN = 4, 5
#: Rows of ids that may be broadcast (8 bytes each); beyond, a shuffle join is used.
BROADCAST_ROWS = 1_000_000
#: Parts for up to 6 differences: all but k of them agree, and those hold members of nearly every set.
SUBSETS = {1: 8, 2: 9, 3: 9, 4: 9, 5: 9, 6: 10}
#: Signatures that at least this many of one in SAMPLE ids have are dealt over as many stars as there are partitions.
HOT, SAMPLE = 16, 64
#: Of a node's open rare members, how many of the smallest go with each to tell that a pair has met before (no pair is lost, few are made twice).
EARLIER = 32
#: Members whose commonness in the sample is told to every task (16 bytes each); it sets an order and drops nothing.
COMMON = 1 << 18
MULTIPLIERS = mix(np.arange(101, 133, dtype=np.uint64))


def shingle_sets(column: pa.Array, width: int):
    """The sorted distinct shingle hashes (uint64) of each text of an Arrow column."""
    for _, words, at in docs_words(column):
        at = at.tolist()
        sums = None
        if len(words) >= width:
            sums = np.zeros(len(words) - width + 1, np.uint64)
            for j in range(width):
                sums += words[j : len(words) - width + 1 + j] * MULTIPLIERS[j]
            sums = mix(sums)
        for a, e in zip(at, at[1:]):
            if e - a >= width:
                yield np.unique(sums[a : e - width + 1])
            elif e > a:
                yield mix(np.array([(words[a:e] * MULTIPLIERS[: e - a]).sum(dtype=np.uint64) + np.uint64(e - a)]))
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit id of a set; 0 for the empty set."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0]) if len(s) else 0


class Bands:
    """Size bands [low, high] with high = floor(low * DEN / NUM), and their part layouts."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.low, self.high = [1], [den // num if den // num >= 1 else 1]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * self.den // self.num))
        return int(np.searchsorted(self.high, size))

    def differences(self, band: int) -> int:
        """The largest symmetric difference of two similar sets of at most ``high`` members."""
        self.of(self.high[-1] + 1) if band >= len(self.high) else None
        return 2 * self.high[band] * (self.den - self.num) // (self.den + self.num)

    @staticmethod
    def spare(k: int, low: int) -> int:
        """Spare parts where single parts are signatures: as many as parts of a set of ``low`` members stay empty, but for a rare excess."""
        for spare in range(1, k // 2 + 2):
            parts = k + 1 + spare
            empty = parts * (1 - 1 / parts) ** low
            if empty + 3.5 * empty**0.5 <= spare:
                return spare
        return max(1, k // 6)

    @staticmethod
    def parts_of(s: np.ndarray, content: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(sum of member hashes, number of members) of each part of the hash domain."""
        edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        return content[at[1:]] - content[at[:-1]], np.diff(at)

    def subsets(self, s: np.ndarray, content: np.ndarray, parts: int, k: int) -> np.ndarray:
        """A value for every subset of parts that leaves out k of them."""
        sums, _ = self.parts_of(s, content, parts)
        took = np.array(list(combinations(range(parts), parts - k)))
        return mix(sums + mix(np.arange(201, 201 + parts, dtype=np.uint64)))[took].sum(1, dtype=np.uint64)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures (int64) of a set for its own band and the next."""
        out = []
        own = self.of(len(s))
        if not len(s):
            return np.zeros(0, np.int64)
        content = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
        for band in (own, own + 1):
            self.of(self.low[band] if band < len(self.low) else self.high[-1] + 1)
            if band > own and len(s) * self.den < self.low[band] * self.num:
                continue  # too small for anything in the next band
            k = self.differences(band)
            if k == 0:
                continue  # only equal sets, which are one node
            if k in SUBSETS:
                sums = self.subsets(s, content, SUBSETS[k], k)
            else:
                # At least spare + 1 parts agree.  With at most ``spare`` empty parts one of those has members;
                # otherwise both sets have more empty parts than that, and both sign subsets of parts as well.
                spare = self.spare(k, -(-self.low[band] * self.num // self.den))
                sums, sizes = self.parts_of(s, content, k + 1 + spare)
                label = np.arange(len(sums), dtype=np.uint64) + np.uint64(band << 32)
                out.append(mix(sums + mix(label + np.uint64(1)))[sizes > 0])
                if (sizes == 0).sum() <= spare:
                    continue
                sums = self.subsets(s, content, k + (3 if k <= 16 else 2), k) + np.uint64(1)
            label = np.arange(len(sums), dtype=np.uint64) + np.uint64(band << 32)
            out.append(mix(sums + mix(label + np.uint64(1))))
        return np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The parity of members by hash, in the next power of two of n bits (256 at least), as int64.

    Two sets differ in at least as many members as their sketches differ in bits.
    """
    size = max(256, 1 << (len(s) - 1).bit_length()) if len(s) else 256
    bits = np.bincount((mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def measure(width: int):
    """(doc_id, text) to (doc_id, n_shingles, node, sketch)."""

    def run(batches):
        for b in batches:
            n, f, sketches = [], [], []
            for s in shingle_sets(b.column(1), width):
                n.append(len(s))
                f.append(fingerprint(s))
                sketches.append(sketch_of(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "sketch"])

    return run


def sign(width: int, num: int, den: int):
    def run(batches):
        bands, seen = Bands(num, den), set()
        for b in batches:
            sigs, nodes, held = [], [], 0
            for s in shingle_sets(b.column(1), width):
                node = fingerprint(s)
                if not len(s) or node in seen:
                    continue  # a copy in this task adds nothing
                seen.add(node)
                sigs.append(bands.signatures(s))
                nodes.append(np.full(len(sigs[-1]), node, np.int64))
                held += len(sigs[-1])
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])
                    sigs, nodes, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], ["sig", "node"])

    return run


def unpack(width: int):
    """(doc_id, text, node) to (node, members), for texts whose set is that node."""

    def run(batches):
        for b in batches:
            nodes, sets = [], []
            for s, node in zip(shingle_sets(b.column(1), width), b.column(2).to_pylist()):
                if fingerprint(s) == node:
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])

    return run


def count_members(width: int):
    """(doc_id, text) to (member), for every set in a task once."""

    def run(batches):
        seen = set()
        for b in batches:
            members = [np.zeros(0, np.uint64)]
            for s in shingle_sets(b.column(1), width):
                if (node := fingerprint(s)) not in seen:
                    seen.add(node)
                    members.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(members).view(np.int64))], ["member"])

    return run


def rarest(s: np.ndarray, known: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest members of a set by (``often`` of ``known``, else 0; hash): as many as may be without a partner in a similar set, and one more."""
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        counts = np.where(known[at] == s, often[at], 0)
    else:
        counts = np.zeros(len(s), np.int64)
    return s[np.lexsort((s, counts))][: len(s) - -(-len(s) * num // den) + 1]


def sign_again(width: int, num: int, den: int, common):
    """(doc_id, text, node, c) to (rare, node, c), for texts whose set is that node."""

    def run(batches):
        known, often = common.value
        for b in batches:
            rare, own = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
            for s, *ids in zip(shingle_sets(b.column(1), width), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if fingerprint(s) == ids[0]:
                    rare.append(rarest(s, known, often, num, den))
                    own.append(np.tile(np.array(ids, np.int64), (len(rare[-1]), 1)))
            own = np.concatenate(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare).view(np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1])], ["rare", "node", "c"])

    return run


def close(x: str, y: str, num: int, den: int):
    """Whether sizes and sketches of two aliased rows allow the similarity (never false for similar sets)."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    a, b = F.col(f"{x}.sketch"), F.col(f"{y}.sketch")

    def halved(v, other):
        """A sketch of twice the other's size, folded."""
        n = F.size(other)
        return F.when(F.size(v) > n, F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(v)

    apart = F.aggregate(F.zip_with(halved(a, b), halved(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + F.coalesce(c, F.lit(0)))
    return (small * den >= large * num) & (apart * (num + den) <= (small + large) * (den - num))


def possible(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (hub, node, ...) whose sizes and sketches allow the similarity."""
    x = facts.select(F.col("node").alias("node"), F.struct("n", "sketch").alias("x"))
    y = facts.select(F.col("node").alias("hub"), F.struct("n", "sketch").alias("y"))
    return pairs.join(x, "node").join(y, "hub").filter(close("x", "y", num, den)).select(*pairs.columns)


def members_of(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, members), cut: the sets of all ends of ``pairs`` (hub, node), once each."""
    ends = pairs.select("hub").unionByName(pairs.select(F.col("node").alias("hub"))).distinct()
    wanted = cut(ends.join(classes, ends["hub"] == classes["node"]).select(F.col("first").alias("doc_id"), "node"), "candidates")
    some = rows.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted, "doc_id").select("doc_id", "text", "node")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A repeated row gives its set again; partial results are one a task and node.
    sets = some.mapInArrow(unpack(width), "node long, members array<long>").repartition(n, "node").dropDuplicates(["node"])
    out = cut(sets, "sets")
    free(wanted)
    return out


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (hub, node) pairs as (a, b) whose sets are similar enough, by exact set sizes."""
    # Both sides are named anew, so that one exchange of the sets serves both joins.
    x = sets.select(F.col("node").alias("b"), F.col("members").alias("mine"))
    y = sets.select(F.col("node").alias("a"), F.col("members").alias("other"))
    own = pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(x, "b")
    both = F.size(F.array_intersect("mine", "other"))
    return own.join(y, "a").withColumn("both", both).filter(F.col("both") * den >= (F.size("mine") + F.size("other") - F.col("both")) * num).select("a", "b")


def stars_of(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(sig, node, hub, hot): the nodes of every signature that has several, each with a first node (hub) of that signature.

    A hot signature is dealt by node over one star a partition; its rows have
    hot = true, and further rows link the hubs to the first of all.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = lambda df: df.mapInArrow(sign(width, num, den), "sig long, node long")
    # Only how signatures are dealt depends on this sample; their number is at most signatures / HOT.
    some = signed(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)).distinct().groupBy("sig").count().filter(F.col("count") >= HOT)
    hot = cut(some.select("sig", F.lit(True).alias("hot")), "hot")
    marked = signed(rows).join(F.broadcast(hot) if small_enough(hot, BROADCAST_ROWS) else hot, "sig", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(n))).otherwise(F.lit(0)).cast("int")
    w = Window.partitionBy("sig", "salt").orderBy("node")
    dealt = (
        marked.select("sig", "node", F.coalesce("hot", F.lit(False)).alias("hot"), salt.alias("salt"))
        .withColumn("hub", F.min("node").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last", F.lead("node").over(w))
        .filter("hub <> node or last <> node or hot")
        .select("sig", "node", "hub", "hot")
        .distinct()
    )
    stars = cut(dealt, "stars")
    hubs = stars.filter("hot and hub = node").select("sig", "node")
    first = hubs.groupBy("sig").agg(F.min("node").alias("hub"))
    more = hubs.join(first, "sig").filter("hub <> node").select("sig", "node", "hub", F.lit(True).alias("hot"))
    out = cut(stars.unionByName(more), "stars")
    free(stars, hot)
    return out


def common_members(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted members, counts) of the COMMON commonest members in one of SAMPLE ids."""
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(count_members(width), "member long")
    top = some.groupBy("member").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "member").limit(COMMON).toArrow()
    known = top.column("member").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], top.column("n").to_numpy()[order]


def open_pairs(left: DataFrame, rows: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(hub, node), cut: the possible pairs across components among the nodes of ``left`` (node, c).

    Similar sets of n members share at least one of the n - ceil(n num / den) + 1
    that come first in any common order; the order is from rare to common.
    """
    wanted = cut(left.join(classes, "node").select(F.col("first").alias("doc_id"), "node", "c"), "open-nodes")
    common = rows.sparkSession.sparkContext.broadcast(common_members(rows, width))
    some = rows.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted, "doc_id").select("doc_id", "text", "node", "c")
    # One exchange by member serves what tells repeated rows, whole components and pairs apart.
    signed = some.mapInArrow(sign_again(width, num, den, common), "rare long, node long, c long").repartition("rare").dropDuplicates(["rare", "node", "c"])
    w = Window.partitionBy("rare")
    mixed = cut(signed.select("*", F.min("c").over(w).alias("lo"), F.max("c").over(w).alias("hi")).filter("lo <> hi").select("rare", "node", "c"), "rare")
    low = mixed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("rare")), 1, EARLIER).alias("low"))
    met = cut(mixed.join(classes.select("node", "n", "sketch"), "node").join(low, "node"), "open")
    # No column is null; where both sides say so alike, one exchange serves both.
    dealt = met.filter(" and ".join(f"{c} is not null" for c in met.columns)).repartition("rare")
    x, y = dealt.alias("x"), dealt.alias("y")
    meet = (F.col("x.rare") == F.col("y.rare")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
    # A pair with a smaller rare member in common is made there (the smallest one always makes it).
    earlier = F.arrays_overlap(F.filter("x.low", lambda v: v < F.col("x.rare")), F.col("y.low"))
    again = cut(x.join(y, meet & close("x", "y", num, den) & ~earlier).select(F.col("x.node").alias("hub"), F.col("y.node").alias("node")).distinct(), "open-pairs")
    free(wanted, mixed, met)
    common.destroy()
    return again


def jaccard_components(docs: DataFrame, width: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when |A & B| / |A | B| >= num / den for their sets of
    ``width``-word shingles (A-Z lowered, words are runs without ASCII white
    space; a text with fewer words is one shingle).  component_id is the
    smallest doc_id reachable by links, itself included.

    Null or empty texts have an empty set and link with nothing.  Repeated
    rows link with each other.  A null doc_id is dropped, as no result could
    name it.  Other columns are ignored; an empty table gives an empty result.
    Distinct sets are told apart by 64-bit hashes.
    """
    rows = docs.select("doc_id", "text").filter("doc_id is not null")
    sizes = cut(rows.mapInArrow(measure(width), "doc_id long, n_shingles long, node long, sketch array<long>"), "shingle-sizes")
    groups = sizes.filter("n_shingles > 0").groupBy("node")
    classes = cut(groups.agg(F.min("doc_id").alias("first"), F.first("n_shingles").cast("int").alias("n"), F.first("sketch").alias("sketch")), "classes")
    facts = classes.select("node", "n", "sketch")

    stars = stars_of(rows, width, num, den)
    links = stars.filter("hub <> node").groupBy("hub", "node").agg(F.count("*").alias("shared"))
    pairs = cut(possible(links, facts, num, den), "pairs")
    sets = members_of(pairs, rows, classes, width)

    # First each node with the hub it shares most signatures with, then what is left across components.
    likely = pairs.groupBy("node").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    good = cut(verified(likely, sets, num, den), "good-links")
    groups = connected(good)
    names = groups.select("node", "component")

    def across(pairs: DataFrame) -> DataFrame:
        named = pairs.join(names, "node", "left").withColumnRenamed("component", "c").join(names.select(F.col("node").alias("hub"), "component"), "hub", "left")
        return named.filter(F.coalesce("c", "node") != F.coalesce("component", "hub")).select("hub", "node")

    rest = across(pairs.join(likely.select("hub", "node"), ["hub", "node"], "left_anti"))
    more = cut(verified(rest, sets, num, den), "more-links")
    free(pairs, sets, groups)
    links = cut(good.unionByName(more), "links")
    free(good, more)
    groups = connected(links)

    # Signatures whose members are still in several components: their nodes sign again; the only hub of one has met all.
    left = stars.filter("hub <> node or hot").select("sig", "node").join(groups, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    mixed = left.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("sig")
    left = cut(left.join(mixed, "sig", "left_semi").select("node", "c").distinct(), "left")
    again = open_pairs(left, rows, classes, width, num, den)
    free(stars, left)
    if not again.isEmpty():
        sets = members_of(again, rows, classes, width)
        last = cut(verified(again, sets, num, den), "last-links")
        free(sets, groups)
        groups = connected(links.unionByName(last))
        free(last)
    free(again, links)

    tops = groups.join(classes, "node").select("node", "component", "first")
    named = tops.join(tops.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component_id")
    # Written first, so that the last join is between plain exchanges and Spark can split a node that very many rows share.
    named = cut(classes.select("node", "first").join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "names")
    free(classes, groups)
    return sizes.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
