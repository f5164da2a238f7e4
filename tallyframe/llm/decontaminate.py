"""Benchmark decontamination with spaced seeds.

Fixed masks look at some of the positions of a short span of words and ignore
the others, so a substituted word under a hole does not hide a match.  The
hashes of every test item are joined with those of the training texts inside
the tasks, a block of items at a time; around each hit the aligned words are
compared, tolerating substitutions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .words import PUNCT, docs_words, mix

#: Looked-at offsets.  Together they hit every WINDOW-word stretch with at most
#: WRONG substituted words (shown exhaustively in the tests).
MASKS = ((0, 1, 3, 5, 6), (0, 2, 4, 5, 6), (0, 1, 3, 4, 7))
#: An overlap is a stretch of this many aligned words, all but WRONG of them equal.
WINDOW, WRONG = 13, 2
#: Test items, and bytes of their texts, handled together: their words are held by every task.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Seed hits expanded together; a seed more often than DENSE in one item is handled by itself.
CHUNK, DENSE = 1 << 20, 32
#: Items of fewer words prove nothing and are left out.
FEWEST = 5
OUT = "doc_id long, item_id long, overlap_words int, equal_words int"


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the masked words from each position at which the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(sum((o + 1) * 0xD1B54A32D192ED03 ** (j + 1) for j, o in enumerate(mask)) & 2**64 - 1))
    for j, o in enumerate(mask):
        out += words[o : o + n] * np.uint64(2 * 0x9E3779B97F4A7C15 * (j + 1) + 0xD6E8FEB86659FD93 & 2**64 - 1)
    return mix(out)


def limits(n: int, window: int, wrong: int) -> tuple[int, int]:
    """The stretch and the substitutions allowed for an item of n words; short items must occur whole."""
    return (window, wrong) if n >= window else (n, 1 if n >= 8 else 0)


class Items:
    """A block of test items: their words and the seed hashes of each mask, sorted."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], masks, window: int, wrong: int):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.sizes = np.array([len(w) for _, w in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate([*(w for _, w in rows), np.zeros(0, np.uint64)])
        self.masks, self.window, self.wrong = masks, window, wrong
        #: For each mask: sorted hashes, their places, and how often at most each lies in one item.
        self.seeds = []
        for mask in masks:
            h = [seed_hashes(w, mask) for _, w in rows]
            hashes = np.concatenate([*h, np.zeros(0, np.uint64)])
            at = np.concatenate([*(s + np.arange(len(x)) for s, x in zip(self.starts, h)), np.zeros(0, np.int64)]).astype(np.int64)
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            item = np.searchsorted(self.starts, at, "right") - 1
            fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])])[: len(hashes)]
            begin = np.flatnonzero(fresh)
            most = np.zeros(len(hashes), np.int64)
            np.maximum.at(most, np.searchsorted(hashes, hashes[begin]), np.diff(np.append(begin, len(hashes))))
            self.seeds.append((hashes, at, most))
        #: Items too short for substitutions, by their whole word sequence.
        self.tiny: dict[tuple, list[int]] = {}
        for k, (_, w) in enumerate(rows):
            if FEWEST <= len(w) < 8:
                self.tiny.setdefault(tuple(w.tolist()), []).append(k)

    def shared(self, words: np.ndarray):
        """For each mask: text positions whose seed some item has, and where its places begin, how many and how dense they are."""
        for mask, (hashes, at, most) in zip(self.masks, self.seeds):
            own = seed_hashes(words, mask)
            if not len(own) or not len(hashes):
                continue
            low = np.searchsorted(hashes, own, "left")
            same = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own)
            first = low[same]
            yield at, same, first, np.searchsorted(hashes, own[same], "right") - first, most[first]

    def overlaps(self, words: np.ndarray, bounds: np.ndarray):
        """(row, item, overlap words, equal words) of the texts whose words start at ``bounds``."""
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def compare(row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> None:
            """Compare alignments, the longest first: shorter ones than the best so far cannot beat it."""
            span = np.minimum(shift + self.sizes[item], bounds[row + 1]) - np.maximum(shift, bounds[row])
            order = np.lexsort((shift, -span))
            for r, k, s, n in zip(row[order].tolist(), item[order].tolist(), shift[order].tolist(), span[order].tolist()):
                if (n, n) > (old := best.get((r, k), (0, 0))):
                    got = self.compare(words, bounds[r], bounds[r + 1], k, s)
                    if got and got > old:
                        best[r, k] = got

        for at, same, first, n, dense in self.shared(words):
            row = np.searchsorted(bounds, same, "right") - 1
            few = np.flatnonzero(dense <= DENSE)
            cuts = np.searchsorted(np.cumsum(n[few]), np.arange(CHUNK, int(n[few].sum()) + CHUNK, CHUNK), "right") if len(few) else []
            for some in np.split(few, np.unique(cuts)) if len(few) else []:
                if not len(some):
                    continue
                c = n[some]
                place = at[np.repeat(first[some] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
                item = np.searchsorted(self.starts, place, "right") - 1
                # One alignment of a text and an item is compared once, however many seeds hit on it.
                lines = np.unique(np.stack([np.repeat(row[some], c), item, np.repeat(same[some], c) - (place - self.starts[item])], 1), axis=0)
                compare(*lines.T)
            many = np.flatnonzero(dense > DENSE)
            many = many[np.lexsort((first[many], row[many]))]
            change = np.flatnonzero((np.diff(row[many]) != 0) | (np.diff(first[many]) != 0)) + 1
            for group in np.split(many, change) if len(many) else []:
                r, places = int(row[group[0]]), at[first[group[0]] : first[group[0]] + n[group[0]]]
                items = np.searchsorted(self.starts, places, "right") - 1
                for k in np.unique(items).tolist():
                    shifts = differences(same[group], places[items == k] - self.starts[k])
                    compare(np.full(len(shifts), r), np.full(len(shifts), k), shifts)
        if self.tiny:
            for n in {len(t) for t in self.tiny}:
                wanted = {t[0] for t in self.tiny if len(t) == n}
                for p in np.flatnonzero(np.isin(words, np.array(list(wanted), np.uint64))).tolist():
                    r = int(np.searchsorted(bounds, p, "right")) - 1
                    if p + n <= bounds[r + 1]:
                        for k in self.tiny.get(tuple(words[p : p + n].tolist()), []):
                            best[r, k] = max(best.get((r, k), (0, 0)), (n, n))
        return [(r, k, *v) for (r, k), v in best.items()]

    def compare(self, words, low, high, k, shift):
        """The longest union of matching stretches on one alignment: (words, equal words), or None."""
        size = int(self.sizes[k])
        window, wrong = limits(size, self.window, self.wrong)
        a, e = max(shift, int(low)), min(shift + size, int(high))
        if e - a < window or size < 8:
            return None
        s = int(self.starts[k])
        same = words[a:e] == self.words[s + a - shift : s + e - shift]
        total = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(total[window:] - total[:-window] >= window - wrong)
        if not len(good):
            return None
        covered = np.zeros(e - a + 1, np.int64)
        np.add.at(covered, good, 1)
        np.add.at(covered, good + window, -1)
        covered = np.cumsum(covered)[:-1] > 0
        return int(covered.sum()), int((covered & same).sum())


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distinct values of p - q, by convolution where there are many pairs."""
    if len(p) * len(q) <= CHUNK:
        return np.unique(p[:, None] - q[None, :])
    low, top = int(p[0]), int(q.max())
    n = int(p.max()) - low + top + 1
    size = 1 << n.bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[p - low], y[top - q] = 1, 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[:n] > 0.5) + low - top


def find(items: Items):
    def run(batches):
        held = items.value
        for b in batches:
            ids = b.column(0)
            rows: list[tuple] = []
            for first, words, at in docs_words(b.column(1), PUNCT):
                rows += [(ids[first + r].as_py(), int(held.ids[k]), n, m) for r, k, n, m in held.overlaps(words, at)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "overlap_words", "equal_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, wrong: int = WRONG, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, overlap_words, equal_words): every text that overlaps a test item.

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, A-Z lowered.  A text (doc_id, text) overlaps an item (item_id,
    text) when, on one alignment without insertions, some stretch of
    ``window`` words differs in at most ``wrong`` of them; an item of fewer
    words must occur whole, with one substitution from 8 words on and none
    below, and items of fewer than 5 words are left out.  overlap_words counts the words of all such
    stretches on the best alignment, equal_words the equal ones of them.

    Rows with a null id or text, and empty texts, overlap nothing.  Of rows
    repeated with one doc_id or item_id the best overlap counts once.  Other
    columns are ignored; empty tables give an empty result.  Items are taken
    in blocks of about ``block_items`` and ``block_bytes`` of text, one after
    the other, each with one pass over the texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    tests = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    n, size = tests.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    out = None
    for b in range(blocks):
        own = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = []
        for batch in own.toArrow().to_batches():
            for first, words, at in docs_words(batch.column(1), PUNCT):
                held += [(batch.column(0)[first + r].as_py(), words[a:e]) for r, (a, e) in enumerate(zip(at, at[1:]))]
        block = spark.sparkContext.broadcast(Items(held, masks, window, wrong))
        found = rows.mapInArrow(find(block), OUT)
        if blocks > 1:
            # A block's overlaps are written before the next block is made, so that one at a time is held anywhere.
            found = cut(found, "overlaps")
            block.destroy()
            del block, held
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("overlap_words", "equal_words")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
