"""Byte-level BPE by merge replay over a block of the corpus.

Every task treats the texts of its partition as a corpus in blocks of bounded
size.  The distinct words of a block that no block before had are laid out as
one array of byte symbols; an inverted index maps each merge rank to the word
positions where it applies.  Ranks are replayed in ascending order, each updating only the
neighbours of the positions it touched, and the results are spread back to
every occurrence.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_blocks

#: Characters that the rank file's library takes for \s (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words that a task knows before it starts anew.
CACHE = 150_000


def plain(pattern: str) -> str:
    """The pattern with white space spelled out, so that every regex library reads it alike."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def latin(pattern: str) -> str:
    """The plain pattern for texts without characters beyond U+00FF, for the faster library."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    for k, chars in kinds.items():
        pattern = re.sub(rf"(\[[^\]]*)\\p{{{k}}}", lambda m, c=chars: m[1] + c, pattern).replace(rf"\p{{{k}}}", f"[{chars}]")
    return pattern


class Splitter:
    def __init__(self, pattern: str):
        import regex

        full = plain(pattern)
        self.full, self.fast = regex.compile(full).findall, re.compile(latin(full)).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.fast(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full(text)
        return self.fast(text)


class Merges:
    """Tokens of a rank file and the ranks of all pairs that can merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        size = max(self.token) + 1
        self.bytes = [self.token.get(i, b"") for i in range(size)]
        self.text = [str(i) for i in range(size)]
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        # The lowest rank of a pair that each token is part of.
        least = np.full(size, np.iinfo(np.int32).max, np.int32)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            np.minimum.at(least, part, self.ranks)
        #: Tokens of which no copy makes a pair that should come before the token's other copies.
        self.ordered = (least > np.arange(size)).tolist()

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that merging a and b gives, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def replay(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and n + 1 offsets.

    At each step the lowest rank anywhere is applied, from the left, at all its
    places (only at the leftmost of each word if that token is part of a
    pair of lower rank), which for each word is the order in which a
    word-by-word encoder would merge.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n = int(offsets[-1])
    sym = m.byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[offsets[1:][lengths > 0] - 1] = -1
    prv[offsets[:-1][lengths > 0]] = -1
    alive = np.ones(n, bool)
    now = np.full(n, -1, np.int32)  # the rank of the pair that starts at a position
    at = np.flatnonzero(nxt >= 0).astype(np.int32)
    now[at] = m.pair(sym[at], sym[at + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        ranks = now[at]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, some in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if r in index:
                index[r].append(some)
            else:
                index[r] = [some]
                heapq.heappush(heap, r)

    at = at[now[at] >= 0]
    if len(at):
        enter(at)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[now[at] == r]
        if not len(at):
            continue
        first = np.ones(len(at), bool)
        if m.ordered[r]:
            # Of places that overlap in a row, every second one from the left.
            first[1:] = nxt[at[:-1]] != at[1:]
            place = np.arange(len(at))
            first = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            at, first = at[first], first[first]
        else:
            w = word[at]
            first[1:] = w[1:] != w[:-1]
        if not first.all():
            index[r] = [at[~first]]
            heapq.heappush(heap, r)
            at = at[first]
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = r
        nxt[at] = after
        alive[gone] = False
        now[gone] = -1
        has = after >= 0
        prv[after[has]] = at[has]
        now[at] = -1
        now[at[has]] = m.pair(sym[at[has]], sym[after[has]])
        before = prv[at]
        left, mid = before[before >= 0], at[before >= 0]
        now[left] = m.pair(sym[left], sym[mid])
        touched = np.concatenate([at, left])
        touched = touched[now[touched] >= 0]
        if len(touched):
            enter(np.unique(touched))
    counts = np.bincount(word[alive], minlength=len(words))
    return sym[alive], np.concatenate([[0], np.cumsum(counts)])


def replayed(words: list[bytes], m: Merges, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """:func:`replay` of about ``most`` bytes of words at a time."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    ids, counts, i = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        some, offsets = replay(words[i:j], m)
        ids.append(some)
        counts.append(np.diff(offsets))
        i = j
    return np.concatenate(ids), np.cumsum(np.concatenate(counts))


class Known:
    """Words that a task has met: word -> number, and the ids of number i at flat[start[i] : start[i] + count[i]]."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)


def encode_block(texts: list[str | None], m: Merges, split: Splitter, known: Known) -> list[np.ndarray]:
    """Token ids of each text (null: none); only words that are not ``known`` yet are replayed, and then are."""
    number, before = known.number, len(known.number)
    docs = []
    for t in texts:
        found = split(t) if t else []
        docs.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)))
    words = [w.encode() for w in islice(number, before, None)]
    whole = np.fromiter((m.rank.get(w, -1) for w in words), np.int64, len(words))
    rest = np.flatnonzero(whole < 0)
    ids, offsets = replayed([words[i] for i in rest.tolist()], m)
    counts = np.ones(len(words), np.int64)
    counts[rest] = np.diff(offsets)
    starts = np.cumsum(counts) - counts
    new = np.empty(int(counts.sum()), np.int32)
    new[starts[whole >= 0]] = whole[whole >= 0]
    new[np.repeat(starts[rest] - offsets[:-1], counts[rest]) + np.arange(len(ids))] = ids
    table, counts = np.concatenate([known.flat, new]), np.concatenate([known.count, counts])
    known.flat, known.count = table, counts
    starts = np.cumsum(counts) - counts
    out = []
    for d in docs:
        c = counts[d]
        ends = np.cumsum(c)
        n = int(ends[-1]) if len(d) else 0
        out.append(table[np.repeat(starts[d] - (ends - c), c) + np.arange(n)])
    return out


def decode(ids: list[int], m: Merges) -> bytes:
    return b"".join(map(m.bytes.__getitem__, ids))


def mapper(path: str, pattern: str, finish):
    """A mapInArrow function: encode blocks and let ``finish`` turn (key, ids, merges) into a batch."""

    def run(batches):
        m, split, known = merges(path), splitter(pattern), Known()
        for t in text_blocks(batches):
            if len(known.number) > CACHE:
                known = Known()
            yield finish(t.column(0), encode_block(t.column(1).to_pylist(), m, split, known), m)

    return run


def as_ids(keys, docs, m):
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*docs, np.zeros(0, np.int32)]).astype(np.int32)))], ["doc_id", "ids"])


def as_digests(keys, docs, m):
    n, coded, decoded = [], [], []
    for d in docs:
        ids = d.tolist()
        n.append(len(ids))
        coded.append(hashlib.sha256(",".join(map(m.text.__getitem__, ids)).encode()).hexdigest())
        decoded.append(hashlib.sha256(decode(ids, m)).hexdigest())
    return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no ids; a null doc_id stays null; repeated rows
    stay repeated; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(mapper(path, pattern, as_ids), "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary) for rows of (doc_id, ids); null ids count as none."""

    def run(batches):
        m = merges(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or [], m) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids again, and return both as digests.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes); edge cases as in :func:`encode`.
    """
    return docs.select("doc_id", "text").mapInArrow(mapper(path, pattern, as_digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
