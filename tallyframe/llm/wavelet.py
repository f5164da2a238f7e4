"""Token-id shards as wavelet matrices.

Documents are range-partitioned and sorted by id, encoded, and cut into
shards of bounded size.  A shard is one binary payload: a header and one bit
plane per bit of the token ids, most significant first, each stably
partitioned by the plane above, with running counts per 512 bits.  Tokens can
be read, counted and located from the payload without unpacking it.

Payload layout (all little-endian): magic ``TWM1``, planes uint32, tokens
uint64; then for each plane the number of zero bits uint64, the counts
uint32[ceil(tokens / 512) + 1], and the bits uint8[64 * ceil(tokens / 512)],
lowest bit of a byte first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import split_words

MAGIC = b"TWM1"
STEP = 512
#: Tokens after which a shard is closed; a document is never split.
SHARD = 1 << 20
#: Strings whose ids a worker keeps from one block to the next (about 40 bytes each); beyond, those that were met once go.
CACHE = 500_000
#: Runs that the library gets as one text.
GROUP = 32
BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)
SHARD_ROWS = "part int, seq int, local_start long, doc_ids array<long>, lengths array<int>, n_tokens long, payload binary"


def build(tokens: np.ndarray) -> bytes:
    """The payload of a sequence of token ids."""
    seq = tokens.astype(np.uint16 if tokens.max(initial=0) < 1 << 16 else np.uint32)
    planes = max(1, int(seq.max(initial=0)).bit_length())
    n = len(seq)
    blocks = -(-n // STEP)
    out = [MAGIC, struct.pack("<IQ", planes, n)]
    for p in range(planes - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << p)) != 0
        packed = np.zeros(blocks * STEP // 8, np.uint8)
        raw = np.packbits(one, bitorder="little")
        packed[: len(raw)] = raw
        counts = np.zeros(blocks + 1, np.uint32)
        np.cumsum(BITS[packed].reshape(blocks, STEP // 8).sum(1, dtype=np.uint32), out=counts[1:])
        zeros = seq[~one]
        out += [struct.pack("<Q", len(zeros)), counts.tobytes(), packed.tobytes()]
        seq = np.concatenate([zeros, seq[one]])
    return b"".join(out)


class WaveletMatrix:
    """Read access to a payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet matrix payload")
        self.planes, self.n = struct.unpack_from("<IQ", payload, 4)
        blocks, at = -(-self.n // STEP), 16
        self.zeros, self.counts, self.bits = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", payload, at)[0])
            self.counts.append(np.frombuffer(payload, np.uint32, blocks + 1, at + 8))
            self.bits.append(np.frombuffer(payload, np.uint8, blocks * STEP // 8, at + 8 + 4 * (blocks + 1)))
            at += 8 + 4 * (blocks + 1) + blocks * STEP // 8

    def __len__(self) -> int:
        return self.n

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, bits = i // STEP, self.bits[plane]
        start = block * STEP // 8
        whole = i // 8
        r = int(self.counts[plane][block]) + int(BITS[bits[start:whole]].sum())
        return r + (int(BITS[bits[whole] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, i), self._rank1(p, i)
            token = token << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return token

    def _walk(self, token: int, i: int) -> int | None:
        """Where the first i positions' copies of ``token`` end in the last order (None: no such token)."""
        if token < 0 or token >> self.planes:
            return None
        for p in range(self.planes):
            ones = self._rank1(p, i)
            i = self.zeros[p] + ones if token >> (self.planes - 1 - p) & 1 else i - ones
        return i

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first i positions."""
        end = self._walk(token, min(i, self.n))
        return 0 if end is None else end - self._walk(token, 0)

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of that value in a plane."""
        counts = self.counts[plane].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * STEP - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        own = np.unpackbits(self.bits[plane][block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(own == bit)[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._walk(token, 0) + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._find(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        # From the last plane up: each plane says where the two halves below it came from.
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.bits[p], count=self.n, bitorder="little").view(bool)
            below, out = out, np.empty_like(out)
            below[self.zeros[p] :] |= out.dtype.type(1 << (self.planes - 1 - p))
            out[~one], out[one] = below[: self.zeros[p]], below[self.zeros[p] :]
        return out


class WordEncoder:
    """A tokenizers file's encoder for whole texts, calling the library once per distinct word.

    For files whose pre-tokenizer drops white space and never joins across it.
    Words of ASCII and Latin-1 letters are lowered and split into runs here, as
    the file's pattern would; the library encodes each distinct run by the
    file's model alone, as lowering and splitting are done.  Any other
    white-space separated string goes to the library as it is, so also one that
    holds the text of an added token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Tokens that close a run.
        vocab, suffix = self.library.get_vocab(with_added_tokens=True), self.library.model.end_of_word_suffix
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)").search
        low = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
        self.runs = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{low}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^{low}0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
        #: No added token is letters only, so that words of ASCII letters hold none.
        self.plain = not any(t.isascii() and t.isalpha() for t in self.added)
        self.easy = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+").fullmatch
        self.forget()

    def forget(self) -> None:
        """Drop the known strings: sorted hashes, and the ids of the i-th at flat[starts[i] : starts[i] + counts[i]]; again[i]: met in a later block."""
        self.hashes, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def tidy(self) -> None:
        """Drop the known strings that were met in one block only, or all where the others are many as well."""
        keep = self.again
        if 2 * np.count_nonzero(keep) > CACHE:
            return self.forget()
        self.hashes, starts, self.counts = self.hashes[keep], self.starts[keep], self.counts[keep]
        self.flat, self.again = gather(self.flat, starts, self.counts), np.zeros(len(starts), bool)
        self.starts = np.cumsum(self.counts) - self.counts

    def runs_ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`ids`, for lowered runs; each ends with a token that closes it."""
        flat = [np.zeros(0, np.uint16)]
        for s in range(0, len(runs), 8192):
            texts = [" ".join(runs[i : min(i + GROUP, s + 8192)]) for i in range(s, min(s + 8192, len(runs)), GROUP)]
            flat.append(np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)), np.uint16))
        ids = np.concatenate(flat)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(runs) or (len(ends) and ends[-1] != len(ids)):
            return self.ids(runs)
        return ids, np.diff(ends, prepend=0)

    def ids(self, strings: list[str], joined: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all strings, one after another, and how many each has.

        ``joined``: hand over many at once, as none joins with a neighbour across a blank.
        """
        flat, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for s in range(0, len(strings), 8192):
            some = strings[s : s + 8192]
            groups = [some[i : i + 1024] for i in range(0, len(some), 1024)] if joined else [[x] for x in some]
            for group, e in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
                flat.append(np.array(e.ids, np.uint16))
                if not joined:
                    counts.append(np.array([len(flat[-1])]))
                    continue
                # Where the library sees as many words as there are, each is one; else offsets tell.
                words = e.word_ids
                if None not in words and words and words[-1] == len(group) - 1:
                    counts.append(np.bincount(words, minlength=len(group)))
                    continue
                ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
                at = np.searchsorted(np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids)), ends)
                counts.append(np.diff(at, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def exact(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hashes, those of words that hold an added token made anew from their bytes: case counts there."""
        for token in self.added:
            i = raw.find(token.encode())
            while i >= 0:
                k = int(np.searchsorted(starts, i, "right")) - 1
                hashes[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
                i = raw.find(token.encode(), int(ends[k]))
        return hashes

    def learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        """Encode new strings and add them to the known ones."""
        number: dict[str, int] = {}
        easy, special, at, n_parts, hard = self.easy, self.special, [], np.ones(len(strings), np.int64), []
        plain = self.plain
        for i, w in enumerate(strings):
            if plain and w.isascii() and w.isalpha():
                at.append(number.setdefault(w.lower(), len(number)))
            elif not easy(w) or special(w):
                # Strings beyond Latin-1 may change length when normalised, so each is encoded alone.
                hard.append(w)
                at.append(-len(hard))
            elif w.isalpha():
                at.append(number.setdefault(w.lower(), len(number)))
            else:
                own = [number.setdefault(r, len(number)) for r in self.runs(w.lower())]
                n_parts[i] = len(own)
                at += own
        flat, counts = (np.concatenate(x) for x in zip(self.runs_ids(list(number)), self.ids(hard, joined=False)))
        starts, at = np.cumsum(counts) - counts, np.array(at, np.int64)
        at = np.where(at < 0, len(number) - 1 - at, at)
        word_counts = segment_sums(counts[at], n_parts)
        word_starts = np.cumsum(word_counts) - word_counts + len(self.flat)
        order = np.argsort(all_hashes := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.again = all_hashes[order], np.concatenate([self.again, np.zeros(len(hashes), bool)])[order]
        self.starts, self.counts = np.concatenate([self.starts, word_starts])[order], np.concatenate([self.counts, word_counts])[order]
        self.flat = np.concatenate([self.flat, gather(flat, starts[at], counts[at])])

    def encode(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each closed by ``end``; and the number of ids of each.

        Distinct strings are told apart by a 64-bit hash.
        """
        parts_of = [(self.exact(data.tobytes(), w, starts, ends), at, data, starts, ends) for data, w, at, starts, ends in split_words(column)]
        hashes = np.concatenate([w for w, *_ in parts_of] or [np.zeros(0, np.uint64)])
        n_words = np.concatenate([np.diff(at) for _, at, *_ in parts_of] or [np.zeros(0, np.int64)])
        # By a hash table; in the order in which they first occur.
        told = pa.array(hashes).dictionary_encode()
        distinct, inverse = told.dictionary.to_numpy(), told.indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))
        if len(self.hashes) > CACHE:
            self.tidy()
        known = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[known] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        self.again[known[~new]] = True
        places, strings, base = first[new], [], 0
        for w, _, data, starts, ends in parts_of:
            own = places[np.searchsorted(places, base) : np.searchsorted(places, base + len(w))] - base
            raw = data.tobytes()
            strings += [raw[x:y].decode() for x, y in zip(starts[own].tolist(), ends[own].tolist())]
            base += len(w)
        self.learn(hashes[places], strings)
        at = np.searchsorted(self.hashes, distinct)[inverse]
        counts = self.counts[at]
        tokens, lengths = gather(self.flat, self.starts[at], counts), segment_sums(counts, n_words)
        if end is None:
            return tokens, lengths
        lengths = lengths + 1
        out, close = np.full(len(tokens) + len(lengths), end, np.uint16), np.zeros(len(tokens) + len(lengths), bool)
        close[np.cumsum(lengths) - 1] = True
        out[~close] = tokens
        return out, lengths


def gather(table: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices of ``table`` at ``starts`` of length ``counts``, one after another."""
    ends = np.cumsum(counts)
    return table[np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def shard_writer(path: str, end: int | None, shard: int):
    """A mapInArrow function from sorted (doc_id, text) to shard rows."""

    def run(batches):
        coder, me, seq, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        ids, lengths, tokens, size = [], [], [], 0

        def row():
            n = int(sum(lengths))
            return pa.RecordBatch.from_pylist([{"part": me, "seq": seq, "local_start": start, "doc_ids": ids, "lengths": lengths, "n_tokens": n, "payload": build(np.concatenate(tokens))}], schema=SCHEMA)

        for t in shared.text_blocks(batches):
            flat, counts = coder.encode(t.column(1), end)
            ends = np.cumsum(counts)
            keys, first = t.column(0).to_pylist(), 0
            while first < len(keys):
                room = (ends[first - 1] if first else 0) + shard - size
                last = max(first + 1, int(np.searchsorted(ends, room, "left")) + 1)
                last = min(last, len(keys))
                ids += keys[first:last]
                lengths += counts[first:last].tolist()
                tokens.append(flat[(ends[first - 1] if first else 0) : ends[last - 1]])
                size += len(tokens[-1])
                first = last
                if size >= shard:
                    yield row()
                    seq, start = seq + 1, start + size
                    ids, lengths, tokens, size = [], [], [], 0
        if ids:
            yield row()

    return run


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("local_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int | None, shard: int = SHARD) -> None:
    """Encode ``docs`` (doc_id, text) and write wavelet-matrix shards under ``path``.

    Shards ascend by doc_id over (part, seq).  A null or empty text is just
    ``end``; rows with one doc_id stay apart, ordered by a hash of the text; a
    null doc_id comes first; other columns are ignored; an empty table gives no shard.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are drawn from ids and hashes only: texts never go to the driver.
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.select("doc_id", "text").mapInArrow(shard_writer(tokenizer, end, shard), SHARD_ROWS).write.parquet(path)


def read_shards(docs_path: str, spark) -> DataFrame:
    return spark.read.schema(SHARD_ROWS).parquet(docs_path)


def read_digests(spark, path: str) -> DataFrame:
    """From the shards under ``path``: doc_id, start, n_tokens, ids_crc32 of every document."""
    shards = read_shards(path, spark)
    # One number per part (a bounded count of tasks), never per document or shard.
    base, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.part):
        base[r.part] = total
        total += r.n

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                part, start, ids, lengths, payload = (b.column(c)[r].as_py() for c in range(5))
                tokens = WaveletMatrix(payload).tokens().astype("<u4")
                lengths = np.array(lengths, np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(tokens[a:e].tobytes()) for a, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + start + base[part]), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "local_start", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end: int | None, shard: int = SHARD) -> DataFrame:
    """Write shards into the shared folder and return the digests read back from them."""
    spark = docs.sparkSession
    path = shared.fresh_path(spark, "wavelet")
    write_shards(docs, path, tokenizer, end, shard)
    return read_digests(spark, path)
