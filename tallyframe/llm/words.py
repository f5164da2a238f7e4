"""Vectorised word hashing over the bytes of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ODD = 0x9E3779B97F4A7C15
STEP = 0x100000001B3
INVERSE = pow(STEP, -1, 2**64)
#: Bytes of text hashed at a time.
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX2
    return x ^ (x >> np.uint64(33))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))


def lowered(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For loose matching every ASCII byte that is neither letter nor digit separates words.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = lowered(BYTE)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", STEP), ("down", INVERSE)):
            p = np.full(max(n, PIECE + 1), np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words in ``data`` (uint8), A-Z lowered."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = space[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])[: len(data)]
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LOWER[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and n + 1 offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def pieces(column: pa.Array, most: int = PIECE):
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer text is a run of its own."""
    data, offsets = texts_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split_words(column: pa.Array, space: np.ndarray = SPACE):
    """(bytes, word hashes, n + 1 word offsets by row, first bytes, end bytes) for runs of rows.

    Texts are kept apart by a separator, so no word spans two rows.
    """
    for _, data, offsets in pieces(column):
        n = len(offsets) - 1
        if n > 1:
            padded = np.full(len(data) + n, 0x20, np.uint8)
            padded[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
            data, offsets = padded, offsets + np.arange(n + 1)
        hashes, starts, ends = word_hashes(data, space)
        yield data, hashes, np.searchsorted(starts, offsets), starts, ends


def docs_words(column: pa.Array, space: np.ndarray = SPACE):
    """(first row, word hashes, n + 1 word offsets by row) for runs of rows."""
    first = 0
    for _, hashes, at, _, _ in split_words(column, space):
        yield first, hashes, at
        first += len(at) - 1
