"""Hashes over the bytes of an Arrow string column, without a Python object per value.

All functions take and return numpy arrays; Spark deals the batches they work on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column one after another, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from every position; positions with fewer bytes have none."""
    if len(data) < k:
        return np.empty(0, U64)
    out, out_len, power, span, base = None, 0, BYTE[data], 1, BASE
    while True:
        if k & span:
            if out is None:
                out, out_len = power, span
            else:
                n = len(data) - out_len - span + 1
                out, out_len = out[:n] * base + power[out_len : out_len + n], out_len + span
        if span * 2 > k:
            return mix(out)
        power = power[:-span] * base + power[span:]
        base, span = U64(int(base) ** 2 % (1 << 64)), span * 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from every position."""
    m, span = h, 1
    while span * 2 <= width:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - span : width - span + n])


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a set (other than space and 0x09-0x0D, if not given), and the rows they are in."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    solid = of[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every span; spans are in order, not empty, and don't overlap."""
    if not len(starts):
        return np.empty(0, U64)
    lengths = ends - starts
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), BASE, U64))
    parts = BYTE[data[at + np.repeat(starts, lengths)]] * powers[at]
    return mix(np.add.reduceat(parts, np.cumsum(lengths) - lengths))


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every row in lower case (A-Z only), distinct and sorted in each row, and n + 1 offsets.

    A row with fewer words than ``size`` has its whole sequence as one shingle; without words it has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    words = span_hash(data, starts, ends)
    counts = np.bincount(rows, minlength=n)
    h = np.zeros(len(words), U64)
    long = counts[rows] >= size
    firsts = np.cumsum(counts) - counts
    whole = np.arange(len(words)) + size <= (firsts + counts)[rows] if len(words) else np.empty(0, bool)
    m = max(len(words) - size + 1, 0)
    for i in range(size):
        h[:m] = h[:m] * BASE + words[i : i + m]
    keep = long & whole
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra, extra_rows = np.empty(0, U64), short
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(size - 1):
            has = counts[short] > i
            extra[has] = extra[has] * BASE + words[firsts[short[has]] + i]
        extra = extra * BASE + counts[short].astype(U64)
    tokens = mix(np.concatenate([h[keep], extra]))
    owner = np.concatenate([rows[keep], extra_rows])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[fresh], owner[fresh]
    return tokens, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)
