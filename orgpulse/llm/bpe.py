"""Byte-level BPE encoding and decoding.

A pre-token that is a vocabulary entry is resolved whole, through a minimal perfect hash
built once for each worker. Any other is merged: its bytes are a doubly linked list, and
a heap holds the ranks of neighbouring pairs, so the lowest rank, the leftmost first, is
merged until no pair is in the vocabulary. The lists and heaps of many short pre-tokens lie
side by side in arrays, and a step takes the top of each heap; a long one has its own.

A null text encodes as an empty one. Rows are independent: repeated rows get equal
results, an empty table gives an empty result. Very long texts are encoded whole, by
themselves. Columns named like a result are replaced; other columns stay whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.llm.bytehash import mix, span_hash

# Merged pre-tokens that a worker keeps, so that frequent ones are merged once. When so many have come, those
# that weren't asked for since the last time are dropped.
KEPT_MERGES = 150_000
# Characters of the texts whose pre-tokens are looked up together; a longer text is taken by itself.
LOOKED_UP = 1 << 19
# Bytes of texts that are Python strings at once, and tokens of the rows that are handed back to Spark at once.
HELD_BYTES = 4 << 20
YIELDED_TOKENS = 1 << 18
# Places that a piece merged beside others takes: its bytes and at least one more, as a power of FAN, the width of a heap's nodes.
FAN = 4
WIDTHS = (4, 16, 64)
# Places of the pieces merged side by side, and how many pieces are worth it.
PLACES = 1 << 16
SIDE_BY_SIDE = 64
NONE = np.iinfo(np.int64).max
_LOADED: dict[tuple[str, str], Encoder] = {}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys to the slots 0 to n - 1, by a displacement for each small bucket of keys."""

    TRIES = np.arange(1, 129, dtype=np.uint64)[:, None]

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = max(n, 1), max(1, n // 2)
        h = self.hash(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        firsts = np.cumsum(counts) - counts
        free = np.ones(self.size, bool)
        # Displacement of a bucket; one with a single key has its slot instead, as a negative number.
        self.shift = np.zeros(self.buckets, np.int64)
        self.index = np.full(self.size, -1, np.int64)
        several = np.flatnonzero(counts > 1)
        for b in several[np.argsort(-counts[several], kind="stable")]:
            own = order[firsts[b] : firsts[b] + counts[b]]
            base = np.uint64(0)
            while True:
                slots = self._slots(h[own][None, :], self.TRIES + base)
                ordered = np.sort(slots, axis=1)
                fit = np.flatnonzero(free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fit):
                    break
                base += np.uint64(len(self.TRIES))
            self.shift[b] = int(base) + int(fit[0]) + 1
            free[slots[fit[0]]] = False
            self.index[slots[fit[0]]] = own
        single = np.flatnonzero(counts == 1)
        left = np.flatnonzero(free)[: len(single)]
        self.shift[single] = -1 - left
        self.index[left] = order[firsts[single]]
        self.keys = [keys[i] if i >= 0 else b"" for i in self.index.tolist()]

    @staticmethod
    def hash(keys: list[bytes]) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(keys) else ends
        return span_hash(np.frombuffer(b"".join(keys), np.uint8), starts, ends)

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """Place of every key in the list it was built from, or -1."""
        if not keys:
            return []
        h = self.hash(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(h, shift.astype(np.uint64)))
        held, index = self.keys, self.index[slots].tolist()
        return [i if held[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), index, strict=True)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], due: list[int], heap: list[int], wide: int) -> tuple[int, ...]:
    """Ids of a piece by merging its bytes in the order of rank, leftmost first among equals.

    ``due`` holds the rank of the pair that starts at a byte (-1 if it is no entry), ``heap`` those that are
    entries, each before its place in the lowest ``wide`` bits, as a heap. Both are used up.
    """
    n = len(piece)
    get, place = ranks.get, (1 << wide) - 1
    after = list(range(1, n + 2))  # start of the next part; n ends the list
    before = list(range(-1, n))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & place
        if due[i] != top >> wide:
            continue  # the pair has changed since
        j = after[i]
        k = after[i] = after[j]
        due[j] = -1
        if k < n:
            before[k] = i
            due[i] = rank = get(piece[i : after[k]], -1)
            if rank >= 0:
                push(heap, rank << wide | i)
        else:
            due[i] = -1
        p = before[i]
        if p >= 0:
            due[p] = rank = get(piece[p:k], -1)
            if rank >= 0:
                push(heap, rank << wide | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class PairRanks:
    """Ranks of the entries that two parts make, by the numbers of the parts: an open table, a quarter of it taken at most.

    The number of an entry is its rank; bytes that are no entries, and a last one for no part at all, have numbers above.
    """

    SPREAD = np.uint64(0x9E3779B97F4A7C15)
    FREE = np.uint64((1 << 64) - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.beyond = max(ranks.values(), default=-1) + 1
        self.no_part = self.beyond + 256
        single = {bytes([b]): self.beyond + b for b in range(256)}
        self.of_byte = np.array([ranks.get(b, number) for b, number in single.items()], np.int64)
        number = (single | ranks).get
        left, right, rank = [], [], []
        for entry, own in ranks.items():
            for cut in range(1, len(entry)):
                if (a := number(entry[:cut])) is not None and (b := number(entry[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(own)
        keys, rank = self._keys(np.array(left, np.int64), np.array(right, np.int64)), np.array(rank, np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.last, self.down = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, self.FREE), np.full(1 << bits, -1, np.int64)
        at = self._places(keys)
        while len(keys):
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.ranks[at[put]] = rank[put]
            keys, rank, at = keys[~put], rank[~put], (at[~put] + 1) & self.last

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 32 | right).view(np.uint64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.SPREAD >> self.down).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of parts, -1 if it is no entry."""
        keys = self._keys(left, right)
        at = self._places(keys)
        out, held = self.ranks[at], self.keys[at]
        other = np.flatnonzero(held != keys)
        out[other] = -1
        other = other[held[other] != self.FREE]
        at = at[other]
        while len(other):
            at = (at + 1) & self.last
            held = self.keys[at]
            hit = held == keys[other]
            out[other[hit]] = self.ranks[at[hit]]
            go_on = ~hit & (held != self.FREE)
            other, at = other[go_on], at[go_on]
        return out


def merge_beside(pieces: list[bytes], width: int, pairs: PairRanks) -> list[tuple[int, ...]]:
    """Ids of pieces of fewer than ``width`` bytes, as ``merge_bytes`` finds them; each step merges one pair of every piece.

    A piece has ``width`` places for its bytes, for the links of its list and for the leaves of its heap. A leaf is the rank of
    the pair that starts there before its place in the piece; the nodes above hold the least of ``FAN`` below, the last one the top.
    """
    n, bits, place = len(pieces), width.bit_length() - 1, width - 1
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(np.arange(n) * width - ends + lengths, lengths)
    part = np.full(n * width, pairs.no_part, np.int64)
    part[at] = pairs.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    before = np.arange(-1, n * width - 1)
    after = before + 2

    def leaf(left: np.ndarray, right: np.ndarray, start: np.ndarray) -> np.ndarray:
        rank = pairs.find(left, right)
        return np.where(rank >= 0, rank << bits | start & place, NONE)

    leaves = np.full(n * width, NONE)
    leaves[at] = leaf(part[at], part[at + 1], at)
    heap = [leaves]
    while len(heap[-1]) > n:
        heap.append(_least(heap[-1].reshape(-1, FAN)))
    top, rows = heap[-1], np.arange(n)
    while len(rows := rows[top[rows] != NONE]):
        best = top[rows]
        i, merged = rows * width + (best & place), best >> bits
        j, p = after[i], before[i]
        k = after[j]
        part[i], part[j] = merged, pairs.no_part
        after[i], before[k] = k, i
        # Behind the last part, and before the first one, is a place without a part.
        leaves[i], leaves[j], leaves[p] = leaf(merged, part[k], i), NONE, leaf(part[p], merged, p)
        at = np.concatenate([i, j, p])
        for below, above in pairwise(heap):
            at //= FAN
            above[at] = _least(below.reshape(-1, FAN)[at])
    at = np.flatnonzero(part != pairs.no_part)
    ids = part[at]
    if len(at) and ids.max() >= pairs.beyond:
        raise KeyError(f"byte {np.flatnonzero(pairs.of_byte == ids.max())[0]} is no entry")
    ids, ends = ids.tolist(), np.cumsum(np.bincount(at // width, minlength=n)).tolist()
    return [tuple(ids[a:b]) for a, b in pairwise([0, *ends])]


def _least(nodes: np.ndarray) -> np.ndarray:
    return np.minimum(np.minimum(nodes[:, 0], nodes[:, 1]), np.minimum(nodes[:, 2], nodes[:, 3]))


def merge_pieces(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairRanks) -> list[tuple[int, ...]]:
    """Ids of every piece, none of them empty."""
    out: list[tuple[int, ...]] = [()] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width_of = np.searchsorted(WIDTHS, lengths, side="right")
    alone = np.flatnonzero(width_of == len(WIDTHS)).tolist()
    for w, width in enumerate(WIDTHS):
        own = np.flatnonzero(width_of == w).tolist()
        if len(own) < SIDE_BY_SIDE:
            alone += own
            continue
        for first in range(0, len(own), PLACES // width):
            some = own[first : first + PLACES // width]
            for i, ids in zip(some, merge_beside([pieces[i] for i in some], width, pairs), strict=True):
                out[i] = ids
    for i, ids in zip(alone, merge_each([pieces[i] for i in alone], ranks, pairs), strict=True):
        out[i] = ids
    return out


def merge_each(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairRanks) -> Iterator[tuple[int, ...]]:
    """Ids of every piece by itself. The ranks of their neighbouring bytes are looked up and put in order together."""
    if not pieces:
        return
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = pairs.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    due = np.full(len(data), -1, np.int64)
    due[:-1] = pairs.find(data[:-1], data[1:])
    due[ends - 1] = -1
    wide = int(lengths.max()).bit_length()
    # In order, the entries of a piece are a heap already.
    at = np.flatnonzero(due >= 0)
    owner = np.searchsorted(ends, at, side="right")
    keys = due[at] << wide | at - starts[owner]
    keys = keys[np.lexsort((keys, owner))].tolist()
    last = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
    due, first = due.tolist(), 0
    for piece, start, end, stop in zip(pieces, starts.tolist(), ends.tolist(), last, strict=True):
        yield merge_bytes(piece, ranks, due[start:end], keys[first:stop], wide)
        first = stop


class Encoder:
    """Encodes and decodes texts by a file of ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        entries = list(ranks)
        self.ids = [ranks[e] for e in entries]
        self.whole = PerfectHash(entries)
        # Entries by id; an id that no entry has is null.
        by_id: list[bytes | None] = [None] * (max(self.ids, default=-1) + 1)
        for entry, i in ranks.items():
            by_id[i] = entry
        self.bytes_of = pa.array(by_id, pa.large_binary())
        self.pieces = regex.compile(pattern).findall
        self.pairs = PairRanks(ranks)
        # Merged pre-tokens asked for since the last change, and those before it.
        self.merged: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text. The pre-tokens of up to ``LOOKED_UP`` characters are looked up together."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= LOOKED_UP):
                size += len(texts[stop])
                stop += 1
            split = [self.pieces(t) for t in texts[at:stop]]
            known = self._resolve(set().union(*split)).__getitem__
            for pieces in split:
                yield np.fromiter(chain.from_iterable(map(known, pieces)), np.uint32)
            at = stop

    def _resolve(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        if len(self.merged) > KEPT_MERGES:
            self.older, self.merged = self.merged, {}
        merged, ids = self.merged, self.ids
        merged.update((p, self.older.pop(p)) for p in pieces & self.older.keys())
        known = {p: merged[p] for p in pieces & merged.keys()}
        new = list(pieces - known.keys())
        raw = [p.encode() for p in new]
        places = self.whole.find(raw)
        known.update((p, (ids[i],)) for p, i in zip(new, places, strict=True) if i >= 0)
        apart = [(p, key) for p, key, i in zip(new, raw, places, strict=True) if i < 0]
        for (piece, key), own in zip(apart, merge_pieces([key for _, key in apart], self.ranks, self.pairs), strict=True):
            known[piece] = own
            if len(key) < 64:
                merged[piece] = own
        return known

    def decode(self, ids: np.ndarray) -> pa.Buffer:
        """The bytes of ids one after another."""
        if not len(ids):
            return pa.py_buffer(b"")
        found = self.bytes_of.take(pa.array(ids))
        if found.null_count:
            raise KeyError(f"no entry has id {ids[found.is_null().index(True).as_py()]}")
        first, last = np.frombuffer(found.buffers()[1], np.int64)[[found.offset, found.offset + len(found)]]
        return found.buffers()[2].slice(first, last - first)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder of a rank file that every machine has."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(read_ranks(path), pattern)
    return _LOADED[path, pattern]


SUMS = T.StructType([T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
COUNT = T.StructField("n_tokens", T.LongType())
IDS = T.StructType([COUNT, T.StructField("ids", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([COUNT, *SUMS.fields])


def _sums(own: Encoder, ids: np.ndarray) -> tuple[str, str]:
    """SHA-256 of ids (little-endian, 32 bits) and of the bytes they decode to."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Rows with n_tokens, ids (array<int>, if asked) and digests of ids and decoded bytes (if asked) of their whole text.

    All come from one pass. Texts are taken out of their batch and results are given back a few MB at a time.
    """
    schema = T.StructType([COUNT, *(IDS.fields[1:] if ids else []), *(SUMS.fields if digests else [])])

    def result(rows: list[np.ndarray], sums: list[tuple[str, str]]) -> pa.Array:
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        columns = [pa.array(counts)]
        if ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32))))
        if digests:
            columns.extend(pa.array([s[i] for s in sums], pa.string()) for i in range(2))
        return pa.StructArray.from_arrays(columns, names=schema.names)

    @F.arrow_udf(schema)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(rank_path, pattern)
        for batch in batches:
            rows, sums, size = [], [], 0
            for texts in _held(batch):
                for found in own.encode_batch(texts):
                    rows.append(found)
                    if digests:
                        sums.append(_sums(own, found))
                    size += len(found)
                    if size >= YIELDED_TOKENS:
                        yield result(rows, sums)
                        rows, sums, size = [], [], 0
            if rows or not len(batch):
                yield result(rows, sums)

    return _widened(docs, encode(F.col(text_col)), schema)


def _held(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in order, those of a few MB at a time; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + HELD_BYTES, side="right")))
        yield [t or "" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Rows with the bytes of their ids as ``decoded``; null ids give empty bytes."""
    schema = T.StructType([T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(schema)
    def decode(ids: pa.Array) -> pa.Array:
        decode = encoder(rank_path, pattern).decode
        return pa.StructArray.from_arrays([pa.array([decode(i).to_pybytes() for i in _id_arrays(ids)], pa.binary())], names=schema.names)

    return _widened(encoded, decode(F.col(ids_col)), schema)


def digest_ids(encoded: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Rows with the SHA-256 of their ids (little-endian, 32 bits) and of the bytes they decode to; null ids count as none."""

    @F.arrow_udf(SUMS)
    def digests(ids: pa.Array) -> pa.Array:
        own = encoder(rank_path, pattern)
        sums = [_sums(own, i) for i in _id_arrays(ids)]
        return pa.StructArray.from_arrays([pa.array([s[i] for s in sums], pa.string()) for i in range(2)], names=SUMS.names)

    return _widened(encoded, digests(F.col(ids_col)), SUMS)


def _id_arrays(ids: pa.Array) -> Iterator[np.ndarray]:
    """The ids of every row; null is none."""
    for row in ids:
        yield row.values.to_numpy(zero_copy_only=False).astype(np.uint32) if row.is_valid else np.empty(0, np.uint32)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Rows with n_tokens and the digests of ids and decoded bytes; ids don't travel between processes."""
    return encode_texts(docs, rank_path, pattern, text_col, ids=False, digests=True)


def _widened(df: DataFrame, result: Column, schema: T.StructType) -> DataFrame:
    """Rows with the fields of a result; the column that holds it meanwhile has a name that no other has."""
    kept = [c for c in df.columns if c not in schema.names]
    name = "_result"
    while name.lower() in [c.lower() for c in kept]:
        name += "_"
    return df.select(*[F.col(f"`{c}`") for c in kept], result.alias(name)).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{name}.{n}").alias(n) for n in schema.names])
