"""Exact removal of repeated substrings by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``length`` bytes only; equal groups are exactly the
windows that occur more than once. The passes go from the most significant digit on:

1. Suffixes are dealt to buckets by the least hash of a short gram among the windows'
   own. Neighbouring windows share it, so a run of them travels as one string, about
   length + 18 bytes for 20 windows, and equal windows meet in one bucket.
2. In a bucket equal runs become one. Windows are grouped by their first 24 bytes;
   groups of a single document are done.
3. The rest are grouped by the remaining bytes, and neighbours are compared byte by byte.

A window is repeated in a document if a document with a smaller id has it too. A block
of documents sends each of its distinct runs once, with the smallest id that has it, and
gets back which of the run's windows a smaller id has, so a passage that a third of all
documents share is sent once a block, not once a document.

A null text counts as empty. Rows with a null id lose nothing and remove nothing. Rows
with equal ids don't remove each other's bytes. Texts of fewer than ``length`` bytes
have no window. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orgpulse.llm.blocks import bucket_count, deal_blocks, open_block, pack, slices, unpack
from orgpulse.llm.bytehash import BASE, U64, gram_hash, mix, sliding_min

GRAM = 12
# Text bytes whose windows one bucket sorts, and bytes of a block that are looked at together.
BUCKET_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
# Leading bits of a digit that windows are counted by before they are sorted.
COUNT_BITS = 22

DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary())])
FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("masks", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
ALL = U64(1) << U64(63)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number, without a copy; the last seven positions have none."""
    return np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,)) if len(data) >= 8 else np.empty(0, "<u8")


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and dealing hashes of the runs of neighbouring windows of a document with one least gram hash.

    A run has at most length - GRAM + 1 windows, so that a mask of them fits a number for lengths up to 74.
    """
    width = length - GRAM + 1
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES + length - 1]
        least = sliding_min(gram_hash(part, GRAM), width)
        row = row_of[at : at + len(least)]
        inside = row == row_of[at + length - 1 : at + length - 1 + len(least)]
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        first = np.flatnonzero(change & inside)
        run = np.cumsum(change) - 1
        count = np.bincount(run[inside], minlength=run[-1] + 1)[run[first]]
        pieces = -(-count // width)
        start = np.repeat(first, pieces)
        step = (np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
        parts.append((at + start + step, np.minimum(width, np.repeat(count, pieces) - step), mix(least[start])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64))


def equal_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the number of its class of equal strings, and the classes' first runs. Hashes only propose; bytes decide."""
    words = _words(data)
    h = lengths.astype(U64)
    for at in range(0, int(lengths.max(initial=0)), 8):
        live = lengths >= at + 8
        h[live] = (h[live] ^ words[starts[live] + at]) * BASE
        h[live] ^= h[live] >> U64(31)
    h = mix(h ^ words[starts + lengths - 8])
    order = np.argsort(h, kind="stable")
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.empty(0, bool)
    model = np.empty(len(h), np.int64)
    model[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    other = np.flatnonzero(model != np.arange(len(h)))
    same = lengths[other] == lengths[model[other]]
    for at in range(0, int(lengths.max(initial=0)), 8):
        live = np.flatnonzero(same & (lengths[other] >= at + 8))
        same[live] = words[starts[other[live]] + at] == words[starts[model[other[live]]] + at]
    live = np.flatnonzero(same)
    same[live] = words[(starts + lengths)[other[live]] - 8] == words[(starts + lengths)[model[other[live]]] - 8]
    model[other[~same]] = other[~same]
    firsts, number = np.unique(model, return_inverse=True)
    return number, firsts


def _block_runs(ids: np.ndarray, known: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, buckets: int):
    """Runs of a block's documents with ids, and their classes in the order of buckets: what both passes over a block must agree on."""
    starts, windows, deal = window_runs(data, offsets, length)
    row = np.searchsorted(offsets, starts, side="right") - 1
    kept = known[row]
    starts, windows, deal, owner = starts[kept], windows[kept], deal[kept], ids[row[kept]]
    number, firsts = equal_runs(data, starts, windows + length - 1)
    least = np.full(len(firsts), np.iinfo(np.int64).max)
    np.minimum.at(least, number, owner)
    bucket = (((deal[firsts] >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return starts, windows, owner, number, firsts, least, bucket, order


def _deal(length: int, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, data, offsets = open_block(row)
                starts, windows, _, _, firsts, least, bucket, order = _block_runs(ids, known, data, offsets, length, buckets)
                cut, out = slices(bucket[order], buckets), []
                for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if j > i:
                        own = order[i:j]
                        spans = [data[s : s + n] for s, n in zip(starts[firsts[own]].tolist(), (windows[firsts[own]] + length - 1).tolist(), strict=True)]
                        out.append((b, row["block"], pack(windows[firsts[own]].astype(np.uint8)), pack(np.diff(least[own], prepend=0)), pack(np.concatenate(spans), 5)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DEALT, strict=True)], schema=DEALT)

    return deal


def repeated_windows(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window the least owner of its equals, and its own where no other has it. Owners are distinct runs' least ids."""
    words = _words(data)
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    least = owner.copy()
    live, found = np.arange(len(starts)), owner[:0]
    group = np.zeros(len(starts), np.int64)
    # Most significant digit first: three words, then the rest. Groups with one owner leave after each pass.
    for last, digits in enumerate((offsets[:3], offsets[3:])):
        h = group.astype(U64)
        for at in digits:
            h = (h ^ words[starts[live] + at]) * BASE
            h ^= h >> U64(31)
        h = mix(h)
        if not last:
            # Counting by the leading bits first spares most windows that occur once the sort.
            slot = (h >> U64(64 - COUNT_BITS)).astype(np.int32)
            latest = np.empty(1 << COUNT_BITS, np.int32)
            latest[slot] = np.arange(len(slot), dtype=np.int32)
            shared = np.zeros(1 << COUNT_BITS, bool)
            shared[slot[latest[slot] != np.arange(len(slot))]] = True
            live = np.flatnonzero(shared[slot])
            h = h[live]
        order = np.argsort(h, kind="stable")
        live, h = live[order], h[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = h[1:] != h[:-1]
        if last:
            # Exact ends: equal hashes must be equal bytes, else the group is split there.
            same = np.ones(max(len(live) - 1, 0), bool)
            for at in offsets:
                same &= words[starts[live[1:]] + at] == words[starts[live[:-1]] + at]
            if (~same & ~fresh[1:]).any():
                fine = np.lexsort([words[starts[live] + at] for at in reversed(offsets)])
                live = live[fine]
                fresh = np.ones(len(live), bool)
                fresh[1:] = np.logical_or.reduce([words[starts[live[1:]] + at] != words[starts[live[:-1]] + at] for at in offsets])
        if not len(live):
            return least
        edges = np.flatnonzero(fresh)
        low, high = np.minimum.reduceat(owner[live], edges), np.maximum.reduceat(owner[live], edges)
        number = np.cumsum(fresh) - 1
        several = (low < high)[number]
        live, group, found = live[several], number[several], low[number[several]]
    least[live] = found
    return least


def _sort(length: int):
    def sort(table: pa.Table) -> pa.Table:
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        windows = [unpack(x.as_py(), "u1") for x in table.column("lengths")]
        ids = np.concatenate([np.cumsum(unpack(x.as_py(), "<i8")) for x in table.column("ids")])
        data = np.concatenate([unpack(x.as_py(), "u1") for x in table.column("runs")])
        ends = np.cumsum([len(x) for x in windows])
        count = np.concatenate(windows).astype(np.int64)
        sizes = count + length - 1
        starts = np.cumsum(sizes) - sizes
        number, firsts = equal_runs(data, starts, sizes)
        least = np.full(len(firsts), np.iinfo(np.int64).max)
        np.minimum.at(least, number, ids)
        # Windows of the distinct runs, and for the run's least document which of them a smaller one has.
        own = np.repeat(np.arange(len(firsts)), count[firsts])
        place = np.arange(len(own)) - np.repeat(np.cumsum(count[firsts]) - count[firsts], count[firsts])
        hit = repeated_windows(data, starts[firsts][own] + place, least[own], length) < least[own]
        masks = np.zeros(len(firsts), U64)
        np.bitwise_or.at(masks, own[hit], U64(1) << place[hit].astype(U64))
        # A run that a smaller document outside the block has is repeated as a whole.
        answer = np.where(ids > least[number], ALL, masks[number])
        rows = []
        for block, i, j in zip(blocks, [0, *ends[:-1]], ends, strict=True):
            places = np.flatnonzero(answer[i:j])
            if len(places):
                rows.append((block, bucket, pack(np.diff(places.astype(np.uint32), prepend=np.uint32(0))), pack(answer[i:j][places])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, FOUND, strict=True)], schema=FOUND)

    return sort


def _remove(length: int, buckets: int, with_text: bool):
    def remove(blocks: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            ids, known, data, offsets = open_block(row)
            starts, windows, owner, number, firsts, least, bucket, order = _block_runs(ids, known, data, offsets, length, buckets)
            cut = slices(bucket[order], buckets)
            masks = np.zeros(len(firsts), U64)
            for back in found.to_pylist():
                masks[order[cut[back["bucket"]] + np.cumsum(unpack(back["places"], "<u4"), dtype=np.int64)]] = unpack(back["masks"], "<u8")
            mask = masks[number]
            whole = (owner > least[number]) | (mask == ALL)
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, starts[whole], 1)
            np.add.at(change, starts[whole] + windows[whole] + length - 1, -1)
            some = np.flatnonzero(~whole & (mask > 0))
            for bit in range(int(windows[some].max(initial=0))):
                at = starts[some[(mask[some] >> U64(bit)) & U64(1) > 0]] + bit
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begin[inner] = gone[inner]
            for i in range(len(ids)):
                a, b = offsets[i], offsets[i + 1]
                kept = data[a:b][~gone[a:b]].tobytes()
                removed = int(b - a) - len(kept)
                rows.append((int(ids[i]) if known[i] else None, int(b - a), removed, int(begin[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, KEPT, strict=True)], schema=KEPT)

    return remove


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (what is left; bytes of characters cut in two are left out of it)."""
    if not 24 <= length <= 74:
        raise ValueError("length must be from 24 to 74 bytes")
    blocks = deal_blocks(docs, id_col, text_col)
    buckets = bucket_count(blocks, BUCKET_BYTES)
    dealt = blocks.mapInArrow(_deal(length, buckets), "bucket int, block long, lengths binary, ids binary, runs binary")
    found = dealt.groupBy("bucket").applyInArrow(_sort(length), "block long, bucket int, places binary, masks binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(length, buckets, with_text), schema)
    return out if with_text else out.drop("kept")
