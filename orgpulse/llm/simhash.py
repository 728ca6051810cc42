"""Near-duplicate groups by SimHash fingerprints, compared bit plane by bit plane.

A fingerprint has a bit for each of the 64 bits of a hash: set if over half of the text's
word shingles (repeats included) have it set. Two fingerprints that differ in at most
``radius`` bits agree in one of ``radius + 1`` runs of bits, so only those that share a run
meet. A run that very many share is split again by the bits that are left, in the same way,
and what is still large after MASK_LEVELS splits is cut into parts that meet two by two.

The members of a group are stored as bit planes: word b of a plane holds bit b of 64
fingerprints. A fingerprint is compared with 64 others by adding the differing bits of one
plane after another into carry-save counters, and a block of 64 is left as soon as all of it
is beyond the radius. Of the links in a group a spanning forest goes on (any link within the
radius is found in some group, and its ends stay connected), so that thousands of near copies
don't become all their pairs.

Null, empty and blank texts have fingerprint zero, linked like any other. Very long texts are
hashed a slab of words at a time. Rows with equal texts have equal fingerprints and one node.
Rows with a null id keep their fingerprint and get the least known id that they reach, null if
there is none. Rows with equal ids stay rows of their own. An empty table gives an empty
result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.components import components
from orgpulse.session import cut_lineage

BITS = 64
SEED = 42
# Bytes of text that are split into words at once, and shingles whose bits are counted at once.
SLAB_BYTES = 1 << 20
SLAB_SHINGLES = 1 << 17
# Fingerprints that meet in one task at most, splits by further bits before parts are made, and comparisons held at once.
GROUP_ROWS = 2048
MASK_LEVELS = 3
SLAB_ENTRIES = 1 << 15
SPACE = regex.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text in lower case (A-Z only), in slabs; a text with fewer words than ``size`` is one shingle."""
    kept: list[bytes] = []
    at, whole = 0, False
    while at < len(text):
        stop = min(len(text), at + SLAB_BYTES)
        if stop < len(text):
            gap = SPACE.search(text, stop)
            stop = gap.start() if gap else len(text)
        # bytes.lower changes A-Z alone; bytes.split splits at 0x20 and 0x09 to 0x0D.
        words = kept + text[at:stop].lower().split()
        at = stop
        if len(words) >= size:
            whole = True
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            first = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
            yield np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(first, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(first))
            kept = words[len(words) - size + 1 :]
        else:
            kept = words
    if kept and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts."""
    votes, counts = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    slabs: list[np.ndarray] = []
    rows: list[int] = []

    def count() -> None:
        if not slabs:
            return
        lengths = np.array([len(s) for s in slabs])
        bits = np.unpackbits(np.concatenate(slabs).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(votes, rows, np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int64))
        np.add.at(counts, rows, lengths)
        slabs.clear()
        rows.clear()

    held = 0
    for row, text in enumerate(texts):
        for slab in shingle_hashes(text, size):
            slabs.append(slab)
            rows.append(row)
            held += len(slab)
            if held >= SLAB_SHINGLES:
                count()
                held = 0
    count()
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_texts(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (the unsigned value as a signed long) of every row's whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(texts, words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def child_masks(mask: int, parts: int) -> list[int]:
    """The mask widened by each of ``parts`` runs of the bits that it leaves open."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in run) for run in np.array_split(left, parts) if len(run)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """Planes of 64-bit values, as many as a multiple of 64: [b, w] has bit b of the 64 values from 64 * w."""
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.reshape(-1, 64, BITS).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def within_radius(planes: np.ndarray, values: np.ndarray, words: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries (a value, a word of 64 lanes, the lanes that are wanted): the entries and lanes that differ in ``radius`` bits at most."""
    n_counters = max(1, radius.bit_length())
    # Counters begin so high that one difference more than the radius carries out of the last one.
    begin = (1 << n_counters) - 1 - radius
    entry = np.arange(len(values))
    counters = [np.full(len(values), np.uint64(0xFFFFFFFFFFFFFFFF if begin >> i & 1 else 0)) for i in range(n_counters)]
    beyond = ~wanted
    for b in range(BITS):
        carry = planes[b][words] ^ (np.uint64(0) - (values >> np.uint64(b) & np.uint64(1)))
        for i in range(n_counters):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        beyond |= carry
        if b % 8 == 7:
            alive = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if alive.mean() < 0.75:
                entry, values, words, beyond = entry[alive], values[alive], words[alive], beyond[alive]
                counters = [c[alive] for c in counters]
    hits = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(hits)
    return entry[at], lane


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member) after joining the groups of every a and b."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            after = label[label]
            if (after == label).all():
                break
            label = after


def group_links(starts: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``values``) that connect what is within the radius inside each run of values from ``starts``."""
    sizes = np.diff(np.append(starts, len(values)))
    n_words = -(-sizes // 64)
    first = np.cumsum(n_words) - n_words
    group = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(values)) - np.repeat(starts, sizes)
    lane_of = first[group] * 64 + rank
    lanes, row_at = np.zeros(int(n_words.sum()) * 64, np.uint64), np.zeros(int(n_words.sum()) * 64, np.int64)
    lanes[lane_of], row_at[lane_of] = values, np.arange(len(values))
    planes = bit_planes(lanes)
    # Each value meets its own word and those after it in its group.
    own = lane_of // 64
    meets = first[group] + n_words[group] - own
    ends = np.cumsum(meets)
    label = np.arange(len(values))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB_ENTRIES, side="right")))
        row = np.repeat(np.arange(at, stop), meets[at:stop])
        word = own[row] + np.arange(len(row)) - np.repeat(np.cumsum(meets[at:stop]) - meets[at:stop], meets[at:stop])
        held = np.minimum(sizes[group[row]] - (word - first[group[row]]) * 64, 64)  # lanes in use
        wanted = np.where(held == 64, full, (np.uint64(1) << (held % 64).astype(np.uint64)) - np.uint64(1))
        later = full << ((lane_of[row] % 64).astype(np.uint64)) << np.uint64(1)
        wanted = np.where(word == own[row], wanted & later, wanted)
        entry, lane = within_radius(planes, values[row], word, wanted, radius)
        label = union(label, row[entry], row_at[word[entry] * 64 + lane])
        at = stop
    linked = np.flatnonzero(label != np.arange(len(values)))
    return linked, label[linked]


def _compare(radius: int):
    """Links of groups of rows in order of their key; a group goes on over batches."""
    key = ["mask", "value", "x", "y"]

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        a, b = group_links(starts, values, radius)
        return pa.RecordBatch.from_arrays([pa.array(values[a].view(np.int64)), pa.array(values[b].view(np.int64))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty((0, len(key)), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy() for c in key], axis=1)])
            values = np.concatenate([values, batch.column("fp").to_numpy().view(np.uint64)])
            # The last group may go on in the next batch.
            differs = np.flatnonzero((keys != keys[-1]).any(axis=1))
            done = int(differs[-1]) + 1 if len(differs) else 0
            if done:
                yield links(keys[:done], values[:done])
                keys, values = keys[done:], values[done:]
        if len(values):
            yield links(keys, values)

    return compare


def link_fingerprints(fps: DataFrame, radius: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within ``radius`` bits of each other."""
    masks = child_masks(0, radius + 1)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    due = []
    for level in range(MASK_LEVELS):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut_lineage(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        sized = rows.join(sizes, ["mask", "value"])
        if level == MASK_LEVELS - 1:
            parts = F.when(F.col("n") <= group_rows, 1).otherwise(F.ceil(F.col("n") / (group_rows // 2))).cast("long")
            due.append(sized.withColumn("parts", parts))
            break
        due.append(sized.where(F.col("n") <= group_rows).withColumn("parts", F.lit(1).cast("long")))
        if sizes.where(F.col("n") > group_rows).isEmpty():
            break
        children = {m: child_masks(m, radius + 1) for m in masks}
        of_mask = F.create_map(*[x for m, kids in children.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in kids]))])
        rows = sized.where(F.col("n") > group_rows).select("fp", F.explode(of_mask[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({k for kids in children.values() for k in kids})
    met = due[0]
    for more in due[1:]:
        met = met.unionByName(more)
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: j != F.col("part")))
    dealt = met.withColumn("part", part).withColumn("other", F.explode(other))
    dealt = dealt.select("mask", "value", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fp")
    key = ["mask", "value", "x", "y"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(radius), "a long, b long")


def group_documents(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least id that links reach) and n_same (rows with this very fingerprint) of every row."""
    rows = cut_lineage(fingerprint_texts(docs, words, id_col, text_col))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_same")))
    labels = components(link_fingerprints(nodes.select("fp"), radius))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = named.join(smallest, "label").select("fp", "component_id", "n_same")
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")
