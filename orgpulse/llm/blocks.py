"""Documents in compressed blocks, and the buckets that blocks deal their parts to.

A block is one row with the texts of many documents, so that millions of shingles or
suffixes of a block travel as a few packed values. Blocks are checkpointed: what a block
sends out and gets back refers to places in it, which a recomputed scan could change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.bytehash import column_bytes
from orgpulse.session import cut_lineage

BLOCK_BYTES = 4 << 20
ROW_BITS = 20
BLOCK_SCHEMA = "block long, n_bytes long, ids binary, known binary, ends binary, texts binary"


def pack(values: np.ndarray, level: int = 3) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), level)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def deal_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: its documents' ids (and which are known), ends of their texts, and the texts. Longer texts are blocks of their own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), *[(c, pa.binary()) for c in ("ids", "known", "ends", "texts")]])
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            known = np.asarray(batch.column("id").is_valid())
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
                stop = min(stop, at + (1 << ROW_BITS), batch.num_rows)
                parts = (ids[at:stop], known[at:stop].astype(np.uint8), offsets[at + 1 : stop + 1] - offsets[at], data[offsets[at] : offsets[stop]])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(offsets[stop] - offsets[at])]), *[pa.array([pack(p)], pa.binary()) for p in parts]], schema=schema)
                number, at = number + 1, stop

    return cut_lineage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, BLOCK_SCHEMA))


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are known, bytes and offsets of a block's texts."""
    ends = unpack(row["ends"], "<i8")
    return unpack(row["ids"], "<i8"), unpack(row["known"], "u1").astype(bool), unpack(row["texts"], "u1"), np.concatenate([[0], ends]).astype(np.int64)


def bucket_count(blocks: DataFrame, bytes_each: int) -> int:
    """As many buckets as shuffle partitions, or more if the texts are larger than that many times ``bytes_each``."""
    total = blocks.agg(F.sum("n_bytes").alias("n")).first().n or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def slices(buckets: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins in a sorted array of bucket numbers, and the end."""
    return np.searchsorted(buckets, np.arange(n + 1))
