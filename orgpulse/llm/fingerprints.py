"""Document fingerprints: threshold-scaled sketches of byte shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. As
the threshold is the same for all texts, sketches of very unequal texts compare without
bias, and the sketch of several texts is the union of theirs. A fingerprint is the
sorted hashes as text, so equal texts have equal fingerprints.

A null text counts as an empty one. A text shorter than a shingle is one shingle. A text
none of whose hashes is below the threshold gets ``=`` and its digest: it is alike only
to equal texts. Very long texts have as long fingerprints. Repeated rows are rows of their
own; an empty table gives an empty result. Other columns are not read by the comparison and
kept by ``fingerprint_documents``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.llm.bytehash import gram_hash

SHINGLE_BYTES = 12
# One hash in so many is kept, for texts of any length; a power of two.
SCALE = 4
# Bytes of fingerprints that are handed to Spark at once.
YIELDED_BYTES = 8 << 20


def sketch(text: bytes, size: int = SHINGLE_BYTES, scale: int = SCALE) -> np.ndarray:
    """Distinct shingle hashes below 2**64 / scale, sorted, cut to the 32 bits that follow the leading zeros below the threshold."""
    hashes = gram_hash(np.frombuffer(text, np.uint8), min(size, len(text))) if text else np.empty(0, np.uint64)
    limit = np.uint64((1 << 64) // scale)
    return np.unique(hashes[hashes < limit] >> np.uint64(33 - scale.bit_length()))


def fingerprint(text: bytes, hashes: np.ndarray) -> str:
    if not len(hashes):
        return "=" + hashlib.sha256(text).hexdigest()[:24]
    return hashes.astype(">u4").tobytes().hex()


def parse(mark: str) -> np.ndarray:
    """Hashes of a fingerprint; none of an exact one."""
    if not mark or mark[0] == "=":
        return np.empty(0, np.uint64)
    return np.frombuffer(bytes.fromhex(mark), ">u4").astype(np.uint64)


def merge(marks: list[str]) -> str:
    """Fingerprint of texts taken together; exact ones have no hashes to add."""
    hashes = np.unique(np.concatenate([parse(m) for m in marks])) if marks else np.empty(0, np.uint64)
    return fingerprint(b"", hashes)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    """Share of all their shingles that two texts have in common (Jaccard), estimated from their sketches."""
    if equal:
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = _common(a, b)
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has, however much longer it is."""
    return _common(a, b) / len(a) if len(a) else 0.0


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with ``fingerprint``, which replaces a column of that name."""

    @F.pandas_udf("string")
    def mark(texts):
        raw = [t.encode() for t in texts.fillna("")]
        return texts.__class__([fingerprint(t, sketch(t)) for t in raw], dtype=object)

    return docs.withColumn("fingerprint", mark(F.col(text_col)))


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down, in code points) replaced by the first as many of the following one, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each beside the one after it in its bucket. A row from outside the bucket only follows, and ends it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held, rows, size = None, [], 0
    for batch in batches:
        for bucket, outside, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("bucket", "outside", "doc_id", "text")], strict=True):
            text = text or ""
            raw = text.encode()
            hashes = sketch(raw)
            row = (bucket, outside, doc_id, text, hashes, fingerprint(raw, hashes))
            if held is not None and held[0] == bucket and held[1] == 0:
                after = edited(held[3], text).encode()
                after_hashes = sketch(after)
                after_mark = fingerprint(after, after_hashes)
                rows.append((held[2], len(held[3]), hashlib.sha256(after).hexdigest(), held[5], after_mark, likeness(held[4], after_hashes, held[5] == after_mark), likeness(held[4], hashes, held[5] == row[5])))
                size += len(held[5]) + len(after_mark)
                if size >= YIELDED_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            held = row
    yield packed(rows)


def compare_with_edited(docs: DataFrame, rows_per_bucket: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The next document has the next smaller id; after the smallest comes the largest. Ids are
    cut into buckets at quantiles, each sorted by itself; the row that follows a bucket's
    last one is sent to both, so text travels once. Rows with equal ids are ordered by a
    hash of the text; null ids come after all others. A single row follows itself.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    total = ids.count()
    wanted = max(1, min(100_000, total // rows_per_bucket))
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 10 * wanted).alias("c")).first().c or [])) if wanted > 1 else []
    # Bucket 0 has the nulls and the smallest ids.
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_place(F.col("doc_id"), cuts))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Largest id of every bucket: a row a bucket, as many as there are cuts.
    tops = named.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    follows: dict[int | None, list[int]] = {}
    for below, above in zip(tops, tops[1:] + tops[:1], strict=True):
        follows.setdefault(below.top, []).append(above.bucket)
    # The first bucket is followed by the last one's top, so the list is walked upwards and around.
    extra = F.array().cast("array<int>")
    if follows:
        keys = [k for k in follows if k is not None]
        table = F.create_map(*[v for k in keys for v in (F.lit(k).cast("long"), F.array(*[F.lit(b) for b in follows[k]]))]) if keys else F.lit(None).cast("map<bigint,array<int>>")
        extra = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.try_element_at(table, F.col("doc_id")), extra)).otherwise(F.array(*[F.lit(b) for b in follows[None]]) if None in follows else extra)
    own = F.array(F.struct(bucket.cast("int").alias("bucket"), F.lit(0).alias("outside")))
    dealt = named.select("doc_id", "text", F.explode(F.concat(own, F.transform(extra, lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("outside"))))).alias("to"))
    dealt = dealt.select(F.col("to.bucket").alias("bucket"), F.col("to.outside").alias("outside"), "doc_id", "text")
    ordered = dealt.repartition(len(tops) or 1, "bucket").sortWithinPartitions("bucket", "outside", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return ordered.mapInArrow(_compare, RESULT)


def _place(value, cuts: list[int]):
    """Number of cuts up to a value, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(value >= cuts[mid], _place(value, cuts[mid + 1 :]) + (mid + 1)).otherwise(_place(value, cuts[:mid]))
