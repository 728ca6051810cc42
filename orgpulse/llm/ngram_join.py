"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. In an order of all shingles from rare to
frequent, two sets with enough in common share at least l of the first
n - ceil(t * n) + l shingles, for any l. Each document chooses its l: a longer prefix
means more postings but asks for more shared shingles before a pair is verified, and the
l of least estimated cost wins. A pair is a candidate if it shares as many prefix
shingles as the smaller of its two l, raised by what its two sizes say that a linked
pair shares beyond the least that a partner of any size would.

How rare a shingle is, is counted over all documents. Blocks of documents send each
bucket the shingles they have, as packed sorted numbers, and get back those that more
than one document has. Shingles of a single document can't be shared and get no posting.

Groups of copies don't become all their pairs. Equal sets are one class. Of the classes
in a posting list each is verified against one, the hub; linked ones are one group.
Further candidates are only pairs of different groups whose distances to the hub differ
by no more than linked sets can (Jaccard distance is a metric). So every link between
different groups is verified, and none can be lost.

Rows with a null id are linked with nothing and have a null component; ``keep_one``, which
chooses rows and not ids, compares them like others. Rows without words (null, empty or blank texts) are components of their own.
Rows with equal ids are nodes of their own; each gets the smallest id it reaches. Very long
texts are blocks of their own. An empty table gives an empty result. Other columns are only
carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.blocks import ROW_BITS, bucket_count, deal_blocks, open_block, pack, slices, unpack
from orgpulse.llm.bytehash import word_shingles
from orgpulse.llm.components import components
from orgpulse.session import cut_lineage

# Text bytes whose shingles one bucket counts, longest choice of l, and the cost of verifying a pair in postings read.
BUCKET_BYTES = 16 << 20
MATCHES = 16
VERIFY_COST = 8.0

DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("shingles", pa.binary()), ("counts", pa.binary())])
COUNTED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
SETS = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])


def _placed(shingles: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, lower half) numbers of a block's shingles in order, where each shingle's is, and how many documents have it.

    Shingles of one bucket with equal lower halves are counted as one; that only changes where they come in the order.
    """
    bucket = ((shingles >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.unique(bucket << np.uint64(32) | shingles & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)


def _deal(words: int, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, data, offsets = open_block(row)
                shingles, _ = word_shingles(data, offsets, words)
                keys, _, counts = _placed(shingles, buckets)
                cut = slices((keys >> np.uint64(32)).astype(np.int64), buckets)
                low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out = [(b, row["block"], pack(np.diff(low[i:j], prepend=np.uint32(0))), pack(counts[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DEALT, strict=True)], schema=DEALT)

    return deal


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block the places of its shingles that other documents have too, and how many have them."""
    blocks = table.column("block").to_pylist()
    lows = [np.cumsum(unpack(s.as_py(), "<u4"), dtype=np.uint32) for s in table.column("shingles")]
    counts = np.concatenate([unpack(c.as_py(), "<u4") for c in table.column("counts")])
    every = np.concatenate(lows)
    order = np.argsort(every, kind="stable")
    fresh = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(fresh))
    df = np.empty(len(every), np.int64)
    df[order] = total[np.cumsum(fresh) - 1]
    ends = np.cumsum([len(x) for x in lows])
    bucket, rows = table.column("bucket")[0].as_py(), []
    for block, i, j in zip(blocks, [0, *ends[:-1]], ends, strict=True):
        places = np.flatnonzero(df[i:j] > 1)
        if len(places):
            rows.append((block, bucket, pack(np.diff(places.astype(np.uint32), prepend=np.uint32(0))), pack(np.minimum(df[i:j][places], 0xFFFFFFFF).astype(np.uint32))))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, COUNTED, strict=True)], schema=COUNTED)


def choose_matches(df: np.ndarray, n: int, need: int) -> tuple[int, int]:
    """The l of least estimated cost and its prefix length, for a set of n shingles in order with document counts ``df``, of which linked sets share ``need``.

    The postings that share a prefix shingle are read; at most that number divided by l can be candidates.
    """
    most = max(1, min(MATCHES, need))
    read = np.cumsum(df - 1)[n - need : n - need + most].astype(float)
    matches = int(np.argmin(read * (1 + VERIFY_COST / np.arange(1, len(read) + 1)))) + 1
    return matches, n - need + matches


def _prefixes(words: int, percent: int, buckets: int, unknown_ids: bool):
    def prefixes(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            ids, known, data, offsets = open_block(row)
            shingles, ends = word_shingles(data, offsets, words)
            keys, where, _ = _placed(shingles, buckets)
            cut = slices((keys >> np.uint64(32)).astype(np.int64), buckets)
            df = np.ones(len(keys), np.int64)
            for back in counted.to_pylist():
                df[cut[back["bucket"]] + np.cumsum(unpack(back["places"], "<u4"), dtype=np.int64)] = unpack(back["counts"], "<u4")
            for i in range(len(ids)):
                own = shingles[ends[i] : ends[i + 1]]
                n, doc_id = len(own), int(ids[i]) if known[i] else None
                digest = hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()
                if not n or doc_id is None and not unknown_ids:
                    rows.append((row["block"] << ROW_BITS | i, doc_id, n, digest, None, None, None, None))
                    continue
                counts = df[where[ends[i] : ends[i + 1]]]
                order = np.lexsort((own, counts))
                matches, length = choose_matches(counts[order], n, -(-percent * n // 100))
                prefix = own[order[:length]][counts[order[:length]] > 1]
                shared = len(prefix) > 0
                content = hashlib.sha256(own.tobytes()).digest()[:16]
                rows.append((row["block"] << ROW_BITS | i, doc_id, n, digest, content, matches, prefix.view(np.int64) if shared else None, own.view(np.int64) if shared else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, SETS, strict=True)], schema=SETS)

    return prefixes


def document_sets(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, unknown_ids: bool) -> DataFrame:
    """One row a document: node, doc_id, n_shingles, digest (MD5 of the text), content (digest of the set), and for those that share a prefix shingle the l, prefix and whole set."""
    blocks = deal_blocks(docs, id_col, text_col)
    buckets = bucket_count(blocks, BUCKET_BYTES)
    dealt = blocks.mapInArrow(_deal(words, buckets), "bucket int, block long, shingles binary, counts binary")
    counted = dealt.groupBy("bucket").applyInArrow(_count, "block long, bucket int, places binary, counts binary")
    schema = "node long, doc_id long, n_shingles long, digest binary, content binary, matches int, prefix array<long>, shingles array<long>"
    return cut_lineage(blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_prefixes(words, percent, buckets, unknown_ids), schema))


def _near_in_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their intersection and union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("_a", "_b")))
    return joined.withColumn("all", F.size("_a") + F.size("_b") - F.col("common")).drop("_a", "_b")


def link_classes(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that make up every component of the full set of links."""
    postings = classes.select("node", "n_shingles", "matches", F.explode("prefix").alias("shingle"))
    hubs = postings.groupBy("shingle").agg(F.min(F.struct("node", "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = cut_lineage(postings.join(hubs.select("shingle", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("hub_n")), "shingle"))
    stars = listed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "hub_n", "n_shingles").distinct()
    tried = cut_lineage(_verified(stars.where(_near_in_size(F.col("hub_n"), F.col("n_shingles"), percent)).select("a", "b"), classes))
    linked = tried.where(F.col("common") * 100 >= F.col("all") * percent).select("a", "b")
    labels = components(linked)
    # Distance to the hub: known if tried, else at least what the sizes tell.
    apart = (1 - F.col("common") / F.col("all")).alias("apart")
    known = listed.join(tried.select(F.col("a").alias("hub"), F.col("b").alias("node"), apart), ["hub", "node"], "left").join(labels, "node", "left")
    low = F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.coalesce("apart", 1 - F.least("hub_n", "n_shingles") / F.greatest("hub_n", "n_shingles")))
    high = F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.coalesce("apart", F.lit(1.0)))
    members = known.select("shingle", "node", "n_shingles", "matches", F.coalesce("label", "node").alias("label"), low.alias("low"), high.alias("high"))
    mixed = members.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle")
    open_ = cut_lineage(members.join(mixed, "shingle").join(classes.select("node", "prefix"), "node"))
    slack = 1 - percent / 100 + 1e-9
    a, b = open_.alias("a"), open_.alias("b")
    meet = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    meet &= (F.col("a.low") <= F.col("b.high") + slack) & (F.col("b.low") <= F.col("a.high") + slack)
    meet &= _near_in_size(F.col("a.n_shingles"), F.col("b.n_shingles"), percent)
    # Sizes of both tell how many shingles a linked pair shares, so how many of these prefixes it must;
    # the first shared one alone gives the pair.
    both = F.array_intersect("a.prefix", "b.prefix")
    shared = F.ceil((F.col("a.n_shingles") + F.col("b.n_shingles")) * percent / (100 + percent) - 1e-9)
    spare = [F.ceil(F.col(f"{x}.n_shingles") * percent / 100 - 1e-9) - F.col(f"{x}.matches") for x in "ab"]
    meet &= (F.element_at(both, 1) == F.col("a.shingle")) & (F.size(both) >= shared - F.greatest(*spare))
    pairs = a.join(b, meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    more = _verified(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), classes).where(F.col("common") * 100 >= F.col("all") * percent)
    return linked.union(more.select("a", "b"))


def labelled_documents(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, unknown_ids: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest, and label of every document: the smallest node of its component, null for one without links.

    Rows with a null id are linked only if ``unknown_ids`` says so.
    """
    rows = document_sets(docs, words, percent, id_col, text_col, unknown_ids)
    own = rows.where("content IS NOT NULL AND prefix IS NOT NULL")
    firsts = own.groupBy("content").agg(F.min("node").alias("node"))
    classes = cut_lineage(own.drop("content").join(firsts.drop("content"), "node").select("node", "n_shingles", "matches", "prefix", "shingles"))
    labels = components(link_classes(classes, percent))
    named = firsts.join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("label"))
    return rows.select("doc_id", "n_shingles", "digest", "content").join(named, "content", "left").drop("content")


def link_documents(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document; linked are sets with 100 * intersection >= percent * union."""
    rows = labelled_documents(docs, words, percent, id_col, text_col)
    smallest = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(smallest, "label", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of each component one: that with the smallest known id, of those the one with the least digest of its text, of repeated rows any.

    Rows without words stay, each of them.
    """
    rows = cut_lineage(labelled_documents(docs, words, percent, id_col, text_col, unknown_ids=True).where("n_shingles > 0"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    chosen = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("x")).select("x.doc_id", "x.digest")
    alone = rows.where("label IS NULL").select("doc_id", "digest")
    kept = chosen.union(alone).select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    # How many rows have a kept id and text: only repeated ones need a choice, and those meet after a fold on the map side.
    times = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.join(times, kept.kept_id.eqNullSafe(times.doc_id) & (kept.kept_digest == times.digest)).select("kept_id", "kept_digest", "n")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("digest"), text.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    found = whole.where("worded").join(kept, F.col("id").eqNullSafe(kept.kept_id) & (F.col("digest") == kept.kept_digest))
    once = found.where("n > 1").groupBy("id", "digest").agg(F.first("row").alias("row"))
    return whole.where("NOT worded").select("row").union(found.where("n = 1").select("row")).union(once.select("row")).select("row.*")
