"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenizers' tokens are spans of the bytes of a space and the text. In a batch of
documents every token start finds the other side's covering token by an as-of merge, keyed
by document; both directions together are all overlapping pairs, and common ends cut the
tokens into groups.

In how many documents two ids are linked is counted over the whole corpus: a block of
documents gives each distinct pair once with its number of documents, Spark adds those up
and returns to every block the counts of its own pairs, and whether a count is the highest
of its first id. Blocks are checkpointed, so texts are encoded once.

A text that is null, empty, or whose joined tokens of either side aren't the space and the
text (the second tokenizer may normalise) has no tokens: zeros, and '' for the groups. Rows
with equal or null ids stay rows of their own, and each counts as a document. Very long texts
are encoded whole, by themselves. An empty table gives an empty result. Other columns than id
and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.blocks import pack, unpack
from orgpulse.session import cut_lineage

# Characters of the texts of a block, and of those that are encoded at once.
BLOCK_CHARS = 4 << 20
STEP_CHARS = 1 << 19
# A pair of ids is one number. What is left of 64 bits numbers the documents of a step.
ID_BITS = 24
STEP_ROWS = 8192
_LOADED: dict[tuple[str, str], Pair] = {}


def byte_level_alphabet() -> dict[str, int]:
    """The byte of every character of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Bytes of every id, their lengths, and the ids as text before a comma and before the sign that ends a side of a group."""

    entries: list[bytes]
    lengths: np.ndarray
    shown: np.ndarray

    @staticmethod
    def of(entries: list[bytes], end: str) -> Vocabulary:
        shown = np.array([[f"{i}{sign}" for i in range(len(entries))] for sign in (",", end)], object)
        return Vocabulary(entries, np.array([len(e) for e in entries], np.int64), shown)


def rank_encoder(json_path: str) -> tiktoken.Encoding | None:
    """The same tokenizer by ranks, four times as fast: for a plain byte-level BPE whose merges make ids in rising order, else None."""
    with open(json_path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole["pre_tokenizer"] or {}
    options = [whole["normalizer"], *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if model["type"] != "BPE" or any(options) or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    added = {t["content"] for t in whole["added_tokens"]}
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
    alphabet = byte_level_alphabet()
    if made != sorted(made) or len(made) + len(alphabet) != len(model["vocab"].keys() - added):
        return None
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
    return tiktoken.Encoding(json_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Both tokenizers of a worker: a byte-level BPE in JSON (A) and a piece model with byte fallback (B)."""

    def __init__(self, json_path: str, model_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        self.a = tokenizers.Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True
        self.ranked = rank_encoder(json_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        alphabet = byte_level_alphabet()
        pieces = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.vocab_a = Vocabulary.of([bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p in pieces], "|")
        self.vocab_b = Vocabulary.of([self.piece_bytes(i) for i in range(self.b.get_piece_size())], ";")

    def piece_bytes(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; both empty where the bytes of a side aren't those of the space and the text."""
        asked = [t for t in texts if t]
        ids_a = self.encode_a([" " + t for t in asked])
        ids_b = self.b.encode(asked, num_threads=1) if asked else []
        whole = [(" " + t).encode() for t in asked]
        bytes_a, bytes_b = self.vocab_a.entries.__getitem__, self.vocab_b.entries.__getitem__
        same = [b"".join(map(bytes_a, x)) == w and b"".join(map(bytes_b, y)) == w for x, y, w in zip(ids_a, ids_b, whole, strict=True)]
        found = iter(zip(ids_a, ids_b, same, strict=True))
        out = [next(found) if t else ([], [], False) for t in texts]
        return [x if ok else [] for x, _, ok in out], [y if ok else [] for _, y, ok in out]


def pair_of(json_path: str, model_path: str) -> Pair:
    """The worker's tokenizers of files that every machine has."""
    if (json_path, model_path) not in _LOADED:
        _LOADED[json_path, model_path] = Pair(json_path, model_path)
    return _LOADED[json_path, model_path]


def spans(ids: list[list[int]], vocabulary: Vocabulary) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A batch's tokens in order: document, where they begin in the batch's joined bytes, and number; their ids and ends."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum()))
    lengths = vocabulary.lengths[flat]
    ends = np.cumsum(lengths)
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), sizes), "at": ends - lengths, "number": np.arange(len(flat))}), flat, ends


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every pair of tokens whose bytes overlap.

    Batches begin every document at the same byte on both sides, so the last token of the
    other side that begins no later in the same document is the covering one.
    """
    forth = pd.merge_asof(a, b, on="at", by="doc", suffixes=("_a", "_b"))
    back = pd.merge_asof(b, a, on="at", by="doc", suffixes=("_b", "_a"))
    # Tokens that begin together are found from both sides.
    covering = back["number_a"].to_numpy()
    fresh = back["at"].to_numpy() != a["at"].to_numpy()[covering] if len(a) else np.empty(0, bool)
    return np.concatenate([forth["number_a"].to_numpy(), covering[fresh]]), np.concatenate([forth["number_b"].to_numpy(), back["number_b"].to_numpy()[fresh]])


def groups(doc: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of groups of every document, and the group of each token of a and of b (numbered over the batch)."""
    common = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a] if len(ends_a) else ends_a
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    return np.bincount(doc[np.searchsorted(ends_a, common)], minlength=n_docs), group_a, group_b


def digests(pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: np.ndarray) -> list[str]:
    """SHA-256 of every document's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens. ``sizes`` has the tokens of both sides in each document."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_b, until_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
    parts = np.empty(len(ids_a) + len(ids_b), object)
    parts[np.arange(len(ids_a)) + before_b[group_a]] = pair.vocab_a.shown[last_a.astype(int), ids_a]
    parts[np.arange(len(ids_b)) + until_a[group_b]] = pair.vocab_b.shown[last_b.astype(int), ids_b]
    ends = np.cumsum(sizes)
    out = []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        out.append(hashlib.sha256("".join(parts[begin:end])[:-1].encode()).hexdigest() if end > begin else "")
    return out


BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("links", pa.binary()), ("codes", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _steps(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of runs of rows of up to so many characters, one row at least."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < min(len(texts), at + STEP_ROWS) and (stop == at or size + len(texts[stop]) <= chars):
            size += len(texts[stop])
            stop += 1
        yield batch.column("doc_id").slice(at, stop - at), texts[at:stop]
        at = stop


def _blocks(json_path: str, model_path: str, block_chars: int):
    """Blocks of documents: their own results, each document's distinct pairs (place in the block's and how often), and the block's pairs with their number of documents."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(json_path, model_path)
        number = TaskContext.get().partitionId() << 32
        rows: list[pa.RecordBatch] = []
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held
            docs = pa.Table.from_batches(rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs)
            counts, codes, times = (np.concatenate(x) for x in zip(*links, strict=True))
            own, place = np.unique(codes, return_inverse=True)
            packed = pack(np.concatenate([[len(counts)], counts, place, times]).astype(np.uint32))
            block = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([packed], pa.binary()), pa.array([own], pa.list_(pa.int64())), pa.array([np.bincount(place, minlength=len(own))], pa.list_(pa.int64()))], schema=BLOCK)
            number, held = number + 1, 0
            rows.clear()
            links.clear()
            return block

        for batch in batches:
            for ids, texts in _steps(batch, STEP_CHARS):
                n = len(texts)
                ids_a, ids_b = pair.encode(texts)
                (a, flat_a, ends_a), (b, flat_b, ends_b) = spans(ids_a, pair.vocab_a), spans(ids_b, pair.vocab_b)
                doc_a = a["doc"].to_numpy()
                n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(b["doc"].to_numpy(), minlength=n)
                from_a, from_b = overlaps(a, b)
                n_groups, group_a, group_b = groups(doc_a, ends_a, ends_b, n)
                sha = digests(pair, flat_a, flat_b, group_a, group_b, n_a + n_b)
                doc, code = doc_a[from_a], flat_a[from_a] << ID_BITS | flat_b[from_b]
                once, times = np.unique(doc << 2 * ID_BITS | code, return_counts=True)
                links.append((np.bincount(once >> 2 * ID_BITS, minlength=n), once & ((1 << 2 * ID_BITS) - 1), times))
                columns = [ids, pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(np.bincount(doc, minlength=n)), pa.array(sha)]
                rows.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, DOCS, strict=True)], schema=DOCS))
                held += sum(map(len, texts))
                if held >= block_chars:
                    yield close()
        if rows:
            yield close()

    return align


def _score(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus' counts of their pairs."""
    out = []
    for row in blocks.to_pylist():
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        packed = unpack(row["links"], "<u4").astype(np.int64)
        n = int(packed[0])
        sizes, place, times = packed[1 : n + 1], *np.split(packed[n + 1 :], 2)
        doc = np.repeat(np.arange(n), sizes)
        order = np.argsort(counted.column("code").to_numpy(), kind="stable")  # places are in the order of codes
        count, best = counted.column("n").to_numpy()[order], counted.column("best").to_numpy()[order]
        sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        np.add.at(sums[0], doc, times * best[place])
        np.add.at(sums[1], doc, times * count[place])
        out.append(docs.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])))
    return pa.concat_tables(out).select([c.split()[0] for c in RESULT.split(", ")])


def align_documents(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = cut_lineage(plain.mapInArrow(_blocks(json_path, model_path, block_chars), "block long, docs binary, links binary, codes array<long>, n_docs array<long>"))
    each = blocks.select(F.col("block").alias("of_block"), F.explode(F.arrays_zip("codes", "n_docs")).alias("x")).select("of_block", F.col("x.codes").alias("code"), F.col("x.n_docs").alias("n_docs"))
    counted = each.select("of_block", "code").join(pair_counts(each), "code")
    return blocks.select("block", "docs", "links").groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_score, RESULT)


def pair_counts(each: DataFrame) -> DataFrame:
    """Of parts (code, n_docs): code, n documents that hold the pair linked, and best (1 if no other pair of its first id has more)."""
    total = each.groupBy("code").agg(F.sum("n_docs").alias("n")).withColumn("a_id", F.shiftright("code", ID_BITS))
    most = total.groupBy("a_id").agg(F.max("n").alias("most"))
    return total.join(most, "a_id").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
