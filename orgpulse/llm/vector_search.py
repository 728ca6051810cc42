"""Approximate nearest neighbours by balanced posting lists.

Vectors are grouped in lists around centroids. A vector near a boundary is replicated to
several lists. A query finds its nearest centroids through a neighbour graph held in
memory, drops lists that are further than a ratio of the nearest, and is compared with
all vectors of the rest. Nearness is the inner product: with one more component that
gives all vectors the same length, the largest product is the smallest distance.

Equal vectors are one entry with its smallest ids, as many as a result can need, so a
vector that fills a third of a table is searched once. Long lists are cut into parts. Queries
go in chunks of much the same lists; a task reads such lists one after another and keeps each
query's best, so its rows follow the queries and not the lists they search. Vectors that are null, zero, hold null or
non-finite components, or don't have the commonest length take no part, nor do null ids.
Of rows with equal ids and different vectors each is a candidate of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.llm.blocks import pack, unpack
from orgpulse.session import cut_lineage

# Rows that the centroids are fitted on, and the most centroids (16 MB at 512 components).
FIT_ROWS = 32_768
MAX_LISTS = 4096
# Queries that the pruning ratio is measured on.
CALIBRATION_QUERIES = 128
# Queries of a task, and tasks that share the lists of a chunk of queries.
CHUNK_QUERIES = 1024
SLICES = 8


@dataclass
class ListIndex:
    """Centroids of unit-scaled, lengthened vectors, and for each the numbers of its neighbours in the graph."""

    centroids: np.ndarray
    graph: np.ndarray
    scale: float
    spread: float = 0.0  # mean squared distance of a vector from its centroid

    def lengthen(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x / self.scale
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return np.concatenate([x, extra[:, None]], axis=1)

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of about the ``beam`` nearest centroids of every row, nearest first; unused places are -1.

        Best-first search over the graph, a batch of rows at a time.
        """
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        c2 = (self.centroids**2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        starts = np.unique(np.linspace(0, k - 1, min(k, 2 * beam)).astype(int))
        seen[:, starts] = True
        number = np.broadcast_to(starts, (n, len(starts))).copy()
        distance = c2[starts] - 2 * x @ self.centroids[starts].T
        order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
        number, distance = np.take_along_axis(number, order, 1), np.take_along_axis(distance, order, 1)
        open_ = np.ones(number.shape, bool)
        rows = np.arange(n)
        while len(rows := rows[open_[rows].any(axis=1)]):
            at = np.argmax(open_[rows], axis=1)  # beams are sorted, so the first open one is the nearest
            open_[rows, at] = False
            near = self.graph[number[rows, at]]
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            d = np.where(fresh, c2[near] - 2 * np.einsum("rd,rgd->rg", x[rows], self.centroids[near]), np.inf)
            all_d = np.concatenate([distance[rows], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            distance[rows] = np.take_along_axis(all_d, order, 1)
            number[rows] = np.take_along_axis(np.concatenate([number[rows], near], axis=1), order, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), order, 1)
        return np.where(np.isfinite(distance), number, -1), np.maximum(0, distance + (x * x).sum(axis=1)[:, None])

    def lists_of(self, x: np.ndarray, replicas: int, slack: float, apart: float = 0.25) -> list[np.ndarray]:
        """Lists of every row: the nearest, and others nearly as near whose centroids aren't close to a chosen one."""
        number, d2 = self.nearest(x, max(16, 2 * replicas))
        out = []
        for own, dist in zip(number, d2, strict=True):
            chosen: list[int] = []
            for c, d in zip(own, dist, strict=True):
                if c < 0 or len(chosen) == replicas or d > slack * dist[0] + 1e-12 and chosen:
                    break
                if all(((self.centroids[c] - self.centroids[o]) ** 2).sum() >= apart * d for o in chosen):
                    chosen.append(int(c))
            out.append(np.array(chosen))
        return out

    def probes_of(self, x: np.ndarray, probes: int, ratio: float) -> list[np.ndarray]:
        """Lists to search for every row, of the ``probes`` nearest: those within the ratio of the nearest's distance, which counts as the usual distance at least."""
        number, d2 = self.nearest(x, probes)
        return [own[(own >= 0) & (dist <= ratio * max(dist[0], self.spread))] for own, dist in zip(number, d2, strict=True)]


def fit_index(sample: np.ndarray, lists: int, scale: float, degree: int = 24, rounds: int = 12) -> ListIndex:
    """Balanced k-means: in every round large lists look further away, so that their borders move inwards. Then the graph."""
    index = ListIndex(np.empty((0, 0)), np.empty((0, 0), int), scale)
    x = index.lengthen(sample)
    random = np.random.default_rng(7)
    lists = max(1, min(lists, len(x)))
    c = x[np.sort(random.choice(len(x), lists, replace=False))]
    weight, spread = np.zeros(lists), 0.0
    for _ in range(rounds):
        own, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 2048):  # distances of a slab at a time
            d = (c**2).sum(axis=1) - 2 * x[at : at + 2048] @ c.T
            own[at : at + 2048] = np.argmin(d + weight, axis=1)
            near[at : at + 2048] = d[np.arange(len(d)), own[at : at + 2048]]
        size = np.bincount(own, minlength=lists)
        spread = float(np.maximum(0, near + (x * x).sum(axis=1)).mean())
        weight += 0.05 * spread * np.log((size + 1) / (len(x) / lists + 1))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[random.integers(0, len(x), lists)])
    near = (c**2).sum(axis=1) - 2 * c @ c.T
    np.fill_diagonal(near, np.inf)
    degree = min(degree, lists - 1)
    graph = np.argsort(near, axis=1, kind="stable")[:, :degree]
    far = random.integers(0, lists, (lists, 4))  # a few long links, so that no part is cut off
    index.centroids, index.graph, index.spread = c, np.concatenate([graph, far], axis=1), spread
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _deal(rows: DataFrame, index: ListIndex, choose, columns: str) -> DataFrame:
    """Rows (id long, vec) once for each list that ``choose`` gives for a batch of them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = choose(_matrix(batch.column("vec")))
                take = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
                numbers = np.concatenate([np.asarray(x, np.int32) for x in lists]) if len(lists) else np.empty(0, np.int32)
                out = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([out.column("id"), out.column("vec"), pa.array(numbers.astype(np.int32))], names=["id", "vec", "list"])

    return rows.select("id", "vec").mapInArrow(deal, columns)


def _choose(rows: DataFrame, index: ListIndex, choose) -> DataFrame:
    """Rows (id long, vec) with the lists that ``choose`` gives for a batch of them, nearest first."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = choose(_matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array([np.asarray(x, np.int32) for x in lists], pa.list_(pa.int32()))], names=["id", "vec", "lists"])

    return rows.select("id", "vec").mapInArrow(deal, "id long, vec array<double>, lists array<int>")


def _packed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, part, id, vec) in the order of list and part as one packed value for each run of them in a batch."""
    for batch in batches:
        lists, parts = batch.column("list").to_numpy(), batch.column("part").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1])])) if len(lists) else []
        for at, end in zip(starts, [*starts[1:], len(lists)], strict=True):
            ids, vec = batch.column("id")[at:end].to_numpy(), _matrix(batch.column("vec")[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(lists[at : at + 1]), pa.array(parts[at : at + 1]), pa.array([[pack(np.concatenate([ids.view(np.float64), vec.ravel()]))]], pa.list_(pa.binary()))], names=["list", "part", "data"])


def _packed_chunk(table: pa.Table) -> pa.Table:
    ids, vec = table.column("id").to_numpy(), _matrix(table.column("vec").combine_chunks())
    lists = table.column("lists").to_pylist()
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
    numbers = np.concatenate([np.asarray(x, np.int64) for x in lists])
    data = [pack(x) for x in (ids, vec.ravel(), owner, numbers)]
    return pa.table({"chunk": table.column("chunk")[:1], "data": pa.array([data], pa.list_(pa.binary()))})


class Nearest:
    """The best entries found so far of each query of a chunk."""

    def __init__(self, data: list[bytes], keep: int):
        self.keep, self.ids = keep, unpack(data[0], "<i8")
        self.vec = unpack(data[1], "<f8").reshape(len(self.ids), -1)
        owner, numbers = unpack(data[2], "<i8"), unpack(data[3], "<i8")
        order = np.argsort(numbers, kind="stable")
        self.owner, self.numbers = owner[order], numbers[order]
        self.least = np.full(len(self.ids), -np.inf)
        self.query, self.entry, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def read(self, number: int, data: bytes) -> None:
        """Compare the queries that search a list with its vectors."""
        own = self.owner[slice(*np.searchsorted(self.numbers, [number, number + 1]))]
        if not len(own):
            return
        values = unpack(data, "<f8")
        n = len(values) // (self.vec.shape[1] + 1)
        ids, v = values[:n].view(np.int64), values[n:].reshape(n, -1)
        near = self.vec[own] @ v.T
        # Products by matrix differ from plain sums in the last bits, so whatever is that near is summed plainly.
        margin = 1e-12 * (np.abs(self.vec[own]) @ np.abs(v.T).max(axis=1) + 1e-300)
        least = self.least[own]
        if n > self.keep:
            least = np.maximum(least, np.partition(near, n - self.keep, axis=1)[:, n - self.keep] - margin)
        i, j = np.nonzero(near >= (least - margin)[:, None])
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            # Summed from the first component to the last, as a plain loop does.
            score = np.cumsum(self.vec[own[a]] * v[b], axis=1)[:, -1]
            self._offer(own[a], ids[b], score)

    def _offer(self, query: np.ndarray, entry: np.ndarray, score: np.ndarray) -> None:
        q, e, s = np.concatenate([self.query, query]), np.concatenate([self.entry, entry]), np.concatenate([self.score, score])
        order = np.lexsort((e, -s, q))
        q, e, s = q[order], e[order], s[order]
        # An entry that several lists hold comes with the same score.
        fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (e[1:] != e[:-1])]) if len(q) else np.empty(0, bool)
        q, e, s = q[fresh], e[fresh], s[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.keep - 1
        self.least[q[last]] = s[last]
        kept = place < self.keep
        self.query, self.entry, self.score = q[kept], e[kept], s[kept]

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.entry), pa.array(self.score)], names=["query", "entry", "score"])


def _compared(postings: DataFrame, queries: DataFrame, chunks: int, keep: int, part_rows: int) -> DataFrame:
    """query, entry and score of the best ``keep`` that each of SLICES tasks a chunk finds in its share of the chunk's lists.

    A task reads lists one after another and gives each query's best of all of them, so rows
    follow the number of queries, however many lists they search.
    """
    sizes = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"))
    parts = postings.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("list", "part", "id", "vec")
    blocks = parts.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(_packed_lists, "list int, part long, data array<binary>")
    wanted = queries.select("chunk", F.explode("lists").alias("list")).distinct()
    lists = blocks.join(wanted, "list").select("chunk", F.pmod(F.xxhash64("list", "part"), F.lit(SLICES)).cast("int").alias("slice"), F.lit(1).alias("side"), "list", "data")
    every = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice")
    heads = queries.groupBy("chunk").applyInArrow(_packed_chunk, "chunk int, data array<binary>").select("chunk", every, F.lit(0).alias("side"), F.lit(-1).alias("list"), "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = None
        for batch in batches:
            for side, number, data in zip(batch.column("side").to_pylist(), batch.column("list").to_pylist(), batch.column("data"), strict=True):
                if side == 0:
                    if nearest:
                        yield nearest.result()
                    nearest = Nearest(data.as_py(), keep)
                else:
                    nearest.read(number, data.as_py()[0])
        if nearest:
            yield nearest.result()

    tiles = heads.union(lists).repartition(chunks * SLICES, "chunk", "slice").sortWithinPartitions("chunk", "slice", "side", "list")
    return tiles.mapInArrow(compare, "query long, entry long, score double")


def _calibrate(entries: DataFrame, postings: DataFrame, asked: DataFrame, index: ListIndex, k: int, recall: float) -> tuple[float, int]:
    """Ratio within which the given share of true neighbours is found, and lists that it takes at most (with a margin)."""
    sample = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_QUERIES).select("id", "vec").toArrow()
    if not sample.num_rows:
        return 1.0, 1
    own, q = sample.column("id").to_numpy(), _matrix(sample.column("vec").combine_chunks())

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            scores = q @ _matrix(batch.column("vec")).T
            scores[own[:, None] == ids] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query", "id", "score"])

    found = entries.select("id", "vec").mapInArrow(top, "query long, id long, score double").where("score > double('-inf')")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    true = found.withColumn("n", place).where(F.col("n") <= k).select("query", "id")
    held = F.broadcast(true).join(postings.select("id", "list"), "id").groupBy("query", "id").agg(F.collect_set("list").alias("lists")).collect()
    x = index.lengthen(q, query=True)
    d = np.maximum(0, (index.centroids**2).sum(axis=1) - 2 * x @ index.centroids.T + (x * x).sum(axis=1)[:, None])
    d /= np.maximum(d.min(axis=1), index.spread)[:, None] + 1e-12
    row_of = {int(i): n for n, i in enumerate(own)}
    needed = np.sort([d[row_of[r.query], r.lists].min() for r in held])
    if not len(needed):
        return 1.0, 1
    ratio = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) * (1 + 1e-9)
    return ratio, int(min(len(index.centroids), 1.25 * (d <= ratio).sum(axis=1).max() + 8))


def search(vectors: DataFrame, is_query, k: int = 20, rows_per_list: int = 128, replicas: int = 4, slack: float = 1.1, recall: float = 0.96,
           part_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products found for every query row, itself left out; ties go to smaller ids.

    ``recall``: share of true neighbours that the pruning ratio is set for, on CALIBRATION_QUERIES queries compared with all rows.
    """
    spark = vectors.sparkSession
    x = F.col("vec")
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    fit = plain.where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).where(F.exists(x, lambda c: c != 0))
    lengths = fit.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    usable = fit.where(F.size("vec") == lengths.length).select("id", F.transform("vec", lambda c: c + F.lit(0.0)).alias("vec"), "is_query")
    # One entry for equal vectors, named by its smallest id, with the k + 1 smallest ids.
    first = usable.groupBy("vec").agg(F.min("id").alias("entry"))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = usable.select("vec", "id", place.alias("n")).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("members"))
    entries = cut_lineage(few.select(F.col("members")[0].alias("id"), "vec", "members"))
    queries = cut_lineage(usable.where("is_query").select(F.col("id").alias("query_id"), "vec").join(first, "vec").select("query_id", "entry"))
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))).alias("top")).first()
    lists = int(min(MAX_LISTS, max(1, facts.n // rows_per_list)))
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").toArrow().column("vec").combine_chunks()
    index = fit_index(_matrix(sample), lists, float(facts.top))
    shape = "id long, vec array<double>, list int"
    postings = cut_lineage(_deal(entries, index, lambda m: index.lists_of(index.lengthen(m), replicas, slack), shape))
    asked = entries.join(queries.select(F.col("entry").alias("id")).distinct(), "id", "left_semi")
    ratio, probes = _calibrate(entries, postings, asked, index, k, recall)
    probed = cut_lineage(_choose(asked, index, lambda m: index.probes_of(index.lengthen(m, query=True), probes, ratio)))
    chunks = -(-max(1, probed.count()) // CHUNK_QUERIES)
    # Queries whose nearest lists are next to each other search much the same lists.
    dealt = probed.repartitionByRange(chunks, F.element_at("lists", 1), "id")
    dealt = cut_lineage(dealt.select(F.spark_partition_id().alias("chunk"), "id", "vec", "lists"))
    pairs = _compared(postings, dealt, chunks, k + 1, part_rows)
    best = pairs.groupBy("query", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    named = best.join(entries.select(F.col("id").alias("entry"), "members"), "entry").select("query", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = cut_lineage(named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1))
    full = queries.join(named, queries.entry == named["query"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("n"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
