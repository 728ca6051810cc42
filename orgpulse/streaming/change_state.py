"""Versions of records as they change, from keyed state instead of a scan of the stored log.

Each key holds the tracked values of its newest version and the rows that may still be overtaken
by earlier ones. An event-time timer fires when the watermark has passed a waiting row; then all
rows up to the watermark are compared in their own order, each with the one before. So two changes
in one micro-batch give two versions, and the result depends neither on how rows are cut into
batches nor on their order of arrival within ``delay``. Rows later than that are left out, as
everywhere behind a watermark.

What a key holds is one version and its rows of the last ``delay``, each as pickled tuples, many
rows to a value. Tracked values are compared as they are, not by a hash.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Time of rows that only move the watermark, see ``closing_row``.
CLOSING_TIME = "9999-01-01 00:00:00"
# Waiting rows of a key that make one value of its state: a call to the state store costs far more than a row.
HELD_TOGETHER = 1_000


def use_rocksdb(spark: SparkSession) -> None:
    """State with several variables a key needs the RocksDB state store; queries started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def versions(schema: T.StructType, cols: Sequence[str], order: Sequence[str]) -> StatefulProcessor:
    """Processor that gives the rows of a key whose tracked columns differ from those of the row before.

    The class is made here so that it travels by value: the worker that sets state up on the driver
    need not find this package.
    """

    names = schema.fieldNames()
    at = names.index("_ms")
    tracked = [names.index(c) for c in cols]
    sorting = [names.index(c) for c in order]
    given = [i for i, n in enumerate(names) if n != "_ms"]
    version = Row(*[names[i] for i in given])

    class Versions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # Each element is a pickled pair: the newest version (or None) and rows that wait.
            self.held = handle.getListState("held", "held binary")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs()
            fresh = (tuple(r) for r in rows if r[at] > passed)
            first = None
            while some := list(itertools.islice(fresh, HELD_TOGETHER)):
                self.held.appendValue((pickle.dumps((None, some)),))
                lowest = min(r[at] for r in some)
                first = lowest if first is None else min(first, lowest)
            if first is not None:
                self.handle.registerTimer(first)
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs()
            before, rows = None, []
            for (element,) in self.held.get():
                newest, some = pickle.loads(element)
                before = before if newest is None else newest
                rows += some
            # A missing value comes before all others.
            due = sorted((r for r in rows if r[at] <= passed), key=lambda r: [(r[i] is not None, r[i]) for i in sorting])
            # Another timer of this key came first; rows that still wait have timers of their own.
            if not due:
                return
            left = [r for r in rows if r[at] > passed]
            for row in due:
                now = tuple(row[i] for i in tracked)
                if now != before:
                    before = now
                    yield version(*[row[i] for i in given])
            parts = [left[i : i + HELD_TOGETHER] for i in range(0, len(left), HELD_TOGETHER)]
            self.held.put([(pickle.dumps(held),) for held in [(before, []), *((None, some) for some in parts)]])
            if left:
                self.handle.registerTimer(min(r[at] for r in left))

        def close(self) -> None:
            pass

    return Versions()


def changed_since(stream: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str, order: Sequence[str], delay: str) -> DataFrame:
    """Rows of a stream at which one of ``cols`` changes for their key, in the order of ``ts`` and then ``order``.

    The first row of a key counts as a change. Append mode: a version is given once, as soon as the
    watermark (the newest time less ``delay``) has passed it.
    """
    use_rocksdb(stream.sparkSession)
    # The closing row is taken out behind the watermark, which it moves; the condition is on the time so that it stays there.
    rows = stream.withWatermark(ts, delay).where(F.col(ts) < F.lit(CLOSING_TIME).cast("timestamp"))
    rows = rows.withColumn("_ms", F.unix_millis(ts))
    out = T.StructType([f for f in rows.schema if f.name != "_ms"])
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    return rows.groupBy(*keys).transformWithState(versions(plain, list(cols), [ts, *order]), out, "append", "eventTime")


def closing_row(spark: SparkSession, schema: T.StructType, ts: str) -> DataFrame:
    """One row that tells a stream of ``schema`` that nothing comes after it: it moves the watermark past all rows and is in no result."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    empty = spark.createDataFrame([tuple(None for _ in schema)], nullable)
    return empty.withColumn(ts, F.lit(CLOSING_TIME).cast("timestamp").cast(schema[ts].dataType))
