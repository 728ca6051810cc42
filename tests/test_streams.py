"""Streams against the batch result: any cut into batches, any order within the delay, late rows, days that settle."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.sources import versioned
from orgpulse.streaming import change_state, incremental, windows

START = datetime(2024, 1, 1)
SHAPE = "id long, who string, kind string, ts timestamp"


class Inbox:
    """A folder that a stream reads, one file a micro-batch."""

    def __init__(self, spark, folder):
        self.spark, self.path, self.out = spark, f"file://{folder}/in", f"file://{folder}/out"
        self.checkpoint, self.n = f"file://{folder}/checkpoint", 0
        spark.createDataFrame([], SHAPE).write.parquet(self.path)

    def put(self, rows):
        self.spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(self.path)

    def close(self):
        change_state.closing_row(self.spark, self.stream().schema, "ts").coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture()
def inbox(spark, tmp_path):
    return Inbox(spark, tmp_path)


def at(hours):
    return START + timedelta(hours=hours)


def changes(inbox):
    rows = change_state.changed_since(inbox.stream(), ["who"], ["kind"], "ts", ["id"], "12 hours")
    incremental.run_available(rows, lambda batch, i: incremental.append_batch(batch, inbox.out, i), inbox.checkpoint, "append")
    found = incremental.read_if_exists(inbox.spark, inbox.out)
    return [] if found is None else sorted(r.id for r in found.collect())


def expected_changes(rows):
    out, last = [], {}
    for id_, who, kind, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if who not in last or last[who] != kind:
            out.append(id_)
        last[who] = kind
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 4])
def test_versions_do_not_depend_on_batches_or_order(inbox, cuts):
    rnd = random.Random(cuts)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), at(i / 2)) for i in range(80)]
    # Rows arrive up to six hours late.
    arriving = sorted(rows, key=lambda r: r[3] + timedelta(hours=rnd.random() * 6))
    step = len(rows) // cuts
    for i in range(0, len(rows), step):
        inbox.put(arriving[i : i + step])
        changes(inbox)
    inbox.close()
    assert changes(inbox) == expected_changes(rows)


def test_two_changes_in_one_batch_are_two_versions_and_late_rows_are_left_out(inbox):
    inbox.put([(1, "a", "x", at(0)), (2, "a", "y", at(1)), (3, "a", "y", at(2)), (4, "a", "x", at(3)), (5, "b", "x", at(40))])
    assert changes(inbox) == [1, 2, 4]  # the newest row is still within the delay
    inbox.put([(6, "a", "z", at(2)), (7, "a", "x", at(41))])
    assert changes(inbox) == [1, 2, 4]
    inbox.close()
    assert changes(inbox) == [1, 2, 4, 5]  # 6 came too late, 7 is what 4 was


def test_sliding_windows_of_several_batches(inbox):
    rows = [(i, "abc"[i % 3], "x", at(i * 7)) for i in range(40)]
    random.Random(1).shuffle(rows)
    measures = {"n": F.count(F.lit(1)), "last": F.max("id")}
    for i in range(0, 40, 10):
        inbox.put(rows[i : i + 10])
        windows.keep_sliding(inbox.stream(), "ts", "3 days", "1 day", "60 days", ["who"], measures, inbox.out, inbox.checkpoint)
    batch = windows.sliding(inbox.spark.createDataFrame(rows, SHAPE), "ts", "3 days", "1 day", ["who"], measures)
    stored = versioned.read(inbox.spark, inbox.out).drop("_batch")
    assert stored.count() == batch.count() and stored.exceptAll(batch.select(stored.columns)).count() == 0


def test_sessions_that_late_rows_join(inbox):
    hours = [0, 1, 9, 4.5, 30, 31, 33, 32, 60]  # 4.5 joins what 1 and 9 are apart
    rows = [(i, "a", "x", at(h)) for i, h in enumerate(hours)]

    def run():
        windows.keep_sessions(inbox.stream(), "ts", "5 hours", "20 hours", ["who"], {"n": F.count(F.lit(1))}, inbox.out, inbox.checkpoint)
        found = incremental.read_if_exists(inbox.spark, inbox.out)
        return [] if found is None else sorted((r.window_start, r.n) for r in found.where("window_start < '9000-01-01'").collect())

    for i in (0, 3, 6):
        inbox.put(rows[i : i + 3])
        run()
    inbox.close()
    batch = windows.sessions(inbox.spark.createDataFrame(rows, SHAPE), "ts", "5 hours", ["who"], {"n": F.count(F.lit(1))})
    assert run() == sorted((r.window_start, r.n) for r in batch.collect()) == [(at(0), 4), (at(30), 4), (at(60), 1)]


def test_days_settle_and_late_rows_count_until_then(inbox):
    final, provisional = f"{inbox.out}/final", f"{inbox.out}/provisional"

    def run():
        windows.keep_days(inbox.stream(), "ts", "1 day", ["who"], {"n": F.count(F.lit(1))}, final, provisional, inbox.checkpoint)
        return sorted((r.window_start.day, r.n, r.settled) for r in windows.settled_days(inbox.spark, final, provisional, ["who"]).collect())

    inbox.put([(1, "a", "x", at(1)), (2, "a", "x", at(2)), (3, "a", "x", at(25))])
    assert run() == [(1, 2, False), (2, 1, False)]
    inbox.put([(4, "a", "x", at(3))])  # late, the day is still open
    assert run() == [(1, 3, False), (2, 1, False)]
    inbox.put([(5, "a", "x", at(50))])
    assert run() == [(1, 3, True), (2, 1, False), (3, 1, False)]
    inbox.put([(6, "a", "x", at(4)), (7, "a", "x", at(26))])  # the first is too late, its day has settled
    assert run() == [(1, 3, True), (2, 2, False), (3, 1, False)]
    inbox.put([(8, "a", "x", at(100))])
    assert run() == [(1, 3, True), (2, 2, True), (3, 1, True), (5, 1, False)]


class Kept:
    """A list state of one key that counts the calls reaching the state store."""

    def __init__(self):
        self.values, self.calls = [], 0

    def appendValue(self, value):  # noqa: N802
        self.put([*self.values, value])

    def put(self, values):
        self.values, self.calls = list(values), self.calls + 1

    def get(self):
        return iter(self.values)


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):  # noqa: N802
        self.held = Kept()
        return self.held

    def registerTimer(self, at_ms):  # noqa: N802
        self.timers.append(at_ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_rows_of_a_key_wait_in_few_values():
    schema = T.StructType.fromDDL("id bigint, kind string, _ms bigint")
    handle, row = Handle(), Row("id", "kind", "_ms")
    versions = change_state.versions(schema, ["kind"], ["id"])
    versions.init(handle)
    rows = [row(i, "xy"[i // 10 % 2], i) for i in range(2500)]
    list(versions.handleInputRows(("a",), iter(rows), Watermark(-1)))
    assert len(handle.held.values) == 3
    assert handle.timers == [0]
    seen = list(versions.handleExpiredTimer(("a",), Watermark(1004), None))
    assert [r.id for r in seen] == list(range(0, 1005, 10))
    assert seen[1].asDict() == {"id": 10, "kind": "y"}
    assert (len(handle.held.values), handle.held.calls, handle.timers) == (3, 4, [0, 1005])
    calls = handle.held.calls
    # A second timer behind the same watermark finds nothing to do.
    assert list(versions.handleExpiredTimer(("a",), Watermark(1004), None)) == []
    assert handle.held.calls == calls
    assert [r.id for r in versions.handleExpiredTimer(("a",), Watermark(5000), None)] == list(range(1010, 2500, 10))
    assert len(handle.held.values) == 1
