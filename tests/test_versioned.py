"""Versioned tables: published in one step, only touched files rewritten."""

import pytest
from pyspark.sql import functions as F

from orgpulse.sources import landing, versioned

KEYS, ORDER = ["k"], ["at"]


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, at int, v string")


@pytest.fixture()
def path(tmp_path):
    return f"file://{tmp_path}/table"


def content(spark, path, number=None):
    return sorted((tuple(r) for r in versioned.read(spark, path, number).select("k", "at", "v").collect()), key=repr)


def names(spark, path):
    return {r.file for r in versioned.manifest(spark, path).collect()}


def test_newest_row_of_a_key_wins_and_versions_stay_readable(spark, path):
    assert versioned.version(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path)
    versioned.upsert(batch(spark, [(1, 1, "a"), (2, 1, "b"), (None, 1, "n"), (1, 2, "c"), (1, 2, "c")]), path, KEYS, ORDER)
    versioned.upsert(batch(spark, [(2, 0, "old"), (3, 5, None), (None, 2, "m")]), path, KEYS, ORDER)
    assert content(spark, path, 1) == [(1, 2, "c"), (2, 1, "b"), (None, 1, "n")]
    assert content(spark, path) == [(1, 2, "c"), (2, 1, "b"), (3, 5, None), (None, 2, "m")]


def test_a_batch_twice_and_an_empty_one_change_nothing(spark, path):
    rows = batch(spark, [(i, 1, str(i)) for i in range(20)])
    for each in (rows, rows, rows.limit(0)):
        landing.write_sink(each, path, "versioned", KEYS, ORDER)
        assert content(spark, path) == sorted([(i, 1, str(i)) for i in range(20)], key=repr)
    assert versioned.version(spark, path) == 3


def test_a_table_of_no_rows(spark, path):
    versioned.upsert(batch(spark, []), path, KEYS, ORDER)
    assert content(spark, path) == []
    versioned.upsert(batch(spark, [(1, 1, "a")]), path, KEYS, ORDER)
    assert content(spark, path) == [(1, 1, "a")]


def test_only_touched_files_are_rewritten(spark, path, monkeypatch):
    monkeypatch.setattr(versioned, "FILE_ROWS", 10)
    versioned.replace(batch(spark, [(i, 1, "x") for i in range(100)]), path, KEYS)
    before = names(spark, path)
    assert len(before) == 10
    versioned.upsert(batch(spark, [(55, 2, "y"), (200, 1, "new")]), path, KEYS, ORDER)
    assert len(before & names(spark, path)) >= 8
    want = {i: "x" for i in range(100)} | {55: "y", 200: "new"}
    assert {k: v for k, _, v in content(spark, path)} == want and len(content(spark, path)) == 101


def test_a_writer_that_ends_before_the_last_step_leaves_the_old_version(spark, path, monkeypatch):
    versioned.upsert(batch(spark, [(1, 1, "a")]), path, KEYS, ORDER)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(versioned, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            versioned.upsert(batch(spark, [(1, 2, "half")]), path, KEYS, ORDER)
    assert content(spark, path) == [(1, 1, "a")] and versioned.version(spark, path) == 1
    versioned.upsert(batch(spark, [(1, 3, "whole")]), path, KEYS, ORDER)
    assert content(spark, path) == [(1, 3, "whole")]


def test_a_version_that_another_writer_took_is_merged_again(spark, path, monkeypatch):
    versioned.upsert(batch(spark, [(1, 1, "a")]), path, KEYS, ORDER)
    publish, others = versioned._publish, []

    def late(session, where, number, commit):
        if not others:
            others.append(number)
            monkeypatch.setattr(versioned, "_publish", publish)
            versioned.upsert(batch(session, [(2, 1, "theirs"), (1, 5, "newer")]), where, KEYS, ORDER)
            monkeypatch.setattr(versioned, "_publish", late)
        publish(session, where, number, commit)

    monkeypatch.setattr(versioned, "_publish", late)
    assert versioned.upsert(batch(spark, [(1, 2, "ours"), (3, 1, "ours")]), path, KEYS, ORDER) == 3
    assert content(spark, path) == [(1, 5, "newer"), (2, 1, "theirs"), (3, 1, "ours")]


def test_a_taken_version_is_not_overwritten(spark, path):
    versioned.upsert(batch(spark, [(1, 1, "a")]), path, KEYS, ORDER)
    with pytest.raises(versioned.TakenError):
        versioned.commit(batch(spark, [(1, 1, "b")]), path, KEYS, after=0)
    assert content(spark, path) == [(1, 1, "a")]


def test_a_new_column_is_null_in_older_rows(spark, path):
    versioned.upsert(batch(spark, [(1, 1, "a"), (2, 1, "b")]), path, KEYS, ORDER)
    versioned.upsert(batch(spark, [(2, 2, "c")]).withColumn("w", F.lit(7)), path, KEYS, ORDER)
    assert sorted((r.k, r.v, r.w) for r in versioned.read(spark, path).collect()) == [(1, "a", None), (2, "c", 7)]


def test_old_versions_are_dropped_with_what_only_they_hold(spark, path):
    for at in range(1, 5):
        versioned.upsert(batch(spark, [(1, at, str(at)), (9, 1, "z")]), path, KEYS, ORDER)
    assert versioned.drop_versions(spark, path, keep=2) == 2 and versioned.drop_versions(spark, path, keep=2) == 0
    assert content(spark, path, 3) == [(1, 3, "3"), (9, 1, "z")] and content(spark, path) == [(1, 4, "4"), (9, 1, "z")]
