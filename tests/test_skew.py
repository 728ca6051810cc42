"""Operators against brute force on fixtures where one key owns most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orgpulse.operators import ordered
from orgpulse.operators.flow import field_history_full_values

RNG = random.Random(5)
ROWS = [("hot" if RNG.random() < 0.7 else f"k{RNG.randrange(5)}", RNG.randrange(86400 * 40), i, RNG.choice([0.0, 1.5, -2.0, 7.25, 1e6, RNG.random() * 10])) for i in range(900)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "key string, sec bigint, id bigint, value double").withColumn("at", F.timestamp_seconds("sec"))


def by_key():
    out = defaultdict(list)
    for key, sec, i, value in sorted(ROWS, key=lambda r: (r[1], r[2])):
        out[key].append((sec, i, value))
    return out


@pytest.mark.parametrize("direction", ["previous", "next"])
def test_neighbours(frame, direction):
    got = {(r.key, r.id): r.near for r in ordered.with_neighbour(frame, ["key"], ["at", "id"], {"near": "id"}, F.to_date("at"), direction).collect()}
    want = {}
    for key, items in by_key().items():
        ids = [i for _, i, _ in items]
        shifted = [None, *ids[:-1]] if direction == "previous" else [*ids[1:], None]
        want.update({(key, i): n for i, n in zip(ids, shifted)})
    assert got == want


def test_row_numbers(frame):
    got = {r.id: r.n for r in ordered.with_row_number(frame, ["key"], ["at", "id"], F.to_date("at"), "n").collect()}
    assert got == {i: n for items in by_key().values() for n, (_, i, _) in enumerate(items, 1)}


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(frame, p):
    got = {r.key: r.q for r in ordered.exact_quantile(frame, ["key"], "value", p, "q").collect()}
    for key, items in by_key().items():
        values = sorted(v for _, _, v in items)
        assert got[key] == values[min(int(len(values) * p), len(values) - 1)]


def test_percent_rank(frame):
    got = {r.id: r.pr for r in ordered.percent_rank_by(frame, ["key"], "value", "pr").collect()}
    for items in by_key().values():
        values = [v for _, _, v in items]
        for _, i, v in items:
            want = sum(x < v for x in values) / (len(values) - 1) if len(values) > 1 else 0.0
            assert got[i] == pytest.approx(want)


def test_quantile_without_keys(frame):
    values = sorted(r[3] for r in ROWS)
    assert ordered.exact_quantile(frame, [], "value", 0.5, "q").first().q == values[len(values) // 2]


def test_dense_rank(frame):
    ranks = {v: n for n, v in enumerate(sorted({r[1] for r in ROWS}), 1)}
    assert all(r.n == ranks[r.sec] for r in ordered.dense_rank_all(frame.select("sec"), "sec", "n").collect())


def test_dense_rank_by_ranges(spark):
    odd = spark.createDataFrame([(None, None), (float("nan"), "z"), (-0.0, "é"), (0.0, ""), (1e300, None)], "x double, s string")
    many = spark.range(5000).select((F.col("id") * 7919 % 997 - 400).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 83).alias("s"))
    df = odd.unionByName(many)
    for c in ("x", "s"):
        out = ordered.dense_rank_all(df.select(c), c, "n")
        # No value is looked for in a list of bounds.
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        seen = out.collect()
        held = {str(r[0] + 0.0) if c == "x" else r[0]: r[0] for r in seen if r[0] is not None}
        order = sorted(held, key=lambda k: (k == "nan", float(k)) if c == "x" else k.encode())
        ranks = {k: n for n, k in enumerate(order, 1)}
        assert len(seen) == 5005
        assert all(r.n == (None if r[0] is None else ranks[str(r[0] + 0.0) if c == "x" else r[0]]) for r in seen)
    assert ordered.dense_rank_all(df.where("false"), "x", "n").collect() == []


def test_latest_row(frame):
    got = {r.key: r.id for r in ordered.latest_per_key(frame, ["key"], ["at", "id"]).collect()}
    assert got == {key: items[-1][1] for key, items in by_key().items()}


def test_running_field_values_match_a_replay(spark):
    rng = random.Random(9)
    deltas = []
    for i in range(300):
        single = rng.random() < 0.3
        action = "set" if single else rng.choice(["add", "add", "remove"])
        deltas.append(("t", f"i{rng.randrange(3)}", "status" if single else "labels", "single" if single else "multi", rng.randrange(50), i, action, f"v{rng.randrange(4)}"))
    schema = "tenant_id string, issue_id string, field_id string, field_cardinality string, day int, event_id int, delta_action string, delta_value string"
    df = spark.createDataFrame(deltas, schema).withColumn("event_at", F.timestamp_seconds(F.col("day") * 86400)).drop("day")
    got = {r.event_id: r.value_ids for r in field_history_full_values(df).collect()}
    state = defaultdict(set)
    for _, issue, field, _, day, eid, action, value in sorted(deltas, key=lambda d: (d[4], d[5])):
        held = state[issue, field]
        if action == "set":
            held.clear()
        (held.discard if action == "remove" else held.add)(value)
        assert got[eid] == sorted(held)


def test_positions_and_neighbours_keep_null_keys_and_times(spark):
    rows = [(None, 1, "a"), (None, 9, "b"), (None, None, "c"), ("k", None, "d"), ("k", 3, "e")]
    df = spark.createDataFrame(rows, "key string, at int, v string")
    numbered = ordered.with_row_number(df, ["key"], ["at"], F.floor(F.col("at") / 5), "n")
    assert sorted((r.key or "", r.v, r.n) for r in numbered.collect()) == [("", "a", 2), ("", "b", 3), ("", "c", 1), ("k", "d", 1), ("k", "e", 2)]
    before = ordered.with_neighbour(df.where("at IS NOT NULL"), ["key"], ["at"], {"last": "v"}, F.floor(F.col("at") / 5), "previous")
    assert {r.v: r.last for r in before.collect()} == {"a": None, "b": "a", "e": None}


def test_positions_keep_null_groups_large_integers_and_outliers(spark):
    big = 2**60
    rows = [(None, big), (None, big + 1), (None, None), ("k", 5), ("k", 10**15)] + [("k", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, value bigint")
    got = {(r.key, r.value): (r.n, r.below, r.values_below, r.total) for r in ordered.value_positions(df, ["key"], "value", 16).collect()}
    assert got[None, big] == (1, 0, 0, 2) and got[None, big + 1] == (1, 1, 1, 2)
    assert got["k", 10**15] == (1, 5001, 5000, 5002) and got["k", 6] == (1, 7, 6, 5002)
    ranks = {(r.key, r.value): r.pr for r in ordered.percent_rank_by(df, ["key"], "value", "pr").collect()}
    assert ranks[None, None] is None and ranks[None, big + 1] == 1.0
    assert {r.key: r.q for r in ordered.exact_quantile(df, ["key"], "value", 0.5, "q").collect()} == {None: big + 1, "k": 2500}


def test_as_of_join_keeps_facts_without_key_or_time(spark):
    facts = spark.createDataFrame([("a", 5, 1), ("a", 25, 2), ("a", None, 3), (None, 7, 4), ("b", 1, 5)], "key string, at int, id int")
    log = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, None), (None, 3, 8), ("b", 2, 9), ("a", None, 7)], "key string, at int, seen int")
    got = {r.id: r.seen for r in ordered.as_of_join(facts, log, ["key"], "at", "seen", lambda at: F.floor(at / 10)).collect()}
    assert got == {1: 2, 2: 2, 3: None, 4: 8, 5: None}


def test_several_quantiles_in_one_pass(spark):
    """A hot key, heavy ties, integers beyond double precision, decimals, texts, a NULL key and single rows."""
    rng = random.Random(4)
    big = 2**60
    rows = [("hot", rng.choice([0, 5, rng.randrange(10**6)])) for _ in range(6000)] + [("tie", 7)] * 500 + [("one", 3), (None, big), (None, big + 1), (None, big + 2), ("none", None)]
    wanted = {"p0": (0.0, lambda n: F.lit(0)), "p5": (0.05, lambda n: F.ceil(n * 5 / 100) - 1), "mid": (0.5, lambda n: F.floor(n / 2)), "p95": (0.95, lambda n: F.ceil(n * 95 / 100) - 1), "last": (1.0, lambda n: n - 1)}
    place = {"p0": lambda n: 0, "p5": lambda n: -(-n * 5 // 100) - 1, "mid": lambda n: n // 2, "p95": lambda n: -(-n * 95 // 100) - 1, "last": lambda n: n - 1}
    groups = defaultdict(list)
    for key, value in rows:
        if value is not None:
            groups[key].append(value)
    df = spark.createDataFrame(rows, "key string, value bigint").repartition(7)
    for kind, plain in (("bigint", int), ("decimal(25,2)", int), ("string", str)):
        typed = df.withColumn("value", F.col("value").cast(kind))
        got = {r.key: tuple(plain(r[n]) for n in wanted) for r in ordered.exact_quantiles(typed, ["key"], "value", wanted).collect()}
        assert got == {key: tuple(sorted(map(plain, values))[place[n](len(values))] for n in wanted) for key, values in groups.items()}
    assert ordered.exact_quantiles(df.limit(0), ["key"], "value", wanted).count() == 0


def test_quantiles_of_floats_with_infinities_and_nan(spark):
    values = [float("-inf"), -0.0, 1.5, float("inf"), float("nan"), float("nan")] + [float(i) for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    wanted = {"first": (0.0, lambda n: F.lit(0)), "mid": (0.5, lambda n: F.floor(n / 2)), "before_last": (0.94, lambda n: n - 3)}
    got = ordered.exact_quantiles(df, [], "value", wanted).first()
    assert (got.first, got.mid, got.before_last) == (float("-inf"), 25.0, float("inf"))


@pytest.mark.parametrize("hot_rows", [16, 60])
def test_hot_buckets_are_cut_without_changing_a_result(spark, hot_rows):
    """One key with all rows in one day, many of them at one moment, a NULL key, NULL times, and a key of a single row."""
    rng = random.Random(3)
    rows = [("bot", rng.choice([None, 5, 5, rng.randrange(86400)]), i) for i in range(600)] + [(None, rng.randrange(86400), i) for i in range(600, 700)] + [("one", 3, 700)]
    df = spark.createDataFrame(rows, "key string, sec int, id int").repartition(5)
    day = F.to_date(F.timestamp_seconds(F.coalesce("sec", F.lit(0))))
    spans = ordered._bucketed(df, ["key"], ["sec", "id"], day, hot_rows).groupBy("key", "_bucket").count()
    assert spans.agg(F.max("count")).first()[0] <= 4 * hot_rows and spans.where("key = 'bot'").count() > 600 / (4 * hot_rows)
    groups = defaultdict(list)
    for key, sec, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups[key].append(i)
    numbered = ordered.with_row_number(df, ["key"], ["sec", "id"], day, "n", hot_rows).collect()
    assert {r.id: r.n for r in numbered} == {i: n for ids in groups.values() for n, i in enumerate(ids, 1)} and len(numbered) == len(rows)
    both = ordered.with_neighbours(df, ["key"], ["sec", "id"], {"before": "id"}, {"after": "id"}, day, hot_rows).collect()
    want = {i: (b, a) for ids in groups.values() for b, i, a in zip([None, *ids], ids, [*ids[1:], None])}
    assert {r.id: (r.before, r.after) for r in both} == want and len(both) == len(rows)


def test_neighbours_can_be_rows_of_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None)], "key string, at int, v string")
    got = ordered.with_neighbours(df, ["key"], ["at"], {"p": "v", "p_at": "at"}, {"n": "v"}, F.lit(0)).collect()
    assert sorted((r.at, r.p, r.p_at, r.n) for r in got) == [(1, None, None, "x"), (2, None, 1, None), (3, "x", 2, None)]


def test_as_of_join_cuts_a_hot_key(spark):
    rng = random.Random(8)
    log = [("k", rng.randrange(500), i) for i in range(300)] + [(None, 4, 1)]
    facts = [("k", rng.randrange(500), i) for i in range(300)] + [(None, 9, 900), ("none", 5, 901)]
    frames = spark.createDataFrame(facts, "key string, at int, id int"), spark.createDataFrame(log, "key string, at int, seen int")
    got = {r.id: r.seen for r in ordered.as_of_join(*frames, ["key"], "at", "seen", lambda at: F.lit(0), hot_rows=20).collect()}
    newest = {i: max(((a, s) for k, a, s in log if k == key and a <= at), default=(0, None))[1] for key, at, i in facts}
    assert got == newest


@pytest.mark.parametrize("chunk", [4, 4096])
def test_one_hot_field_month(spark, monkeypatch, chunk):
    """All events of one field in one month: values held over many chunks, set again, removed twice, and without a value."""
    from orgpulse.operators import flow

    monkeypatch.setattr(flow, "CHUNK_EVENTS", chunk)
    rng = random.Random(chunk)
    deltas = [("t", "i", "labels", "multi", rng.randrange(2000), i, rng.choice(["add", "add", "remove"]), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    schema = "tenant_id string, issue_id string, field_id string, field_cardinality string, sec int, event_id int, delta_action string, delta_value string"
    df = spark.createDataFrame(deltas, schema).withColumn("event_at", F.timestamp_seconds("sec")).drop("sec")
    got = {r.event_id: r.value_ids for r in field_history_full_values(df).collect()}
    held = set()
    for *_, event_id, action, value in sorted(deltas, key=lambda d: (d[4], d[5])):
        if value is not None:
            (held.add if action == "add" else held.discard)(value)
        assert got[event_id] == sorted(held)


def test_keys_of_few_rows_take_one_window_without_a_join(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("key"), F.timestamp_seconds(F.col("id") * 86400).alias("at"), "id")
    near = ordered.with_neighbours(df, ["key"], ["at"], {"before": "id"}, {"after": "id"}, F.to_date("at"))
    placed = ordered.with_row_number(df, ["key"], ["at"], F.to_date("at"), "n")
    for out in (near, placed):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Window") == 1
    assert all((r.before, r.after) == (r.id - 500 if r.id >= 500 else None, r.id + 500 if r.id < 1500 else None) for r in near.collect())
    assert all(r.n == r.id // 500 + 1 for r in placed.collect())


def test_hot_and_other_keys_have_the_same_neighbours(spark):
    df = spark.range(300).select(F.when(F.col("id") < 250, "hot").when(F.col("id") < 290, F.col("id").cast("string")).alias("key"), "id", (F.col("id") * 7 % 300).alias("at"))
    got = ordered.with_neighbours(df, ["key"], ["at"], {"before": "id"}, {"after": "id"}, F.floor(F.col("at") / 50), 20).collect()
    placed = {r.id: r.n for r in ordered.with_row_number(df, ["key"], ["at"], F.floor(F.col("at") / 50), "n", 20).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.key, []).append((r.at, r.id))
    want = {}
    for rows_ in groups.values():
        ids = [i for _, i in sorted(rows_)]
        for n, i in enumerate(ids):
            want[i] = (ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None)
            assert placed[i] == n + 1
    assert {r.id: (r.before, r.after) for r in got} == want
