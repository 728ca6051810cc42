"""Worked examples of facts, metrics, organisation, queries, streams."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.functions.similarity import jaro_winkler, lastname_score
from orgpulse.operators import domain_metrics, flow, gold, metrics, org, quality, silver
from orgpulse.plans import query
from orgpulse.plans.registry import Registry, table_model, union_by_tag
from orgpulse.sources import derive, landing, schemas
from orgpulse.streaming import incremental, windows


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_time_helpers(spark):
    day = F.lit("2024-03-10").cast("date")  # a Sunday
    assert [str(x) for x in one(spark, fx.monday_week(day), fx.sunday_week(day))] == ["2024-03-04", "2024-03-10"]
    assert one(spark, *[fx.duration_seconds(F.lit(d)) for d in ("PT1H2M3S", "PT45S", "P1DT2H", "bad")]) == (3723, 45, 93600, 0)
    assert one(spark, fx.parse_time(F.lit("2024-01-02T03:04:05+02:00")))[0] == datetime(2024, 1, 2, 1, 4, 5)
    assert one(spark, fx.parse_time(F.lit("1704164645")), fx.parse_time(F.lit("nope"))) == (datetime(2024, 1, 2, 3, 4, 5), None)


def test_null_rules(spark):
    null = F.lit(None).cast("double")
    assert one(spark, fx.clamp(null, 0, 1), fx.ratio(F.lit(1), F.lit(0)), fx.tidy_round(F.lit(8.0) - F.lit(4.15), 1)) == (None, None, 3.9)
    assert one(spark, fx.json_text(F.lit("{}"), "a", "b"), fx.json_number(F.lit('{"a":"x"}'), "a"), fx.join_key("-", F.lit("a"), F.lit(None), F.lit("c"))) == ("", 0.0, "a--c")


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("same", "same", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(spark, a, b, want):
    assert one(spark, jaro_winkler(F.lit(a), F.lit(b)))[0] == pytest.approx(want, abs=1e-6)


def test_lastname_score_orders_candidates(spark):
    words = ["novotny", "anovotny", "novtny", "novotnya", "ivanek"]
    scores = one(spark, *[lastname_score(F.lit("novotny"), F.lit(w)) for w in words])
    assert scores[0] == 1.0 and min(scores[0], scores[1], scores[3]) > scores[2] > scores[4]


def test_author_text(spark, rows):
    df = spark.createDataFrame([("Ann Bee <ann@x.test>",), ("plain",), (None,)], "raw string")
    assert rows(derive.parse_author(df, "raw"), "author_name", "author_email") == [("", None), ("Ann Bee", "ann@x.test"), ("plain", None)]


def test_impossible_cycle_time_is_null(spark, rows):
    cols = "state string, created_on timestamp, closed_on timestamp, author_email string, author_name string"
    t = lambda d: datetime(2024, 1, d)
    prs = spark.createDataFrame([("MERGED", t(1), t(2), "A@x", "n"), ("MERGED", t(3), t(2), "", "Bob"), ("OPEN", t(1), None, "", "Bob")], cols)
    assert rows(silver.git_pr_fact(prs), "person_key", "cycle_time_h") == [("a@x", 24.0), ("bob", None), ("bob", None)]


def test_bullet_uses_upper_median(spark):
    data = [("t", f"p{i}", "u", "2024-01-01", "tasks_completed", float(i)) for i in (1, 2, 3, 4)]
    got = metrics.bullet_team(spark.createDataFrame(data, schemas.BULLET_ROWS), "task_delivery").first()
    assert (got.value, got.median, got.range_min, got.range_max) == (2.5, 3.0, 1.0, 4.0)


def test_estimation_accuracy(spark):
    data = [("t", "p", "u", "d", "estimation_accuracy", v) for v in (90.0, 120.0, 500.0, 0.0)]
    assert metrics.bullet_team(spark.createDataFrame(data, schemas.BULLET_ROWS), "task_delivery").first().value == 85.0


def test_active_indicator_scale(spark):
    data = [("t", f"p{i}", "u", "d", "cursor_active", float(i % 2)) for i in range(5)]
    got = metrics.bullet_team(spark.createDataFrame(data, schemas.BULLET_ROWS), "ai").first()
    assert (got.value, got.median, got.range_min, got.range_max) == (2.0, 0.0, 0.0, 5.0)


def test_empty_views_are_typed(spark):
    assert gold.ai_bullet_rows(None, None, spark).count() == gold.ic_drill(spark).count() == gold.ic_timeoff(None, spark).count() == 0


def test_org_tree(spark, rows):
    units = spark.createDataFrame([("t", "1", None, "Acme"), ("t", "2", "1", "Engineering"), ("t", "3", "2", "Platform"), ("t", "8", "9", "Loop"), ("t", "9", "8", "Loop two")], "tenant_id string, unit_id string, parent_id string, name string")
    paths = org.org_paths(units)
    assert rows(paths, "path", "depth") == [("/acme", 0), ("/acme/engineering", 1), ("/acme/engineering/platform", 2)]
    assert org.org_subtree(paths, "/acme/engineering").count() == 2


def test_transfer_keeps_history(spark, rows):
    t = lambda m: datetime(2025, m, 1)
    assigned = spark.createDataFrame([("t", "p", "old", t(1), t(6)), ("t", "p", "new", t(6), None)], "tenant_id string, person_id string, unit_id string, valid_from timestamp, valid_to timestamp")
    facts = spark.createDataFrame([("t", "p", datetime(2024, 12, 31), 0), ("t", "p", t(5), 1), ("t", "p", t(6), 2), ("t", "p", t(9), 3)], "tenant_id string, person_id string, at timestamp, n int")
    out = org.temporal_join(facts, assigned, ["tenant_id", "person_id"], "at", ["unit_id"])
    assert rows(out, "n", "unit_id") == [(0, None), (1, "old"), (2, "new"), (3, "new")]
    assert org.overlap_violations(assigned, ["tenant_id", "person_id"]).count() == 0
    assert org.open_row_violations(assigned, ["tenant_id", "person_id"]).count() == 0


def test_status_hours_and_lead_time(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    log = spark.createDataFrame([("a", t(0), 1, "Open"), ("a", t(2), 2, "Doing"), ("a", t(5), 3, "Done"), ("b", t(1), 4, "Open")], "task_id string, at timestamp, event_id int, status string")
    life = flow.lifecycle_summary(flow.status_periods(log, ["task_id"], ["at", "event_id"], "status", "at"), ["task_id"], {"in_progress": ["Doing"], "testing": ["QA"], "done": ["Done"]})
    assert {r.task_id: r.lead_time_h for r in life.collect()} == {"a": 3.0, "b": None}


def test_thresholds_and_validation(spark):
    df = spark.createDataFrame([(0.58, 26.4, None)], "focus double, cycle double, empty double")
    rules = [query.Threshold("focus", "lt", 0.6, "warning"), query.Threshold("cycle", "gt", 24, "critical"), query.Threshold("cycle", "gt", 10, "warning"), query.Threshold("empty", "gt", 0, "good")]
    assert query.evaluate_thresholds(df, rules).first()._thresholds == {"focus": "warning", "cycle": "critical"}
    with pytest.raises(ValueError):
        query.Threshold("x", "like", 1, "good")
    with pytest.raises(ValueError):
        query.Threshold("x", "gt", 1, "fine")


@pytest.mark.parametrize("good", ["name", "metric_date desc", "a ASC"])
def test_ordering_accepts(spark, good):
    assert len(query.ordering(good)) == 1


@pytest.mark.parametrize("bad", ["name; DROP TABLE x", "1col", "name sideways", "a,b", "name desc desc"])
def test_ordering_refuses(spark, bad):
    with pytest.raises(ValueError):
        query.ordering(bad)


def test_top_is_clamped_and_has_next(spark):
    assert [query.page_size(x) for x in (None, 1, 5, 200)] == [25, 1, 5, 200]
    for outside in (0, 201, 999):
        with pytest.raises(ValueError, match="1 to 200"):
            query.page_size(outside)
    df = spark.range(3)
    assert [r.has_next for r in query.top_with_has_next(df, 2, [F.col("id")]).collect()] == [True, True]
    assert [r.has_next for r in query.top_with_has_next(df, 3, [F.col("id")]).collect()] == [False] * 3


def test_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(25)], "a int, id int")
    keys, cursor, seen = [("a", False), ("id", True)], None, []
    while page := query.keyset_page(df, keys, cursor, 4).collect():
        seen += [(r.a, r.id) for r in page]
        cursor = seen[-1]
    assert seen == sorted(((i % 3, i) for i in range(25)), key=lambda r: (-r[0], r[1]))
    back = query.keyset_page(df, keys, seen[10], 4, forward=False).collect()
    assert [(r.a, r.id) for r in back] == seen[6:10]


def test_dates_apply_before_aggregation(spark):
    data = spark.createDataFrame([("p", "2024-01-01", 1.0), ("p", "2024-02-01", 10.0)], "person_id string, metric_date string, v double")
    spec = query.MetricSpec("m", "", lambda: data, lambda rows: rows.groupBy("person_id").agg(F.sum("v").alias("v")))
    assert query.query_metric(query.Catalog().add(spec), "m", "2024-02-01", "2024-03-01").first().v == 10.0
    with pytest.raises(LookupError):
        query.query_metric(query.Catalog(), "m")


def test_metric_pages_go_on_to_the_end(spark):
    data = spark.createDataFrame([(f"p{i}", None if i % 5 == 0 else float(i % 3) / 3) for i in range(23)], "person_id string, v double")
    catalog = query.Catalog().add(query.MetricSpec("m", "", lambda: data, lambda rows: rows))
    for orderby in (["v desc", "person_id"], ["v", "person_id desc"]):
        seen, after = [], None
        while True:
            page = query.query_metric(catalog, "m", orderby=orderby, top=4, after=after).collect()
            seen += [r.person_id for r in page]
            if not page[-1].has_next:
                break
            after = [page[-1].v, page[-1].person_id]
        assert len(seen) == 23 and len(set(seen)) == 23
        assert seen == [r.person_id for r in query.query_metric(catalog, "m", orderby=orderby, top=100).collect()]
    with pytest.raises(ValueError, match="2 values"):
        query.query_metric(catalog, "m", orderby=["v", "person_id"], after=[1.0])


def test_drill_rows_of_commits(spark):
    commits = spark.createDataFrame([("t", "p", "2024-01-01 10:00:00", "git", f"c{i}") for i in range(5)] + [("t", "q", None, "git", "x")], "tenant_id string, person_key string, date string, data_source string, commit_hash string")
    (row,) = gold.ic_drill(spark, commits).collect()
    assert (row.person_id, row.metric_date, row.value, row.rows) == ("p", "2024-01-01", "5", ["c0", "c1", "c2", "c3", "c4"])
    (short,) = gold.ic_drill(spark, commits, max_listed=2).collect()
    assert (short.value, short.rows) == ("5", ["c0", "c1"]) and set(gold.ic_drill(spark).columns) == set(short.asDict())


def test_upsert_reads_only_touched_partitions(spark, tmp_path, capsys):
    from orgpulse.streaming import incremental

    path = f"{tmp_path}/t"
    for batch in ([("a", 1, 1), ("b", 1, 1), (None, 1, 1)], [("a", 1, 2), ("a", 2, 1)], [(None, 1, 3)]):
        incremental.upsert_by_key(spark.createDataFrame(batch, "part string, id int, version int"), path, ["part", "id"], ["version"], ["part"])
    assert sorted(((r.part or "", r.id, r.version) for r in spark.read.parquet(path).collect())) == [("", 1, 3), ("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]
    batch = spark.createDataFrame([("a", 9, 9), ("a", 8, 9)], "part string, id int, version int")
    read = spark.read.parquet(path).where(incremental.in_partitions(batch, ["part"]))
    capsys.readouterr()
    read.explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*part#", capsys.readouterr().out)
    wide = spark.read.parquet(path).where(incremental.in_partitions(spark.createDataFrame([("a",), ("b",)], "part string"), ["part"], max_values=1))
    assert wide.count() == 4


def test_union_skips_missing_tables_and_needs_one(spark):
    registry = Registry().add("gone", {"x", "y"}, table_model(spark, "no_such_table")).add("here", {"x"}, lambda: spark.range(2))
    assert union_by_tag(registry, "x").count() == 2
    with pytest.raises(ValueError):
        union_by_tag(registry, "y")


def test_missing_and_unknown_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tenant_id":"t","id":"7","surprise":1}\n')
    row = landing.read_bronze(spark, str(tmp_path), schemas.bronze_schema("cursor_members"), "json").first()
    assert (row.id, row.name) == ("7", None) and "surprise" not in row


def test_quality_checks(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", 2)], "k string, v int")
    assert rows(quality.unique(df, "k")) == [("a", 2)]
    assert quality.not_null(df, ["v"]).count() == 1
    assert rows(quality.accepted_values(df, "k", ["a"])) == [("b", 1)]


def test_drop_needs_earlier_days_only(spark):
    days = [("t", "p", datetime(2024, 1, d).date(), 10.0) for d in range(1, 15)] + [("t", "p", datetime(2024, 1, 15).date(), 1.0)]
    df = spark.createDataFrame(days, "tenant_id string, person_id string, day date, n double")
    assert [str(r.day) for r in domain_metrics.activity_drop(df, "n", 14, 0.5).where("day > '2024-01-08'").collect()] == ["2024-01-15"]


@pytest.fixture()
def landed(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 7).alias("k"), "id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return df, path


def test_stream_equals_batch(spark, landed, tmp_path, rows):
    df, path = landed
    measures = {"n": F.count(F.lit(1))}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "30 days")
    out = str(tmp_path / "out")
    keys = ["k", "window_start", "window_end"]
    incremental.run_available(
        windows.tumbling(stream, "ts", "monday_week", ["k"], measures), lambda b, _: incremental.upsert_by_key(b, out, keys, ["n"]), str(tmp_path / "ckpt"), "update"
    )
    assert rows(spark.read.parquet(out)) == rows(windows.tumbling(df, "ts", "monday_week", ["k"], measures))


def test_upsert_twice_changes_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("d1", "a", 1), ("d2", "b", 1), ("d1", "a", 2)], "day string, key string, v int")
    newer = spark.createDataFrame([("d1", "a", 5)], "day string, key string, v int")
    for df in (batch, newer, newer, batch):
        incremental.upsert_by_key(df, path, ["day", "key"], ["v"], ["day"])
    assert rows(spark.read.parquet(path), "day", "key", "v") == [("d1", "a", 5), ("d2", "b", 1)]


def test_retried_batch_is_not_appended_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    at = F.lit("2024-01-01").cast("timestamp")
    first = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "key string, v string, n int")
    second = spark.createDataFrame([("a", "z", 2), ("b", "y", 2)], "key string, v string, n int")
    for df, batch_id in ((first, 0), (second, 1), (second, 1)):
        incremental.snapshot_batch(df, path, "key", ["v"], at, batch_id, ["n"])
    assert spark.read.parquet(path).count() == 3


def test_lookback_takes_all_on_first_run(spark):
    df = spark.createDataFrame([("2024-01-0%d" % d,) for d in range(1, 9)], "day string").select(F.col("day").cast("date").alias("day"))
    assert incremental.incremental_with_lookback(df, df.where("false"), "day", 3).count() == 8
    assert incremental.incremental_with_lookback(df, df.where("day <= '2024-01-06'"), "day", 3).count() == 5


def test_two_names_of_a_key_do_not_double_facts(spark):
    from orgpulse.operators import silver, staging_ai, staging_collab, staging_people

    keys = spark.createDataFrame([("t", "k", "old", 1), ("t", "k", "new", 2)], "tenant_id string, id string, name string, _airbyte_extracted_at int")
    spaces = spark.createDataFrame([("t", "w", "a"), ("t", "w", "b")], "tenant_id string, id string, display_name string")
    tokens = ["uncached_input_tokens", "cache_read_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "output_tokens", "web_search_requests"]
    usage = spark.createDataFrame([("t", "s", "2024-01-01", "m", "k", "w", "std", "big", *[5] * len(tokens))], "tenant_id string, source_id string, date string, model string, api_key_id string, workspace_id string, service_tier string, context_window string, " + ", ".join(f"{c} bigint" for c in tokens))
    found = staging_ai.api_usage(usage, keys, spaces, "p").collect()
    assert len(found) == 1 and {"new", "b"} <= set(map(str, found[0]))

    calls = spark.createDataFrame([("t", "z", "a@x", "A", "m1", "2024-01-01T10:00:00Z", "2024-01-01T10:30:00Z")], "tenant_id string, source_id string, email string, user_name string, meeting_uuid string, join_time string, leave_time string")
    meetings = spark.createDataFrame([("t", "z", "m1", True, False), ("t", "z", "m1", True, True)], "tenant_id string, source_id string, uuid string, has_video boolean, has_screen_share boolean")
    assert [(r.audio_duration_seconds, r.video_duration_seconds) for r in staging_collab.zoom_meetings(calls, meetings).collect()] == [(1800, 1800)]

    leave = spark.createDataFrame([("t", "s", "l1", "7", "2024-01-01", "2024-01-02", "{}", "{}", "{}", "2024-01-01", 1)], "tenant_id string, source_id string, unique_key string, employeeId string, start string, end string, type string, amount string, status string, created string, _airbyte_extracted_at int")
    staff = spark.createDataFrame([("t", "7", "old@x", 1), ("t", "7", "new@x", 2)], "tenant_id string, id string, workEmail string, _airbyte_extracted_at int")
    assert [r.email for r in staging_people.hr_leave_events(leave, staff).collect()] == ["new@x"]

    comms = spark.createDataFrame([("t", "A@x", "2024-01-01", "meeting_participation", 3600)], "tenant_id string, user_email string, activity_date string, event_type string, duration_seconds bigint")
    hours = spark.createDataFrame([("t", "a@x", 8.0, 1), ("t", "A@X", 4.0, 2)], "tenant_id string, email string, working_hours_per_day double, ingested_at int")
    assert [(r.day.day, r.working_hours_per_day) for r in silver.focus_metrics(comms, hours).collect()] == [(1, 4.0)]


def test_row_hash_parts_rows_that_differ(spark):
    from orgpulse.functions import scalars as fx

    rows = [("a", "b"), ("ab", ""), ("", "ab"), ("a|1", "b"), ("a", "1|b"), (None, "b"), ("", "b"), ("b", None), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    hashes = [r.h for r in df.select(fx.row_hash(["x", "y"], "__null__").alias("h")).collect()]
    assert len(set(hashes)) == len(rows) and all(len(h) == 64 for h in hashes)
    again = df.select(fx.row_hash(["x", "y"], "__null__").alias("h")).collect()
    assert [r.h for r in again] == hashes


def test_approximate_distinct_counts_are_within_their_error(spark):
    from harness.all_cases import CASES

    sf = "/root/testdata/sf0.01"
    exact = {r.l_returnflag: r.parts for r in CASES["distinct_aggregate"](spark, sf).collect()}
    for r in CASES["distinct_aggregate_approx"](spark, sf).collect():
        assert abs(r.parts - exact[r.l_returnflag]) <= 5 * 0.01 * exact[r.l_returnflag]


def test_dated_membership_is_the_same_by_month_and_by_key(spark, rows, monkeypatch):
    facts = spark.createDataFrame([("t", p, i, f"2024-0{1 + i % 6}-{1 + i % 27:02d}") for i in range(60) for p in ("a", "b", None)], "tenant_id string, person_id string, id int, day string").withColumn("at", F.col("day").cast("timestamp"))
    held = [("t", "a", "u1", "2023-05-01", "2024-02-10"), ("t", "a", "u2", "2024-02-10", "2024-04-01"), ("t", "a", "u3", "2024-05-03", None), ("t", "b", "u1", "2024-03-01", "2024-03-01"), ("t", "b", "u4", None, None)]
    held = spark.createDataFrame(held, "tenant_id string, person_id string, unit_id string, f string, u string").select("tenant_id", "person_id", "unit_id", F.col("f").cast("timestamp").alias("valid_from"), F.col("u").cast("timestamp").alias("valid_to"))
    for how in ("left", "inner"):
        plain = org.temporal_join(facts, held, ["tenant_id", "person_id"], "at", ["unit_id"], how)
        assert "Generate" not in plain._jdf.queryExecution().optimizedPlan().toString()
        for hot in (0, 2):
            monkeypatch.setattr(org, "HOT_ASSIGNMENTS", hot)
            assert rows(org.temporal_join(facts, held, ["tenant_id", "person_id"], "at", ["unit_id"], how)) == rows(plain)
        monkeypatch.undo()


def test_links_of_requests_are_not_dealt_to_be_distinct(spark):
    from orgpulse.operators import code_metrics

    repo = "tenant_id string, source_id string, project_key string, repo_slug string"
    key = ("t", "s", "p", "r")
    when = lambda s: F.timestamp_seconds(F.lit(s))
    prs = spark.createDataFrame([(*key, 1, "merged", "x", "b", "A")], f"{repo}, pr_id bigint, state_norm string, title string, source_branch string, person_key string").withColumns({"created_on": when(0), "closed_on": when(7200)})
    reviews = spark.createDataFrame([(*key, 1, "B", 1)], f"{repo}, pr_id bigint, person_key string, approved int").withColumn("reviewed_at", when(3600))
    links = spark.createDataFrame([(*key, 1, "h")] * 3, f"{repo}, pr_id bigint, commit_hash string")
    commits = spark.createDataFrame([(*key, "h")], f"{repo}, commit_hash string").withColumn("date", when(0))
    files = spark.createDataFrame([(*key, "h", "README.md")], f"{repo}, commit_hash string, file_path string")
    out = code_metrics.pr_props(prs, reviews, links, commits, files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 5
    row = out.first()
    assert (row.cycle_time_hours, row.review_time_hours, row.reviewers) == (2.0, 1.0, 1)


def test_task_json_is_parsed_once(spark):
    issues = spark.range(10).select(
        F.lit("t").alias("tenant_id"), F.lit("2024-01-01T00:00:00Z").alias("updated"), F.lit("Bug").alias("issue_type"), F.lit(None).cast("string").alias("due_date"), F.col("id").cast("string").alias("id_readable"),
        F.when(F.col("id") < 8, F.concat(F.lit('{"assignee":{"emailAddress":"A@x"},"timespent":'), F.col("id").cast("string"), F.lit(',"status":{"name":"Closed"}}'))).alias("custom_fields_json"),
    )
    states = gold.closed_states(issues)
    assert states._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r.person_id, r.tasks_closed, r.bugs_fixed) for r in states.collect()] == [("a@x", 8, 8)]


def test_period_values_sort_no_rows(spark, rows):
    seen = [("tasks_completed", "a", "u1", 2.0), ("tasks_completed", "a", "u2", 3.0), ("tasks_completed", "a", None, None), ("estimation_accuracy", "a", "u1", 90.0), ("estimation_accuracy", "a", "u2", 130.0), ("estimation_accuracy", "a", "u2", 500.0), ("x", "a", "u1", 1.0), ("x", "a", "u2", 2.0), ("x", "a", "u2", 6.0), ("x", "b", None, None)]
    df = spark.createDataFrame([("t", *r) for r in seen], "tenant_id string, metric_key string, person_id string, org_unit_id string, metric_value double")
    out = metrics.person_period_values(df, "task_delivery")
    first = out._jdf.queryExecution().sparkPlan().toString().splitlines()[-3:]
    assert not any("SortAggregate" in line for line in first)
    assert rows(out, "metric_key", "person_id", "org_unit_id", "v_period") == [("estimation_accuracy", "a", "u2", 80.0), ("tasks_completed", "a", "u2", 5.0), ("x", "a", "u2", 3.0), ("x", "b", None, None)]


COMMIT = "tenant_id string, source_id string, project_key string, repo_slug string, commit_hash string"


def commit_rows(spark):
    """Two commits of one hash in two repositories, one commit of no tenant."""
    seen = [("t", "s", "p", "r1", "h", "a"), ("t", "s", "p", "r2", "h", "b"), (None, "s", "p", "r1", "g", "a")]
    df = spark.createDataFrame([(*r[:5], "", r[5]) for r in seen], f"{COMMIT}, author_email string, author_name string")
    return silver.git_commit_fact(df.withColumns({"date": F.lit("2024-01-03").cast("timestamp"), "is_merge_commit": F.lit(0)}))


def file_rows(spark):
    seen = [("t", "s", "p", "r1", "h", "f1", "a.py", 5), ("t", "s", "p", "r2", "h", "f2", "b.test.js", 7), ("t", "s", "p", "r3", "h", "f3", "c.py", 9)]
    return spark.createDataFrame(seen, f"{COMMIT}, unique_key string, file_path string, lines_added bigint")


def test_commits_meet_by_their_hash_first(spark, rows):
    out = silver.git_file_change_fact(file_rows(spark), commit_rows(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert join.index("commit_hash") < join.index("tenant_id")
    assert out.columns[:7] == ["tenant_id", "source_id", "project_key", "repo_slug", "commit_hash", "unique_key", "file_path"]
    assert rows(out, "unique_key", "repo_slug", "person_key", "file_category") == [("f1", "r1", "a", "code"), ("f2", "r2", "b", "spec")]


def test_weekly_counts_are_dealt_once(spark, rows):
    commits = commit_rows(spark)
    cols = f"{COMMIT.replace('commit_hash', 'merge_commit_hash')}, author_email string, author_name string, state string"
    seen = [("t", "s", "p", "r1", "h", "", "a", "MERGED"), ("t", "s", "p", "r1", "x", "", "c", "MERGED"), (None, "s", "p", "r1", "x", "", "a", "MERGED")]
    at = F.lit("2024-01-04").cast("timestamp")
    prs = silver.git_pr_fact(spark.createDataFrame(seen, cols).withColumns({"created_on": at, "closed_on": at}))
    out = silver.git_person_weekly(prs, commits, silver.git_file_change_fact(file_rows(spark), commits))
    # One join for the files' commits and one for merge commits.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    week = datetime(2024, 1, 1).date()
    assert {(r.week, r.unique_key) for r in out.collect() if r.tenant_id} == {(week, f"t|{p}|2024-01-01") for p in "abc"}
    assert rows(out, "tenant_id", "person_key", "commits", "prs_merged", "code_loc", "spec_lines") == sorted(
        [("t", "a", 1, 1, 5, 0), ("t", "b", 1, 0, 0, 7), ("t", "c", 0, 1, 0, 0), (None, "a", 1, 0, 0, 0), (None, "a", 0, 1, 0, 0)], key=repr
    )
