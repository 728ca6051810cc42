"""Stored Gold against folding everything again, after refreshes of only the touched days."""

import json

import pytest
from orgpulse.operators import gold
from orgpulse.plans.gold_store import GoldTables, Inputs
from orgpulse.sources import versioned

EMPTY = {
    "employees": "tenant_id string, workEmail string, jobTitle string, displayName string, department string, status string, _airbyte_extracted_at timestamp, unique_key string",
    "issues": "tenant_id string, custom_fields_json string, updated string, issue_type string, due_date string, id_readable string",
    "comms": "tenant_id string, user_email string, activity_date string, emails_sent long, source string",
    "participants": "tenant_id string, email string, join_time string, leave_time string, meeting_uuid string",
    "teams": "tenant_id string, userPrincipalName string, lastActivityDate string, teamChatMessageCount double, privateChatMessageCount double, meetingsAttendedCount double, callCount double",
    "onedrive": "tenant_id string, userPrincipalName string, lastActivityDate string, sharedInternallyFileCount double, sharedExternallyFileCount double",
}


def issue(person, day, kind="Task", spent=0, estimate=0):
    fields = {"assignee": {"emailAddress": person}, "status": {"name": "Closed"}, "timespent": spent, "timeoriginalestimate": estimate}
    return ("t", json.dumps(fields), f"2024-01-{day:02d}T10:00:00Z", kind, "2024-01-05", "X-1")


def call(person, day, minutes):
    return ("t", person, f"2024-01-{day:02d}T10:00:00Z", f"2024-01-{day:02d}T10:{minutes:02d}:00Z", "m")


def inputs(spark, issues=(), calls=(), people=()):
    rows = {"issues": issues, "participants": calls, "employees": people}
    frames = {name: spark.createDataFrame(list(rows.get(name, ())), schema) for name, schema in EMPTY.items()}
    return Inputs(**frames, sharepoint=frames["onedrive"])


def same(found, want):
    return found.exceptAll(want.select(found.columns)).count() == want.select(found.columns).exceptAll(found).count() == 0


@pytest.fixture()
def tables(spark, tmp_path):
    return GoldTables(spark, f"file://{tmp_path}/gold")


def test_refreshed_days_equal_folding_everything_again(spark, tables, monkeypatch):
    monkeypatch.setattr(versioned, "FILE_ROWS", 8)
    people = [("t", f"P{i}@x.com", "Lead", f"P{i}", "u", "Active", None, str(i)) for i in range(4)]
    first = [issue(f"p{i % 4}@x.com", 1 + i % 20, "Bug" if i % 3 else "Task", i, i * 2) for i in range(80)]
    calls = [call(f"p{i % 3}@x.com", 1 + i % 15, i % 50) for i in range(60)]
    later = [issue("p1@x.com", 4, "Bug", 5, 9), issue("new@x.com", 25)]
    late_calls = [call("p2@x.com", 4, 30), call("p2@x.com", 4, 30)]
    assert not tables.exists()
    tables.build(inputs(spark, first, calls, people))
    assert tables.exists()
    before = {r.file for r in versioned.manifest(spark, f"{tables.path}/closed").collect()}
    whole = inputs(spark, first + later, calls + late_calls, people)
    days = inputs(spark, later, late_calls).days()
    assert sorted(r.metric_date.day for r in days.collect()) == [4, 25]
    tables.refresh(whole, days)
    assert same(tables.closed(), gold.closed_of(whole.states()["closed"])) and same(tables.comms(), gold.comms_of(whole.states()["comms"]))
    assert tables.closed().where("person_id = 'p1@x.com' AND day(metric_date) = 4").first().bugs_fixed >= 1
    after = {r.file for r in versioned.manifest(spark, f"{tables.path}/closed").collect()}
    assert len(before & after) >= len(before) // 2  # files of other days are carried on


def test_a_day_that_lost_its_rows_is_empty_and_refreshing_twice_changes_nothing(spark, tables):
    rows = [issue("a@x.com", 3), issue("a@x.com", 4), issue("b@x.com", 4)]
    tables.build(inputs(spark, rows))
    day = spark.sql("SELECT DATE '2024-01-04' AS metric_date")
    for _ in range(2):
        tables.refresh(inputs(spark, rows[:1]), day)
        assert [(r.person_id, r.metric_date.day) for r in tables.closed().collect()] == [("a@x.com", 3)]


def test_days_without_a_date_are_a_day_of_their_own(spark, tables):
    calls = [call("a@x.com", 3, 10), ("t", "b@x.com", None, None, "m")]
    tables.build(inputs(spark, calls=calls))
    assert tables.comms().where("metric_date IS NULL").count() == 1
    tables.refresh(inputs(spark, calls=calls + [("t", "c@x.com", None, None, "n")]), spark.sql("SELECT CAST(NULL AS DATE) AS metric_date"))
    assert sorted(r.person_id for r in tables.comms().where("metric_date IS NULL").collect()) == ["b@x.com", "c@x.com"]
    assert tables.comms().count() == 3


def test_averages_come_from_sums_and_counts(spark, tables):
    rows = [issue("a@x.com", 3, spent=10, estimate=20), issue("a@x.com", 3, spent=20, estimate=40), issue("a@x.com", 3, spent=99), issue("b@x.com", 3)]
    tables.build(inputs(spark, rows))
    got = {r.person_id: (r.tasks_closed, r.avg_time_spent, r.avg_time_estimate) for r in tables.closed().collect()}
    assert got == {"a@x.com": (3, 15.0, 30.0), "b@x.com": (1, None, None)}
    assert same(tables.closed(), gold.closed_tasks(inputs(spark, rows).issues))
