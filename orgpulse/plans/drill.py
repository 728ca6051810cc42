"""Row-level breakdowns of single KPIs, for a person or for every member of a unit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.gold import PERSON

# --- person drills: filter and project ------------------------------------------------------


def commits(commit_fact: DataFrame) -> DataFrame:
    return commit_fact.select("tenant_id", F.col("person_key").alias("person_id"), "commit_hash", "repo_slug", "lines_added", "lines_removed", "date")


def pull_requests(pr_fact: DataFrame) -> DataFrame:
    return pr_fact.select("tenant_id", F.col("person_key").alias("person_id"), "title", "repo_slug", "state", "cycle_time_h")


def reviews(review_fact: DataFrame, pr_fact: DataFrame) -> DataFrame:
    """Reviews given: title and author of the request, outcome, hours from creation to review."""
    keys = ["tenant_id", "source_id", "project_key", "repo_slug", "pr_id"]
    about = pr_fact.select(*keys, "title", F.col("person_key").alias("author"), "created_on")
    return review_fact.join(about, keys).select(
        "tenant_id",
        F.col("person_key").alias("person_id"),
        "title",
        "author",
        F.col("status").alias("outcome"),
        fx.hours_between("created_on", "reviewed_at").alias("time_to_review_h"),
    )


def builds(ci_runs: DataFrame) -> DataFrame:
    return ci_runs.select(*PERSON, "build_id", "branch", "status", "duration_s")


def tasks_completed(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("done")).select(*PERSON, "task_id", "story_points", "dev_time_h", "closed_date")


def cycle_time(tasks: DataFrame) -> DataFrame:
    return tasks.select(*PERSON, "task_id", "story_points", "dev_time_h", "status")


def task_reopen(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("reopened_at").isNotNull()).select(*PERSON, "task_id", "reopen_reason", "reopened_at", "closed_date")


def bugs_fixed(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("done") & (F.col("task_type") == "Bug")).select(
        *PERSON, "task_id", "priority", F.col("dev_time_h").alias("fix_time_h"), "closed_date"
    )


# --- unit drills: one row per member, compared with unit and organisation --------------------------


def _per_member(rows: DataFrame, people: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Fold facts per person, then attach name and unit."""
    folded = rows.groupBy(*PERSON).agg(*[c.alias(name) for name, c in measures.items()])
    return folded.join(people.select(*PERSON, "display_name", "org_unit_id"), PERSON)


def _against(members: DataFrame, value: str, levels: dict[str, list[str]]) -> DataFrame:
    """Average of ``value`` per level, joined back as a column. One small aggregate per level."""
    out = members
    for name, keys in levels.items():
        mean = members.groupBy(*keys).agg(F.avg(value).alias(name))
        out = out.join(mean, keys, "left")
    return out


UNIT = ["tenant_id", "org_unit_id"]
ORG = ["tenant_id"]


def team_members(tasks: DataFrame, pr_fact: DataFrame, runs: DataFrame, focus: DataFrame, usage: DataFrame, people: DataFrame) -> DataFrame:
    done = tasks.where(F.col("done")).groupBy(*PERSON).agg(F.count(F.lit(1)).alias("tasks"), F.avg("dev_time_h").alias("dev_time_h"))
    prs = (
        pr_fact.where(F.col("state_norm") == "merged")
        .groupBy("tenant_id", F.col("person_key").alias("person_id"))
        .agg(F.count(F.lit(1)).alias("prs"))
    )
    built = runs.groupBy(*PERSON).agg(fx.percent(fx.count_where(F.col("status") == "success"), F.count(F.lit(1)), 1).alias("build_pct"))
    focused = focus.groupBy(*PERSON).agg(F.avg("focus_time_pct").alias("focus_pct"))
    lines = usage.groupBy(*PERSON).agg(fx.percent(F.sum("ai_lines"), F.sum("ai_lines") + F.sum("clean_loc"), 1).alias("ai_loc_pct"))
    out = people.where(F.col("status") == "Active").select(*PERSON, "display_name", "org_unit_id")
    for part in (done, prs, built, focused, lines):
        out = out.join(part, PERSON, "left")
    return out


def team_tasks(tasks: DataFrame, people: DataFrame) -> DataFrame:
    members = _per_member(
        tasks.where(F.col("done")),
        people,
        {"tasks_closed": F.count(F.lit(1)), "story_points": F.sum("story_points"), "avg_points": F.avg("story_points")},
    )
    out = _against(members, "tasks_closed", {"unit_avg": UNIT})
    return out.withColumn("vs_team", F.col("tasks_closed") - F.col("unit_avg"))


def team_dev_time(tasks: DataFrame, people: DataFrame) -> DataFrame:
    members = _per_member(
        tasks.where(F.col("done")), people, {"dev_time_h": F.avg("dev_time_h"), "tasks_sampled": F.count("dev_time_h")}
    )
    out = _against(members, "dev_time_h", {"unit_avg": UNIT, "org_avg": ORG})
    return out.withColumns(
        {"vs_team": F.col("dev_time_h") - F.col("unit_avg"), "vs_org": F.col("dev_time_h") - F.col("org_avg")}
    )


def _merged(pr_fact: DataFrame) -> DataFrame:
    return pr_fact.where(F.col("state_norm") == "merged").withColumnRenamed("person_key", "person_id")


def team_prs(pr_fact: DataFrame, review_fact: DataFrame, people: DataFrame) -> DataFrame:
    members = _per_member(
        _merged(pr_fact),
        people,
        {
            "prs_merged": F.count(F.lit(1)),
            "avg_cycle_h": F.avg("cycle_time_h"),
            "avg_size": F.avg(F.col("lines_added") + F.col("lines_removed")),
        },
    )
    given = review_fact.groupBy("tenant_id", F.col("person_key").alias("person_id")).agg(F.count(F.lit(1)).alias("_given"))
    return members.join(given, PERSON, "left").withColumn("reviews_given", fx.or_zero("_given")).drop("_given")


def team_pr_cycle(pr_timing: DataFrame, people: DataFrame) -> DataFrame:
    members = _per_member(
        pr_timing,
        people,
        {"cycle_h": F.avg("cycle_h"), "pickup_h": F.avg("pickup_h"), "review_h": F.avg("review_h")},
    )
    out = _against(members, "cycle_h", {"org_avg": ORG})
    return out.withColumn("vs_org", F.col("cycle_h") - F.col("org_avg"))


def team_bugs(tasks: DataFrame, people: DataFrame) -> DataFrame:
    reopened = fx.count_where(F.col("reopened_at").isNotNull())
    return _per_member(
        tasks.where(F.col("done") & (F.col("task_type") == "Bug")),
        people,
        {
            "bugs_fixed": F.count(F.lit(1)),
            "avg_fix_time_h": F.avg("dev_time_h"),
            "reopened": reopened,
            "reopen_rate": fx.ratio(reopened, F.count(F.lit(1))),
        },
    )


def team_build(runs: DataFrame, people: DataFrame) -> DataFrame:
    passed = fx.count_where(F.col("status") == "success")
    return _per_member(
        runs,
        people,
        {
            "build_pct": fx.percent(passed, F.count(F.lit(1)), 1),
            "passed": passed,
            "failed": fx.count_where(F.col("status") != "success"),
        },
    )


def team_focus(focus: DataFrame, people: DataFrame) -> DataFrame:
    return _per_member(
        focus,
        people,
        {"focus_pct": F.avg("focus_time_pct"), "focus_hours": F.sum("dev_time_h"), "meeting_hours": F.sum("meeting_hours")},
    )


def team_ai_active(usage: DataFrame, people: DataFrame) -> DataFrame:
    per_tool = usage.groupBy(*PERSON, "tool").agg(
        F.sum("sessions").alias("sessions"), F.sum("ai_lines").alias("ai_lines"), F.sum("clean_loc").alias("clean_loc")
    )
    return _per_member(
        per_tool,
        people,
        {
            "tools_active": fx.count_where(F.col("sessions") > 0),
            "ai_loc_share": fx.percent(F.sum("ai_lines"), F.sum("ai_lines") + F.sum("clean_loc"), 1),
            "sessions": F.sum("sessions"),
        },
    )


def team_ai_loc(usage: DataFrame, people: DataFrame) -> DataFrame:
    return _per_member(
        usage,
        people,
        {
            "ai_loc_pct": fx.percent(F.sum("ai_lines"), F.sum("ai_lines") + F.sum("clean_loc"), 1),
            "ai_lines": F.sum("ai_lines"),
            "clean_loc": F.sum("clean_loc"),
        },
    )


def team_reopen(tasks: DataFrame, people: DataFrame) -> DataFrame:
    """Reopen rate per member and the most frequent reason (smallest text on a tie)."""
    per_reason = (
        tasks.where(F.col("done"))
        .groupBy(*PERSON, "reopen_reason")
        .agg(F.count(F.lit(1)).alias("n"), fx.count_where(F.col("reopened_at").isNotNull()).alias("again"))
    )
    reasons = F.min_by("reopen_reason", F.when(F.col("again") > 0, F.struct(-F.col("again"), F.col("reopen_reason"))))
    return _per_member(
        per_reason,
        people,
        {
            "reopen_rate": fx.ratio(F.sum("again"), F.sum("n")),
            "reopened": F.sum("again"),
            "total_closed": F.sum("n"),
            "top_reason": reasons,
        },
    )


DRILLS: dict[str, Callable[..., DataFrame]] = {
    "commits": commits,
    "pull-requests": pull_requests,
    "reviews": reviews,
    "builds": builds,
    "tasks-completed": tasks_completed,
    "cycle-time": cycle_time,
    "task-reopen": task_reopen,
    "bugs-fixed": bugs_fixed,
    "team-members": team_members,
    "team-tasks": team_tasks,
    "team-dev-time": team_dev_time,
    "team-prs": team_prs,
    "team-pr-cycle": team_pr_cycle,
    "team-bugs": team_bugs,
    "team-build": team_build,
    "team-focus": team_focus,
    "team-ai-active": team_ai_active,
    "team-ai-loc": team_ai_loc,
    "team-reopen": team_reopen,
}


def drill(drill_id: str, *sources: DataFrame, person_id: str | None = None, org_unit_id: str | None = None) -> DataFrame:
    """Run one drill, scoped to a person or a unit. Inputs are already bounded by date."""
    out = DRILLS[drill_id](*sources)
    if person_id is not None:
        out = out.where(F.col("person_id") == person_id)
    if org_unit_id is not None:
        out = out.where(F.col("org_unit_id") == org_unit_id)
    return out
