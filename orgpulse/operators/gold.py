"""Gold views: the columns dashboards read. Every view keeps the tenant in its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.sources import schemas

PERSON = ["tenant_id", "person_id"]
PERSON_DAY = [*PERSON, "metric_date"]
WORKDAY_HOURS = 8.0

# Seniority patterns, tested in this order; everything else is Mid.
SENIOR_PATTERNS = [
    "%senior%", "%lead%", "%principal%", "%architect%", "%director%", "%head%", "%vice president%", "%vp of%",
    "vp %", "%chief%", "%president%", "%ceo%", "%cto%", "%cfo%", "%coo%", "%executive%",
]
JUNIOR_PATTERNS = ["%junior%", "%intern%", "%trainee%"]
CLOSED_STATES = ["Closed", "Resolved", "Verified"]
UNKNOWN_USER = "(Unknown)"


def seniority(title: str) -> Column:
    return fx.multi_if(
        (fx.ilike_any(title, SENIOR_PATTERNS), F.lit("Senior")),
        (fx.ilike_any(title, JUNIOR_PATTERNS), F.lit("Junior")),
        default=F.lit("Mid"),
    )


def people(employees: DataFrame) -> DataFrame:
    """Newest known name, department, title and status per lower-cased work e-mail."""
    order, tie = "_airbyte_extracted_at", "unique_key"
    rows = employees.where(fx.filled("workEmail")).withColumns(
        {"person_id": F.lower("workEmail"), "_seniority": seniority("jobTitle")}
    )
    return rows.groupBy(*PERSON).agg(
        fx.latest_filled("displayName", order, tie).alias("display_name"),
        fx.latest_filled("department", order, tie).alias("org_unit_id"),
        fx.latest_filled("department", order, tie).alias("org_unit_name"),
        fx.latest_filled("_seniority", order, tie).alias("seniority"),
        fx.latest_filled("jobTitle", order, tie).alias("job_title"),
        fx.latest_filled("status", order, tie).alias("status"),
    )


# --- tasks ------------------------------------------------------------------------------------


TASK_FIELDS = (
    "assignee struct<emailAddress:string>, status struct<name:string>, resolution struct<name:string>, "
    "timeoriginalestimate double, timespent double"
)


def task_person_daily(issues: DataFrame) -> DataFrame:
    """Task rows with assignee, state and estimates; the custom-field JSON is parsed once per row."""
    custom = F.from_json("custom_fields_json", TASK_FIELDS)
    # Filters on an exploded column stay above it; on a plain one each would parse the text again.
    return (
        issues.withColumn("_c", F.explode(F.array(custom)))
        .select(
            "tenant_id",
            F.lower(fx.or_empty("_c.assignee.emailAddress")).alias("person_id"),
            F.to_date(fx.parse_iso("updated")).alias("metric_date"),
            "issue_type",
            fx.or_empty("_c.status.name").alias("status_name"),
            fx.or_empty("_c.resolution.name").alias("resolution"),
            "due_date",
            F.coalesce("_c.timeoriginalestimate", F.lit(0.0)).alias("time_estimate_sec"),
            F.coalesce("_c.timespent", F.lit(0.0)).alias("time_spent_sec"),
            "id_readable",
        )
        .where(F.col("person_id") != "")
    )


def closed_states(issues: DataFrame) -> DataFrame:
    """Sums and counts of closed work per person and day; parts of a day add up, so days can be folded again by themselves."""
    tasks = task_person_daily(issues).where(F.col("status_name").isin(CLOSED_STATES))
    due = fx.filled("due_date")
    estimated = F.col("time_estimate_sec") > 0
    return tasks.groupBy(*PERSON_DAY).agg(
        F.count(F.lit(1)).alias("tasks_closed"),
        fx.count_where(F.col("issue_type") == "Bug").alias("bugs_fixed"),
        fx.count_where(due & (F.col("metric_date") <= F.col("due_date").try_cast("date"))).alias("on_time_count"),
        fx.count_where(due).alias("has_due_date_count"),
        fx.count_where(estimated).alias("estimated_count"),
        F.sum(F.when(estimated, F.col("time_spent_sec"))).alias("time_spent"),
        F.sum(F.when(estimated, F.col("time_estimate_sec"))).alias("time_estimate"),
    )


def closed_of(states: DataFrame) -> DataFrame:
    """Closed work per person and day from its states."""
    return states.select(
        *PERSON_DAY,
        "tasks_closed",
        "bugs_fixed",
        "on_time_count",
        "has_due_date_count",
        fx.ratio("time_spent", "estimated_count").alias("avg_time_spent"),
        fx.ratio("time_estimate", "estimated_count").alias("avg_time_estimate"),
    )


def closed_tasks(issues: DataFrame) -> DataFrame:
    """Closed work per person and day. JSON is parsed here once; store the result as a table."""
    return closed_of(closed_states(issues))


# --- communication ------------------------------------------------------------------------------


def _report_day() -> list[Column]:
    return [
        F.col("tenant_id"),
        F.lower("userPrincipalName").alias("person_id"),
        fx.parse_day("lastActivityDate").alias("metric_date"),
    ]


def teams_person_daily(teams: DataFrame) -> DataFrame:
    known = teams.where(fx.filled("userPrincipalName") & (F.col("userPrincipalName") != UNKNOWN_USER))
    return known.select(
        *_report_day(),
        (fx.or_zero("teamChatMessageCount") + fx.or_zero("privateChatMessageCount")).alias("teams_messages"),
        fx.or_zero("meetingsAttendedCount").alias("teams_meetings"),
        fx.or_zero("callCount").alias("teams_calls"),
    )


def _shared_files(onedrive: DataFrame, sharepoint: DataFrame) -> DataFrame:
    cols = ["tenant_id", "userPrincipalName", "lastActivityDate", "sharedInternallyFileCount", "sharedExternallyFileCount"]
    rows = onedrive.select(cols).unionByName(sharepoint.select(cols)).where(fx.filled("userPrincipalName"))
    shared = fx.or_zero("sharedInternallyFileCount") + fx.or_zero("sharedExternallyFileCount")
    return rows.select(*_report_day(), shared.alias("files_shared"))


def files_person_daily(onedrive: DataFrame, sharepoint: DataFrame) -> DataFrame:
    return _shared_files(onedrive, sharepoint).groupBy(*PERSON_DAY).agg(F.sum("files_shared").alias("files_shared"))


def _sessions(participants: DataFrame) -> DataFrame:
    joined, left = fx.parse_iso("join_time"), fx.parse_iso("leave_time")
    return participants.where(fx.filled("email")).select(
        "tenant_id",
        F.lower("email").alias("person_id"),
        F.to_date(joined).alias("metric_date"),
        "meeting_uuid",
        fx.seconds_between(joined, left).alias("_seconds"),
    )


COMMS_MEASURES = ["emails_sent", "zoom_calls", "_seconds", "teams_messages", "teams_meetings", "files_shared"]


def comms_states(
    comms: DataFrame, participants: DataFrame, teams: DataFrame, onedrive: DataFrame, sharepoint: DataFrame
) -> DataFrame:
    """Sums of e-mail, calls (one per session), meeting seconds, messages, meetings and files per person and day.

    The union leaves the measures a source lacks NULL, and one aggregate folds all sources. Seconds are
    summed as integers, so hours do not depend on the order of rows.
    """
    mail = comms.select(
        "tenant_id",
        F.lower("user_email").alias("person_id"),
        fx.parse_day("activity_date").alias("metric_date"),
        F.col("emails_sent").cast("double").alias("emails_sent"),
    )
    calls = _sessions(participants).select(*PERSON_DAY, F.lit(1.0).alias("zoom_calls"), "_seconds")
    chat = teams_person_daily(teams).drop("teams_calls")
    files = _shared_files(onedrive, sharepoint)
    rows = mail
    for part in (calls, chat, files):
        rows = rows.unionByName(part, allowMissingColumns=True)
    totals = {m: F.coalesce(F.sum(m), F.lit(0)) for m in COMMS_MEASURES}
    seconds = totals.pop("_seconds").cast("bigint").alias("meeting_seconds")
    return rows.groupBy(*PERSON_DAY).agg(*[c.cast("double").alias(m) for m, c in totals.items()], seconds)


def comms_of(states: DataFrame) -> DataFrame:
    """Communication per person and day from its states, with meeting hours and the day as text."""
    hours = (F.col("meeting_seconds") / F.lit(3600.0)).alias("meeting_hours")
    return states.select(*PERSON, F.col("metric_date").cast("string").alias("metric_date"), *[m for m in COMMS_MEASURES if m != "_seconds"], hours)


def comms_daily(
    comms: DataFrame, participants: DataFrame, teams: DataFrame, onedrive: DataFrame, sharepoint: DataFrame
) -> DataFrame:
    """E-mail, calls, meeting hours, messages, meetings and files per person and day."""
    return comms_of(comms_states(comms, participants, teams, onedrive, sharepoint))


def email_daily(comms: DataFrame) -> DataFrame:
    mail = F.lower("user_email")
    return comms.select(
        "tenant_id",
        mail.alias("person_id"),
        F.col("activity_date").alias("metric_date"),
        mail.alias("user_email"),
        "emails_sent",
        "source",
    )


def zoom_person_daily(participants: DataFrame) -> DataFrame:
    """Distinct meetings (not sessions) and hours. Sessions are folded per meeting, then meetings are counted."""
    per_meeting = _sessions(participants).groupBy(*PERSON_DAY, "meeting_uuid").agg(F.sum("_seconds").alias("_seconds"))
    return per_meeting.groupBy(*PERSON_DAY).agg(
        F.count("meeting_uuid").alias("zoom_calls"), (F.sum("_seconds") / F.lit(3600.0)).alias("meeting_hours")
    )


# --- long metric rows -----------------------------------------------------------------------------


def _with_unit(df: DataFrame, people_: DataFrame) -> DataFrame:
    return df.join(people_.select(*PERSON, "org_unit_id"), PERSON, "left")


def _bullets(df: DataFrame, people_: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One join for the org unit, then one unpivot of all measures."""
    ids = ["tenant_id", "person_id", "org_unit_id", "metric_date"]
    wide = _with_unit(df, people_).select(
        *ids[:-1], F.col("metric_date").cast("string").alias("metric_date"), *[c.cast("double").alias(k) for k, c in measures.items()]
    )
    return wide.unpivot(ids, list(measures), "metric_key", "metric_value")


def collab_bullet_rows(comms_daily_: DataFrame, people_: DataFrame) -> DataFrame:
    no_meeting = F.when(F.col("meeting_hours") + F.col("teams_meetings") == 0, 1).otherwise(0)
    return _bullets(
        comms_daily_,
        people_,
        {
            "m365_emails_sent": F.col("emails_sent"),
            "zoom_calls": F.col("zoom_calls"),
            "meeting_hours": F.col("meeting_hours"),
            "m365_teams_messages": F.col("teams_messages"),
            "m365_files_shared": F.col("files_shared"),
            "meeting_free": no_meeting,
        },
    )


def task_delivery_bullet_rows(closed: DataFrame, people_: DataFrame) -> DataFrame:
    on_time = F.coalesce(fx.percent("on_time_count", "has_due_date_count", 1), F.lit(0.0))
    return _bullets(
        closed,
        people_,
        {"tasks_completed": F.col("tasks_closed"), "task_reopen_rate": F.lit(0.0), "due_date_compliance": on_time},
    )


def code_quality_bullet_rows(closed: DataFrame, people_: DataFrame) -> DataFrame:
    placeholders = {k: F.lit(0.0) for k in ("prs_per_dev", "pr_cycle_time", "build_success")}
    return _bullets(closed, people_, {"bugs_fixed": F.col("bugs_fixed"), **placeholders})


def empty_relation(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def ai_bullet_rows(dev_usage: DataFrame | None, people_: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Active flag, sessions and accepted lines per person and day; typed and empty without usage."""
    if dev_usage is None:
        return empty_relation(spark, schemas.BULLET_ROWS)
    daily = dev_usage.groupBy(*PERSON_DAY).agg(
        F.sum("sessions").alias("sessions"), F.sum("lines").alias("lines"), F.max("is_active").alias("active")
    )
    return _bullets(
        daily,
        people_,
        {
            "active_ai_members": F.col("active"),
            "cursor_active": F.col("active"),
            "cursor_agents": F.col("sessions"),
            "cursor_lines": F.col("lines"),
            "team_ai_loc": F.col("lines"),
        },
    )


# --- dashboard views ----------------------------------------------------------------------------------


def focus_share(hours: Column) -> Column:
    """Share of the working day outside meetings, in percent, bounded to 0..100."""
    return fx.clamp(fx.tidy_round(F.lit(100.0) - hours / F.lit(WORKDAY_HOURS) * 100, 1), 0, 100)


def exec_summary(people_: DataFrame, closed: DataFrame, comms_daily_: DataFrame, keep_all_days: bool = False) -> DataFrame:
    """Unit and day: headcount, tasks, bugs, focus.

    By default days come from closed tasks, and focus joins on them. With
    ``keep_all_days`` tasks and focus join full outer, so days with meetings
    but no closed task stay.
    """
    unit = ["tenant_id", "org_unit_id"]
    active = people_.where(F.col("status") == "Active")
    heads = active.groupBy(*unit, "org_unit_name").agg(F.count(F.lit(1)).cast("int").alias("headcount"))
    members = active.select(*PERSON, "org_unit_id")
    tasks = (
        closed.join(members, PERSON)
        .groupBy(*unit, F.col("metric_date").cast("string").alias("metric_date"))
        .agg(F.sum("tasks_closed").alias("tasks_closed"), F.sum("bugs_fixed").alias("bugs_fixed"))
    )
    focus = (
        comms_daily_.join(members, PERSON)
        .groupBy(*unit, "metric_date")
        .agg(fx.tidy_round(F.lit(100.0) - F.avg("meeting_hours") / F.lit(WORKDAY_HOURS) * 100, 1).alias("focus"))
    )
    days = tasks.join(focus, [*unit, "metric_date"], "full" if keep_all_days else "left")
    zero = F.lit(0.0)
    return heads.join(days, unit, "left").select(
        *unit,
        "org_unit_name",
        "headcount",
        fx.or_zero("tasks_closed").alias("tasks_closed"),
        fx.or_zero("bugs_fixed").alias("bugs_fixed"),
        F.lit(None).cast("double").alias("build_success_pct"),
        fx.clamp(F.coalesce(F.col("focus"), F.lit(100.0)), 0, 100).alias("focus_time_pct"),
        zero.alias("ai_adoption_pct"),
        zero.alias("ai_loc_share_pct"),
        zero.alias("pr_cycle_time_h"),
        "metric_date",
    )


def _meeting_hours(comms_daily_: DataFrame) -> DataFrame:
    """``comms_daily`` already holds one row per person and day."""
    return comms_daily_.select(*PERSON_DAY, "meeting_hours")


def team_member(people_: DataFrame, closed: DataFrame, comms_daily_: DataFrame, keep_all_days: bool = False) -> DataFrame:
    """Active people with tasks, bugs, development hours and focus per day."""
    tasks = closed.select(*PERSON, F.col("metric_date").cast("string").alias("metric_date"), "tasks_closed", "bugs_fixed")
    days = tasks.join(_meeting_hours(comms_daily_), PERSON_DAY, "full" if keep_all_days else "left")
    met = F.coalesce(F.col("meeting_hours"), F.lit(0.0))
    active = people_.where(F.col("status") == "Active")
    return active.join(days, PERSON, "left").select(
        *PERSON,
        "display_name",
        "seniority",
        "org_unit_id",
        fx.or_zero("tasks_closed").cast("double").alias("tasks_closed"),
        fx.or_zero("bugs_fixed").cast("double").alias("bugs_fixed"),
        F.greatest(F.lit(0.0), fx.tidy_round(F.lit(WORKDAY_HOURS) - met, 1)).alias("dev_time_h"),
        F.lit(0.0).alias("prs_merged"),
        F.lit(None).cast("double").alias("build_success_pct"),
        focus_share(met).alias("focus_time_pct"),
        F.array().cast("array<string>").alias("ai_tools"),
        F.lit(0.0).alias("ai_loc_share_pct"),
        "metric_date",
    )


def ic_kpis(closed: DataFrame, people_: DataFrame, comms_daily_: DataFrame) -> DataFrame:
    tasks = closed.withColumn("metric_date", F.col("metric_date").cast("string"))
    joined = _with_unit(tasks, people_).join(_meeting_hours(comms_daily_), PERSON_DAY, "left")
    zero = F.lit(0.0)
    return joined.select(
        *PERSON,
        "org_unit_id",
        "metric_date",
        zero.alias("loc"),
        zero.alias("ai_loc_share_pct"),
        zero.alias("prs_merged"),
        zero.alias("pr_cycle_time_h"),
        focus_share(F.coalesce(F.col("meeting_hours"), zero)).alias("focus_time_pct"),
        F.col("tasks_closed").cast("double").alias("tasks_closed"),
        F.col("bugs_fixed").cast("double").alias("bugs_fixed"),
        F.lit(None).cast("double").alias("build_success_pct"),
        zero.alias("ai_sessions"),
    )


def ic_chart_delivery(closed: DataFrame, people_: DataFrame) -> DataFrame:
    """Tasks done per Sunday week; weeks are folded before the org unit is joined."""
    weekly = closed.groupBy(*PERSON, fx.sunday_week("metric_date").cast("string").alias("date_bucket")).agg(
        F.sum("tasks_closed").alias("tasks_done")
    )
    return _with_unit(weekly, people_).select(
        *PERSON,
        "org_unit_id",
        "date_bucket",
        F.col("date_bucket").alias("metric_date"),
        F.lit(0).cast("bigint").alias("commits"),
        F.lit(0).cast("bigint").alias("prs_merged"),
        "tasks_done",
    )


def ic_chart_loc(closed: DataFrame, people_: DataFrame, weekly_code: DataFrame | None = None) -> DataFrame:
    """Weekly code-line rows. Weeks come from closed tasks with zero lines, or from ``git_person_weekly`` when given."""
    if weekly_code is None:
        weeks = closed.select(*PERSON, fx.sunday_week("metric_date").cast("string").alias("date_bucket")).distinct()
        code, spec = F.lit(0.0), F.lit(0.0)
    else:
        weeks = weekly_code.withColumnsRenamed({"person_key": "person_id"}).withColumn(
            "date_bucket", F.col("week").cast("string")
        )
        code, spec = F.col("code_loc").cast("double"), F.col("spec_lines").cast("double")
    return _with_unit(weeks, people_).select(
        *PERSON,
        "org_unit_id",
        "date_bucket",
        F.col("date_bucket").alias("metric_date"),
        F.lit(0.0).alias("ai_loc"),
        code.alias("code_loc"),
        spec.alias("spec_lines"),
    )


def ic_drill(spark: SparkSession, commits: DataFrame | None = None, max_listed: int | None = None) -> DataFrame:
    """Drill rows of commits: one per person, day and source, with the commits' hashes as ``rows``; typed and empty without commits.

    ``value`` counts every commit. A person-day is one row by its nature; with ``max_listed`` only
    that many hashes, the first in order, are listed, for days on which a bot writes very many.
    Commits without a date have no day to be listed under.
    """
    if commits is None:
        return empty_relation(spark, schemas.DRILL_ROWS)
    keys = ["tenant_id", "person_id", "metric_date", "source"]
    named = commits.where(F.col("date").isNotNull()).select(
        "tenant_id", F.col("person_key").alias("person_id"), F.to_date("date").cast("string").alias("metric_date"), F.col("data_source").alias("source"), "commit_hash"
    )
    total = F.count(F.lit(1)).cast("string").alias("value")
    if max_listed is None:
        found = named.groupBy(*keys).agg(total, F.array_sort(F.collect_list("commit_hash")).alias("rows"))
    else:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("commit_hash"))
        # The window's limit is applied before the shuffle, so a long day is cut where it is read.
        listed = named.withColumn("_n", place).where(F.col("_n") <= max_listed).groupBy(*keys).agg(F.array_sort(F.collect_list("commit_hash")).alias("rows"))
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
        found = named.groupBy(*keys).agg(total).alias("n").join(listed.alias("l"), same, "left").select("n.*", "l.rows")
    return found.select(
        "tenant_id", "person_id", F.lit(None).cast("string").alias("org_unit_id"), "metric_date", F.lit("commits").alias("drill_id"), F.lit("Commits").alias("title"),
        "source", F.lit("git").alias("src_class"), "value", F.lit("").alias("filter"), F.array(F.lit("commit_hash"), F.lit("repo_slug")).alias("columns"), "rows",
    )


def ic_timeoff(leave_events: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Leave per person: days, range text, link; typed and empty without leave events."""
    if leave_events is None:
        return empty_relation(spark, schemas.TIMEOFF_ROWS)
    start, end = F.to_date("start_date"), F.to_date("end_date")
    return leave_events.where(fx.filled("email")).select(
        "tenant_id",
        F.lower("email").alias("person_id"),
        F.lit("").alias("org_unit_id"),
        start.cast("string").alias("metric_date"),
        (F.datediff(end, start) + 1).alias("days"),
        F.concat_ws(" - ", start.cast("string"), end.cast("string")).alias("date_range"),
        F.lit("").alias("hr_url"),
    )
