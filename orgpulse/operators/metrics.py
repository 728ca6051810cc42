"""Catalogued metric queries over Gold rows. Date filters are applied to the input rows by the caller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.gold import PERSON
from orgpulse.operators.ordered import exact_quantile, exact_quantiles

# Titles that always count as senior in the team metric.
SENIOR_TITLES = [
    "%vice president%", "%chief%", "%president%", "%ceo%", "%cto%", "%cfo%", "%coo%", "%vp of%", "vp %", "%executive%",
]
# Metric keys by how a person's period value is formed; all other keys are averaged.
COLLAB_SUMS = [
    "m365_emails_sent", "zoom_calls", "meeting_hours", "m365_teams_messages", "m365_files_shared", "meeting_free",
    "slack_thread_participation", "slack_message_engagement",
]
CODE_QUALITY_SUMS = ["bugs_fixed", "prs_per_dev"]
TASK_SUMS = ["tasks_completed"]
AI_SUMS = [
    "chatgpt", "cc_lines", "cc_sessions", "cursor_agents", "cursor_lines", "claude_web", "cursor_completions", "team_ai_loc",
]
AI_ACTIVE = ["active_ai_members", "cursor_active", "cc_active", "codex_active"]
ACCURACY_KEY = "estimation_accuracy"


def metric_exec_summary(exec_rows: DataFrame) -> DataFrame:
    return exec_rows.groupBy("tenant_id", "org_unit_id").agg(
        F.max("org_unit_name").alias("org_unit_name"),
        F.max("headcount").alias("headcount"),
        F.sum("tasks_closed").alias("tasks_closed"),
        F.sum("bugs_fixed").alias("bugs_fixed"),
        F.max("build_success_pct").alias("build_success_pct"),
        fx.tidy_round(F.avg("focus_time_pct"), 1).alias("focus_time_pct"),
        fx.tidy_round(F.avg("ai_adoption_pct"), 1).alias("ai_adoption_pct"),
        fx.tidy_round(F.avg("ai_loc_share_pct"), 1).alias("ai_loc_share_pct"),
        F.avg("pr_cycle_time_h").alias("pr_cycle_time_h"),
    )


def metric_team_members(member_rows: DataFrame, people: DataFrame, employees: DataFrame) -> DataFrame:
    """Per-person period values, with seniority raised by title and the newest supervisor.

    Member rows are folded to one row per person before any join.
    """
    folded = member_rows.groupBy(*PERSON, "org_unit_id").agg(
        F.max("display_name").alias("display_name"),
        F.max("seniority").alias("_seniority"),
        F.sum("tasks_closed").alias("tasks_closed"),
        F.sum("bugs_fixed").alias("bugs_fixed"),
        fx.tidy_round(F.avg("dev_time_h"), 1).alias("dev_time_h"),
        F.sum("prs_merged").alias("prs_merged"),
        F.max("build_success_pct").alias("build_success_pct"),
        fx.tidy_round(F.avg("focus_time_pct"), 1).alias("focus_time_pct"),
        fx.distinct_flat("ai_tools").alias("ai_tools"),
        fx.tidy_round(F.avg("ai_loc_share_pct"), 1).alias("ai_loc_share_pct"),
    )
    supervisors = (
        employees.where(fx.filled("workEmail"))
        .groupBy("tenant_id", F.lower("workEmail").alias("person_id"))
        .agg(F.lower(fx.latest_filled("supervisorEmail", "_airbyte_extracted_at", "unique_key")).alias("supervisor_email"))
    )
    joined = folded.join(people.select(*PERSON, "job_title"), PERSON, "left").join(supervisors, PERSON, "left")
    senior = fx.multi_if((fx.ilike_any("job_title", SENIOR_TITLES), F.lit("Senior")), default=F.col("_seniority"))
    return joined.withColumn("seniority", senior).drop("_seniority", "job_title")


def metric_ic_kpis(kpi_rows: DataFrame) -> DataFrame:
    return kpi_rows.groupBy(*PERSON).agg(
        F.sum("loc").alias("loc"),
        fx.tidy_round(F.avg("ai_loc_share_pct"), 1).alias("ai_loc_share_pct"),
        F.sum("prs_merged").alias("prs_merged"),
        F.avg("pr_cycle_time_h").alias("pr_cycle_time_h"),
        fx.tidy_round(F.avg("focus_time_pct"), 1).alias("focus_time_pct"),
        F.sum("tasks_closed").alias("tasks_closed"),
        F.sum("bugs_fixed").alias("bugs_fixed"),
        F.max("build_success_pct").alias("build_success_pct"),
        F.sum("ai_sessions").alias("ai_sessions"),
    )


# --- bullets -----------------------------------------------------------------------------------


# Period values are folded from parts, one for each unit a person has been in, see ``person_period_values``.


def _mean() -> Column:
    """Mean of all values of the parts."""
    return fx.ratio(F.sum("_sum"), F.sum("_n"))


def _period_sum_or_avg(sums: Sequence[str]) -> Column:
    return F.when(F.col("metric_key").isin(list(sums)), F.sum("_sum")).otherwise(_mean())


def _period_tasks() -> Column:
    miss = fx.ratio(F.sum("_miss"), F.sum("_misses"))
    accuracy = F.when(miss.isNotNull(), F.greatest(F.lit(0.0), F.lit(100.0) - miss))
    key = F.col("metric_key")
    return F.when(key.isin(TASK_SUMS), F.sum("_sum")).when(key == ACCURACY_KEY, accuracy).otherwise(_mean())


def _period_ai() -> Column:
    key = F.col("metric_key")
    return F.when(key.isin(AI_SUMS), F.sum("_sum")).when(key.isin(AI_ACTIVE), F.max("_max")).otherwise(_mean())


FAMILIES: dict[str, Callable[[], Column]] = {
    "task_delivery": _period_tasks,
    "code_quality": lambda: _period_sum_or_avg(CODE_QUALITY_SUMS),
    "collab": lambda: _period_sum_or_avg(COLLAB_SUMS),
    "ai": _period_ai,
}


def person_period_values(rows: DataFrame, family: str) -> DataFrame:
    """One value per metric key and person over the period.

    Rows are folded per unit first: these parts are numbers, which hash aggregation folds without sorting the rows.
    """
    keys = ["tenant_id", "metric_key", "person_id"]
    value = F.col("metric_value")
    off = F.when((value > 0) & (value <= 200), F.abs(F.lit(100.0) - value))
    parts = rows.groupBy(*keys, "org_unit_id").agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.max(value).alias("_max"), F.sum(off).alias("_miss"), F.count(off).alias("_misses")
    )
    return parts.groupBy(*keys).agg(F.max("org_unit_id").alias("org_unit_id"), FAMILIES[family]().alias("v_period"))


def _distribution(values: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median, minimum and maximum over people; active indicators use 0..number of people instead."""
    active = F.col("metric_key").isin(AI_ACTIVE)
    shape = values.groupBy(*keys).agg(
        F.when(active, F.lit(0.0)).otherwise(F.min("v_period")).alias("range_min"),
        F.when(active, F.count(F.lit(1)).cast("double")).otherwise(F.max("v_period")).alias("range_max"),
    )
    medians = exact_quantile(values, keys, "v_period", 0.5, "median")
    out = shape.join(medians, keys, "left")
    return out.withColumn("median", F.when(F.col("metric_key").isin(AI_ACTIVE), F.lit(0.0)).otherwise(F.col("median")))


def _headline(values: DataFrame, keys: list[str]) -> DataFrame:
    active = F.col("metric_key").isin(AI_ACTIVE)
    return values.groupBy(*keys).agg(
        F.when(active, F.sum("v_period")).otherwise(F.avg("v_period")).alias("value")
    )


BULLET_COLUMNS = ["value", "median", "range_min", "range_max"]


def bullet_team(rows: DataFrame, family: str, org_unit_id: str | None = None) -> DataFrame:
    """Value of a team (or of everyone) against the distribution over the whole company."""
    values = person_period_values(rows, family)
    team = values if org_unit_id is None else values.where(F.col("org_unit_id") == org_unit_id)
    keys = ["tenant_id", "metric_key"]
    return _headline(team, keys).join(_distribution(values, keys), keys, "left").select(*keys, *BULLET_COLUMNS)


def bullet_every_team(rows: DataFrame, family: str) -> DataFrame:
    """``bullet_team`` for all units at once: one company distribution, one value per unit."""
    values = person_period_values(rows, family)
    keys = ["tenant_id", "metric_key"]
    teams = _headline(values, [*keys, "org_unit_id"])
    return teams.join(_distribution(values, keys), keys, "left").select(*keys, "org_unit_id", *BULLET_COLUMNS)


def bullet_ic(rows: DataFrame, family: str, person_id: str | None = None) -> DataFrame:
    """Value of a person (or of every person) against the distribution over their own unit."""
    values = person_period_values(rows, family)
    mine = values if person_id is None else values.where(F.col("person_id") == person_id)
    keys = ["tenant_id", "metric_key", "org_unit_id"]
    unit = _distribution(values.where(F.col("org_unit_id").isNotNull()), keys)
    return mine.join(unit, keys, "left").select(
        "tenant_id", "person_id", "metric_key", F.col("v_period").alias("value"), "median", "range_min", "range_max"
    )


# --- chart and placeholder projections -------------------------------------------------------------

CHART_LOC = ["date_bucket", "ai_loc", "code_loc", "spec_lines", "tenant_id", "person_id", "metric_date"]
CHART_DELIVERY = ["date_bucket", "commits", "prs_merged", "tasks_done", "tenant_id", "person_id", "metric_date"]
DRILL = ["tenant_id", "person_id", "drill_id", "title", "source", "src_class", "value", "filter", "columns", "rows", "metric_date"]
TIMEOFF = ["tenant_id", "person_id", "days", "date_range", "hr_url", "metric_date"]


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


# --- specified metrics ------------------------------------------------------------------------------


def metric_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """5th, 50th and 95th percentile of a KPI: the smallest value that so many percent of the rows don't exceed."""
    shares = {"p5": 5, "p50": 50, "p95": 95}
    return exact_quantiles(df, by, col, {name: (p / 100, lambda total, p=p: F.ceil(total * p / 100) - 1) for name, p in shares.items()})


def _done(kind: str) -> Column:
    is_bug = F.col("task_type") == "Bug"
    return F.col("task_id").isNotNull() & F.col("done") & (is_bug if kind == "bug" else ~is_bug)


def exec_summary_full(facts: DataFrame) -> DataFrame:
    """Unit totals from one wide fact: distinct people, tasks and bugs done, build, focus, AI and cycle values."""
    unit = ["tenant_id", "org_unit_id", "org_unit_name"]
    # One row per person first: the distinct counts become plain counts.
    per_person = facts.groupBy(*unit, "person_id").agg(
        fx.count_where(_done("task")).alias("tasks_closed"),
        fx.count_where(_done("bug")).alias("bugs_fixed"),
        F.sum(F.when(F.col("build_status") == "success", 100.0).when(F.col("build_status").isNotNull(), 0.0)).alias("_build"),
        F.count("build_status").alias("_builds"),
        F.sum("focus_time_pct").alias("_focus"),
        F.count("focus_time_pct").alias("_focus_n"),
        F.max(fx.flag(F.col("ai_active"))).alias("_ai"),
        F.sum("ai_lines_added").alias("_ai_lines"),
        F.sum("total_lines").alias("_lines"),
        F.sum("pr_cycle_time_h").alias("_cycle"),
        F.count("pr_cycle_time_h").alias("_cycles"),
    )
    return per_person.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("headcount"),
        F.sum("tasks_closed").alias("tasks_closed"),
        F.sum("bugs_fixed").alias("bugs_fixed"),
        fx.ratio(F.sum("_build"), F.sum("_builds")).alias("build_success_pct"),
        fx.ratio(F.sum("_focus"), F.sum("_focus_n")).alias("focus_time_pct"),
        (fx.ratio(F.sum("_ai"), F.count(F.lit(1))) * 100).alias("ai_adoption_pct"),
        (fx.ratio(F.sum("_ai_lines"), F.sum("_lines")) * 100).alias("ai_loc_share_pct"),
        fx.ratio(F.sum("_cycle"), F.sum("_cycles")).alias("pr_cycle_time_h"),
    )


def ic_summary_full(facts: DataFrame) -> DataFrame:
    build = F.when(F.col("build_status") == "success", 100.0).when(F.col("build_status").isNotNull(), 0.0)
    return facts.groupBy(*PERSON).agg(
        F.sum("clean_loc").alias("loc"),
        (fx.ratio(F.sum("ai_lines_added"), F.sum(F.col("clean_loc") + F.col("ai_lines_added"))) * 100).alias("ai_loc_share_pct"),
        F.count("pr_id").alias("prs_merged"),
        F.avg("pr_cycle_time_h").alias("pr_cycle_time_h"),
        F.avg("focus_time_pct").alias("focus_time_pct"),
        fx.count_where(_done("task")).alias("tasks_closed"),
        fx.count_where(_done("bug")).alias("bugs_fixed"),
        F.avg(build).alias("build_success_pct"),
        F.sum("ai_sessions").alias("ai_sessions"),
    )


def trend_loc(facts: DataFrame, grain: str) -> DataFrame:
    return facts.groupBy(*PERSON, fx.grain_of("activity_date", grain).alias("date_bucket")).agg(
        F.sum("ai_lines_added").alias("ai_loc"), F.sum("clean_loc").alias("code_loc"), F.sum("spec_lines").alias("spec_lines")
    )


def trend_delivery(facts: DataFrame, grain: str) -> DataFrame:
    """Distinct commits, merged requests and finished tasks per bucket.

    Each id is reduced to one row per bucket by its own aggregate first, which
    spreads one busy person over all their ids.
    """
    bucket = [*PERSON, "date_bucket"]
    rows = facts.withColumn("date_bucket", fx.grain_of("activity_date", grain))
    kinds = {"commits": "commit_sha", "prs_merged": "merged_pr_id", "tasks_done": "done_task_id"}
    long = rows.unpivot(bucket, list(kinds.values()), "kind", "ref").where(F.col("ref").isNotNull())
    counts = long.distinct().groupBy(*bucket).agg(
        *[fx.count_where(F.col("kind") == src).alias(out) for out, src in kinds.items()]
    )
    return counts


def team_kpi_strip(member_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """People at risk, with focus of 60 or more, without AI tools."""
    return member_rows.groupBy(*keys).agg(
        fx.count_where(F.array_contains(F.map_values("_thresholds"), "critical")).alias("at_risk_count"),
        fx.count_where(F.col("focus_time_pct") >= 60).alias("focus_gte_60"),
        fx.count_where(F.size("ai_tools") == 0).alias("not_using_ai"),
    )


def org_kpis(exec_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Averages over teams; a KPI without any value stays NULL."""
    names = {
        "avg_build_success": "build_success_pct",
        "avg_ai_adoption": "ai_adoption_pct",
        "avg_focus": "focus_time_pct",
        "pr_cycle_score": "pr_cycle_time_h",
    }
    return exec_rows.groupBy(*keys).agg(*[F.avg(src).alias(out) for out, src in names.items()])


def period_delta(
    rows: DataFrame, keys: Sequence[str], value: str, date_col: str, current: tuple[str, str], previous: tuple[str, str]
) -> DataFrame:
    """Sum in the current and previous [from, to) period and their difference, in one pass."""

    def inside(span: tuple[str, str]) -> Column:
        return (F.col(date_col) >= F.lit(span[0])) & (F.col(date_col) < F.lit(span[1]))

    kept = rows.where(inside(current) | inside(previous))
    out = kept.groupBy(*keys).agg(
        fx.sum_where(value, inside(current)).alias("current_value"),
        fx.sum_where(value, inside(previous)).alias("previous_value"),
    )
    delta = F.col("current_value") - F.col("previous_value")
    return out.withColumns(
        {
            "delta": delta,
            "delta_type": fx.multi_if((delta > 0, F.lit("up")), (delta < 0, F.lit("down")), default=F.lit("flat")),
        }
    )


def time_off_next(leave_rows: DataFrame, as_of: str) -> DataFrame:
    """First leave of each person that starts on or after a UTC date."""
    coming = leave_rows.where(F.col("leave_start_date") >= F.lit(as_of).cast("date"))
    first = F.min_by(F.struct("leave_start_date", "leave_end_date", "leave_days"), F.struct("leave_start_date", "unique_key"))
    return coming.groupBy(*PERSON).agg(first.alias("_l")).select(*PERSON, "_l.*")
