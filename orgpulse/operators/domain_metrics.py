"""Metrics of the other domains: AI tools, collaboration, CRM, wiki, support, design, quality, and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import percent_rank_by
from orgpulse.operators.org import temporal_join

PERSON = ["tenant_id", "person_id"]

# --- AI tools --------------------------------------------------------------------------------


def ai_adoption(usage: DataFrame, members: DataFrame) -> DataFrame:
    """Active members of all members, per week."""
    active = usage.where(F.col("is_active")).select("tenant_id", "person_id", fx.monday_week("day").alias("week")).distinct()
    weekly = active.groupBy("tenant_id", "week").agg(F.count(F.lit(1)).alias("active_members"))
    size = members.select(*PERSON).distinct().groupBy("tenant_id").agg(F.count(F.lit(1)).alias("members"))
    return weekly.join(size, "tenant_id").withColumn("adoption_rate", fx.ratio("active_members", "members"))


def ai_cost_per_user(events: DataFrame, grain: str) -> DataFrame:
    cost = fx.or_zero("request_cost") + fx.or_zero("platform_fee")
    return events.groupBy(*PERSON, fx.grain_of("at", grain).alias("period")).agg(F.sum(cost).alias("cost"))


def ai_acceptance(usage: DataFrame) -> DataFrame:
    """Tab acceptance and AI line share per user and week."""
    return usage.groupBy(*PERSON, fx.monday_week("day").alias("week")).agg(
        fx.ratio(F.sum("tabs_accepted"), F.sum("tabs_shown")).alias("tab_acceptance"),
        fx.ratio(F.sum("ai_lines"), F.sum("total_lines")).alias("ai_line_ratio"),
    )


def model_distribution(events: DataFrame) -> DataFrame:
    counts = events.groupBy("tenant_id", "model").agg(F.count(F.lit(1)).alias("requests"))
    totals = counts.groupBy("tenant_id").agg(F.sum("requests").alias("_t"))
    return counts.join(totals, "tenant_id").withColumn("share", fx.ratio("requests", "_t")).drop("_t")


def cross_tool_comparison(usage: DataFrame, tools: Sequence[str]) -> DataFrame:
    """Cost and accepted lines per person, one column pair per tool."""
    return (
        usage.groupBy(*PERSON)
        .pivot("tool", list(tools))
        .agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("ai_lines"), F.lit(0.0)).alias("lines"))
    )


def seat_activity(seats: DataFrame, as_of: str, days: int) -> DataFrame:
    """Seats with activity in the last days."""
    end = F.lit(as_of).cast("timestamp")
    recent = (F.col("last_activity_at") > end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("last_activity_at") <= end)
    return seats.withColumn("is_active", fx.flag(recent))


def org_ai_usage(usage: DataFrame) -> DataFrame:
    """Suggestions, acceptances and acceptance rate per day."""
    return usage.groupBy("tenant_id", "day").agg(
        F.sum("shown").alias("shown"), F.sum("accepted").alias("accepted"), fx.ratio(F.sum("accepted"), F.sum("shown")).alias("acceptance_rate")
    )


def ai_api_cost(usage: DataFrame, cost: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cost allocated to usage rows in proportion to tokens.

    Shares use a token total per key joined back, so no window spans a key.
    """
    totals = usage.groupBy(*keys).agg(F.sum("total_tokens").alias("_tokens"))
    spend = cost.groupBy(*keys).agg(F.sum("amount").alias("_amount"))
    rate = totals.join(spend, list(keys)).select(*keys, fx.ratio("_amount", "_tokens").alias("_rate"))
    return usage.join(rate, list(keys), "left").withColumn("allocated_cost", F.col("total_tokens") * F.col("_rate")).drop("_rate")


def spend_by(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(F.sum("allocated_cost").alias("cost"), F.sum("total_tokens").alias("tokens"))


def ai_tool_adoption(conversations: DataFrame) -> DataFrame:
    """Active users and conversations per model and client; (user, conversation) pairs are folded first."""
    keys = ["tenant_id", "model", "client"]
    pairs = conversations.groupBy(*keys, "user_id", "conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    users = pairs.groupBy(*keys, "user_id").agg(F.count(F.lit(1)).alias("c"), F.sum("messages").alias("m"))
    return users.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("active_users"), F.sum("c").alias("conversations"), F.sum("m").alias("messages")
    )


# --- collaboration --------------------------------------------------------------------------------


def collab_metrics(chat: DataFrame, meetings: DataFrame, documents: DataFrame) -> DataFrame:
    """Communication load, chat against meeting hours, meeting load, documents and breadth per person and week."""
    keys = ["tenant_id", "person_key", "week"]

    def weekly(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        rows = df.withColumn("week", fx.monday_week("date"))
        return rows.groupBy(*keys, F.col("data_source").alias("src")).agg(*[F.sum(c).cast("double").alias(n) for n, c in measures.items()])

    parts = [
        weekly(chat, {"messages": fx.or_zero("total_chat_messages")}),
        weekly(
            meetings,
            {
                "meetings": fx.or_zero("meetings_attended"),
                "meeting_hours": F.col("audio_duration_seconds") / F.lit(3600.0),
                "organized": fx.or_zero("meetings_organized"),
                "adhoc": fx.or_zero("adhoc_meetings_attended"),
                "scheduled": fx.or_zero("scheduled_meetings_attended"),
            },
        ),
        weekly(documents, {"files": fx.or_zero("viewed_or_edited_count"), "shares": fx.or_zero("shared_internally_count")}),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    measures = [c for c in rows.columns if c not in (*keys, "src")]
    per_source = rows.groupBy(*keys, "src").agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])
    out = per_source.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("breadth"))
    return out.withColumns(
        {
            "communication_load": F.col("messages") + F.col("meetings"),
            "async_sync_ratio": fx.ratio("messages", "meeting_hours"),
            "meeting_overload": F.col("organized") + F.col("meetings"),
        }
    )


# --- CRM ---------------------------------------------------------------------------------------------


def crm_sales(deals: DataFrame) -> DataFrame:
    """Per salesperson: deals, value, win rate, average days from creation to closing."""
    closed, won = F.col("is_closed") == 1, F.col("is_won") == 1
    return deals.groupBy("tenant_id", "owner_id").agg(
        F.count(F.lit(1)).alias("deals"),
        fx.sum_where("amount", won).alias("won_value"),
        fx.ratio(fx.count_where(won), fx.count_where(closed)).alias("win_rate"),
        fx.avg_where(F.datediff("close_date", "created_at"), closed).alias("avg_cycle_days"),
    )


def crm_open_stages(deals: DataFrame) -> DataFrame:
    """Open deals per stage: count, value, value weighted by probability."""
    weighted = F.col("amount") * F.col("probability") / F.lit(100.0)
    return deals.where(F.col("is_closed") == 0).groupBy("tenant_id", "stage").agg(
        F.count(F.lit(1)).alias("open_deals"), F.sum("amount").alias("open_value"), F.sum(weighted).alias("weighted_value")
    )


def crm_activity_mix(activities: DataFrame) -> DataFrame:
    """Share of each activity type per owner and week."""
    keys = ["tenant_id", "owner_id", "week"]
    counts = activities.groupBy("tenant_id", "owner_id", fx.monday_week("timestamp").alias("week"), "activity_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(totals, keys).withColumn("share", fx.ratio("n", "_t")).drop("_t")


# --- wiki ---------------------------------------------------------------------------------------------


def wiki_velocity(activity: DataFrame) -> DataFrame:
    return activity.groupBy(*PERSON, fx.monday_week("day").alias("week")).agg(
        F.sum("created").alias("pages_created"), F.sum("edits").alias("edits")
    )


def wiki_views(activity: DataFrame) -> DataFrame:
    return activity.groupBy("tenant_id", "page_id", fx.monday_week("day").alias("week")).agg(F.sum("views").alias("views"))


def wiki_spaces(pages: DataFrame) -> DataFrame:
    """Created to archived ratio and distinct authors per space."""
    per_author = pages.groupBy("tenant_id", "space", "author_id").agg(
        F.count(F.lit(1)).alias("created"), fx.count_where(F.col("archived")).alias("archived")
    )
    return per_author.groupBy("tenant_id", "space").agg(
        F.sum("created").alias("pages_created"),
        F.sum("archived").alias("pages_archived"),
        fx.ratio(F.sum("created"), F.sum("archived")).alias("created_archived_ratio"),
        F.count(F.lit(1)).alias("authors"),
    )


# --- support -------------------------------------------------------------------------------------------


def support_activity(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Per agent and day: solved tickets, first-response and resolution seconds, satisfaction, public replies.

    Solving and replying are two different daily facts; they meet in a full join.
    """
    keys = ["tenant_id", "ticket_id"]
    first_solved = events.where((F.col("event_type") == "status_change") & (F.col("new_value") == "solved")).groupBy(*keys).agg(
        F.min_by("agent_id", F.struct("at", "agent_id")).alias("agent_id"), F.min("at").alias("solved_at")
    )
    public = events.where((F.col("event_type") == "comment") & (F.col("is_public") == 1))
    first_reply = public.groupBy(*keys).agg(
        F.min_by("agent_id", F.struct("at", "agent_id")).alias("agent_id"), F.min("at").alias("replied_at")
    )
    opened = tickets.select(*keys, "opened_at", "rating")
    agent_day = ["tenant_id", "agent_id", "day"]
    rated = F.col("rating").isNotNull()
    solved = first_solved.join(opened, keys).groupBy("tenant_id", "agent_id", F.to_date("solved_at").alias("day")).agg(
        F.count(F.lit(1)).alias("tickets_resolved"),
        F.avg(fx.seconds_between("opened_at", "solved_at")).alias("full_resolution_s"),
        fx.ratio(fx.count_where(F.col("rating") == "good"), fx.count_where(rated)).alias("satisfaction_score"),
    )
    answered = first_reply.join(opened, keys).groupBy("tenant_id", "agent_id", F.to_date("replied_at").alias("day")).agg(
        F.avg(fx.seconds_between("opened_at", "replied_at")).alias("first_response_s")
    )
    sent = public.groupBy("tenant_id", "agent_id", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("comments_sent"))
    out = solved.join(answered, agent_day, "full").join(sent, agent_day, "full")
    return out.withColumns({c: fx.or_zero(c) for c in ("tickets_resolved", "comments_sent")})


def support_sla(tickets: DataFrame, events: DataFrame, sla: DataFrame) -> DataFrame:
    """MTTR, first-response and resolution compliance, and open tickets past their limit, per priority."""
    keys = ["tenant_id", "ticket_id"]
    solved_at = F.min(F.when((F.col("event_type") == "status_change") & (F.col("new_value") == "solved"), F.col("at")))
    replied_at = F.min(F.when((F.col("event_type") == "comment") & (F.col("is_public") == 1), F.col("at")))
    marks = events.groupBy(*keys).agg(solved_at.alias("solved_at"), replied_at.alias("replied_at"), F.max("at").alias("last_at"))
    rows = tickets.join(marks, keys, "left").join(sla, "priority", "left").withColumns(
        {"_res": fx.seconds_between("opened_at", "solved_at"), "_rep": fx.seconds_between("opened_at", "replied_at")}
    )
    overdue = F.col("_res").isNull() & (fx.seconds_between("opened_at", "last_at") > F.col("resolve_within_s"))
    return rows.groupBy("tenant_id", "priority").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.avg("_res").alias("mttr_s"),
        fx.ratio(fx.count_where(F.col("_rep") < F.col("reply_within_s")), F.count("_rep")).alias("reply_compliance"),
        fx.ratio(fx.count_where(F.col("_res") < F.col("resolve_within_s")), F.count("_res")).alias("resolve_compliance"),
        fx.count_where(overdue).alias("overdue"),
    )


# --- design ----------------------------------------------------------------------------------------------


def design_activity(activity: DataFrame) -> DataFrame:
    """Per person and day: distinct files edited and touched, versions, comments. Files are folded first."""
    per_file = activity.groupBy(*PERSON, "day", "file_id").agg(F.sum("versions").alias("v"), F.sum("comments").alias("c"))
    return per_file.groupBy(*PERSON, "day").agg(
        fx.count_where(F.col("v") > 0).alias("files_edited"),
        F.sum("v").alias("versions_created"),
        F.sum("c").alias("comments_posted"),
        fx.count_where((F.col("v") > 0) | (F.col("c") > 0)).alias("files_with_activity"),
    )


def design_code_overlap(design: DataFrame, commits: DataFrame, days: int) -> DataFrame:
    """Design days beside commits of the same person within some days.

    Commits are folded to one row per person and day and offered to each of
    the 2n+1 design days they are near to, so the range join is an equi-join.
    """
    daily = commits.groupBy(*PERSON, F.to_date("date").alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    near = daily.withColumn("day", F.explode(F.sequence(F.date_sub("_d", days), F.date_add("_d", days))))
    folded = near.groupBy(*PERSON, "day").agg(F.sum("n").alias("commits_near"))
    return design.join(folded, [*PERSON, "day"], "left").withColumn("commits_near", fx.or_zero("commits_near"))


# --- quality ------------------------------------------------------------------------------------------------


def pass_rate_trend(results: DataFrame) -> DataFrame:
    return results.groupBy("tenant_id", F.to_date("at").alias("day")).agg(
        F.count(F.lit(1)).alias("results"), fx.ratio(fx.count_where(F.col("status") == "passed"), F.count(F.lit(1))).alias("pass_rate")
    )


def flaky_rate(results: DataFrame) -> DataFrame:
    """Share of tests that both passed and failed."""
    tests = results.groupBy("tenant_id", "test_id").agg(
        F.max(fx.flag(F.col("status") == "passed")).alias("p"), F.max(fx.flag(F.col("status") == "failed")).alias("f")
    )
    return tests.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("tests"), F.sum(F.col("p") * F.col("f")).alias("flaky"), fx.ratio(F.sum(F.col("p") * F.col("f")), F.count(F.lit(1))).alias("flaky_rate")
    )


def defect_stats(defects: DataFrame) -> DataFrame:
    """Open defects and mean hours to resolution per day of creation."""
    return defects.groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(
        fx.count_where(F.col("resolved_at").isNull()).alias("open_defects"),
        F.avg(fx.hours_between("created_at", "resolved_at")).alias("mttr_h"),
    )


def defects_per_sprint(defects: DataFrame, memberships: DataFrame) -> DataFrame:
    """Defects per sprint their task was in when they were found."""
    linked = defects.withColumnRenamed("external_issue_id", "task_id")
    placed = temporal_join(linked, memberships, ["tenant_id", "task_id"], "created_at", ["sprint_id"], "inner")
    return placed.groupBy("tenant_id", "sprint_id").agg(F.count(F.lit(1)).alias("defects"))


def pass_rate_by_branch(launches: DataFrame, results: DataFrame) -> DataFrame:
    """Pass rate per branch; results are folded per launch before the join."""
    per_launch = results.groupBy("tenant_id", "launch_id").agg(
        F.count(F.lit(1)).alias("n"), fx.count_where(F.col("status") == "passed").alias("p")
    )
    return per_launch.join(launches.select("tenant_id", "launch_id", "branch"), ["tenant_id", "launch_id"]).groupBy("tenant_id", "branch").agg(
        F.sum("n").alias("results"), fx.ratio(F.sum("p"), F.sum("n")).alias("pass_rate")
    )


# --- patterns and trends ---------------------------------------------------------------------------------------


def percentile_patterns(metrics: DataFrame, cohort: str, conditions: Sequence[tuple[str, str, float]], applies_to: Sequence[str]) -> DataFrame:
    """People of the named teams whose percentile ranks (0..100) meet every (metric, operator, threshold)."""
    rows = metrics.where(F.col(cohort).isin(list(applies_to)))
    checks = []
    for i, (metric, op, threshold) in enumerate(conditions):
        rows = percent_rank_by(rows, ["tenant_id", cohort], metric, f"_p{i}")
        rank = F.col(f"_p{i}") * 100
        checks.append(rank <= threshold if op == "<=" else rank >= threshold)
    return rows.where(fx.all_of(checks)).select(
        *PERSON, cohort, *[F.round(F.col(f"_p{i}") * 100, 4).alias(f"{m}_percentile") for i, (m, _, _) in enumerate(conditions)]
    )


def _day_number(col: str) -> Column:
    return F.unix_date(F.to_date(col)).cast("bigint")


def activity_drop(daily: DataFrame, value: str, days: int, drop_to: float) -> DataFrame:
    """Days whose activity fell to a share of the average of the preceding days.

    ``daily`` holds one row per person and day, so a window spans at most one person's calendar.
    """
    base = Window.partitionBy(*PERSON).orderBy(_day_number("day")).rangeBetween(-days, -1)
    rows = daily.withColumn("baseline", F.sum(value).over(base) / F.lit(float(days)))
    return rows.where(F.col(value) < F.col("baseline") * F.lit(drop_to))


def moving_average_trend(series: DataFrame, keys: Sequence[str], at: str, value: str, grain: str, n: int) -> DataFrame:
    """Sum per period, and the average of the last n periods. Windows run over folded periods."""
    per = series.groupBy(*keys, fx.grain_of(at, grain).alias("period")).agg(F.sum(value).alias("total"))
    last = Window.partitionBy(*keys).orderBy("period").rowsBetween(-(n - 1), 0)
    return per.withColumn("moving_avg", F.avg("total").over(last))


def derived_metric(metrics: DataFrame, keys: Sequence[str], weights: dict[str, float], out: str) -> DataFrame:
    """Weighted sum of named metrics out of long rows."""
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    rows = metrics.where(F.col("metric_key").isin(list(weights)))
    return rows.groupBy(*keys).agg(F.sum(F.col("metric_value") * weight[F.col("metric_key")]).alias(out))
