"""Communication stream: wide daily reports to one row per channel, and the reports over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx

# Fixed values: (measure column, channel, direction) per source.
CHANNELS = {
    "ms365_teams": [
        ("teamChatMessageCount", "chat_group", "outbound"),
        ("privateChatMessageCount", "chat_private", "outbound"),
        ("postMessages", "channel_post", "outbound"),
        ("replyMessages", "channel_reply", "outbound"),
        ("callCount", "call", "outbound"),
        ("meetingsAttendedCount", "meeting", "engagement"),
    ],
    "ms365_email": [
        ("sendCount", "email_sent", "outbound"),
        ("receiveCount", "email_received", "inbound"),
        ("readCount", "email_read", "engagement"),
    ],
}
CHAT_CHANNELS = ["chat_group", "chat_private", "chat"]


def _fan_out(df: DataFrame, source: str, name: Column) -> DataFrame:
    """One row per channel with a positive count, out of one wide row; a map-side step, no shuffle."""
    items = F.array(
        *[
            F.struct(F.lit(channel).alias("channel"), F.lit(way).alias("direction"), F.col(col).cast("double").alias("count"))
            for col, channel, way in CHANNELS[source]
        ]
    )
    live = df.where(~F.coalesce(F.col("isDeleted"), F.lit(False)))
    return live.withColumn("_c", F.explode(F.filter(items, lambda i: i["count"] > 0))).select(
        "tenant_id",
        fx.join_key(":", F.lit(source), "unique_key", "_c.channel").alias("source_id"),
        fx.parse_day("reportRefreshDate").alias("event_date"),
        F.lit(source).alias("source"),
        F.lower("userPrincipalName").alias("user_email"),
        name.alias("user_display_name"),
        "_c.channel",
        "_c.direction",
        "_c.count",
    )


def communication_events(teams: DataFrame, email: DataFrame, chat: DataFrame, chat_users: DataFrame) -> DataFrame:
    """Teams, e-mail and chat as rows (user, channel, direction, count) with a traceable source id."""
    teams_rows = _fan_out(teams, "ms365_teams", F.lit(None).cast("string"))
    mail_rows = _fan_out(email, "ms365_email", F.col("displayName"))
    users = chat_users.select("tenant_id", F.col("id").alias("sender_id"), "email", "full_name")
    chat_rows = chat.join(users, ["tenant_id", "sender_id"]).select(
        "tenant_id",
        fx.join_key(":", F.lit("zulip"), "uniq").alias("source_id"),
        F.to_date("created_at").alias("event_date"),
        F.lit("zulip").alias("source"),
        F.lower("email").alias("user_email"),
        F.col("full_name").alias("user_display_name"),
        F.lit("chat").alias("channel"),
        F.lit("outbound").alias("direction"),
        F.col("count").cast("double").alias("count"),
    )
    return teams_rows.unionByName(mail_rows).unionByName(chat_rows)


def comm_volume_by_platform(events: DataFrame, sources: Sequence[str], top: int) -> DataFrame:
    """Total and per-platform volume of the most active users."""
    parts = [fx.sum_where("count", F.col("source") == s).alias(f"{s}_events") for s in sources]
    totals = events.groupBy("tenant_id", "user_email").agg(F.sum("count").alias("total_events"), *parts)
    return totals.orderBy(F.desc("total_events"), "tenant_id", "user_email").limit(top)


def _with_users(events: DataFrame, keys: Sequence[str], users: str) -> DataFrame:
    """Sum of counts and number of distinct users: users are folded first, so no key holds a distinct set."""
    per_user = events.groupBy(*keys, "user_email").agg(F.sum("count").alias("count"))
    return per_user.groupBy(*keys).agg(F.sum("count").alias("total_events"), F.count("user_email").alias(users))


def comm_daily_trend(events: DataFrame) -> DataFrame:
    return _with_users(events, ["tenant_id", "event_date", "source"], "active_users")


def comm_channel_breakdown(events: DataFrame) -> DataFrame:
    return _with_users(events, ["tenant_id", "source", "channel", "direction"], "unique_users")


def developer_comm_profile(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Channel totals per user beside their commit count; both sides are folded before the join."""
    is_chat = F.col("channel").isin(CHAT_CHANNELS)
    profile = events.groupBy("tenant_id", "user_email").agg(
        fx.sum_where("count", is_chat).alias("chat_messages"),
        fx.sum_where("count", F.col("channel") == "email_sent").alias("emails_sent"),
        fx.sum_where("count", F.col("channel") == "meeting").alias("meetings"),
        fx.sum_where("count", F.col("channel") == "call").alias("calls"),
    )
    authored = commits.groupBy("tenant_id", F.lower("author_email").alias("user_email")).agg(F.count(F.lit(1)).alias("_n"))
    joined = profile.join(authored, ["tenant_id", "user_email"], "left")
    return joined.withColumn("git_commits", fx.or_zero("_n")).drop("_n")


def out_in_ratio(events: DataFrame) -> DataFrame:
    """Outbound over inbound volume of users who receive anything."""
    out = events.groupBy("tenant_id", "user_email").agg(
        fx.sum_where("count", F.col("direction") == "outbound").alias("outbound"),
        fx.sum_where("count", F.col("direction") == "inbound").alias("inbound"),
    )
    return out.where(F.col("inbound") > 0).withColumn("out_in_ratio", F.round(fx.ratio("outbound", "inbound"), 2))


def source_trace(events: DataFrame, source_rows: DataFrame, source: str) -> DataFrame:
    """Event rows beside the report row they came from, through the key inside ``source_id``."""
    keyed = events.where(F.col("source") == source).withColumn("unique_key", fx.split_part("source_id", ":", 2))
    origin = source_rows.select("tenant_id", "unique_key", F.col("reportRefreshDate").alias("origin_date"))
    return keyed.join(origin, ["tenant_id", "unique_key"]).select(
        "tenant_id", "source_id", "unique_key", "channel", "count", "origin_date"
    )


def latest_report(report: DataFrame, date_col: str = "reportRefreshDate") -> DataFrame:
    """Live rows of the newest report day."""
    newest = report.agg(F.max(date_col).alias("d")).scalar()
    return report.where((F.col(date_col) == newest) & ~F.coalesce(F.col("isDeleted"), F.lit(False)))


def latest_report_top(report: DataFrame, measures: dict[str, Column], order_by: str, top: int) -> DataFrame:
    """Measures of the newest report day, highest first."""
    rows = latest_report(report).select("tenant_id", "unique_key", "userPrincipalName", *[c.alias(n) for n, c in measures.items()])
    return rows.orderBy(F.desc_nulls_last(order_by), "unique_key").limit(top)


def teams_report_measures() -> dict[str, Column]:
    """Messages, channel activity, meetings, and meetings per message (0 without messages)."""
    messages = fx.or_zero("teamChatMessageCount") + fx.or_zero("privateChatMessageCount")
    meetings = fx.or_zero("meetingsAttendedCount") + fx.or_zero("meetingsOrganizedCount")
    return {
        "total_messages": messages,
        "channel_activity": fx.or_zero("postMessages") + fx.or_zero("replyMessages"),
        "total_meetings": meetings,
        "meeting_to_message_ratio": F.coalesce(F.round(fx.ratio(meetings, messages), 2), F.lit(0.0)),
    }


def sharepoint_onedrive_join(sharepoint: DataFrame, onedrive: DataFrame) -> DataFrame:
    """Both products per user and day, each folded first so repeated report rows cannot multiply."""
    keys = ["tenant_id", "userPrincipalName", "reportRefreshDate"]

    def folded(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("viewedOrEditedFileCount").alias(f"{name}_files"))

    joined = folded(sharepoint, "sharepoint").join(folded(onedrive, "onedrive"), keys)
    return joined.withColumn("total_files", F.col("sharepoint_files") + F.col("onedrive_files"))


def active_users_trend(report: DataFrame, measure: str) -> DataFrame:
    """Total of a measure and known users with any of it, per report day. Rows without a user count in the total."""
    per_user = report.groupBy("tenant_id", "reportRefreshDate", "userPrincipalName").agg(
        F.sum(measure).alias("_total"), F.max(measure).alias("_most")
    )
    return per_user.groupBy("tenant_id", "reportRefreshDate").agg(
        F.sum("_total").alias("total"), fx.count_where(F.col("userPrincipalName").isNotNull() & (F.col("_most") > 0)).alias("active_users")
    )
