"""Task flow, communication stream, and the metrics of the other domains."""

from pyspark.sql import functions as F

from harness.cases import VIEWS, Tables, case
from harness.git_cases import commit_fact, git_class
from harness.metric_cases import collab_rows
from harness.work_cases import activities, api_usage, cursor_usage, deals, work_class
from orgpulse.functions import scalars as fx
from orgpulse.operators import code_metrics, communication, flow, gold
from orgpulse.operators import domain_metrics as dm

V = VIEWS

# --- field history -----------------------------------------------------------------------------

# The oracle replays each lane on its own: last set for single fields, last action per value for multi fields.
@case(
    "field_history_full_values",
    """
WITH d AS (SELECT *, row_number() OVER (ORDER BY tenant_id, issue_id, field_id, event_at, event_id, delta_value, delta_action) AS pos FROM (SELECT DISTINCT * FROM <b_deltas>)),
  lanes AS (SELECT DISTINCT tenant_id, issue_id, field_id, field_cardinality, CASE WHEN field_cardinality = 'single' THEN '' ELSE delta_value END AS lane FROM d),
  state AS (SELECT e.tenant_id, e.issue_id, e.field_id, e.pos, l.lane, max(x.pos) AS last_pos FROM d e JOIN lanes l USING (tenant_id, issue_id, field_id)
    JOIN d x ON x.tenant_id = e.tenant_id AND x.issue_id = e.issue_id AND x.field_id = e.field_id AND x.pos <= e.pos AND (l.lane = '' OR x.delta_value = l.lane) GROUP BY ALL),
  held AS (SELECT s.pos, d.delta_value FROM state s JOIN d ON d.pos = s.last_pos WHERE d.delta_action IN ('set','add'))
SELECT e.tenant_id, e.issue_id, e.field_id, e.event_id, e.delta_action, e.delta_value, COALESCE((SELECT string_agg(h.delta_value, '|' ORDER BY h.delta_value) FROM held h WHERE h.pos = e.pos), '') AS value_ids FROM d e""",
)
def full_values(t: Tables):
    out = flow.field_history_full_values(t["b_deltas"].distinct())
    return out.select("tenant_id", "issue_id", "field_id", "event_id", "delta_action", "delta_value", "value_ids")


V["v_multi"] = "SELECT * FROM <b_deltas> WHERE field_cardinality = 'multi'"
V["v_current_values"] = "SELECT DISTINCT tenant_id, issue_id, field_id, v.value FROM <v_multi> JOIN (VALUES ('v1'), ('v3'), ('z')) v(value) ON true"


@case(
    "initial_state",
    """
WITH f AS (SELECT tenant_id, issue_id, field_id, delta_value AS value, first(delta_action ORDER BY event_at, event_id) AS a FROM <v_multi> GROUP BY ALL)
SELECT tenant_id, issue_id, field_id, value FROM <v_current_values> ANTI JOIN f USING (tenant_id, issue_id, field_id, value) UNION SELECT tenant_id, issue_id, field_id, value FROM f WHERE a = 'remove'""",
)
def at_creation(t):
    deltas = t["b_deltas"].where(F.col("field_cardinality") == "multi")
    values = F.array(*[F.lit(v) for v in ("v1", "v3", "z")])
    now = deltas.select("tenant_id", "issue_id", "field_id").distinct().withColumn("value", F.explode(values))
    return flow.initial_state(now, deltas)


V["v_tags"] = "SELECT tenant_id, issue_id, s.at, list_transform(string_split_regex(tag_text, '[;,]\\s*'), lambda x: trim(x)) AS tags FROM <b_tag_snapshots> s"


def tags(t):
    return flow.explode_tag_snapshot(t["b_tag_snapshots"], "tag_text")


case("explode_tag_snapshot", "SELECT tenant_id, issue_id, s.at::VARCHAR AS at, array_to_string(tags, '|') AS tags FROM <v_tags> s")(lambda t: tags(t).select("tenant_id", "issue_id", "at", "tags"))


@case(
    "snapshot_diff_deltas",
    """
WITH p AS (SELECT tenant_id, issue_id, s.at AS event_at, tags, lag(tags) OVER (PARTITION BY tenant_id, issue_id ORDER BY s.at) AS was FROM <v_tags> s), d AS (SELECT * FROM p WHERE was IS NOT NULL)
SELECT tenant_id, issue_id, event_at::VARCHAR AS event_at, 'add' AS delta_action, unnest(list_distinct(list_filter(tags, lambda x: NOT list_contains(was, x)))) AS delta_value FROM d
UNION ALL SELECT tenant_id, issue_id, event_at::VARCHAR, 'remove', unnest(list_distinct(list_filter(was, lambda x: NOT list_contains(tags, x)))) FROM d""",
)
def diffs(t):
    return flow.snapshot_diff_deltas(tags(t).select("tenant_id", "issue_id", "at", "tags"), ["tenant_id", "issue_id"], "at", "tags")


# --- status periods --------------------------------------------------------------------------------

V["v_periods"] = """
SELECT tenant_id, task_id, status, h.at AS entered_at, lead(h.at) OVER w AS exited_at, assignee FROM (SELECT DISTINCT * FROM <b_status_history>) h WINDOW w AS (PARTITION BY tenant_id, task_id ORDER BY h.at, event_id, assignee)"""
CATEGORIES = {"in_progress": ["In Progress"], "testing": ["In Review"], "done": ["Done"]}
V["v_lifecycle"] = """
SELECT *, date_diff('second', started_at, done_at) / 3600.0 AS lead_time_h FROM (SELECT tenant_id, task_id, min(entered_at) AS created_at, min(CASE WHEN status = 'In Progress' THEN entered_at END) AS started_at,
  min(CASE WHEN status = 'In Review' THEN entered_at END) AS testing_started_at, min(CASE WHEN status = 'Done' THEN entered_at END) AS done_at FROM <v_periods> GROUP BY ALL)"""
_TASK = ["tenant_id", "task_id"]


def periods(t):
    return flow.status_periods(t["b_status_history"].distinct(), _TASK, ["at", "event_id", "assignee"], "status", "at")


def lifecycle(t):
    return flow.lifecycle_summary(periods(t), _TASK, CATEGORIES)


case("status_periods", "SELECT tenant_id, task_id, status, entered_at::VARCHAR AS entered_at, exited_at::VARCHAR AS exited_at, round(date_diff('second', entered_at, exited_at) / 3600.0, 6) AS hours FROM <v_periods>")(periods)
case(
    "lifecycle_summary",
    "SELECT tenant_id, task_id, created_at::VARCHAR AS created_at, started_at::VARCHAR AS started_at, testing_started_at::VARCHAR AS testing_started_at, done_at::VARCHAR AS done_at, round(lead_time_h,6) AS lead_time_h FROM <v_lifecycle>",
)(lifecycle)
case("throughput", "SELECT tenant_id, date_trunc('week', done_at)::DATE::VARCHAR AS period, count(*) AS tasks_done FROM <v_lifecycle> WHERE done_at IS NOT NULL GROUP BY ALL")(lambda t: flow.throughput(lifecycle(t), "week"))


@case(
    "wip_snapshots",
    """
WITH cal AS (SELECT DISTINCT o_orderdate::DATE AS day FROM <orders>), p AS (SELECT tenant_id, status, entered_at::DATE AS a, exited_at::DATE AS b FROM <v_periods>),
  moves AS (SELECT tenant_id, status, a AS day, 1 AS d FROM p UNION ALL SELECT tenant_id, status, b, -1 FROM p WHERE b IS NOT NULL UNION ALL SELECT tenant_id, status, day, 0 FROM (SELECT DISTINCT tenant_id, status FROM p), cal),
  stock AS (SELECT tenant_id, status, day, sum(sum(d)) OVER (PARTITION BY tenant_id, status ORDER BY day)::BIGINT AS items FROM moves GROUP BY tenant_id, status, day)
SELECT tenant_id, status, s.day::VARCHAR AS day, items FROM stock s SEMI JOIN cal USING (day)""",
)
def wip(t):
    calendar = t["orders"].select(F.to_date("o_orderdate").alias("day")).distinct()
    return flow.wip_snapshots(periods(t), calendar, ["tenant_id", "status"])


@case(
    "sprint_velocity",
    """SELECT l.tenant_id, m.sprint_id, sum(p) AS points_done, count(*) AS tasks_done FROM (SELECT tenant_id, task_id, done_at, (task_id::BIGINT % 8)::DOUBLE AS p FROM <v_lifecycle> WHERE done_at IS NOT NULL) l
JOIN <b_memberships> m ON m.tenant_id = l.tenant_id AND m.task_id = l.task_id AND m.valid_from <= l.done_at AND (m.valid_to IS NULL OR l.done_at < m.valid_to) GROUP BY ALL""",
)
def velocity(t):
    done = lifecycle(t).where(F.col("done_at").isNotNull()).withColumn("story_points", (F.col("task_id").cast("bigint") % 8).cast("double"))
    return flow.sprint_velocity(done.select("tenant_id", "task_id", "done_at", "story_points"), t["b_memberships"])


@case(
    "sprint_carryover",
    "SELECT m.tenant_id, sprint_id, m.task_id, valid_to::VARCHAR AS valid_to FROM <b_memberships> m LEFT JOIN <v_lifecycle> l USING (tenant_id, task_id) WHERE valid_to IS NOT NULL AND (done_at IS NULL OR done_at >= valid_to)",
)
def carryover(t):
    return flow.sprint_carryover(t["b_memberships"], lifecycle(t))


@case("worklog_hours", "SELECT l_suppkey AS person_id, l_orderkey % 9 AS project, round(sum(l_quantity * 60) / 3600.0, 6) AS hours FROM <lineitem> GROUP BY ALL")
def worklogs(t):
    rows = t["lineitem"].select(F.col("l_suppkey").alias("person_id"), (F.col("l_orderkey") % 9).alias("project"), (F.col("l_quantity") * 60).alias("seconds"))
    return flow.worklog_hours(rows, ["person_id", "project"])


@case("comment_volume", "SELECT tenant_id, author_login, count(*) AS comments FROM <b_pr_comments> GROUP BY ALL")
def comment_counts(t):
    return flow.comment_volume(t["b_pr_comments"], ["tenant_id", "author_login"])


@case(
    "blocker_rate",
    """SELECT tenant_id, project, count(*) AS issues, count(b) AS blocked, round(count(b) / count(*), 6) AS blocker_rate FROM (SELECT 't' AS tenant_id, o_orderkey AS issue_id, o_orderpriority AS project FROM <orders>)
LEFT JOIN (SELECT DISTINCT l_orderkey AS issue_id, 1 AS b FROM <lineitem> WHERE l_returnflag = 'R') USING (issue_id) GROUP BY ALL""",
)
def blockers(t):
    issues = t["orders"].select(F.lit("t").alias("tenant_id"), F.col("o_orderkey").alias("issue_id"), F.col("o_orderpriority").alias("project"))
    links = t["lineitem"].select(F.lit("t").alias("tenant_id"), F.col("l_orderkey").alias("target_id"), F.when(F.col("l_returnflag") == "R", "blocks").otherwise("relates").alias("link_type"))
    return flow.blocker_rate(issues, links, ["tenant_id", "project"])


@case(
    "wip_per_person",
    "SELECT tenant_id, assignee, count(*) AS open_items FROM <v_periods> WHERE status IN ('Open','In Progress') AND entered_at <= TIMESTAMP '1998-06-01' AND (exited_at IS NULL OR exited_at > TIMESTAMP '1998-06-01') GROUP BY ALL",
)
def held(t):
    rows = t["b_status_history"].distinct()
    with_owner = flow.with_neighbour(rows, _TASK, ["at", "event_id", "assignee"], {"exited_at": "at"}, F.to_date("at"), "next").withColumnRenamed("at", "entered_at")
    return flow.wip_per_person(with_owner, "1998-06-01", ["Open", "In Progress"])


# --- latest states -------------------------------------------------------------------------------------

V["v_issue_latest"] = "SELECT * FROM <b_task_events> QUALIFY row_number() OVER (PARTITION BY tenant_id, issue_ref ORDER BY event_date DESC, event_id DESC) = 1"
V["v_stories"] = "SELECT * FROM <b_task_events> WHERE type = 'User Story' QUALIFY row_number() OVER (PARTITION BY tenant_id, issue_ref ORDER BY event_date DESC, event_id DESC) = 1"
_PICK = ["tenant_id", "issue_ref", "state", "assignee", "event_id"]
case("issue_latest", "SELECT tenant_id, issue_ref, state, assignee, event_id FROM <v_issue_latest>")(lambda t: flow.issue_latest(t["b_task_events"]).select(_PICK))
case("children_latest", "SELECT tenant_id, issue_ref, state, assignee, event_id FROM <v_issue_latest> WHERE parent_issue_ref = '40'")(lambda t: flow.children_latest(t["b_task_events"], "40").select(_PICK))
case(
    "stories_with_bug_children",
    "SELECT tenant_id, issue_ref, state, assignee FROM <v_stories> s WHERE EXISTS (SELECT 1 FROM <b_task_events> c WHERE c.tenant_id = s.tenant_id AND c.parent_issue_ref = s.issue_ref AND c.type = 'Bug')",
)(lambda t: flow.stories_with_bug_children(t["b_task_events"]))
case(
    "stories_with_open_children",
    "SELECT tenant_id, issue_ref, state FROM <v_stories> s WHERE EXISTS (SELECT 1 FROM <v_issue_latest> c WHERE c.tenant_id = s.tenant_id AND c.parent_issue_ref = s.issue_ref AND c.parent_issue_ref <> '' AND c.state NOT IN ('done','new'))",
)(lambda t: flow.stories_with_open_children(t["b_task_events"]))


def _mapped(t):
    return t["b_task_events"].withColumn("fields_map", F.create_map("field_name", "field_text"))


case("map_field_filter", "SELECT task_id, event_id, field_text AS field_value FROM <b_task_events> WHERE field_name = 'confidence' AND field_text = 'high'")(
    lambda t: flow.map_field_filter(_mapped(t), "confidence", "high").select("task_id", "event_id", "field_value")
)
case("map_field_exists", "SELECT task_id, event_id, field_text AS field_value FROM <b_task_events> WHERE field_name = 'sprints'")(
    lambda t: flow.map_field_filter(_mapped(t), "sprints").select("task_id", "event_id", "field_value")
)

# --- communication stream ---------------------------------------------------------------------------------

V["v_comm_events"] = (
    " UNION ALL ".join(
        f"SELECT tenant_id, '{source}:' || unique_key || ':{channel}' AS source_id, reportRefreshDate::DATE AS event_date, '{source}' AS source, lower(userPrincipalName) AS user_email, {name} AS user_display_name, '{channel}' AS channel, '{way}' AS direction, {col} AS count FROM <{table}> WHERE {col} > 0 AND NOT isDeleted"
        for source, table, name in (("ms365_teams", "b_teams", "NULL::VARCHAR"), ("ms365_email", "b_email", "displayName"))
        for col, channel, way in communication.CHANNELS[source]
    )
    + " UNION ALL SELECT m.tenant_id, 'zulip:' || uniq, created_at::DATE, 'zulip', lower(u.email), u.full_name, 'chat', 'outbound', m.count FROM <b_zulip> m JOIN <b_zulip_users> u ON m.tenant_id = u.tenant_id AND m.sender_id = u.id"
)


def comm_events(t):
    return communication.communication_events(t["b_teams"], t["b_email"], t["b_zulip"], t["b_zulip_users"])


case("communication_events", "SELECT * REPLACE (event_date::VARCHAR AS event_date) FROM <v_comm_events>")(comm_events)
_SRC = ["ms365_teams", "ms365_email", "zulip"]
case(
    "comm_volume_by_platform",
    "SELECT tenant_id, user_email, sum(count) AS total_events, " + ", ".join(f"COALESCE(sum(CASE WHEN source = '{s}' THEN count END),0) AS {s}_events" for s in _SRC) + " FROM <v_comm_events> GROUP BY tenant_id, user_email ORDER BY total_events DESC, tenant_id, user_email LIMIT 20",
)(lambda t: communication.comm_volume_by_platform(comm_events(t), _SRC, 20))
# How often a user did what, said of the events: per source, channel and direction a remainder of k.
_DONE_BY = [
    ("ms365_teams", "chat_group", "outbound", "CASE WHEN event_id % 11 > 0 THEN k % 7 END"), ("ms365_teams", "chat_private", "outbound", "k % 5"), ("ms365_teams", "channel_post", "outbound", "k % 9"),
    ("ms365_teams", "channel_reply", "outbound", "k % 8"), ("ms365_teams", "call", "outbound", "k % 4"), ("ms365_teams", "meeting", "engagement", "CASE WHEN event_id % 7 > 0 THEN k % 3 END"),
    ("ms365_email", "email_sent", "outbound", "CASE WHEN event_id % 17 > 0 THEN k % 10 END"), ("ms365_email", "email_received", "inbound", "k % 12"), ("ms365_email", "email_read", "engagement", "k % 11"),
]
V["v_done_by"] = (
    " UNION ALL ".join(f"SELECT tenant_id, day, lower(office_name) AS who, '{s}' AS source, '{c}' AS channel, '{d}' AS direction, {n} AS times FROM <v_named_events> WHERE event_id % 53 > 0" for s, c, d, n in _DONE_BY)
    + " UNION ALL SELECT 't' || (user_id % 2), ts::DATE, 'user' || user_id || '@example.com', 'zulip', 'chat', 'outbound', regexp_extract(props, '([0-9]+)', 1)::BIGINT % 6 + 1 FROM <events> WHERE user_id IN (SELECT c_custkey FROM <customer>)"
)
V["v_done_by_some"] = "SELECT tenant_id, day, who, source, channel, direction, sum(times)::DOUBLE AS times FROM <v_done_by> WHERE times > 0 GROUP BY ALL"
case("comm_daily_trend", "SELECT tenant_id, day::VARCHAR AS event_date, source, sum(times) AS total_events, len(list_distinct(list(who))) AS active_users FROM <v_done_by_some> GROUP BY tenant_id, day, source")(
    lambda t: communication.comm_daily_trend(comm_events(t))
)
case("comm_channel_breakdown", "SELECT tenant_id, source, channel, direction, sum(times) AS total_events, len(list_distinct(list(who))) AS unique_users FROM <v_done_by_some> GROUP BY ALL")(
    lambda t: communication.comm_channel_breakdown(comm_events(t))
)
case(
    "developer_comm_profile",
    """SELECT e.tenant_id, e.user_email, sum(CASE WHEN channel IN ('chat_group','chat_private','chat') THEN count ELSE 0 END) AS chat_messages, sum(CASE WHEN channel = 'email_sent' THEN count ELSE 0 END) AS emails_sent, sum(CASE WHEN channel = 'meeting' THEN count ELSE 0 END) AS meetings,
  sum(CASE WHEN channel = 'call' THEN count ELSE 0 END) AS calls, COALESCE(max(n), 0) AS git_commits FROM <v_comm_events> e LEFT JOIN (SELECT tenant_id, lower(author_email) AS user_email, count(*) AS n FROM <v_class_git_commits> GROUP BY tenant_id, lower(author_email)) c USING (tenant_id, user_email) GROUP BY ALL""",
)(lambda t: communication.developer_comm_profile(comm_events(t), git_class(t, "class_git_commits")))
case(
    "out_in_ratio",
    """SELECT *, round(outbound / nullif(inbound, 0), 2) AS out_in_ratio FROM (SELECT tenant_id, user_email, COALESCE(sum(CASE WHEN direction = 'outbound' THEN count END),0) AS outbound, COALESCE(sum(CASE WHEN direction = 'inbound' THEN count END),0) AS inbound FROM <v_comm_events> GROUP BY ALL) WHERE inbound > 0""",
)(lambda t: communication.out_in_ratio(comm_events(t)))
case(
    "source_trace",
    "SELECT e.tenant_id, e.source_id, split_part(e.source_id, ':', 2) AS unique_key, channel, count, m.reportRefreshDate AS origin_date FROM <v_comm_events> e JOIN <b_email> m ON m.tenant_id = e.tenant_id AND m.unique_key = split_part(e.source_id, ':', 2) WHERE source = 'ms365_email'",
)(lambda t: communication.source_trace(comm_events(t), t["b_email"], "ms365_email"))
case(
    "latest_report_top",
    """SELECT tenant_id, unique_key, userPrincipalName, m AS total_messages, COALESCE(postMessages,0) + COALESCE(replyMessages,0) AS channel_activity, g AS total_meetings, COALESCE(round(g / nullif(m, 0), 2), 0) AS meeting_to_message_ratio
FROM (SELECT *, COALESCE(teamChatMessageCount,0) + COALESCE(privateChatMessageCount,0) AS m, COALESCE(meetingsAttendedCount,0) + COALESCE(meetingsOrganizedCount,0) AS g FROM <b_teams> WHERE reportRefreshDate = (SELECT max(reportRefreshDate) FROM <b_teams>) AND NOT isDeleted)
ORDER BY total_messages DESC, unique_key LIMIT 20""",
)(lambda t: communication.latest_report_top(t["b_teams"], communication.teams_report_measures(), "total_messages", 20))
case(
    "sharepoint_onedrive_join",
    """SELECT *, sharepoint_files + onedrive_files AS total_files FROM (SELECT tenant_id, userPrincipalName, reportRefreshDate, sum(viewedOrEditedFileCount) AS sharepoint_files FROM <b_sharepoint> GROUP BY ALL) JOIN (SELECT tenant_id, userPrincipalName, reportRefreshDate, sum(viewedOrEditedFileCount) AS onedrive_files FROM <b_onedrive> GROUP BY ALL) USING (tenant_id, userPrincipalName, reportRefreshDate)""",
)(lambda t: communication.sharepoint_onedrive_join(t["b_sharepoint"], t["b_onedrive"]))
case(
    "active_users_trend",
    """WITH visits AS (SELECT tenant_id, day, office_name, sum(k % 13)::DOUBLE AS n FROM <v_named_events> GROUP BY ALL)
SELECT tenant_id, day::VARCHAR AS reportRefreshDate, sum(n) AS total, count(office_name) FILTER (n > 0) AS active_users FROM visits GROUP BY tenant_id, day""",
)(lambda t: communication.active_users_trend(t["b_sharepoint"], "visitedPageCount"))

case(
    "ticket_refs_to_tasks",
    "SELECT r.tenant_id, r.external_ticket_id, r.ticket_source, r.pr_id, r.commit_hash, i.issue_type, i.status_name FROM <v_tickets> r JOIN <v_task_daily> i ON i.tenant_id = r.tenant_id AND i.id_readable = r.external_ticket_id",
)(
    lambda t: code_metrics.code_to_tasks(
        code_metrics.ticket_refs(git_class(t, "class_git_commits"), git_class(t, "class_git_pull_requests")), gold.task_person_daily(t["b_issues"])
    ).select("tenant_id", "external_ticket_id", "ticket_source", "pr_id", "commit_hash", "issue_type", "status_name")
)

# --- AI tools -------------------------------------------------------------------------------------------------

case(
    "ai_usage_metrics",
    """SELECT tenant_id, week::VARCHAR AS week, active_members, members, round(active_members / members, 6) AS adoption_rate FROM (SELECT tenant_id, date_trunc('week', day)::DATE AS week, count(DISTINCT person_id) AS active_members FROM <b_tool_usage> WHERE is_active GROUP BY ALL)
JOIN (SELECT tenant_id, count(DISTINCT lower(workEmail)) AS members FROM <b_employees> GROUP BY ALL) USING (tenant_id)""",
)(lambda t: dm.ai_adoption(t["b_tool_usage"], t["b_employees"].select("tenant_id", F.lower("workEmail").alias("person_id"))))


@case("ai_cost_per_user", "SELECT tenant_id, lower(user_email) AS person_id, date_trunc('month', epoch_ms(event_timestamp::BIGINT))::DATE::VARCHAR AS period, sum(COALESCE(request_cost,0) + COALESCE(platform_fee,0)) AS cost FROM <v_cursor_usage> GROUP BY ALL")
def cost_per_user(t):
    events = cursor_usage(t).withColumns({"person_id": F.lower("user_email"), "at": fx.time_from_millis("event_timestamp")})
    return dm.ai_cost_per_user(events, "month")


case(
    "ai_acceptance",
    "SELECT tenant_id, person_id, date_trunc('week', day)::DATE::VARCHAR AS week, round(sum(tabs_accepted) / nullif(sum(tabs_shown),0), 6) AS tab_acceptance, round(sum(ai_lines) / nullif(sum(total_lines),0), 6) AS ai_line_ratio FROM <b_tool_usage> GROUP BY ALL",
)(lambda t: dm.ai_acceptance(t["b_tool_usage"]))
case("model_distribution", "SELECT tenant_id, model, count(*) AS requests, round(count(*) / sum(count(*)) OVER (PARTITION BY tenant_id), 6) AS share FROM <v_cursor_usage> GROUP BY tenant_id, model")(lambda t: dm.model_distribution(cursor_usage(t)))
case(
    "cross_tool_comparison",
    "SELECT tenant_id, person_id, "
    + ", ".join(f"round(COALESCE(sum(CASE WHEN tool = '{x}' THEN cost END),0),4) AS {x}_cost, COALESCE(sum(CASE WHEN tool = '{x}' THEN ai_lines END),0) AS {x}_lines" for x in ("cursor", "code"))
    + " FROM <b_tool_usage> GROUP BY ALL",
)(lambda t: dm.cross_tool_comparison(t["b_tool_usage"], ["cursor", "code"]).select("tenant_id", "person_id", *[F.coalesce(F.round(f"{x}_{m}", 4), F.lit(0.0)).alias(f"{x}_{m}") for x in ("cursor", "code") for m in ("cost", "lines")]))
case("seat_activity", "SELECT user_id, last_at::VARCHAR AS last_activity_at, CASE WHEN last_at > TIMESTAMP '2024-01-20' - INTERVAL 1 DAY AND last_at <= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END AS is_active FROM (SELECT user_id, max(ts) AS last_at FROM <events> GROUP BY ALL)")(
    lambda t: dm.seat_activity(t["events"].groupBy("user_id").agg(F.max("ts").alias("last_activity_at")), "2024-01-20", 1)
)
case("org_ai_usage", "SELECT tenant_id, day::VARCHAR AS day, sum(tabs_shown) AS shown, sum(tabs_accepted) AS accepted, round(sum(tabs_accepted) / nullif(sum(tabs_shown),0), 6) AS acceptance_rate FROM <b_tool_usage> u GROUP BY tenant_id, u.day")(
    lambda t: dm.org_ai_usage(t["b_tool_usage"].withColumnsRenamed({"tabs_shown": "shown", "tabs_accepted": "accepted"}))
)
V["v_allocated"] = """
SELECT u.tenant_id, u.model, u.report_date, u.unique_key, u.key_name, u.workspace_name, u.total_tokens, u.total_tokens * (c.a / nullif(k.t, 0)) AS allocated_cost FROM <v_api_usage> u
LEFT JOIN (SELECT tenant_id, model, report_date, sum(total_tokens) AS t FROM <v_api_usage> GROUP BY ALL) k USING (tenant_id, model, report_date) LEFT JOIN (SELECT tenant_id, model, report_date, sum(amount) AS a FROM <b_ai_cost> GROUP BY ALL) c USING (tenant_id, model, report_date)"""


def allocated(t):
    return dm.ai_api_cost(api_usage(t), t["b_ai_cost"], ["tenant_id", "model", "report_date"])


case("ai_api_cost", "SELECT tenant_id, model, report_date, unique_key, total_tokens, round(allocated_cost, 6) AS allocated_cost FROM <v_allocated>")(
    lambda t: allocated(t).select("tenant_id", "model", "report_date", "unique_key", "total_tokens", "allocated_cost")
)
case("ai_spend_by_key", "SELECT tenant_id, key_name, model, workspace_name, round(sum(allocated_cost), 6) AS cost, sum(total_tokens) AS tokens FROM <v_allocated> GROUP BY ALL")(
    lambda t: dm.spend_by(allocated(t), ["tenant_id", "key_name", "model", "workspace_name"])
)
case("ai_tool_adoption", "SELECT 't' AS tenant_id, role AS model, 'web' AS client, count(DISTINCT conv_id % 20) AS active_users, count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM <conversations> GROUP BY role")(
    lambda t: dm.ai_tool_adoption(t["conversations"].select(F.lit("t").alias("tenant_id"), F.col("role").alias("model"), F.lit("web").alias("client"), (F.col("conv_id") % 20).alias("user_id"), F.col("conv_id").alias("conversation_id")))
)

# --- collaboration, CRM -----------------------------------------------------------------------------------------

V["v_class_chat"] = "SELECT * FROM <v_m365_chat> UNION ALL BY NAME SELECT * FROM <v_slack_chat>"
V["v_class_meet"] = "SELECT * FROM <v_m365_meetings> UNION ALL BY NAME SELECT * FROM <v_zoom_meetings>"


@case(
    "collab_metrics",
    """
WITH r AS (SELECT tenant_id, person_key, date_trunc('week', date)::DATE AS week, data_source AS src, total_chat_messages::DOUBLE AS messages, 0.0 AS meetings, 0.0 AS meeting_hours, 0.0 AS organized, 0.0 AS adhoc, 0.0 AS scheduled, 0.0 AS files, 0.0 AS shares FROM <v_class_chat>
  UNION ALL SELECT tenant_id, person_key, date_trunc('week', date)::DATE, data_source, 0, COALESCE(meetings_attended,0), audio_duration_seconds / 3600.0, COALESCE(meetings_organized,0), COALESCE(adhoc_meetings_attended,0), COALESCE(scheduled_meetings_attended,0), 0, 0 FROM <v_class_meet>
  UNION ALL SELECT tenant_id, person_key, date_trunc('week', date)::DATE, data_source, 0, 0, 0, 0, 0, 0, COALESCE(viewed_or_edited_count,0), COALESCE(shared_internally_count,0) FROM <v_m365_docs>),
  g AS (SELECT tenant_id, person_key, week, sum(messages)::DOUBLE AS messages, sum(meetings)::DOUBLE AS meetings, sum(meeting_hours)::DOUBLE AS meeting_hours, sum(organized)::DOUBLE AS organized, sum(adhoc)::DOUBLE AS adhoc, sum(scheduled)::DOUBLE AS scheduled, sum(files)::DOUBLE AS files, sum(shares)::DOUBLE AS shares, count(DISTINCT src) AS breadth FROM r GROUP BY ALL)
SELECT * REPLACE (week::VARCHAR AS week, round(meeting_hours,6) AS meeting_hours), messages + meetings AS communication_load, round(messages / nullif(meeting_hours, 0), 4) AS async_sync_ratio, organized + meetings AS meeting_overload FROM g""",
)
def collab(t):
    out = dm.collab_metrics(work_class(t, "class_collab_chat_activity"), work_class(t, "class_collab_meeting_activity"), work_class(t, "class_collab_document_activity"))
    return out.withColumn("async_sync_ratio", F.round("async_sync_ratio", 4))


case(
    "crm_metrics",
    """SELECT tenant_id, owner_id, count(*) AS deals, round(COALESCE(sum(CASE WHEN is_won = 1 THEN amount END),0),2) AS won_value, round(count_if(is_won = 1) / nullif(count_if(is_closed = 1),0),6) AS win_rate,
  round(avg(CASE WHEN is_closed = 1 THEN date_diff('day', created_at::DATE, close_date::DATE) END),6) AS avg_cycle_days FROM <v_crm_deals> GROUP BY ALL""",
)(lambda t: dm.crm_sales(deals(t)).withColumn("won_value", F.round("won_value", 2)))
case("crm_open_stages", "SELECT tenant_id, stage, count(*) AS open_deals, round(sum(amount),2) AS open_value, round(sum(amount * probability / 100.0),2) AS weighted_value FROM <v_crm_deals> WHERE is_closed = 0 GROUP BY ALL")(
    lambda t: dm.crm_open_stages(deals(t)).withColumns({c: F.round(c, 2) for c in ("open_value", "weighted_value")})
)
case(
    "crm_activity_mix",
    "SELECT tenant_id, owner_id, week::VARCHAR AS week, activity_type, n, round(n / sum(n) OVER (PARTITION BY tenant_id, owner_id, week), 6) AS share FROM (SELECT tenant_id, owner_id, date_trunc('week', timestamp)::DATE AS week, activity_type, count(*) AS n FROM <v_crm_activities> GROUP BY ALL)",
)(lambda t: dm.crm_activity_mix(activities(t)))

# --- wiki, support, design, quality ---------------------------------------------------------------------------------

case("wiki_metrics", "SELECT tenant_id, lower(mail) AS person_id, date_trunc('week', day)::DATE::VARCHAR AS week, sum(k % 2)::BIGINT AS pages_created, sum(k % 7)::BIGINT AS edits FROM <b_ev> GROUP BY ALL")(
    lambda t: dm.wiki_velocity(t["b_ev"].select("tenant_id", F.lower("mail").alias("person_id"), "day", (F.col("k") % 2).alias("created"), (F.col("k") % 7).alias("edits")))
)
case("wiki_views", "SELECT tenant_id, k AS page_id, date_trunc('week', day)::DATE::VARCHAR AS week, sum(k % 9)::BIGINT AS views FROM <b_ev> GROUP BY ALL")(
    lambda t: dm.wiki_views(t["b_ev"].select("tenant_id", F.col("k").alias("page_id"), "day", (F.col("k") % 9).alias("views")))
)
case("wiki_spaces", "SELECT lang AS tenant_id, source AS space, count(*) AS pages_created, count_if(n_chars < 500) AS pages_archived, round(count(*) / nullif(count_if(n_chars < 500), 0), 6) AS created_archived_ratio, count(DISTINCT doc_id % 9) AS authors FROM <documents> GROUP BY ALL")(
    lambda t: dm.wiki_spaces(t["documents"].select(F.col("lang").alias("tenant_id"), F.col("source").alias("space"), (F.col("doc_id") % 9).alias("author_id"), (F.col("n_chars") < 500).alias("archived")))
)

V["v_tk"] = "SELECT 't' || (o_orderkey % 2) AS tenant_id, o_orderkey AS ticket_id, o_orderdate AS opened_at, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'good' WHEN o_orderkey % 3 = 1 THEN 'bad' END AS rating FROM <orders>"
V["v_tke"] = """SELECT 't' || (l_orderkey % 2) AS tenant_id, l_orderkey AS ticket_id, 'A' || l_suppkey AS agent_id, l_shipdate AS at, CASE WHEN l_linenumber % 2 = 0 THEN 'comment' ELSE 'status_change' END AS event_type,
  CASE WHEN l_returnflag = 'R' THEN 'solved' ELSE 'open' END AS new_value, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_public FROM <lineitem>"""


def support_tickets(t):
    k = F.col("o_orderkey")
    return t["orders"].select(
        F.concat(F.lit("t"), (k % 2).cast("string")).alias("tenant_id"), k.alias("ticket_id"), F.col("o_orderdate").alias("opened_at"), F.col("o_orderpriority").alias("priority"), F.when(k % 3 == 0, "good").when(k % 3 == 1, "bad").alias("rating")
    )


def support_events(t):
    return t["lineitem"].select(
        F.concat(F.lit("t"), (F.col("l_orderkey") % 2).cast("string")).alias("tenant_id"), F.col("l_orderkey").alias("ticket_id"), F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("agent_id"), F.col("l_shipdate").alias("at"),
        F.when(F.col("l_linenumber") % 2 == 0, "comment").otherwise("status_change").alias("event_type"), F.when(F.col("l_returnflag") == "R", "solved").otherwise("open").alias("new_value"), fx.flag(F.col("l_linestatus") == "O").alias("is_public"),
    )


@case(
    "support_metrics",
    """
WITH s AS (SELECT tenant_id, ticket_id, min_by(agent_id, {'a': e.at, 'b': agent_id}) AS agent_id, min(e.at) AS solved_at FROM <v_tke> e WHERE event_type = 'status_change' AND new_value = 'solved' GROUP BY ALL),
  r AS (SELECT tenant_id, ticket_id, min_by(agent_id, {'a': e.at, 'b': agent_id}) AS agent_id, min(e.at) AS replied_at FROM <v_tke> e WHERE event_type = 'comment' AND is_public = 1 GROUP BY ALL),
  d1 AS (SELECT s.tenant_id, agent_id, solved_at::DATE AS day, count(*) AS tickets_resolved, avg(date_diff('second', opened_at, solved_at)) AS full_resolution_s, count_if(rating = 'good') / nullif(count(rating), 0) AS satisfaction_score FROM s JOIN <v_tk> USING (tenant_id, ticket_id) GROUP BY s.tenant_id, agent_id, solved_at::DATE),
  d2 AS (SELECT r.tenant_id, agent_id, replied_at::DATE AS day, avg(date_diff('second', opened_at, replied_at)) AS first_response_s FROM r JOIN <v_tk> USING (tenant_id, ticket_id) GROUP BY r.tenant_id, agent_id, replied_at::DATE),
  d3 AS (SELECT tenant_id, agent_id, e.at::DATE AS day, count(*) AS comments_sent FROM <v_tke> e WHERE event_type = 'comment' AND is_public = 1 GROUP BY tenant_id, agent_id, e.at::DATE)
SELECT tenant_id, agent_id, day::VARCHAR AS day, COALESCE(tickets_resolved,0) AS tickets_resolved, round(full_resolution_s,4) AS full_resolution_s, round(COALESCE(satisfaction_score, CASE WHEN tickets_resolved IS NULL THEN NULL END),6) AS satisfaction_score, round(first_response_s,4) AS first_response_s, COALESCE(comments_sent,0) AS comments_sent
FROM d1 FULL JOIN d2 USING (tenant_id, agent_id, day) FULL JOIN d3 USING (tenant_id, agent_id, day)""",
)
def support(t):
    out = dm.support_activity(support_tickets(t), support_events(t))
    return out.withColumns({c: F.round(c, 4) for c in ("full_resolution_s", "first_response_s")})


@case(
    "support_sla",
    """
WITH m AS (SELECT tenant_id, ticket_id, min(CASE WHEN event_type = 'status_change' AND new_value = 'solved' THEN e.at END) AS s, min(CASE WHEN event_type = 'comment' AND is_public = 1 THEN e.at END) AS r, max(e.at) AS l FROM <v_tke> e GROUP BY ALL),
  x AS (SELECT t.*, date_diff('second', opened_at, s) AS res, date_diff('second', opened_at, r) AS rep, date_diff('second', opened_at, l) AS age FROM <v_tk> t LEFT JOIN m USING (tenant_id, ticket_id))
SELECT tenant_id, priority, count(*) AS tickets, round(avg(res),3) AS mttr_s, round(count_if(rep < 8640000) / nullif(count(rep),0),6) AS reply_compliance, round(count_if(res < 17280000) / nullif(count(res),0),6) AS resolve_compliance, COALESCE(count_if(res IS NULL AND age > 17280000),0) AS overdue FROM x GROUP BY ALL""",
)
def sla(t):
    limits = t["orders"].select(F.col("o_orderpriority").alias("priority")).distinct().withColumns({"reply_within_s": F.lit(8640000), "resolve_within_s": F.lit(17280000)})
    return dm.support_sla(support_tickets(t), support_events(t), limits).withColumn("mttr_s", F.round("mttr_s", 3))


V["v_design"] = "SELECT 't' || (l_suppkey % 2) AS tenant_id, 'u' || l_suppkey AS person_id, l_shipdate::DATE AS day, l_partkey AS file_id, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS versions, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS comments FROM <lineitem>"
V["v_design_day"] = "SELECT tenant_id, person_id, day, count(DISTINCT CASE WHEN versions > 0 THEN file_id END) AS files_edited, sum(versions)::BIGINT AS versions_created, sum(comments)::BIGINT AS comments_posted, count(DISTINCT CASE WHEN versions > 0 OR comments > 0 THEN file_id END) AS files_with_activity FROM <v_design> GROUP BY ALL"


def design(t):
    flag = F.col("l_returnflag")
    rows = t["lineitem"].select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 2).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("person_id"), F.to_date("l_shipdate").alias("day"), F.col("l_partkey").alias("file_id"),
        F.when(flag == "R", F.col("l_linenumber")).otherwise(0).alias("versions"), F.when(flag == "A", 1).otherwise(0).alias("comments"),
    )
    return dm.design_activity(rows)


case("design_metrics", "SELECT * REPLACE (day::VARCHAR AS day) FROM <v_design_day>")(design)


@case(
    "design_code_overlap",
    """SELECT d.tenant_id, d.person_id, d.day::VARCHAR AS day, d.files_edited, COALESCE(sum(n), 0)::BIGINT AS commits_near FROM <v_design_day> d
LEFT JOIN (SELECT 't' || (o_custkey % 2) AS tenant_id, 'u' || o_custkey AS person_id, o_orderdate::DATE AS cd, count(*) AS n FROM <orders> GROUP BY ALL) c ON c.tenant_id = d.tenant_id AND c.person_id = d.person_id AND abs(date_diff('day', c.cd, d.day)) <= 3 GROUP BY d.tenant_id, d.person_id, d.day, d.files_edited""",
)
def design_near_code(t):
    commits = t["orders"].select(F.concat(F.lit("t"), (F.col("o_custkey") % 2).cast("string")).alias("tenant_id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("person_id"), F.col("o_orderdate").alias("date"))
    return dm.design_code_overlap(design(t), commits, 3).select("tenant_id", "person_id", "day", "files_edited", "commits_near")


V["v_results"] = "SELECT 't' AS tenant_id, l_orderkey AS launch_id, l_partkey AS test_id, l_shipdate AS at, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'passed' ELSE 'skipped' END AS status FROM <lineitem>"


def results(t):
    flag = F.col("l_returnflag")
    return t["lineitem"].select(F.lit("t").alias("tenant_id"), F.col("l_orderkey").alias("launch_id"), F.col("l_partkey").alias("test_id"), F.col("l_shipdate").alias("at"), F.when(flag == "R", "failed").when(flag == "A", "passed").otherwise("skipped").alias("status"))


case("quality_metrics", "SELECT tenant_id, r.at::DATE::VARCHAR AS day, count(*) AS results, round(count_if(status = 'passed') / count(*), 6) AS pass_rate FROM <v_results> r GROUP BY tenant_id, r.at::DATE")(lambda t: dm.pass_rate_trend(results(t)))
case("flaky_rate", "SELECT tenant_id, count(*) AS tests, sum(p * f)::BIGINT AS flaky, round(sum(p * f) / count(*), 6) AS flaky_rate FROM (SELECT tenant_id, test_id, max(CASE WHEN status = 'passed' THEN 1 ELSE 0 END) AS p, max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS f FROM <v_results> GROUP BY ALL) GROUP BY tenant_id")(
    lambda t: dm.flaky_rate(results(t))
)
V["v_defects"] = "SELECT 't' || (o_orderkey % 2) AS tenant_id, o_orderkey::VARCHAR AS task_id, o_orderdate + INTERVAL 20 DAY AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR * (500 + o_orderkey % 90) END AS resolved_at FROM <orders>"


def defects(t):
    k = F.col("o_orderkey")
    opened = F.col("o_orderdate").cast("timestamp")
    return t["orders"].select(
        F.concat(F.lit("t"), (k % 2).cast("string")).alias("tenant_id"), k.cast("string").alias("external_issue_id"), (opened + F.expr("INTERVAL 20 DAYS")).alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.timestamp_seconds(F.unix_timestamp(opened) + (500 + k % 90) * 3600)).alias("resolved_at"),
    )


case("defect_stats", "SELECT tenant_id, created_at::DATE::VARCHAR AS day, count_if(resolved_at IS NULL) AS open_defects, round(avg(date_diff('second', created_at, resolved_at)) / 3600.0, 6) AS mttr_h FROM <v_defects> GROUP BY tenant_id, created_at::DATE")(lambda t: dm.defect_stats(defects(t)))
case(
    "defects_per_sprint",
    "SELECT d.tenant_id, m.sprint_id, count(*) AS defects FROM <v_defects> d JOIN <b_memberships> m ON m.tenant_id = d.tenant_id AND m.task_id = d.task_id AND m.valid_from <= d.created_at AND (m.valid_to IS NULL OR d.created_at < m.valid_to) GROUP BY ALL",
)(lambda t: dm.defects_per_sprint(defects(t), t["b_memberships"]))
case("pass_rate_by_branch", "SELECT tenant_id, o_orderpriority AS branch, count(*) AS results, round(count_if(status = 'passed') / count(*), 6) AS pass_rate FROM <v_results> JOIN <orders> ON o_orderkey = launch_id GROUP BY ALL")(
    lambda t: dm.pass_rate_by_branch(t["orders"].select(F.lit("t").alias("tenant_id"), F.col("o_orderkey").alias("launch_id"), F.col("o_orderpriority").alias("branch")), results(t))
)

# --- patterns and trends ------------------------------------------------------------------------------------------------

V["v_scores"] = "SELECT 't0' AS tenant_id, c_custkey AS person_id, c_mktsegment AS team, floor(c_acctbal / 40)::DOUBLE AS loc_added, (c_custkey % 53)::DOUBLE AS meetings FROM <customer>"


@case(
    "percentile_patterns",
    """
SELECT tenant_id, person_id, team, round(a * 100, 4) AS loc_added_percentile, round(b * 100, 4) AS meetings_percentile FROM (SELECT *, percent_rank() OVER (PARTITION BY tenant_id, team ORDER BY loc_added) AS a, percent_rank() OVER (PARTITION BY tenant_id, team ORDER BY meetings) AS b
  FROM <v_scores> WHERE team IN ('BUILDING','MACHINERY')) WHERE a * 100 <= 40 AND b * 100 >= 60""",
)
def patterns(t):
    rows = t["customer"].select(F.lit("t0").alias("tenant_id"), F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("team"), F.floor(F.col("c_acctbal") / 40).cast("double").alias("loc_added"), (F.col("c_custkey") % 53).cast("double").alias("meetings"))
    return dm.percentile_patterns(rows, "team", [("loc_added", "<=", 40), ("meetings", ">=", 60)], ["BUILDING", "MACHINERY"])


V["v_daily"] = "SELECT tenant_id, lower(mail) AS person_id, day, count(*)::DOUBLE AS n FROM <b_ev> GROUP BY ALL"


def daily(t):
    return t["b_ev"].groupBy("tenant_id", F.lower("mail").alias("person_id"), "day").agg(F.count(F.lit(1)).cast("double").alias("n"))


@case(
    "activity_drop",
    """SELECT tenant_id, person_id, day::VARCHAR AS day, n, round(baseline, 6) AS baseline FROM (SELECT *, sum(n) OVER (PARTITION BY tenant_id, person_id ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) / 14.0 AS baseline FROM <v_daily>) WHERE n < baseline * 0.7""",
)
def drops(t):
    return dm.activity_drop(daily(t), "n", 14, 0.7)


@case(
    "moving_average_trend",
    """SELECT tenant_id, project_key, repo_slug, period::VARCHAR AS period, total, round(avg(total) OVER (PARTITION BY tenant_id, project_key, repo_slug ORDER BY period NULLS FIRST ROWS 2 PRECEDING), 6) AS moving_avg FROM (
  SELECT tenant_id, project_key, repo_slug, date_trunc('quarter', date)::DATE AS period, sum(lines_added)::BIGINT AS total FROM <v_commit_fact> GROUP BY ALL)""",
)
def trend(t):
    """Commits without a date are a period of their own before all others."""
    return dm.moving_average_trend(commit_fact(t), ["tenant_id", "project_key", "repo_slug"], "date", "lines_added", "quarter", 3)


@case(
    "derived_metric",
    """SELECT tenant_id, person_id, metric_date, round(sum(metric_value * CASE metric_key WHEN 'm365_emails_sent' THEN 1.0 WHEN 'm365_teams_messages' THEN 0.5 ELSE 2.0 END), 6) AS communication_load FROM <v_collab_rows> WHERE metric_key IN ('m365_emails_sent','m365_teams_messages','zoom_calls') GROUP BY ALL""",
)
def load(t):
    return dm.derived_metric(collab_rows(t), ["tenant_id", "person_id", "metric_date"], {"m365_emails_sent": 1.0, "m365_teams_messages": 0.5, "zoom_calls": 2.0}, "communication_load")
