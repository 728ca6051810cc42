"""Staging of chat, mail, meetings, HR, CRM and AI tools, and their Silver classes."""

from pyspark.sql import functions as F

from harness.cases import VIEWS, Tables, case
from orgpulse.functions import scalars as fx
from orgpulse.operators import silver
from orgpulse.operators import staging_ai as sa
from orgpulse.operators import staging_collab as sc
from orgpulse.operators import staging_crm as sm
from orgpulse.operators import staging_people as sp
from orgpulse.plans.registry import Registry, union_by_tag
from orgpulse.sources import derive, landing

V = VIEWS

# --- reports of the office suite ----------------------------------------------------------------


# Events with the names that reports and calls know their users by.
V["v_named_events"] = """
SELECT event_id, 't' || (user_id % 2) AS tenant_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, ts::TIMESTAMP AS seen_at, ts::DATE AS day,
  CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 97 = 0 THEN '(Unknown)' WHEN event_id % 101 > 0 THEN 'User' || user_id || '@Example.com' END AS office_name,
  CASE WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 > 0 THEN 'User' || user_id || '@Example.com' END AS call_name FROM <events>"""


def _office(measures: dict[str, str], product: str = "") -> str:
    """What a staged report must hold, said of the events it is made of: counts are remainders of k, gaps follow from event_id."""
    columns = ", ".join(f"{value} AS {name}" for name, value in measures.items())
    key = f"tenant_id || '-m365-' || office_name || '-' || day{f" || '-{product}'" if product else ''}"
    return f"""SELECT {columns}, md5({key}) AS unique_key, tenant_id, 'm365' AS source_id, 'm365' AS data_source, '7' AS report_period, day AS date, seen_at AS collected_at, epoch_us(seen_at) // 1000 AS _version,
  office_name AS email, office_name AS user_id, office_name AS user_name, lower(office_name) AS person_key FROM <v_named_events> WHERE length(office_name) > 0"""


def _left(n: int, gap: int = 0) -> str:
    """k modulo n as a number, missing in every gap-th event."""
    return f"CASE WHEN event_id % {gap} > 0 THEN (k % {n})::DOUBLE END" if gap else f"(k % {n})::DOUBLE"


V["v_m365_chat"] = _office({
    "urgent_messages": _left(2), "direct_messages": _left(5), "group_chat_messages": _left(7, 11), "channel_replies": _left(8), "channel_posts": _left(9),
    "total_chat_messages": "(k % 5 + CASE WHEN event_id % 11 > 0 THEN k % 7 ELSE 0 END)::DOUBLE",
})
V["v_m365_email"] = _office({"sent_count": _left(10, 17), "received_count": _left(12), "read_count": _left(11), "meetings_created": _left(2), "meetings_interacted": _left(3)})
V["v_m365_meetings"] = _office({
    "audio_duration_seconds": "CASE WHEN event_id % 13 > 0 THEN (k % 3) * 3600 + (k % 60) * 60 + event_id % 60 ELSE 0 END",
    "video_duration_seconds": "(k % 60) * 60", "screen_share_duration_seconds": "CASE WHEN k % 2 = 0 THEN 45 ELSE 26 * 3600 END::BIGINT",
    "calls_count": _left(4), "adhoc_meetings_organized": _left(2), "adhoc_meetings_attended": _left(3), "meetings_organized": _left(2), "meetings_attended": _left(3, 7),
    "scheduled_meetings_organized": "(k % 2 + k % 3)::DOUBLE", "scheduled_meetings_attended": "(k % 5 + CASE WHEN event_id % 5 > 0 THEN k % 4 ELSE 0 END)::DOUBLE",
})
V["v_m365_docs"] = (
    _office({"product": "'onedrive'", "visited_page_count": "NULL::DOUBLE", "viewed_or_edited_count": _left(6), "synced_count": _left(3), "shared_internally_count": "nullif(k % 4, 0)::DOUBLE", "shared_externally_count": _left(2)}, "onedrive")
    + " UNION ALL BY NAME "
    + _office({"product": "'sharepoint'", "visited_page_count": _left(13), "viewed_or_edited_count": _left(5), "synced_count": _left(2), "shared_internally_count": _left(3), "shared_externally_count": "CASE WHEN k % 5 > 0 THEN (k % 2)::DOUBLE END"}, "sharepoint")
)
V["v_m365_comms"] = """SELECT tenant_id, source_id, unique_key, userPrincipalName AS user_email, NULL::VARCHAR AS user_name, sendCount AS emails_sent, reportRefreshDate AS activity_date,
  NULL::VARCHAR AS event_type, NULL::BIGINT AS duration_seconds, 'm365' AS source FROM <b_email>"""
_WHEN = "SELECT * REPLACE (date::VARCHAR AS date, collected_at::VARCHAR AS collected_at) FROM "

case("stg_m365_chat", _WHEN + "<v_m365_chat>")(lambda t: sc.m365_chat(t["b_teams"]))
case("stg_m365_email", _WHEN + "<v_m365_email>")(lambda t: sc.m365_email(t["b_email"]))
case("stg_m365_meetings", _WHEN + "<v_m365_meetings>")(lambda t: sc.m365_meetings(t["b_teams"]))
case("stg_m365_documents", _WHEN + "<v_m365_docs>")(lambda t: sc.m365_documents(t["b_onedrive"], t["b_sharepoint"]))
case("stg_m365_comms_events", "SELECT * FROM <v_m365_comms>")(lambda t: sc.m365_comms_events(t["b_email"]))

# --- chat ---------------------------------------------------------------------------------------------

# Writer n of a turn is conv_id * 3 + turn; n is a known user if it is a customer. Conversations deal their kinds by conv_id modulo 5.
V["v_slack_chat"] = """
WITH said AS (SELECT conv_id * 3 + turn AS n, conv_id % 5 AS kind, DATE '2024-01-01' + ((conv_id * 60 + turn) // 1440)::INT AS date FROM <conversations> WHERE role <> 'system' AND conv_id % 31 <> 7),
  days AS (SELECT n, date, count(*) AS total, count_if(kind IN (2, 3)) AS direct, count_if(kind < 2) AS grouped FROM said GROUP BY n, date),
  known AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 8 > 0 THEN 'Nick' || c_custkey WHEN c_custkey % 16 > 0 THEN c_name END AS shown, CASE WHEN c_custkey % 4 > 0 THEN 'User' || c_custkey || '@Example.com' ELSE '' END AS email FROM <customer>)
SELECT 't0' AS tenant_id, 'slack' AS source_id, 'slack' AS data_source, 'U' || n AS user_id, md5('t0-slack-U' || n || '-' || date) AS unique_key, COALESCE(shown, '') AS user_name, COALESCE(email, '') AS email,
  lower(COALESCE(nullif(email, ''), shown, 'U' || n)) AS person_key, date, total AS total_chat_messages, direct AS direct_messages, grouped AS group_chat_messages,
  NULL::BIGINT AS channel_posts, NULL::BIGINT AS channel_replies, NULL::BIGINT AS urgent_messages, NULL::VARCHAR AS report_period
FROM days LEFT JOIN known USING (n)"""
# Every message but the system's is one event: a minute after the one before, an hour after the conversation before.
V["v_slack_comms"] = """
SELECT 't0' AS tenant_id, 'slack' AS source_id, 'slack' AS source, 'message' AS event_type, NULL::VARCHAR AS subtype, concat('sl', conv_id, '-', turn) AS unique_key, 'C' || conv_id AS channel_id,
  CASE conv_id % 5 WHEN 2 THEN 'im' WHEN 3 THEN 'mpim' ELSE if(conv_id % 2 = 0, 'private_channel', 'public_channel') END AS channel_type, if(conv_id % 31 = 7, '', 'U' || (conv_id * 3 + turn)) AS slack_user_id,
  make_timestamp(1704067200000100 + 60000000 * (60 * conv_id + turn)) AS activity_date, least(turn, 1)::INT AS is_thread_reply, turn * (1 - turn % 2) AS reply_count
FROM <conversations> WHERE role IS DISTINCT FROM 'system'"""
case("stg_slack_chat", "SELECT * REPLACE (date::VARCHAR AS date) FROM <v_slack_chat>")(lambda t: sc.slack_chat(t["b_messages"], t["b_channels"], t["b_slack_users"]))
case("stg_slack_comms_events", "SELECT * REPLACE (activity_date::VARCHAR AS activity_date) FROM <v_slack_comms>")(
    lambda t: sc.slack_comms_events(t["b_messages"], t["b_channels"])
)
case("channel_type", "SELECT channel_id, channel_type FROM <b_channels>")(
    lambda t: derive.channel_type(t["b_channels"].drop("channel_type")).select("channel_id", "channel_type")
)
case("profile_fallback", "SELECT slack_user_id, CASE WHEN profile_real_name <> '' THEN profile_real_name ELSE real_name END AS real_name FROM <b_slack_users>")(
    lambda t: derive.profile_fallback(t["b_slack_users"]).select("slack_user_id", "real_name")
)

# --- meetings ---------------------------------------------------------------------------------------------

# Every event is somebody in a call for k minutes; each 29th never leaves, some have no address, and each 19th is in a call that isn't listed.
V["v_in_call"] = """
SELECT event_id, ts, 't' || (user_id % 2) AS tenant_id, 'User ' || user_id AS shown, if(event_id % 31 = 0 OR event_id % 37 = 0, '', 'User' || user_id || '@Example.com') AS mail, COALESCE(if(event_id % 29 > 0, regexp_extract(props, '[0-9]+')::BIGINT * 60, 0), 0) AS stayed,
  if(event_id % 19 > 0, event_id // 3, NULL) AS call FROM <events>"""
V["v_zoom_meetings"] = """
WITH listed AS (SELECT *, call IN (SELECT o_orderkey FROM <orders>) AS known, ts::DATE AS day FROM <v_in_call> WHERE mail <> ''),
  days AS (SELECT tenant_id, mail, shown, day, count(*) AS calls, sum(stayed) AS heard, sum(if(known AND call % 2 = 0, stayed, 0)) AS seen, sum(if(known AND call % 3 = 0, stayed, 0)) AS shared FROM listed GROUP BY ALL)
SELECT 'zoom' AS data_source, 'zoom' AS source_id, tenant_id, mail AS email, mail AS user_id, lower(mail) AS person_key, shown AS user_name, day AS date, md5(concat(tenant_id, '-zoom-', lower(mail), '-', day)) AS unique_key,
  heard::BIGINT AS audio_duration_seconds, seen::BIGINT AS video_duration_seconds, shared::BIGINT AS screen_share_duration_seconds, calls::DOUBLE AS meetings_attended, NULL::VARCHAR AS report_period,
  NULL::DOUBLE AS calls_count, NULL::DOUBLE AS meetings_organized, NULL::DOUBLE AS adhoc_meetings_organized, NULL::DOUBLE AS adhoc_meetings_attended, NULL::DOUBLE AS scheduled_meetings_organized, NULL::DOUBLE AS scheduled_meetings_attended
FROM days"""
# Two events in a row share a key, of which the later one counts.
V["v_zoom_comms"] = """
SELECT 'zoom' AS source, 'zoom' AS source_id, 'meeting_participation' AS event_type, 'zp' || (event_id // 2) AS unique_key, arg_max(tenant_id, ts) AS tenant_id, arg_max(mail, ts) AS user_email, arg_max(shown, ts) AS user_name,
  NULL::DOUBLE AS emails_sent, arg_max(stayed, ts) AS duration_seconds, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS activity_date
FROM <v_in_call> GROUP BY event_id // 2"""
case("stg_zoom_meetings", "SELECT * REPLACE (date::VARCHAR AS date) FROM <v_zoom_meetings>")(lambda t: sc.zoom_meetings(t["b_participants"], t["b_meetings"]))
case("stg_zoom_comms_events", "SELECT * FROM <v_zoom_comms>")(lambda t: sc.zoom_comms_events(t["b_participants"]))

# --- HR ---------------------------------------------------------------------------------------------------------

# Each order asks for up to eight days of leave from its date on, unless its person, start or end is unreadable.
V["v_leave"] = """
SELECT 'bamboohr' AS source, 'hr' AS source_id, 't' || (o_custkey % 2) AS tenant_id, 'lv:' || o_orderkey AS unique_key, o_custkey::VARCHAR AS source_person_id, if(c_custkey % 97 = 13, '', 'User' || c_custkey || '@Example.com') AS email, 'leave' AS event_type,
  o_orderpriority AS event_subtype, o_orderstatus AS request_status, 'days' AS duration_unit, if(o_orderkey % 29 > 0, o_orderkey % 9, NULL)::DOUBLE AS duration_amount, asked AS created_at, asked AS start_date, asked + to_days((o_orderkey % 9)::INT) AS end_date, TIMESTAMP '2024-02-01' AS ingested_at
FROM (SELECT *, date_trunc('day', o_orderdate)::TIMESTAMP AS asked FROM <orders> WHERE o_orderkey % 41 > 0 AND o_orderkey % 19 > 0 AND o_orderkey % 23 > 0) LEFT JOIN <customer> ON c_custkey = o_custkey"""
# Whoever owes nothing is at work, 8 hours a day; each fifth goes by the address, since the later export names none.
V["v_hours"] = """
WITH staff AS (SELECT *, if(c_custkey % 97 = 13, '', 'User' || c_custkey || '@Example.com') AS mail FROM <customer> WHERE NOT COALESCE(c_acctbal < 0, false))
SELECT 'bamboohr' AS source, 'hr' AS source_id, 't' || (c_custkey % 2) AS tenant_id, 'hr:' || c_custkey AS unique_key, c_custkey::VARCHAR AS source_person_id, mail AS email, if(c_custkey % 5 > 0, c_name, mail) AS display_name, 'Full-Time' AS employment_type,
  8::DOUBLE AS working_hours_per_day, 40::DOUBLE AS working_hours_per_week, TIMESTAMP '2024-02-02' AS ingested_at FROM staff"""
# What people must be is said of customer itself: two exports, a day apart, the later one with gaps.
V["v_class_people"] = """
WITH export AS (SELECT unnest([0, 1]) AS again), seen AS (SELECT *, c_custkey % 6 AS grade, 'User' || c_custkey || '@Example.com' AS mail FROM <customer> CROSS JOIN export)
SELECT 'bamboohr' AS source, 'hr' AS source_id, 't' || (c_custkey % 2) AS tenant_id, 't' || (c_custkey % 2) AS workspace_id, 'hr:' || c_custkey AS unique_key, c_custkey::VARCHAR AS source_person_id, 'E' || c_custkey AS employee_number,
  strftime(DATE '2024-02-01' + again, '%Y-%m-%d %H:%M:%S') AS ingested_at, strftime(DATE '2024-01-01' + again, '%Y-%m-%dT%H:%M:%SZ') AS valid_from, NULL::VARCHAR AS valid_to, NULL::VARCHAR AS person_id, NULL::VARCHAR AS org_unit_id, NULL::DOUBLE AS fte,
  if(again = 1 AND c_custkey % 5 = 0, NULL, c_name) AS display_name, 'First' || (c_custkey % 50) AS first_name, 'Last' || (c_custkey % 333) AS last_name, if(c_custkey % 97 = 13, '', mail) AS email,
  if(again = 1 AND c_custkey % 7 = 0, NULL, if(grade = 3, 'Trainee', ['Senior ', 'junior ', 'VP of ', '', '', ''][grade + 1] || c_mktsegment)) AS job_title,
  if(again = 1 AND c_custkey % 11 = 0, 'NATION_0', n_name) AS department_name, n_name AS country, 'Site ' || c_nationkey AS location, 'division=' || r_name AS custom_str_attrs, '' AS custom_num_attrs,
  if(c_custkey > 0, (c_custkey // 8)::VARCHAR, NULL) AS manager_person_id, 'full_time' AS employment_type, if(c_acctbal < 0 AND c_custkey % 2 = 0, 'terminated', 'active') AS status,
  strftime(DATE '2015-01-01' + (c_custkey % 1000)::INT, '%Y-%m-%d 00:00:00') AS hire_date, if(c_acctbal < 0, '2023-06-30 00:00:00', NULL) AS termination_date
FROM seen JOIN <nation> ON n_nationkey = c_nationkey JOIN <region> ON r_regionkey = n_regionkey"""
_LEAVE = "SELECT * REPLACE (start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, created_at::VARCHAR AS created_at, ingested_at::VARCHAR AS ingested_at) FROM <v_leave>"
_HOURS = "SELECT * REPLACE (ingested_at::VARCHAR AS ingested_at) FROM <v_hours>"


def leave_events(t: Tables):
    return sp.hr_leave_events(t["b_leave"], t["b_employees_now"])


def working_hours(t: Tables):
    return sp.hr_working_hours(t["b_employees_now"])


case("stg_hr_leave_events", _LEAVE)(leave_events)
case("stg_hr_working_hours", _HOURS)(working_hours)
case("stg_hr_people", "SELECT * FROM <v_class_people>")(lambda t: sp.hr_people(t["b_employees"]))

# --- CRM ---------------------------------------------------------------------------------------------------------

# Accounts and contacts are customers, users are suppliers, deals are orders; all but deals were written on the same days.
_SAME_DAYS = "'2024-01-01 00:00:00' AS created_at, '2024-01-05 00:00:00' AS updated_at, 'sf' AS data_source, 1704524889000 AS _version"
V["v_crm_accounts"] = f"""
SELECT 't' || (c_custkey % 2) AS tenant_id, '001' || c_custkey AS account_id, c_name AS name, c_mktsegment AS industry, concat('w', c_custkey, '.example') AS domain, 'O' || (c_custkey % 40) AS owner_id,
  if(c_custkey % 4 = 0, '001' || (c_custkey // 4), NULL) AS parent_account_id, {_SAME_DAYS},
  format('{{{{"Type":"{{}}","BillingCity":"City","BillingState":"","BillingCountry":"C{{}}","NumberOfEmployees":"{{}}","AnnualRevenue":"{{}}","IsDeleted":"{{}}"}}}}',
    if(c_custkey % 3 > 0, 'Customer', ''), c_nationkey, c_custkey, floor(c_acctbal)::BIGINT, c_custkey % 11 = 0 AND c_custkey % 7 > 0) AS metadata
FROM <customer>"""
V["v_crm_contacts"] = f"""
SELECT 't' || (c_custkey % 2) AS tenant_id, '003' || c_custkey AS contact_id, '001' || c_custkey AS account_id, 'O1' AS owner_id, 'F' AS first_name, c_name AS last_name, concat('u', c_custkey, '@x.example') AS email,
  NULL::VARCHAR AS lifecycle_stage, '' AS custom_num_attrs, '' AS custom_str_attrs, {_SAME_DAYS},
  format('{{{{"Title":"{{}}","Phone":"","LeadSource":"{{}}","IsDeleted":"{{}}"}}}}', if(c_custkey % 2 = 0, 'Boss', ''), c_mktsegment, c_custkey % 11 = 0) AS metadata
FROM <customer>"""
V["v_crm_deals"] = """
SELECT 't' || (o_custkey % 2) AS tenant_id, '006' || o_orderkey AS deal_id, '001' || o_custkey AS account_id, 'O' || (o_custkey % 40) AS owner_id, 'Deal ' || o_orderkey AS name, o_orderpriority AS stage, o_orderpriority AS pipeline,
  if(o_orderkey % 10 > 0, o_totalprice, NULL) AS amount, (o_orderkey % 100)::DOUBLE AS probability, if(o_orderkey % 14 > 0, (o_orderdate::DATE + (o_orderkey % 60)::INT)::VARCHAR, NULL) AS close_date,
  (o_orderkey % 12 > 0 AND o_orderstatus <> 'O')::INT AS is_closed, (o_orderstatus = 'F')::INT AS is_won, 'web' AS lead_source, '{"Type":"","CurrencyIsoCode":"EUR","IsDeleted":"false"}' AS metadata, '' AS custom_num_attrs, '' AS custom_str_attrs,
  o_orderdate::TIMESTAMP::VARCHAR AS created_at, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS updated_at, 'sf' AS data_source, epoch_ms(o_orderdate::TIMESTAMP) AS _version
FROM <orders>"""
V["v_crm_users"] = """
SELECT 't' || (s_suppkey % 2) AS tenant_id, 'O' || s_suppkey AS user_id, 'S' AS first_name, s_name AS last_name, concat('s', s_suppkey, '@x.example') AS email, 'Rep' AS title, 'Sales' AS department, (s_suppkey % 6 > 0 AND s_acctbal > 0)::INT AS is_active,
  format('{{"Username":"{}","ProfileId":"pr","UserRoleId":"","IsDeleted":"false"}}', s_name) AS metadata, '2024-02-01 00:00:00' AS collected_at, 'sf' AS data_source, 1704524889000 AS _version
FROM <supplier>"""
# Each order gives one task and one calendar entry.
V["v_crm_activities"] = """
WITH made AS (SELECT 't' || (o_custkey % 2) AS tenant_id, 'O' || (o_custkey % 40) AS owner_id, '003' || o_custkey AS contact_id, 'sf' AS data_source, o_orderdate::TIMESTAMP AS made_at, * FROM <orders>),
tasks AS (SELECT *, 'T' || o_orderkey AS activity_id, if(o_orderstatus = 'F', 'call', if(o_orderkey % 2 = 0, 'email', 'task')) AS activity_type, o_orderstatus AS outcome,
    if(o_orderkey % 10 IN (2, 4, 6, 8), '006' || o_orderkey, NULL) AS deal_id, if(o_orderkey % 10 IN (1, 3, 7, 9), '001' || o_custkey, NULL) AS account_id, if(o_orderkey % 8 = 0, made_at, date_trunc('day', made_at)) AS timestamp,
    if(o_orderstatus = 'F', o_orderkey % 900, NULL) AS duration_seconds,
    format('{{"Subject":"Subject {}","Priority":"{}","TaskSubtype":"{}","CallType":"{}","IsDeleted":"false"}}', o_orderkey % 20, o_orderpriority, if(o_orderkey % 2 = 0, 'Email', 'Task'), if(o_orderstatus = 'F', 'Outbound', '')) AS metadata FROM made),
entries AS (SELECT *, 'E' || o_orderkey AS activity_id, if(o_orderkey % 3 = 2, 'meeting', 'event') AS activity_type, NULL::VARCHAR AS outcome, NULL::VARCHAR AS deal_id, NULL::VARCHAR AS account_id, made_at AS timestamp, o_orderkey % 90 * 60 AS duration_seconds,
    format('{{"Subject":"Meet","Location":"","EndDateTime":"later","EventSubtype":"{}","IsDeleted":"false"}}', ['', 'Event', 'Demo'][o_orderkey % 3 + 1]) AS metadata FROM made)
SELECT tenant_id, activity_id, activity_type, owner_id, contact_id, deal_id, account_id, timestamp, duration_seconds, outcome, metadata, made_at::VARCHAR AS created_at, data_source, epoch_ms(made_at) AS _version
FROM (SELECT * FROM tasks UNION ALL BY NAME SELECT * FROM entries)"""


def deals(t: Tables):
    return sm.crm_deals(t["b_opportunities"])


def activities(t: Tables):
    return sm.crm_activities(t["b_crm_tasks"], t["b_crm_events"])


_ACT = "SELECT * REPLACE (timestamp::VARCHAR AS timestamp) FROM <v_crm_activities>"
_CRM = {
    "accounts": ("SELECT * FROM <v_crm_accounts>", lambda t: sm.crm_accounts(t["b_accounts"])),
    "contacts": ("SELECT * FROM <v_crm_contacts>", lambda t: sm.crm_contacts(t["b_contacts"])),
    "deals": ("SELECT * REPLACE (round(amount, 6) AS amount) FROM <v_crm_deals>", deals),
    "users": ("SELECT * FROM <v_crm_users>", lambda t: sm.crm_users(t["b_crm_users"])),
    "activities": (_ACT, activities),
}
for _n, (_sql, _build) in _CRM.items():
    case(f"stg_crm_{_n}", _sql)(_build)

# --- AI tools --------------------------------------------------------------------------------------------------------


def _cursor(binding: str, op: str) -> str:
    def num(k):
        return f"COALESCE(TRY_CAST(tokenUsage::JSON->>'{k}' AS DOUBLE), 0)"

    return f"""SELECT tenant_id, source_id, unique_key, userEmail AS user_email, c.timestamp AS event_timestamp, kind AS event_kind, model, requestsCosts AS request_cost, cursorTokenFee AS platform_fee,
  isTokenBasedCall::INT AS is_token_based, isFreeBugbot::INT AS is_free_bugbot, maxMode::INT AS max_mode, {num('inputTokens')} AS input_tokens, {num('outputTokens')} AS output_tokens, {num('cacheReadTokens')} AS cache_read_tokens,
  {num('cacheWriteTokens')} AS cache_write_tokens, {num('totalCents')} AS total_cents, 'cursor' AS source FROM <{binding}> c WHERE epoch_ms(c.timestamp::BIGINT)::DATE {op} DATE '2024-01-20'"""


V["v_cursor_usage"] = _cursor("b_cursor_resync", "<") + " UNION ALL " + _cursor("b_cursor_realtime", "=")
V["v_code_usage"] = """SELECT tenant_id, source_id, concat_ws('|', c.date, actor_identifier, terminal_type) AS unique_key, c.date AS report_date, actor_identifier AS email, terminal_type, session_count, lines_added, lines_removed,
  tool_use_accepted, tool_use_rejected, NULL::VARCHAR AS person_id, 'anthropic' AS provider, 'code' AS client FROM <b_ai_code> c WHERE actor_type = 'user'"""
V["v_api_usage"] = """
SELECT u.tenant_id, source_id, concat_ws('|', u.date, u.model, COALESCE(u.api_key_id,''), u.workspace_id, service_tier, context_window) AS unique_key, u.date AS report_date, model, api_key_id, key_name, workspace_id, workspace_name, service_tier, context_window,
  uncached_input_tokens, cache_read_tokens, cache_creation_5m_tokens, cache_creation_1h_tokens, cache_creation_5m_tokens + cache_creation_1h_tokens AS cache_creation_tokens, output_tokens,
  uncached_input_tokens + cache_read_tokens + cache_creation_5m_tokens + cache_creation_1h_tokens AS total_input_tokens,
  uncached_input_tokens + cache_read_tokens + cache_creation_5m_tokens + cache_creation_1h_tokens + output_tokens AS total_tokens, web_search_requests, NULL::VARCHAR AS person_id, 'anthropic' AS provider
FROM <b_ai_usage> u LEFT JOIN (SELECT DISTINCT tenant_id, id AS api_key_id, name AS key_name FROM <b_ai_keys>) k USING (tenant_id, api_key_id)
LEFT JOIN (SELECT DISTINCT tenant_id, id AS workspace_id, display_name AS workspace_name FROM <b_ai_workspaces>) w USING (tenant_id, workspace_id)"""


def cursor_usage(t: Tables):
    return sa.cursor_dev_usage(t["b_cursor_resync"], t["b_cursor_realtime"], "2024-01-20")


def code_usage(t: Tables):
    return sa.code_dev_usage(t["b_ai_code"], "code", "anthropic")


def api_usage(t: Tables):
    return sa.api_usage(t["b_ai_usage"], t["b_ai_keys"], t["b_ai_workspaces"], "anthropic")


case("stg_ai_dev_usage_cursor", "SELECT * FROM <v_cursor_usage>")(cursor_usage)
case("stg_ai_dev_usage_code", "SELECT * FROM <v_code_usage>")(code_usage)
case("stg_ai_api_usage", "SELECT * FROM <v_api_usage>")(api_usage)


@case(
    "tool_action_totals",
    """
SELECT event_id, (k % 5) + (k % 3) + (k % 2) AS tool_use_accepted, (k % 4) AS tool_use_rejected,
  CASE WHEN k % 3 = 0 THEN 'key' || user_id ELSE mail END AS actor_identifier FROM <b_ev>""",
)
def tool_actions(t):
    k = F.col("k")

    def tool(accepted, rejected):
        return F.struct(accepted.cast("bigint").alias("accepted"), rejected.cast("bigint").alias("rejected"))

    none = F.lit(None)
    rows = t["b_ev"].select(
        "event_id",
        F.struct(
            tool(k % 5, none).alias("edit_tool"),
            tool(k % 3, k % 4).alias("write_tool"),
            tool(none, none).alias("multi_edit_tool"),
            tool(k % 2, none).alias("notebook_edit_tool"),
        ).alias("tool_actions"),
        F.struct(F.when(k % 3 == 0, F.concat(F.lit("key"), F.col("user_id").cast("string"))).alias("api_key_name"), F.col("mail").alias("email")).alias("actor"),
    )
    return derive.tool_action_totals(rows).select("event_id", "tool_use_accepted", "tool_use_rejected", "actor_identifier")


# --- Silver classes ------------------------------------------------------------------------------------------------------


def work_class(t: Tables, tag: str):
    registry = Registry()
    for name, tags, build in [
        ("m365_chat", {"class_collab_chat_activity"}, lambda: sc.m365_chat(t["b_teams"])),
        ("slack_chat", {"class_collab_chat_activity"}, lambda: sc.slack_chat(t["b_messages"], t["b_channels"], t["b_slack_users"])),
        ("m365_meetings", {"class_collab_meeting_activity"}, lambda: sc.m365_meetings(t["b_teams"])),
        ("zoom_meetings", {"class_collab_meeting_activity"}, lambda: sc.zoom_meetings(t["b_participants"], t["b_meetings"])),
        ("m365_email", {"class_collab_email_activity"}, lambda: sc.m365_email(t["b_email"])),
        ("m365_documents", {"class_collab_document_activity"}, lambda: sc.m365_documents(t["b_onedrive"], t["b_sharepoint"])),
        ("m365_comms", {"class_comms_events"}, lambda: sc.m365_comms_events(t["b_email"])),
        ("zoom_comms", {"class_comms_events"}, lambda: sc.zoom_comms_events(t["b_participants"])),
        ("slack_comms", {"class_comms_events"}, lambda: silver.map_slack_comms(sc.slack_comms_events(t["b_messages"], t["b_channels"]))),
        ("hr_events", {"class_hr_events"}, lambda: leave_events(t)),
        ("hr_hours", {"class_hr_working_hours"}, lambda: working_hours(t)),
        ("hr_people", {"class_people"}, lambda: sp.hr_people(t["b_employees"])),
        ("cursor_usage", {"class_ai_dev_usage"}, lambda: cursor_usage(t)),
        ("code_usage", {"class_ai_dev_usage"}, lambda: code_usage(t)),
        *[(f"crm_{n}", {f"class_crm_{n}"}, lambda build=build: build(t)) for n, (_, build) in _CRM.items()],
    ]:
        registry.add(name, tags, build)
    return union_by_tag(registry, tag)


V["v_class_comms"] = """SELECT * FROM <v_m365_comms> UNION ALL BY NAME SELECT * FROM <v_zoom_comms> UNION ALL BY NAME
SELECT tenant_id, source_id, unique_key, NULL::VARCHAR AS user_email, slack_user_id AS user_name, NULL::DOUBLE AS emails_sent, activity_date::VARCHAR AS activity_date, event_type, NULL::BIGINT AS duration_seconds, source,
  channel_id, channel_type, is_thread_reply, reply_count FROM <v_slack_comms>"""
_CLASS_SQL = {
    "class_collab_chat_activity": "SELECT * REPLACE (date::VARCHAR AS date, collected_at::VARCHAR AS collected_at) FROM (SELECT * FROM <v_m365_chat> UNION ALL BY NAME SELECT * FROM <v_slack_chat>)",
    "class_collab_meeting_activity": "SELECT * REPLACE (date::VARCHAR AS date, collected_at::VARCHAR AS collected_at) FROM (SELECT * FROM <v_m365_meetings> UNION ALL BY NAME SELECT * FROM <v_zoom_meetings>)",
    "class_collab_email_activity": _WHEN + "<v_m365_email>",
    "class_collab_document_activity": _WHEN + "<v_m365_docs>",
    "class_comms_events": "SELECT * FROM <v_class_comms>",
    "class_hr_events": _LEAVE,
    "class_hr_working_hours": _HOURS,
    "class_people": "SELECT * FROM <v_class_people>",
    "class_ai_dev_usage": "SELECT * FROM <v_cursor_usage> UNION ALL BY NAME SELECT * FROM <v_code_usage>",
    **{f"class_crm_{n}": sql for n, (sql, _) in _CRM.items()},
}
for _tag, _sql in _CLASS_SQL.items():
    case(_tag, _sql)(lambda t, tag=_tag: work_class(t, tag))


@case(
    "class_focus_metrics",
    """
SELECT tenant_id, email, day::VARCHAR AS day, tenant_id || '-' || email || '-' || day::VARCHAR AS unique_key, meetings_count, round(s / 3600.0, 4) AS meeting_hours, h AS working_hours_per_day,
  round(least(100.0, greatest(0.0, 100.0 - (s / 3600.0 / nullif(h, 0)) * 100.0)), 2) AS focus_time_pct, round(greatest(0.0, h - s / 3600.0), 4) AS dev_time_h
FROM (SELECT ce.tenant_id, lower(user_email) AS email, TRY_CAST(activity_date AS TIMESTAMP)::DATE AS day, COALESCE(count_if(ce.event_type = 'meeting_participation'), 0) AS meetings_count,
    COALESCE(sum(CASE WHEN ce.event_type = 'meeting_participation' THEN duration_seconds END), 0) AS s, COALESCE(wh.working_hours_per_day, 8.0)::DOUBLE AS h
  FROM <v_class_comms> ce LEFT JOIN <v_hours> wh ON lower(ce.user_email) = lower(wh.email) AND ce.tenant_id = wh.tenant_id
  WHERE user_email <> '' AND TRY_CAST(activity_date AS TIMESTAMP) IS NOT NULL GROUP BY ce.tenant_id, lower(user_email), TRY_CAST(activity_date AS TIMESTAMP)::DATE, wh.working_hours_per_day)""",
)
def focus(t):
    return silver.focus_metrics(work_class(t, "class_comms_events"), working_hours(t))


# --- landing rules ----------------------------------------------------------------------------------------------------------------


@case(
    "add_envelope",
    "SELECT event_id, 't9' AS tenant_id, 's9' AS source_id, 'demo' AS data_source, '2024-03-01 00:00:00' AS collected_at FROM <events>",
)
def envelope(t):
    from datetime import datetime

    return landing.add_envelope(t["events"].select("event_id"), "t9", "s9", "demo", datetime(2024, 3, 1))


@case(
    "make_unique_key",
    "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END) AS unique_key, md5(concat_ws('-', l_orderkey::VARCHAR, l_partkey::VARCHAR)) AS digest FROM <lineitem>",
)
def unique_keys(t):
    rows = t["lineitem"].withColumn("flag", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    keyed = landing.make_unique_key(rows, ["l_orderkey", "l_linenumber", "flag"], ":")
    return landing.make_unique_key(keyed, ["l_orderkey", "l_partkey"], "-", hashed=True, out="digest").select("l_orderkey", "l_linenumber", "l_partkey", "unique_key", "digest")


_LATEST = "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM <events> QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@case("latest_per_key", _LATEST)
def latest(t):
    from orgpulse.operators.ordered import latest_per_key

    return latest_per_key(t["events"].select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@case("append_dedup", _LATEST.replace("user_id,", "user_id, event_type AS kind,").replace("PARTITION BY user_id", "PARTITION BY user_id, event_type").replace("event_id, event_type, round", "event_id, round"))
def dedup_landing(t):
    rows = t["events"].select("user_id", F.col("event_type").alias("kind"), "event_id", "value", "ts")
    cut = F.lit("2024-01-15").cast("timestamp")
    return landing.append_dedup(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), ["user_id", "kind"], ["ts", "event_id"]).drop("ts")


@case(
    "qualify_latest",
    "SELECT id, tenant_id, email FROM <b_members> QUALIFY row_number() OVER (PARTITION BY lower(trim(email)), tenant_id ORDER BY _airbyte_extracted_at DESC, id DESC) = 1",
)
def latest_member(t):
    """Members without an e-mail are one group of each tenant."""
    return landing.qualify_latest(t["b_members"], "email", "tenant_id", ["_airbyte_extracted_at", "id"]).select("id", "tenant_id", "email")


@case(
    "replacing_read",
    "SELECT user_id, event_id, k FROM <b_ev> QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1 AND event_type <> 'error'",
)
def last_versions(t):
    rows = t["b_ev"].select("user_id", "k", "event_id", fx.flag(F.col("event_type") == "error").alias("is_deleted"))
    return landing.replacing_read(rows, ["user_id", "k"], ["event_id"], "is_deleted").select("user_id", "event_id", "k")


@case(
    "flatten_manifest_record",
    """SELECT event_id, event_type AS kind, k AS amount, '{"kind":"' || event_type || '","k":' || k || '}' AS fields_json FROM <b_ev>""",
)
def flattened(t):
    nested = t["b_ev"].select("event_id", F.struct(F.col("event_type").alias("kind"), "k").alias("fields"))
    return landing.flatten_record(nested, {"event_id": "event_id", "kind": "fields.kind", "amount": "fields.k"}, "fields", "fields_json")


@case("expire_rows", "SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate FROM <orders> WHERE o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 1 YEAR")
def kept_rows(t):
    return landing.expire_rows(t["orders"].select("o_orderkey", "o_orderdate"), "o_orderdate", "2001-01-01", "INTERVAL 1 YEAR")


@case(
    "changelog_items",
    """
SELECT tenant_id, issue_id, event_id, 0 AS item_no, field_id, field_id AS field_name, CASE WHEN delta_action = 'remove' THEN delta_value END AS from_value, CASE WHEN delta_action <> 'remove' THEN delta_value END AS to_value FROM <b_deltas>
UNION ALL SELECT tenant_id, issue_id, event_id, 1, 'customfield_1', 'Rank', NULL, 'higher' FROM <b_deltas>""",
)
def changelog(t):
    q = F.col("delta_value")
    moved = F.when(F.col("delta_action") == "remove", F.concat(F.lit('"fromString":"'), q, F.lit('"'))).otherwise(
        F.concat(F.lit('"toString":"'), q, F.lit('"'))
    )
    items = F.concat(F.lit('[{"field":"'), F.col("field_id"), F.lit('",'), moved, F.lit('},{"field":"Rank","fieldId":"customfield_1","toString":"higher"}]'))
    return derive.changelog_items(t["b_deltas"].withColumn("items", items), ["tenant_id", "issue_id", "event_id"])
