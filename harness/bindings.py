"""The driver's tables under the names and shapes of workplace records. One text for both engines."""

from harness.cases import BINDINGS

B = BINDINGS

# --- people ------------------------------------------------------------------------------

B["b_customer_versions"] = "SELECT *, 0 AS v FROM <customer> UNION ALL SELECT *, 1 AS v FROM <customer>"
B["b_employees"] = """
SELECT 't' || (c_custkey % 2)::string AS tenant_id, 'hr' AS source_id, 'hr:' || c_custkey::string AS unique_key,
  c_custkey::string AS id,
  CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status,
  'First' || (c_custkey % 50)::string AS firstName, 'Last' || (c_custkey % 333)::string AS lastName,
  CASE WHEN v = 1 AND c_custkey % 5 = 0 THEN NULL ELSE c_name END AS displayName,
  CASE WHEN c_custkey % 97 = 13 THEN '' ELSE 'User' || c_custkey::string || '@Example.com' END AS workEmail,
  CASE WHEN v = 1 AND c_custkey % 11 = 0 THEN 'NATION_0' ELSE n_name END AS department,
  r_name AS division,
  CASE WHEN v = 1 AND c_custkey % 7 = 0 THEN NULL
       WHEN c_custkey % 6 = 0 THEN 'Senior ' || c_mktsegment
       WHEN c_custkey % 6 = 1 THEN 'junior ' || c_mktsegment
       WHEN c_custkey % 6 = 2 THEN 'VP of ' || c_mktsegment
       WHEN c_custkey % 6 = 3 THEN 'Trainee' ELSE c_mktsegment END AS jobTitle,
  CASE WHEN c_custkey > 0 THEN 'Customer ' || floor(c_custkey / 8)::bigint::string END AS supervisor,
  CASE WHEN c_custkey > 0 THEN floor(c_custkey / 8)::bigint::string END AS supervisorEId,
  CASE WHEN c_custkey > 0 THEN 'USER' || floor(c_custkey / 8)::bigint::string || '@example.com' END AS supervisorEmail,
  'E' || c_custkey::string AS employeeNumber,
  CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'Terminated' ELSE 'Full-Time' END AS employmentHistoryStatus,
  (DATE '2015-01-01' + (c_custkey % 1000)::int)::string AS hireDate,
  CASE WHEN c_acctbal < 0 THEN '2023-06-30' END AS terminationDate,
  'Site ' || c_nationkey::string AS location, 'City ' || (c_custkey % 40)::string AS city, n_name AS country,
  '2024-01-0' || (1 + v)::string || 'T00:00:00Z' AS lastChanged,
  '{"shirt":"' || (c_custkey % 4 + v)::string || '"}' AS raw_data,
  TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' DAY * v AS _airbyte_extracted_at
FROM <b_customer_versions> c JOIN <nation> n ON c_nationkey = n_nationkey JOIN <region> r ON n_regionkey = r_regionkey
"""
B["b_employees_now"] = "SELECT * FROM <b_employees> e WHERE _airbyte_extracted_at >= TIMESTAMP '2024-02-02 00:00:00'"
B["b_leave"] = """
SELECT 't' || (o_custkey % 2)::string AS tenant_id, 'hr' AS source_id, 'lv:' || o_orderkey::string AS unique_key,
  o_orderkey::string AS id, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey::string END AS employeeId,
  CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE o_orderdate::date::string END AS start,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_orderdate::date + (o_orderkey % 9)::int)::string END AS end,
  o_orderdate::date::string AS created,
  '{"id":"' || (o_orderkey % 4)::string || '","name":"' || o_orderpriority || '"}' AS type,
  CASE WHEN o_orderkey % 29 = 0 THEN '{"unit":"days"}' ELSE '{"unit":"days","amount":"' || (o_orderkey % 9)::string || '"}' END AS amount,
  '{"status":"' || o_orderstatus || '"}' AS status,
  TIMESTAMP '2024-02-01 00:00:00' AS _airbyte_extracted_at
FROM <orders> o
"""

# --- activity ------------------------------------------------------------------------------

B["b_ev"] = """
SELECT event_id, ts::timestamp AS ts, user_id, event_type, value, regexp_extract(props, '([0-9]+)', 1)::bigint AS k,
  't' || (user_id % 2)::string AS tenant_id, 'User' || user_id::string || '@Example.com' AS mail, ts::date AS day
FROM <events> e
"""
B["b_m365_user"] = """
SELECT *, CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 97 = 0 THEN '(Unknown)'
  WHEN event_id % 101 = 0 THEN NULL ELSE mail END AS userPrincipalName,
  day::string AS reportRefreshDate, day::string AS lastActivityDate, '7' AS reportPeriod,
  event_id % 53 = 0 AS isDeleted, 'm365' AS source_id, ts AS _airbyte_extracted_at
FROM <b_ev> e
"""
_REPORT = "tenant_id, source_id, reportRefreshDate, lastActivityDate, userPrincipalName, reportPeriod, isDeleted, _airbyte_extracted_at"
B["b_teams"] = f"""
SELECT {_REPORT}, 'te' || event_id::string AS unique_key,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (k % 7)::double END AS teamChatMessageCount,
  (k % 5)::double AS privateChatMessageCount, (k % 4)::double AS callCount, (k % 6)::double AS meetingCount,
  (k % 2)::double AS meetingsOrganizedCount,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (k % 3)::double END AS meetingsAttendedCount,
  (k % 2)::double AS adHocMeetingsOrganizedCount, (k % 3)::double AS adHocMeetingsAttendedCount,
  (k % 2)::double AS scheduledOneTimeMeetingsOrganizedCount,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE (k % 4)::double END AS scheduledOneTimeMeetingsAttendedCount,
  (k % 3)::double AS scheduledRecurringMeetingsOrganizedCount, (k % 5)::double AS scheduledRecurringMeetingsAttendedCount,
  (k % 2)::double AS urgentMessages, (k % 9)::double AS postMessages, (k % 8)::double AS replyMessages,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE 'PT' || (k % 3)::string || 'H' || (k % 60)::string || 'M' || (event_id % 60)::string || 'S' END AS audioDuration,
  'PT' || (k % 60)::string || 'M' AS videoDuration,
  CASE WHEN k % 2 = 0 THEN 'PT45S' ELSE 'P1DT2H' END AS screenShareDuration
FROM <b_m365_user> u
"""
B["b_email"] = f"""
SELECT {_REPORT}, 'em' || event_id::string AS unique_key, 'User ' || user_id::string AS displayName,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE (k % 10)::double END AS sendCount, (k % 12)::double AS receiveCount,
  (k % 11)::double AS readCount, (k % 2)::double AS meetingCreatedCount, (k % 3)::double AS meetingInteractedCount
FROM <b_m365_user> u
"""
B["b_onedrive"] = f"""
SELECT {_REPORT}, 'od' || event_id::string AS unique_key, (k % 6)::double AS viewedOrEditedFileCount,
  (k % 3)::double AS syncedFileCount, CASE WHEN k % 4 = 0 THEN NULL ELSE (k % 4)::double END AS sharedInternallyFileCount,
  (k % 2)::double AS sharedExternallyFileCount
FROM <b_m365_user> u
"""
B["b_sharepoint"] = f"""
SELECT {_REPORT}, 'sp' || event_id::string AS unique_key, (k % 5)::double AS viewedOrEditedFileCount,
  (k % 2)::double AS syncedFileCount, (k % 3)::double AS sharedInternallyFileCount,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 2)::double END AS sharedExternallyFileCount, (k % 13)::double AS visitedPageCount
FROM <b_m365_user> u
"""
B["b_participants"] = """
SELECT tenant_id, 'zoom' AS source_id, 'zp' || floor(event_id / 2)::bigint::string AS unique_key,
  CASE WHEN event_id % 19 = 0 THEN 'x' ELSE 'm' END || floor(event_id / 3)::bigint::string AS meeting_uuid,
  CASE WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN NULL ELSE mail END AS email,
  'User ' || user_id::string AS user_name,
  replace(date_trunc('second', ts)::string, ' ', 'T') || 'Z' AS join_time,
  CASE WHEN event_id % 29 = 0 THEN NULL
       ELSE replace((date_trunc('second', ts) + INTERVAL '1' MINUTE * k)::string, ' ', 'T') || 'Z' END AS leave_time,
  ts AS _airbyte_extracted_at
FROM <b_ev> e
"""
B["b_meetings"] = """
SELECT t.tenant_id, 'zoom' AS source_id, 'm' || o_orderkey::string AS uuid, o_orderkey % 2 = 0 AS has_video, o_orderkey % 3 = 0 AS has_screen_share
FROM <orders> o JOIN (SELECT 't0' AS tenant_id UNION ALL SELECT 't1' AS tenant_id) AS t ON true
"""
B["b_messages"] = """
SELECT 't0' AS tenant_id, 'slack' AS source_id, 'sl' || conv_id::string || '-' || turn::string AS unique_key,
  'C' || conv_id::string AS channel_id, CASE WHEN conv_id % 31 = 7 THEN '' ELSE 'U' || (conv_id * 3 + turn)::string END AS user,
  (1704067200 + conv_id * 3600 + turn * 60)::string || '.000100' AS ts, 'message' AS type,
  CASE WHEN role = 'system' THEN 'channel_join' END AS subtype,
  CASE WHEN turn > 0 THEN (1704067200 + conv_id * 3600)::string || '.000100' END AS thread_ts,
  CASE WHEN turn % 2 = 0 THEN turn END AS reply_count
FROM <conversations> c
"""
B["b_channels"] = """
SELECT DISTINCT 't0' AS tenant_id, 'slack' AS source_id, 'C' || conv_id::string AS channel_id,
  conv_id % 5 = 0 AS is_channel, conv_id % 5 = 1 AS is_group, conv_id % 5 = 2 AS is_im, conv_id % 5 = 3 AS is_mpim, conv_id % 2 = 0 AS is_private,
  CASE WHEN conv_id % 5 = 2 THEN 'im' WHEN conv_id % 5 = 3 THEN 'mpim' WHEN conv_id % 2 = 0 THEN 'private_channel' ELSE 'public_channel' END AS channel_type
FROM <conversations> c WHERE role <> 'system'
"""
B["b_slack_users"] = """
SELECT 't0' AS tenant_id, 'slack' AS source_id, 'U' || c_custkey::string AS slack_user_id,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'User' || c_custkey::string || '@Example.com' END AS email,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'Nick' || c_custkey::string END AS display_name,
  CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE c_name END AS real_name,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE 'Profile ' || c_custkey::string END AS profile_real_name
FROM <customer> c
"""
B["b_zulip"] = """
SELECT tenant_id, 'zu' || event_id::string AS uniq, user_id AS sender_id, ts AS created_at, (k % 6 + 1)::double AS count FROM <b_ev> e
"""
B["b_zulip_users"] = """
SELECT 't' || (c_custkey % 2)::string AS tenant_id, c_custkey AS id, 'User' || c_custkey::string || '@Example.com' AS email, c_name AS full_name FROM <customer> c
"""

# --- tasks -----------------------------------------------------------------------------------

B["b_issues"] = """
SELECT 't' || (floor(o_custkey / 5)::bigint % 2)::string AS tenant_id, 'jira' AS source_id, 'ji' || o_orderkey::string AS unique_key,
  o_orderkey::string AS jira_id, 'PROJ-' || o_orderkey::string AS id_readable, 'PROJ' AS project_key,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Bug' ELSE 'Task' END AS issue_type,
  replace((TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * (o_orderkey % 30) + INTERVAL '1' HOUR * (o_orderkey % 24))::string, ' ', 'T') || 'Z' AS updated,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN ''
       ELSE (DATE '2024-01-01' + ((o_orderkey * 7) % 40)::int)::string END AS due_date,
  CASE WHEN o_orderkey % 17 = 0 THEN '{"status":{"name":"Closed"}}' ELSE
    '{"assignee":{"emailAddress":"User' || floor(o_custkey / 5)::bigint::string || '@Example.com"},"status":{"name":"' ||
    CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'P' THEN 'Resolved' ELSE 'Open' END || '"},' ||
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '"resolution":{"name":"Done"},' END ||
    '"timeoriginalestimate":' || ((o_orderkey % 6) * 600)::string || ',"timespent":' || ((o_orderkey % 13) * 300)::string || '}' END AS custom_fields_json
FROM <orders> o
"""
B["b_status_history"] = """
SELECT 't' || (l_orderkey % 2)::string AS tenant_id, l_orderkey::string AS task_id, l_shipdate::timestamp AS at,
  (l_linenumber::bigint * 100000000000 + l_partkey * 100000 + l_suppkey)::bigint AS event_id,
  CASE WHEN l_returnflag = 'A' THEN 'Open' WHEN l_returnflag = 'N' THEN 'In Progress'
       WHEN l_linestatus = 'F' THEN 'Done' ELSE 'In Review' END AS status, 'U' || l_suppkey::string AS assignee
FROM <lineitem> l
"""
B["b_deltas"] = """
SELECT 't' || (l_orderkey % 2)::string AS tenant_id, l_orderkey::string AS issue_id,
  CASE WHEN l_linestatus = 'O' THEN 'labels' ELSE 'status' END AS field_id,
  CASE WHEN l_linestatus = 'O' THEN 'multi' ELSE 'single' END AS field_cardinality,
  l_shipdate::timestamp AS event_at, (l_linenumber::bigint * 100000000000 + l_partkey * 100000 + l_suppkey)::bigint AS event_id,
  CASE WHEN l_linestatus = 'F' THEN 'set' WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS delta_action,
  'v' || (l_partkey % 5)::string AS delta_value
FROM <lineitem> l
"""
B["b_tag_snapshots"] = """
SELECT 't' || (l_orderkey % 2)::string AS tenant_id, l_orderkey::string AS issue_id,
  min(l_shipdate)::timestamp + INTERVAL '1' SECOND * l_linenumber AS at,
  'v' || (min(l_partkey) % 3)::string || '; w' || (min(l_suppkey) % 4)::string || ', x' || (max(l_partkey) % 3)::string AS tag_text
FROM <lineitem> l GROUP BY l_orderkey, l_linenumber
"""
B["b_task_events"] = """
SELECT 't' || (l_orderkey % 2)::string AS tenant_id, l_orderkey::string AS issue_ref, 'TASK-' || l_orderkey::string AS task_id,
  CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE (floor(l_orderkey / 10)::bigint * 10 + (l_orderkey % 2))::string END AS parent_issue_ref,
  CASE WHEN l_orderkey % 10 < 2 THEN 'User Story' WHEN l_orderkey % 3 = 0 THEN 'Bug' ELSE 'Task' END AS type,
  CASE WHEN l_returnflag = 'A' THEN 'new' WHEN l_returnflag = 'N' THEN 'open' ELSE 'done' END AS state,
  'U' || l_suppkey::string AS assignee, l_shipdate::timestamp AS event_date,
  (l_linenumber::bigint * 100000000000 + l_partkey * 100000 + l_suppkey)::bigint AS event_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'confidence' ELSE 'sprints' END AS field_name,
  CASE WHEN l_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS field_text
FROM <lineitem> l
"""
B["b_tasks"] = """
SELECT 't' || (o_custkey % 2)::string AS tenant_id, 'user' || o_custkey::string || '@example.com' AS person_id,
  o_orderkey::string AS task_id, o_orderstatus <> 'O' AS done, o_orderstatus AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Bug' ELSE 'Task' END AS task_type, o_orderpriority AS priority,
  (o_orderkey % 8)::double AS story_points,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE floor(o_totalprice / 1000)::double END AS dev_time_h,
  CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate::timestamp END AS reopened_at,
  CASE WHEN o_orderkey % 9 = 0 THEN 'reason ' || (o_orderkey % 4)::string END AS reopen_reason,
  o_orderdate::date AS closed_date
FROM <orders> o
"""
B["b_memberships"] = """
SELECT 't' || (o_orderkey % 2)::string AS tenant_id, o_orderkey::string AS task_id, 'S' || (o_custkey % 60)::string AS sprint_id,
  o_orderdate::timestamp AS valid_from,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::timestamp + INTERVAL '1' DAY * (14 + o_orderkey % 300) END AS valid_to
FROM <orders> o
"""

# --- version control -----------------------------------------------------------------------------

_REPO_O = "'t' || (o_orderkey % 2)::string AS tenant_id, 'gh' AS source_id, 'org' || (o_orderkey % 3)::string AS repo_owner, 'repo' || (o_orderkey % 11)::string AS repo_name"
_REPO_L = _REPO_O.replace("o_orderkey", "l_orderkey")
_WS_O = "'t' || (o_orderkey % 2)::string AS tenant_id, 'bb' AS source_id, 'ws' || (o_orderkey % 3)::string AS workspace, 'slug' || (o_orderkey % 7)::string AS repo_slug"
_WS_L = _WS_O.replace("o_orderkey", "l_orderkey")
_AT = "TIMESTAMP '2024-02-01 00:00:00' AS _airbyte_extracted_at"
_LKEY = "l_orderkey::string || ':' || l_linenumber::string || ':' || l_partkey::string || ':' || l_suppkey::string"


def _iso(expr: str) -> str:
    return f"replace(({expr})::string, ' ', 'T') || 'Z'"


B["b_commits"] = f"""
SELECT {_REPO_O}, 'gh:c:' || o_orderkey::string AS unique_key, 'c' || o_orderkey::string AS oid,
  CASE WHEN o_orderkey % 5 = 0 THEN 'dev' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'main' END AS branch_name, 'main' AS default_branch_name,
  'Dev ' || o_custkey::string AS author_name,
  CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN '' ELSE 'User' || o_custkey::string || '@Example.com' END AS author_email,
  'Dev ' || o_custkey::string AS committer_name, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'c@example.com' END AS committer_email,
  'PROJ-' || (o_orderkey + 1)::string || ' change, closes #' || (o_orderkey % 90)::string || ' and #' || (o_orderkey % 7)::string AS message,
  CASE WHEN o_orderkey % 71 = 0 THEN 'unknown' ELSE {_iso("o_orderdate::timestamp")} END AS committed_date,
  (o_orderkey % 9)::bigint AS changed_files, floor(o_totalprice / 1000)::bigint AS additions,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 50)::bigint END AS deletions,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN split('a,b', ',') WHEN o_orderkey % 8 = 0 THEN NULL ELSE split('a', ',') END AS parent_hashes,
  {_AT}
FROM <orders> o
"""
_PATH = """lower(p_type) || CASE WHEN p_size % 7 = 0 THEN '/tests/' ELSE '/' END || replace(p_name, ' ', '_') ||
    CASE WHEN p_size % 6 = 0 THEN '.py' WHEN p_size % 6 = 1 THEN '.test.js' WHEN p_size % 6 = 2 THEN '.YAML'
         WHEN p_size % 6 = 3 THEN '.md' WHEN p_size % 6 = 4 THEN '' ELSE '.lock' END"""
B["b_file_changes"] = f"""
SELECT {_REPO_L}, 'gh:f:' || {_LKEY} AS unique_key, 'c' || l_orderkey::string AS commit_hash, {_PATH} AS filename,
  CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'N' THEN 'modified' END AS status, 'commit' AS source_type,
  floor(l_quantity)::bigint AS additions, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber::bigint END AS deletions, {_AT}
FROM <lineitem> l JOIN <part> p ON l_partkey = p_partkey
"""
B["b_prs"] = f"""
SELECT {_REPO_O}, 'gh:p:' || o_orderkey::string AS unique_key, o_orderkey AS database_id, o_orderkey AS number,
  CASE WHEN o_orderkey % 25 = 0 THEN 'Hotfix for PROJ-' ELSE 'Change for PROJ-' END || (o_orderkey + 2)::string AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'See #' || (o_orderkey % 30)::string END AS body,
  CASE WHEN o_orderstatus = 'F' THEN 'MERGED' WHEN o_orderstatus = 'P' THEN 'CLOSED' ELSE 'OPEN' END AS state,
  'Dev ' || o_custkey::string AS author_login,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'User' || o_custkey::string || '@Example.com' END AS author_email,
  CASE WHEN o_orderkey % 13 = 0 THEN 'hotfix/x' ELSE 'feature/x' END AS head_ref, 'main' AS base_ref,
  {_iso("o_orderdate::timestamp")} AS created_at, {_iso("o_orderdate::timestamp")} AS updated_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL
       ELSE {_iso("o_orderdate::timestamp + INTERVAL '1' HOUR * ((o_orderkey * 37) % 2000 - 200)")} END AS closed_at,
  'c' || (o_orderkey + 66)::string AS merge_commit_sha, (o_orderkey % 9)::bigint AS changed_files,
  floor(o_totalprice / 1000)::bigint AS additions, (o_orderkey % 40)::bigint AS deletions, {_AT}
FROM <orders> o
"""
B["b_reviews"] = f"""
SELECT {_REPO_L}, 'gh:r:' || {_LKEY} AS unique_key, l_orderkey AS pr_database_id, 'Dev ' || l_suppkey::string AS author_login,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS author_database_id,
  CASE WHEN l_returnflag = 'R' THEN 'APPROVED' WHEN l_returnflag = 'A' THEN 'CHANGES_REQUESTED' END AS state,
  {_iso("l_shipdate::timestamp")} AS submitted_at, {_AT}
FROM <lineitem> l
"""
B["b_pr_comments"] = f"""
SELECT {_REPO_L}, 'gh:m:' || {_LKEY} AS unique_key, l_orderkey AS pr_database_id, l_orderkey * 10 + l_linenumber AS database_id,
  'note ' || l_partkey::string AS body, 'Dev ' || l_suppkey::string AS author_login, l_suppkey AS author_database_id,
  {_iso("l_shipdate::timestamp")} AS created_at, {_iso("l_shipdate::timestamp")} AS updated_at,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 2 = 0 END AS is_inline,
  CASE WHEN l_linenumber % 2 = 0 THEN 'src/a.py' END AS path, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS line, {_AT}
FROM <lineitem> l
"""
B["b_pr_commits"] = f"""
SELECT {_REPO_L}, 'gh:l:' || {_LKEY} AS unique_key, l_orderkey AS pr_database_id, l_orderkey AS pr_number,
  CASE WHEN l_partkey % 83 = 0 THEN '' ELSE 'c' || (l_orderkey + 66 * (l_linenumber - 1))::string END AS commit_hash,
  (l_linenumber - 1)::bigint AS commit_order, l_shipdate::timestamp AS commit_committed_date, {_AT}
FROM <lineitem> l
"""
B["b_repos"] = f"""
SELECT 't' || (p_partkey % 2)::string AS tenant_id, 'gh' AS source_id, 'gh:repo:' || p_partkey::string AS unique_key,
  CASE WHEN p_partkey % 21 = 0 THEN '{{}}' ELSE '{{"login":"org' || (p_partkey % 5)::string || '"}}' END AS owner, 'repo' || p_partkey::string AS name,
  p_partkey AS id, 'org/' || p_partkey::string AS full_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS description,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 2 = 0 END AS private, '2020-01-01T00:00:00Z' AS created_at,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE '2024-01-02T03:04:05Z' END AS pushed_at, '2023-12-31T00:00:00Z' AS updated_at,
  p_size::bigint AS size, p_type AS language, p_size % 3 = 0 AS has_issues, p_size % 5 = 0 AS has_wiki,
  p_size % 6 = 0 AS archived, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 7 = 1 END AS fork, {_AT}
FROM <part> p
"""
B["b_branches"] = f"""
SELECT 't' || (floor(p_partkey / 8)::bigint % 2)::string AS tenant_id, 'gh' AS source_id, 'gh:br:' || p_partkey::string AS unique_key,
  'org1' AS repo_owner, 'repo' || floor(p_partkey / 8)::bigint::string AS repo_name, 'branch' || p_partkey::string AS name,
  'branch' || (floor(p_partkey / 8)::bigint * 8 + 3)::string AS default_branch_name,
  CASE WHEN p_partkey % 15 = 0 THEN '' ELSE 'h' || floor(p_partkey / 2)::bigint::string END AS head_sha,
  '{{"sha":"h' || floor(p_partkey / 2)::bigint::string || '"}}' AS commit,
  '2024-01-' || (10 + floor(p_partkey / 8)::bigint % 20)::string || 'T00:00:00Z' AS pushed_at, {_AT}
FROM <part> p
"""
B["b_repo_state"] = """
SELECT DISTINCT tenant_id, repo_owner, repo_name, CASE WHEN length(repo_name) % 2 = 0 THEN '2024-01-15T00:00:00Z' ELSE NULL END AS pushed_at FROM <b_branches> b
"""
B["b_branch_state"] = """
SELECT tenant_id, repo_owner, repo_name, name, CASE WHEN length(name) % 2 = 0 THEN head_sha ELSE 'h1' END AS head_sha, '2023-01-01' AS cursor FROM <b_branches> b
"""

B["b_ws_commits"] = f"""
SELECT {_WS_O}, 'bb:c:' || o_orderkey::string AS unique_key, 'b' || o_orderkey::string AS hash, 'main' AS branch_name,
  'User' || o_custkey::string AS author_name, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'User' || o_custkey::string || '@Example.com' END AS author_email,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'work on #' || (o_orderkey % 12)::string END AS message, {_iso("o_orderdate::timestamp")} AS date,
  CASE WHEN o_orderpriority = '5-LOW' THEN '["x","y"]' WHEN o_orderkey % 10 = 0 THEN NULL ELSE '["x"]' END AS parent_hashes, {_AT}
FROM <orders> o
"""
B["b_ws_file_changes"] = f"""
SELECT {_WS_L}, 'bb:f:' || {_LKEY} AS unique_key, 'b' || l_orderkey::string AS sha, {_PATH} AS filename, l_returnflag AS status,
  'commit' AS source_type, floor(l_quantity)::bigint AS additions, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linenumber::bigint END AS deletions, {_AT}
FROM <lineitem> l JOIN <part> p ON l_partkey = p_partkey
"""
B["b_ws_prs"] = f"""
SELECT {_WS_O}, 'bb:p:' || o_orderkey::string AS unique_key, o_orderkey AS id, 'PR ' || o_orderkey::string AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'text' END AS description,
  CASE WHEN o_orderkey % 9 = 0 THEN 'SUPERSEDED' WHEN o_orderstatus = 'F' THEN 'MERGED' WHEN o_orderstatus = 'P' THEN 'DECLINED' ELSE 'OPEN' END AS state,
  'User' || o_custkey::string AS author_display_name, 'feature/y' AS source_branch, 'main' AS destination_branch,
  {_iso("o_orderdate::timestamp")} AS created_on, {_iso("o_orderdate::timestamp + INTERVAL '1' HOUR * (o_orderkey % 100)")} AS updated_on,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'b' || (o_orderkey + 42)::string END AS merge_commit_hash,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE
   '[{{"role":"REVIEWER","uuid":"u' || (o_custkey % 99)::string || '","display_name":"User' || (o_custkey % 99)::string || '","state":"approved","approved":true}},' ||
   '{{"role":"PARTICIPANT","uuid":"p","display_name":"P","approved":false}},' ||
   '{{"role":"REVIEWER","uuid":"w' || (o_orderkey % 50)::string || '","display_name":"W' || (o_orderkey % 50)::string || '","approved":false}}]' END AS participants, {_AT}
FROM <orders> o
"""
B["b_ws_pr_commits"] = f"""
SELECT {_WS_L}, 'bb:l:' || {_LKEY} AS unique_key, l_orderkey AS pr_id, 'b' || (l_orderkey + 42 * (l_linenumber - 1))::string AS hash, {_AT}
FROM <lineitem> l
"""
B["b_ws_pr_comments"] = f"""
SELECT {_WS_L}, 'bb:m:' || {_LKEY} AS unique_key, l_orderkey AS pr_id, l_orderkey * 10 + l_linenumber AS comment_id, 'c' || l_partkey::string AS body,
  'User' || l_suppkey::string AS author_display_name, 'u' || l_suppkey::string AS author_uuid, {_iso("l_shipdate::timestamp")} AS created_on,
  {_iso("l_shipdate::timestamp")} AS updated_on, l_linenumber % 3 = 0 AS is_inline, CASE WHEN l_linenumber % 3 = 0 THEN 'a/b.c' END AS inline_path,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS inline_to, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS inline_from, {_AT}
FROM <lineitem> l
"""
B["b_ws_repos"] = f"""
SELECT 't' || (p_partkey % 2)::string AS tenant_id, 'bb' AS source_id, 'bb:repo:' || p_partkey::string AS unique_key, 'ws' || (p_partkey % 5)::string AS workspace,
  'slug' || p_partkey::string AS slug, 'uu' || p_partkey::string AS uuid, p_name AS name, 'ws/' || p_partkey::string AS full_name,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS description, p_size % 2 = 0 AS is_private, '2020-01-01T00:00:00+02:00' AS created_on,
  '2024-01-02T03:04:05Z' AS updated_on, p_size::bigint AS size, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_type END AS language, p_size % 3 = 0 AS has_issues,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 5 = 1 END AS has_wiki, {_AT}
FROM <part> p
"""
B["b_ws_branches"] = f"""
SELECT 't' || (p_partkey % 2)::string AS tenant_id, 'bb' AS source_id, 'bb:br:' || p_partkey::string AS unique_key, 'ws1' AS workspace,
  'slug' || floor(p_partkey / 4)::bigint::string AS repo_slug, 'b' || (p_partkey % 4)::string AS name, 'b1' AS mainbranch_name,
  '{{"hash":"x' || p_partkey::string || '"}}' AS target, '2024-01-02T03:04:05Z' AS updated_on, {_AT}
FROM <part> p
"""

# --- AI tools ------------------------------------------------------------------------------------------

_CURSOR = """SELECT tenant_id, 'cursor' AS source_id, 'cu' || event_id::string AS unique_key, mail AS userEmail,
  (1704067200000 + event_id * 259000)::bigint::string AS timestamp, event_type AS kind, 'model-' || (k % 6)::string AS model,
  COST AS requestsCosts, CASE WHEN k % 4 = 0 THEN NULL ELSE (k % 4)::double END AS cursorTokenFee,
  k % 2 = 0 AS isTokenBasedCall, k % 11 = 0 AS isFreeBugbot, k % 3 = 0 AS maxMode,
  CASE WHEN k % 7 = 0 THEN NULL ELSE '{"inputTokens":' || k::string || ',"outputTokens":' || (k * 2)::string || ',"totalCents":' || (k % 9)::string || '.5}' END AS tokenUsage
FROM <b_ev> e"""
B["b_cursor_resync"] = _CURSOR.replace("COST", "(k % 10)::double")
B["b_cursor_realtime"] = _CURSOR.replace("COST", "(k % 10)::double + 1")
B["b_ai_code"] = """
SELECT tenant_id, 'cc' AS source_id, day::string AS date, CASE WHEN k % 3 = 0 THEN 'api_key' ELSE 'user' END AS actor_type,
  mail AS actor_identifier, event_type AS terminal_type, (k % 5)::double AS session_count, (k * 2)::double AS lines_added, (k % 20)::double AS lines_removed,
  (k % 8)::double AS tool_use_accepted, (k % 3)::double AS tool_use_rejected
FROM <b_ev> e
"""
B["b_ai_usage"] = """
SELECT 't' || (l_suppkey % 2)::string AS tenant_id, 'aa' AS source_id, l_shipdate::date::string AS date, 'model-' || l_returnflag AS model,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE 'key' || l_suppkey::string END AS api_key_id, 'ws' || (l_partkey % 30)::string AS workspace_id,
  l_linestatus AS service_tier, '0-200k' AS context_window, l_quantity AS uncached_input_tokens, l_linenumber::double AS cache_read_tokens,
  (l_partkey % 100)::double AS cache_creation_5m_tokens, (l_partkey % 10)::double AS cache_creation_1h_tokens, (l_suppkey % 50)::double AS output_tokens,
  (l_linenumber % 2)::double AS web_search_requests
FROM <lineitem> l
"""
B["b_ai_keys"] = "SELECT 't' || (s_suppkey % 2)::string AS tenant_id, 'key' || s_suppkey::string AS id, s_name AS name FROM <supplier> s UNION ALL SELECT 't' || (s_suppkey % 2)::string AS tenant_id, 'key' || s_suppkey::string AS id, s_name AS name FROM <supplier> s2"
B["b_ai_workspaces"] = "SELECT 't' || (s_suppkey % 2)::string AS tenant_id, 'ws' || (s_suppkey % 30)::string AS id, 'Space ' || (s_suppkey % 30)::string AS display_name FROM <supplier> s"
B["b_ai_cost"] = "SELECT 't' || (l_suppkey % 2)::string AS tenant_id, 'model-' || l_returnflag AS model, l_shipdate::date::string AS report_date, l_extendedprice AS amount FROM <lineitem> l"
B["b_tool_usage"] = """
SELECT tenant_id, lower(mail) AS person_id, day, CASE WHEN k % 2 = 0 THEN 'cursor' ELSE 'code' END AS tool, k % 3 > 0 AS is_active,
  (k % 5)::double AS sessions, (k % 40)::double AS ai_lines, (k % 90)::double AS clean_loc, (k % 90 + 10)::double AS total_lines,
  (k % 30)::double AS tabs_shown, (k % 10)::double AS tabs_accepted, value AS cost
FROM <b_ev> e
"""
B["b_members"] = """
SELECT 't' || (c_custkey % 2)::string AS tenant_id, 'm' || c_custkey::string || '-' || v::string AS id, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_name || CASE WHEN v = 1 THEN ' ' ELSE '' END END AS name,
  CASE WHEN c_custkey % 33 = 0 THEN '' WHEN c_custkey % 35 = 0 THEN NULL ELSE ' User' || c_custkey::string || '@Example.com' END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS role, c_acctbal < 0 AS isRemoved, TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' DAY * v AS _airbyte_extracted_at
FROM <b_customer_versions> c
"""

# --- CRM -----------------------------------------------------------------------------------------------

_CRM_AT = "o_orderdate::timestamp::string AS CreatedDate, o_orderdate::date::string AS LastModifiedDate, replace(o_orderdate::timestamp::string, ' ', 'T') || 'Z' AS SystemModstamp, 'sf' AS data_source"
_CRM_FIXED = "'2024-01-01T00:00:00Z' AS CreatedDate, '2024-01-05' AS LastModifiedDate, '2024-01-06T07:08:09Z' AS SystemModstamp, 'sf' AS data_source"
B["b_accounts"] = f"""
SELECT 't' || (c_custkey % 2)::string AS tenant_id, '001' || c_custkey::string AS Id, c_name AS Name, 'w' || c_custkey::string || '.example' AS Website, c_mktsegment AS Industry,
  'O' || (c_custkey % 40)::string AS OwnerId, CASE WHEN c_custkey % 4 = 0 THEN '001' || floor(c_custkey / 4)::bigint::string END AS ParentId, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Customer' END AS Type,
  'City' AS BillingCity, NULL::string AS BillingState, 'C' || c_nationkey::string AS BillingCountry, c_custkey AS NumberOfEmployees, floor(c_acctbal)::bigint AS AnnualRevenue,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 11 = 0 END AS IsDeleted, {_CRM_FIXED}
FROM <customer> c
"""
B["b_contacts"] = f"""
SELECT 't' || (c_custkey % 2)::string AS tenant_id, '003' || c_custkey::string AS Id, 'u' || c_custkey::string || '@x.example' AS Email, 'F' AS FirstName, c_name AS LastName, 'O1' AS OwnerId,
  '001' || c_custkey::string AS AccountId, CASE WHEN c_custkey % 2 = 0 THEN 'Boss' END AS Title, NULL::string AS Phone, c_mktsegment AS LeadSource, c_custkey % 11 = 0 AS IsDeleted, {_CRM_FIXED}
FROM <customer> c
"""
B["b_opportunities"] = f"""
SELECT 't' || (o_custkey % 2)::string AS tenant_id, '006' || o_orderkey::string AS Id, 'Deal ' || o_orderkey::string AS Name, o_orderpriority AS ForecastCategory, o_orderpriority AS StageName,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS Amount, CASE WHEN o_orderkey % 14 = 0 THEN 'soon' ELSE (o_orderdate::date + (o_orderkey % 60)::int)::string END AS CloseDate, 'O' || (o_custkey % 40)::string AS OwnerId,
  '001' || o_custkey::string AS AccountId, CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_orderstatus <> 'O' END AS IsClosed, o_orderstatus = 'F' AS IsWon, 'web' AS LeadSource, (o_orderkey % 100)::double AS Probability,
  NULL::string AS Type, 'EUR' AS CurrencyIsoCode, false AS IsDeleted, {_CRM_AT}
FROM <orders> o
"""
B["b_crm_users"] = f"""
SELECT 't' || (s_suppkey % 2)::string AS tenant_id, 'O' || s_suppkey::string AS Id, 's' || s_suppkey::string || '@x.example' AS Email, 'S' AS FirstName, s_name AS LastName, 'Rep' AS Title,
  'Sales' AS Department, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal > 0 END AS IsActive, s_name AS Username, 'pr' AS ProfileId, NULL::string AS UserRoleId, false AS IsDeleted, TIMESTAMP '2024-02-01 00:00:00' AS collected_at, {_CRM_FIXED}
FROM <supplier> s
"""
B["b_crm_tasks"] = f"""
SELECT 't' || (o_custkey % 2)::string AS tenant_id, 'T' || o_orderkey::string AS Id, CASE WHEN o_orderstatus = 'F' THEN 'Outbound' END AS CallType, CASE WHEN o_orderkey % 2 = 0 THEN 'Email' ELSE 'Task' END AS TaskSubtype,
  'O' || (o_custkey % 40)::string AS OwnerId, '003' || o_custkey::string AS WhoId, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '006' || o_orderkey::string ELSE '001' || o_custkey::string END AS WhatId,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate::date::string END AS ActivityDate, (o_orderkey % 900)::double AS CallDurationInSeconds, o_orderstatus AS Status, 'Subject ' || (o_orderkey % 20)::string AS Subject,
  o_orderpriority AS Priority, false AS IsDeleted, {_CRM_AT}
FROM <orders> o
"""
B["b_crm_events"] = f"""
SELECT 't' || (o_custkey % 2)::string AS tenant_id, 'E' || o_orderkey::string AS Id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Event' ELSE 'Demo' END AS EventSubtype,
  'O' || (o_custkey % 40)::string AS OwnerId, '003' || o_custkey::string AS WhoId, '00Q' AS WhatId, replace(o_orderdate::timestamp::string, ' ', 'T') || 'Z' AS StartDateTime, (o_orderkey % 90)::double AS DurationInMinutes,
  'Meet' AS Subject, NULL::string AS Location, 'later' AS EndDateTime, NULL::boolean AS IsDeleted, {_CRM_AT}
FROM <orders> o
"""

# --- organisation -----------------------------------------------------------------------------------------

B["b_units"] = """
SELECT 't0' AS tenant_id, c_custkey::string AS unit_id, CASE WHEN c_custkey > 0 THEN floor(c_custkey / 8)::bigint::string END AS parent_id, 'Unit ' || c_custkey::string AS name FROM <customer> c
"""
B["b_assignments"] = """
SELECT 't0' AS tenant_id, 'p' || o_custkey::string AS person_id, (o_orderkey % 100)::string AS unit_id, o_orderkey, o_orderdate::timestamp AS valid_from,
  lead(o_orderdate::timestamp) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to
FROM <orders> o
"""
B["b_facts"] = f"""
SELECT 't0' AS tenant_id, {_LKEY} AS fact_id, 'p' || l_partkey::string AS person_id, l_shipdate::timestamp AS at, l_quantity AS amount, l_returnflag AS source, (l_partkey % 100)::string AS unit_id FROM <lineitem> l
"""
B["b_scd"] = """
SELECT 't' || (o_custkey % 2)::string AS tenant_id, o_custkey::string AS person_id, o_orderdate::timestamp AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::timestamp + INTERVAL '1' DAY * (o_orderkey % 200) END AS valid_to, o_orderkey
FROM <orders> o
"""

# --- identity ----------------------------------------------------------------------------------------------

B["b_member_log"] = """
SELECT tenant_id, 'cursor' AS source_id, 'u' || user_id::string AS unique_key, 'u' || user_id::string AS id, event_id, ts AS _tracked_at,
  'Name ' || floor(user_id / 2)::bigint::string AS name, event_type AS role, k % 4 = 0 AS isRemoved, CASE WHEN k % 9 = 0 THEN '' ELSE 'w' || (k % 3)::string END AS label, '{"team":"' || (k % 2)::string || '"}' AS raw_data
FROM <b_ev> e
"""
B["b_slack_log"] = """
SELECT tenant_id, 'slack' AS source_id, 's' || user_id::string AS unique_key, event_id, ts AS _tracked_at, mail AS email, 'Nick' || (k % 2)::string AS display_name, 'Real ' || floor(k / 50)::bigint::string AS real_name,
  k % 7 = 0 AS is_admin, false AS is_owner, k % 11 = 0 AS is_restricted, false AS is_ultra_restricted, CASE WHEN k % 13 = 0 THEN NULL ELSE k % 2 = 0 END AS is_bot, event_type = 'error' AS deleted, 'zone ' || (user_id % 3)::string AS tz
FROM <b_ev> e
"""
B["b_zoom_log"] = """
SELECT tenant_id, 'zoom' AS source_id, 'z' || user_id::string AS unique_key, 'z' || user_id::string AS id, event_id, ts AS _tracked_at, 'First' || (user_id % 50)::string AS first_name, 'Last' || floor(k / 40)::bigint::string AS last_name,
  CASE WHEN k % 6 = 0 THEN '' ELSE 'Shown ' || (k % 2)::string END AS display_name, mail AS email, 'dept ' || floor(k / 30)::bigint::string AS dept, CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END AS status,
  (k % 3)::string AS role_id, 'UTC' AS timezone, CASE WHEN k % 17 = 0 THEN NULL ELSE 'en' END AS language, '+1' || (user_id % 9)::string AS phone_number, 'E' || user_id::string AS employee_unique_id, (k % 2 + 1)::string AS type
FROM <b_ev> e
"""
B["b_members_now"] = """
SELECT 't' || (c_custkey % 2)::string AS tenant_id, 'cursor' AS source_id, 'u' || c_custkey::string AS unique_key, 'u' || c_custkey::string AS id,
  'Name ' || floor(c_custkey / 2)::bigint::string AS name, CASE WHEN c_custkey % 3 = 0 THEN 'view' WHEN c_custkey % 3 = 1 THEN 'click' ELSE 'error' END AS role, c_custkey % 5 = 0 AS isRemoved
FROM <customer> c
"""
B["b_field_log"] = """
SELECT tenant_id, 'zoom' AS source_id, 'u' || user_id::string AS entity_id, CASE WHEN k % 4 = 0 THEN 'email' WHEN k % 4 = 1 THEN 'status' WHEN k % 4 = 2 THEN 'display_name' ELSE 'dept' END AS field_name,
  '' AS old_value, CASE WHEN k % 4 = 1 AND k % 3 = 0 THEN 'inactive' WHEN k % 10 = 0 THEN '' ELSE 'val' || k::string END AS new_value, ts AS updated_at
FROM <b_ev> e
"""
B["b_aliases"] = """
SELECT 't' || (c_custkey % 2)::string AS tenant_id, 'al' || c_custkey::string AS alias_id, 'P' || floor(c_custkey / 3)::bigint::string AS person_id, 'hr' AS source_type, c_custkey::string AS source_account_id, 'email' AS alias_type,
  'user' || (floor(c_custkey / 8)::bigint * 2 + c_custkey % 2)::string || '@example.com' AS alias_value, 1 AS is_active, CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END AS is_deleted, c_custkey AS version
FROM <customer> c
"""
B["b_obs"] = """
SELECT tenant_id, CASE WHEN k % 2 = 0 THEN 'git' ELSE 'hr' END AS source_type, user_id::string AS source_account_id,
  CASE WHEN k % 3 = 0 THEN 'username' ELSE 'email' END AS alias_type,
  CASE WHEN k % 3 = 0 THEN 'User' || user_id::string WHEN k % 5 = 0 THEN ' User' || user_id::string || '+x@Example.com' WHEN k % 7 = 0 THEN 'user' || user_id::string || '@Example.org' ELSE mail END AS alias_value,
  CASE WHEN k % 13 = 0 THEN 'DELETE' ELSE 'UPSERT' END AS operation_type, ts AS _synced_at
FROM <b_ev> e
"""
B["b_domains"] = "SELECT n_name AS ignored, CASE WHEN n_nationkey = 0 THEN 'example.com' ELSE 'example.org' END AS domain, 'example.com' AS domain_group FROM <nation> n WHERE n_nationkey < 2"
B["b_tokens"] = """
SELECT 'n' || floor(l_partkey / 3)::bigint::string || '_' || l_linenumber::string || '_' || l_returnflag AS token, l_orderkey AS rid FROM <lineitem> l
"""
B["b_sparse_tokens"] = """
SELECT 'cust' || o_custkey::string || '_' || floor(o_orderkey / 40)::bigint::string AS token, o_orderkey AS rid FROM <orders> o
UNION ALL SELECT 'pair' || floor(o_orderkey / 3)::bigint::string || CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE o_orderkey::string END AS token, o_orderkey AS rid FROM <orders> o2
"""
B["b_attr"] = """
SELECT tenant_id, 'P' || user_id::string AS person_id, CASE WHEN k % 4 = 0 THEN 'email' WHEN k % 4 = 1 THEN 'role' WHEN k % 4 = 2 THEN 'display_name' ELSE 'location' END AS attribute,
  CASE WHEN k % 17 = 0 THEN '' ELSE 'val' || (k % 6)::string END AS value, CASE WHEN event_type = 'click' THEN 'git' WHEN event_type = 'view' THEN 'communication' WHEN event_type = 'signup' THEN 'auto' WHEN event_type = 'error' THEN 'hr' ELSE 'other' END AS source_kind, ts AS observed_at
FROM <b_ev> e
"""
