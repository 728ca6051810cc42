"""Bronze schemas: field names as the source APIs give them, all behind one record envelope.

The column lists are fixed values: they must equal the names the connectors deliver.
"""

from __future__ import annotations

from pyspark.sql import types as T

ENVELOPE = "tenant_id string, source_id string, unique_key string, data_source string, collected_at timestamp, _airbyte_extracted_at timestamp"

BRONZE = {
    "hr_employees": "id string, status string, firstName string, lastName string, displayName string, workEmail string, department string, division string, jobTitle string, supervisor string, supervisorEId string, supervisorEmail string, employeeNumber string, employmentHistoryStatus string, hireDate string, terminationDate string, originalHireDate string, location string, city string, country string, lastChanged string, raw_data string",
    "hr_leave_requests": "id string, employeeId string, name string, start string, end string, created string, type string, amount string, status string, dates string, notes string, actions string",
    "m365_email_activity": "reportRefreshDate string, userPrincipalName string, displayName string, lastActivityDate string, reportPeriod string, isDeleted boolean, sendCount double, receiveCount double, readCount double, meetingCreatedCount double, meetingInteractedCount double, assignedProducts array<string>",
    "m365_teams_activity": "reportRefreshDate string, userPrincipalName string, lastActivityDate string, reportPeriod string, isDeleted boolean, teamChatMessageCount double, privateChatMessageCount double, callCount double, meetingCount double, meetingsOrganizedCount double, meetingsAttendedCount double, adHocMeetingsOrganizedCount double, adHocMeetingsAttendedCount double, scheduledOneTimeMeetingsOrganizedCount double, scheduledOneTimeMeetingsAttendedCount double, scheduledRecurringMeetingsOrganizedCount double, scheduledRecurringMeetingsAttendedCount double, urgentMessages double, postMessages double, replyMessages double, audioDuration string, videoDuration string, screenShareDuration string, isExternal boolean, isLicensed boolean",
    "m365_onedrive_activity": "reportRefreshDate string, userPrincipalName string, lastActivityDate string, reportPeriod string, viewedOrEditedFileCount double, syncedFileCount double, sharedInternallyFileCount double, sharedExternallyFileCount double",
    "m365_sharepoint_activity": "reportRefreshDate string, userPrincipalName string, lastActivityDate string, reportPeriod string, viewedOrEditedFileCount double, syncedFileCount double, sharedInternallyFileCount double, sharedExternallyFileCount double, visitedPageCount double",
    "slack_users": "slack_user_id string, email string, display_name string, real_name string, tz string, is_admin boolean, is_owner boolean, is_restricted boolean, is_ultra_restricted boolean, is_bot boolean, deleted boolean, updated bigint",
    "slack_channels": "channel_id string, name string, creator string, channel_type string, is_channel boolean, is_group boolean, is_im boolean, is_mpim boolean, is_private boolean, is_archived boolean, num_members bigint, created bigint",
    "slack_messages": "channel_id string, ts string, ts_raw string, user string, type string, subtype string, thread_ts string, reply_count bigint, reply_users_count bigint",
    "zoom_users": "id string, first_name string, last_name string, display_name string, email string, dept string, status string, role_id string, timezone string, language string, phone_number string, employee_unique_id string, type double",
    "zoom_meetings": "uuid string, id double, topic string, host string, email string, start_time string, end_time string, participants double, has_video boolean, has_screen_share boolean, has_recording boolean",
    "zoom_participants": "meeting_uuid string, id string, user_id string, user_name string, email string, join_time string, leave_time string, share_desktop boolean, recording boolean",
    "jira_issue": "jira_id string, id_readable string, project_key string, issue_type string, reporter_id string, due_date string, parent_id string, created string, updated string, custom_fields_json string",
    "git_commits": "repo_owner string, repo_name string, oid string, branch_name string, default_branch_name string, author_name string, author_email string, committer_name string, committer_email string, message string, committed_date string, changed_files bigint, additions bigint, deletions bigint, parent_hashes array<string>",
    "git_pull_requests": "repo_owner string, repo_name string, database_id bigint, number bigint, title string, body string, state string, author_login string, author_email string, head_ref string, base_ref string, created_at string, updated_at string, closed_at string, merge_commit_sha string, changed_files bigint, additions bigint, deletions bigint",
    "git_file_changes": "repo_owner string, repo_name string, commit_hash string, filename string, status string, source_type string, additions bigint, deletions bigint",
    "cursor_members": "id string, name string, email string, role string, isRemoved boolean",
    "cursor_usage_events": "userEmail string, timestamp string, kind string, model string, requestsCosts double, cursorTokenFee double, chargedCents double, isTokenBasedCall boolean, isFreeBugbot boolean, maxMode boolean, isChargeable boolean, isHeadless boolean, tokenUsage string",
    "ai_admin_users": "id string, type string, email string, name string, role string, status string, added_at string, last_active_at string",
    "ai_messages_usage": "date string, model string, api_key_id string, workspace_id string, service_tier string, context_window string, uncached_input_tokens double, cache_read_tokens double, cache_creation_5m_tokens double, cache_creation_1h_tokens double, output_tokens double, web_search_requests double",
    "ai_code_usage": "date string, actor_type string, actor_identifier string, terminal_type string, session_count double, lines_added double, lines_removed double, tool_use_accepted double, tool_use_rejected double, model_breakdown_json string",
}


def bronze_schema(stream: str) -> T.StructType:
    """Envelope followed by the stream's own fields."""
    return T.StructType.fromDDL(f"{ENVELOPE}, {BRONZE[stream]}")


# Typed relations that some dashboards read before any source fills them.
BULLET_ROWS = "tenant_id string, person_id string, org_unit_id string, metric_date string, metric_key string, metric_value double"
DRILL_ROWS = "tenant_id string, person_id string, org_unit_id string, metric_date string, drill_id string, title string, source string, src_class string, value string, filter string, columns array<string>, rows array<string>"
TIMEOFF_ROWS = "tenant_id string, person_id string, org_unit_id string, metric_date string, days int, date_range string, hr_url string"
