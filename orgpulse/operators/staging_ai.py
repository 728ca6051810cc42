"""AI coding-tool staging: usage events, code sessions, API token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import newest_per_key


def cursor_dev_usage(resync: DataFrame, realtime: DataFrame, today: Column | str) -> DataFrame:
    """Completed days from the authoritative table, the current day from the near-real-time one."""
    today = F.lit(today).cast("date") if isinstance(today, str) else today
    day = F.to_date(fx.time_from_millis("timestamp"))
    rows = resync.where(day < today).unionByName(realtime.where(day == today))
    renamed = {
        "user_email": "userEmail",
        "event_timestamp": "timestamp",
        "event_kind": "kind",
        "model": "model",
        "request_cost": "requestsCosts",
        "platform_fee": "cursorTokenFee",
        "is_token_based": "isTokenBasedCall",
        "is_free_bugbot": "isFreeBugbot",
        "max_mode": "maxMode",
    }
    tokens = {
        "input_tokens": "inputTokens",
        "output_tokens": "outputTokens",
        "cache_read_tokens": "cacheReadTokens",
        "cache_write_tokens": "cacheWriteTokens",
        "total_cents": "totalCents",
    }
    return rows.select(
        "tenant_id",
        "source_id",
        "unique_key",
        *[F.col(src).alias(out) for out, src in renamed.items()],
        *[fx.json_number("tokenUsage", src).alias(out) for out, src in tokens.items()],
        F.lit("cursor").alias("source"),
    )


def code_dev_usage(usage: DataFrame, client: str, provider: str) -> DataFrame:
    """Coding sessions of people (not of API keys)."""
    return usage.where(F.col("actor_type") == "user").select(
        "tenant_id",
        "source_id",
        fx.join_key("|", "date", "actor_identifier", "terminal_type").alias("unique_key"),
        F.col("date").alias("report_date"),
        F.col("actor_identifier").alias("email"),
        "terminal_type",
        "session_count",
        "lines_added",
        "lines_removed",
        "tool_use_accepted",
        "tool_use_rejected",
        F.lit(None).cast("string").alias("person_id"),
        F.lit(provider).alias("provider"),
        F.lit(client).alias("client"),
    )


def api_usage(usage: DataFrame, api_keys: DataFrame, workspaces: DataFrame, provider: str) -> DataFrame:
    """Token totals per key, workspace and model, with the newest names of key and workspace."""
    keys = newest_per_key(api_keys, ["tenant_id", "id"]).select("tenant_id", F.col("id").alias("api_key_id"), F.col("name").alias("key_name"))
    spaces = newest_per_key(workspaces, ["tenant_id", "id"]).select(
        "tenant_id", F.col("id").alias("workspace_id"), F.col("display_name").alias("workspace_name")
    )
    creation = F.col("cache_creation_5m_tokens") + F.col("cache_creation_1h_tokens")
    total_in = F.col("uncached_input_tokens") + F.col("cache_read_tokens") + creation
    identity = ["date", "model", "api_key_id", "workspace_id", "service_tier", "context_window"]
    return (
        usage.join(keys, ["tenant_id", "api_key_id"], "left")
        .join(spaces, ["tenant_id", "workspace_id"], "left")
        .select(
            "tenant_id",
            "source_id",
            fx.join_key("|", *identity).alias("unique_key"),
            F.col("date").alias("report_date"),
            "model",
            "api_key_id",
            "key_name",
            "workspace_id",
            "workspace_name",
            "service_tier",
            "context_window",
            "uncached_input_tokens",
            "cache_read_tokens",
            "cache_creation_5m_tokens",
            "cache_creation_1h_tokens",
            creation.alias("cache_creation_tokens"),
            "output_tokens",
            total_in.alias("total_input_tokens"),
            (total_in + F.col("output_tokens")).alias("total_tokens"),
            "web_search_requests",
            F.lit(None).cast("string").alias("person_id"),
            F.lit(provider).alias("provider"),
        )
    )
