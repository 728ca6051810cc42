"""CRM staging: accounts, contacts, deals, users, activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx

# Record-id prefixes of the polymorphic "what" reference.
DEAL_PREFIX = "006"
ACCOUNT_PREFIX = "001"


def _leftovers(*names: str) -> Column:
    """Fields without a column of their own, packed as a JSON object of texts."""
    packed: dict[str, Column | str] = {n: n for n in names}
    packed["IsDeleted"] = F.coalesce(F.col("IsDeleted"), F.lit(False)).cast("string")
    return fx.json_of_map(packed)


def _version() -> Column:
    return fx.to_millis(fx.parse_time("SystemModstamp"))


def _tail() -> list[Column]:
    return [
        fx.parse_time("CreatedDate").alias("created_at"),
        fx.parse_time("LastModifiedDate").alias("updated_at"),
        F.col("data_source"),
        _version().alias("_version"),
    ]


def _custom_maps() -> list[Column]:
    return [fx.empty_map("string").alias("custom_str_attrs"), fx.empty_map("double").alias("custom_num_attrs")]


def crm_accounts(accounts: DataFrame) -> DataFrame:
    renamed = {
        "account_id": "Id",
        "name": "Name",
        "domain": "Website",
        "industry": "Industry",
        "owner_id": "OwnerId",
        "parent_account_id": "ParentId",
    }
    extra = _leftovers("Type", "BillingCity", "BillingState", "BillingCountry", "NumberOfEmployees", "AnnualRevenue")
    return accounts.select("tenant_id", *[F.col(s).alias(o) for o, s in renamed.items()], extra.alias("metadata"), *_tail())


def crm_contacts(contacts: DataFrame) -> DataFrame:
    renamed = {
        "contact_id": "Id",
        "email": "Email",
        "first_name": "FirstName",
        "last_name": "LastName",
        "owner_id": "OwnerId",
        "account_id": "AccountId",
    }
    return contacts.select(
        "tenant_id",
        *[F.col(s).alias(o) for o, s in renamed.items()],
        F.lit(None).cast("string").alias("lifecycle_stage"),
        _leftovers("Title", "Phone", "LeadSource").alias("metadata"),
        *_custom_maps(),
        *_tail(),
    )


def crm_deals(opportunities: DataFrame) -> DataFrame:
    return opportunities.select(
        "tenant_id",
        F.col("Id").alias("deal_id"),
        F.col("Name").alias("name"),
        F.col("ForecastCategory").alias("pipeline"),
        F.col("StageName").alias("stage"),
        F.col("Amount").alias("amount"),
        F.col("CloseDate").try_cast("date").alias("close_date"),
        F.col("OwnerId").alias("owner_id"),
        F.col("AccountId").alias("account_id"),
        fx.flag(F.col("IsClosed")).alias("is_closed"),
        fx.flag(F.col("IsWon")).alias("is_won"),
        F.col("LeadSource").alias("lead_source"),
        F.col("Probability").alias("probability"),
        _leftovers("Type", "CurrencyIsoCode").alias("metadata"),
        *_custom_maps(),
        *_tail(),
    )


def crm_users(users: DataFrame) -> DataFrame:
    renamed = {
        "user_id": "Id",
        "email": "Email",
        "first_name": "FirstName",
        "last_name": "LastName",
        "title": "Title",
        "department": "Department",
    }
    return users.select(
        "tenant_id",
        *[F.col(s).alias(o) for o, s in renamed.items()],
        fx.flag(F.col("IsActive")).alias("is_active"),
        _leftovers("Username", "ProfileId", "UserRoleId").alias("metadata"),
        "collected_at",
        "data_source",
        _version().alias("_version"),
    )


def crm_activities(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks and calendar events under one activity shape."""

    def about(prefix: str) -> Column:
        return F.when(F.startswith(fx.or_empty("WhatId"), F.lit(prefix)), F.col("WhatId"))

    def shaped(df: DataFrame, kind: Column, at: Column, seconds: Column, outcome: Column, extra: Column) -> DataFrame:
        return df.select(
            "tenant_id",
            F.col("Id").alias("activity_id"),
            kind.alias("activity_type"),
            F.col("OwnerId").alias("owner_id"),
            F.col("WhoId").alias("contact_id"),
            about(DEAL_PREFIX).alias("deal_id"),
            about(ACCOUNT_PREFIX).alias("account_id"),
            at.alias("timestamp"),
            seconds.cast("bigint").alias("duration_seconds"),
            outcome.alias("outcome"),
            extra.alias("metadata"),
            fx.parse_time("CreatedDate").alias("created_at"),
            "data_source",
            _version().alias("_version"),
        )

    is_call = F.col("CallType").isNotNull()
    from_tasks = shaped(
        tasks,
        fx.multi_if((is_call, F.lit("call")), (F.col("TaskSubtype") == "Email", F.lit("email")), default=F.lit("task")),
        fx.parse_time(F.coalesce(F.col("ActivityDate"), F.col("CreatedDate"))),
        F.when(is_call, F.col("CallDurationInSeconds")),
        F.col("Status"),
        _leftovers("Subject", "Priority", "TaskSubtype", "CallType"),
    )
    plain = F.col("EventSubtype").isNull() | (F.col("EventSubtype") == "Event")
    from_events = shaped(
        events,
        F.when(plain, F.lit("event")).otherwise(F.lit("meeting")),
        fx.parse_time("StartDateTime"),
        F.col("DurationInMinutes") * 60,
        F.lit(None).cast("string"),
        _leftovers("Subject", "Location", "EndDateTime", "EventSubtype"),
    )
    return from_tasks.unionByName(from_events)
