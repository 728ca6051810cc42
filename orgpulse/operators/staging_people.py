"""HR directory staging: leave, working hours, people registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import newest_per_key

# Defaults used when the directory gives no schedule.
HOURS_PER_DAY = 8.0
HOURS_PER_WEEK = 40.0


def hr_leave_events(leave: DataFrame, employees: DataFrame) -> DataFrame:
    """Leave requests with both dates, beside the newest e-mail of the employee."""
    start, end = fx.parse_time("start"), fx.parse_time("end")
    people = newest_per_key(employees, ["tenant_id", "id"]).select("tenant_id", F.col("id").alias("employeeId"), F.col("workEmail").alias("email"))
    dated = leave.where(F.col("employeeId").isNotNull()).withColumns({"start_date": start, "end_date": end})
    return (
        dated.where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
        .join(people, ["tenant_id", "employeeId"], "left")
        .select(
            "tenant_id",
            "source_id",
            "unique_key",
            F.col("employeeId").alias("source_person_id"),
            "email",
            F.lit("leave").alias("event_type"),
            fx.json_text("type", "name").alias("event_subtype"),
            "start_date",
            "end_date",
            fx.json_text("amount", "amount").try_cast("double").alias("duration_amount"),
            fx.json_text("amount", "unit").alias("duration_unit"),
            fx.json_text("status", "status").alias("request_status"),
            F.lit("bamboohr").alias("source"),
            fx.parse_time("created").alias("created_at"),
            F.col("_airbyte_extracted_at").alias("ingested_at"),
        )
    )


def hr_working_hours(employees: DataFrame) -> DataFrame:
    active = employees.where((F.col("status") == "Active") & F.col("id").isNotNull() & F.col("workEmail").isNotNull())
    return active.select(
        "tenant_id",
        "source_id",
        "unique_key",
        F.col("id").alias("source_person_id"),
        F.col("workEmail").alias("email"),
        F.coalesce("displayName", "workEmail").alias("display_name"),
        F.col("employmentHistoryStatus").alias("employment_type"),
        F.lit("bamboohr").alias("source"),
        F.lit(HOURS_PER_DAY).alias("working_hours_per_day"),
        F.lit(HOURS_PER_WEEK).alias("working_hours_per_week"),
        F.col("_airbyte_extracted_at").alias("ingested_at"),
    )


def hr_people(employees: DataFrame) -> DataFrame:
    """Current-state people registry; the person id is filled by identity resolution later."""
    renamed = {
        "source_person_id": "id",
        "employee_number": "employeeNumber",
        "display_name": "displayName",
        "first_name": "firstName",
        "last_name": "lastName",
        "email": "workEmail",
        "job_title": "jobTitle",
        "department_name": "department",
    }
    status = fx.multi_if(
        (F.col("status") == "Active", F.lit("active")),
        (F.col("employmentHistoryStatus") == "Terminated", F.lit("terminated")),
        default=F.lit("active"),
    )
    return employees.select(
        "tenant_id",
        "source_id",
        "unique_key",
        fx.or_empty("tenant_id").alias("workspace_id"),
        F.lit(None).cast("string").alias("person_id"),
        F.col("lastChanged").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit("bamboohr").alias("source"),
        *[F.col(src).alias(out) for out, src in renamed.items()],
        F.lit(None).cast("string").alias("org_unit_id"),
        F.col("supervisorEId").alias("manager_person_id"),
        status.alias("status"),
        F.lit("full_time").alias("employment_type"),
        fx.parse_time("hireDate").alias("hire_date"),
        fx.parse_time("terminationDate").alias("termination_date"),
        "location",
        "country",
        F.lit(None).cast("double").alias("fte"),
        F.create_map(F.lit("division"), fx.or_empty("division")).alias("custom_str_attrs"),
        fx.empty_map("double").alias("custom_num_attrs"),
        F.col("_airbyte_extracted_at").alias("ingested_at"),
    )
