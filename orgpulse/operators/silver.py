"""Silver facts (one row in, one row out) and the first aggregates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import newest_per_key

# File categories by path; the first match wins, everything else is code.
SPEC_PATTERN = r"(?i)(\.spec\.|\.test\.|__tests__/|/tests?/)"
CONFIG_PATTERN = r"(?i)(\.lock$|package-lock\.json|yarn\.lock|poetry\.lock|\.ya?ml$|\.toml$|\.cfg$|\.ini$)"

COMMIT_KEYS = ["tenant_id", "source_id", "project_key", "repo_slug", "commit_hash"]
# A sort compares keys in this order; hashes differ in their first bytes, the others hold few values.
HASH_FIRST = ["commit_hash", *COMMIT_KEYS[:-1]]


def map_slack_comms(slack: DataFrame) -> DataFrame:
    """Chat events under the column names of the shared communication class."""
    return slack.select(
        "tenant_id",
        "source_id",
        "unique_key",
        F.lit(None).cast("string").alias("user_email"),
        F.col("slack_user_id").alias("user_name"),
        F.lit(None).cast("double").alias("emails_sent"),
        F.col("activity_date").cast("string").alias("activity_date"),
        "event_type",
        F.lit(None).cast("bigint").alias("duration_seconds"),
        "source",
        "channel_id",
        "channel_type",
        "is_thread_reply",
        "reply_count",
    )


def git_commit_fact(commits: DataFrame) -> DataFrame:
    return commits.withColumns(
        {"person_key": fx.person_key("author_email", "author_name"), "week": fx.monday_week("date")}
    )


def file_category(path: str):
    return fx.multi_if(
        (fx.matches(path, SPEC_PATTERN), F.lit("spec")),
        (fx.matches(path, CONFIG_PATTERN), F.lit("config")),
        default=F.lit("code"),
    )


def git_file_change_fact(file_changes: DataFrame, commit_fact: DataFrame) -> DataFrame:
    """File changes with a known commit, carrying its author, week and merge flag."""
    commit = commit_fact.select(
        *COMMIT_KEYS, "author_name", "author_email", "person_key", F.col("date").alias("committed_at"), "week", "is_merge_commit"
    )
    joined = file_changes.withColumn("file_category", file_category("file_path")).join(commit, HASH_FIRST)
    return joined.select(*COMMIT_KEYS, *[c for c in joined.columns if c not in COMMIT_KEYS])


def git_pr_fact(prs: DataFrame) -> DataFrame:
    """Normalised state, author key, and hours from creation to merge (NULL when impossible)."""
    measurable = (F.lower("state") == "merged") & (F.col("closed_on") >= F.col("created_on"))
    return prs.withColumns(
        {
            "state_norm": F.lower("state"),
            "person_key": fx.person_key("author_email", "author_name"),
            "cycle_time_h": F.when(measurable, fx.hours_between("created_on", "closed_on")),
        }
    )


def git_review_fact(reviewers: DataFrame) -> DataFrame:
    return reviewers.withColumn("person_key", F.lower("reviewer_name"))


def git_person_totals(pr_fact: DataFrame, commit_fact: DataFrame, file_fact: DataFrame) -> DataFrame:
    """Requests, non-merge commits and clean code lines per person, joined full outer."""
    keys = ["tenant_id", "person_key"]
    named = F.col("person_key") != ""
    prs = pr_fact.where(named).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prs_created"),
        fx.count_where(F.col("state_norm") == "merged").alias("prs_merged"),
        F.avg("cycle_time_h").alias("avg_pr_cycle_time_h"),
    )
    commits = commit_fact.where((F.col("is_merge_commit") == 0) & named).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum(F.col("lines_added") + F.col("lines_removed")).alias("loc"),
    )
    code = (F.col("is_merge_commit") == 0) & (F.col("file_category") == "code") & named
    clean = file_fact.where(code).groupBy(*keys).agg(F.sum("lines_added").alias("clean_loc"))
    zero = ["prs_created", "prs_merged", "commits", "loc", "clean_loc"]
    joined = prs.join(commits, keys, "full").join(clean, keys, "full")
    return joined.select(
        *keys,
        fx.join_key("|", *keys).alias("unique_key"),
        *[fx.or_zero(c).alias(c) for c in zero],
        "avg_pr_cycle_time_h",
    )


def git_person_weekly(pr_fact: DataFrame, commit_fact: DataFrame, file_fact: DataFrame) -> DataFrame:
    """Commits, code and spec lines and merged requests per person and Monday week.

    A merged request counts in the week of its merge commit, else of its closing.
    """
    keys = ["tenant_id", "person_key", "week"]
    named = F.col("person_key") != ""
    authored = (F.col("is_merge_commit") == 0) & named
    commits = commit_fact.where(authored & F.col("date").isNotNull()).select(*keys, F.lit(1).alias("commits"))
    lines = lambda category: F.when(F.col("file_category") == category, F.col("lines_added"))
    loc = file_fact.where(authored & F.col("week").isNotNull()).select(
        *keys, lines("code").alias("code_loc"), lines("spec").alias("spec_lines")
    )
    merge_keys = ["merge_commit_hash", *COMMIT_KEYS[:-1]]
    # One week per commit hash, so that a hash stored twice cannot multiply requests.
    merges = commit_fact.groupBy(
        *COMMIT_KEYS[:-1], F.col("commit_hash").alias("merge_commit_hash")
    ).agg(F.max("week").alias("merge_week"))
    merged = pr_fact.where((F.col("state_norm") == "merged") & F.col("closed_on").isNotNull() & named)
    prs = (
        merged.join(merges, merge_keys, "left")
        .withColumn("week", F.coalesce(F.col("merge_week"), fx.monday_week("closed_on")))
        .select(*keys, F.lit(1).alias("prs_merged"))
    )
    # Counts of all three kinds are added up together, so each row is dealt once and nothing is sorted by person.
    # Keys with a NULL meet no other, as in a full join: each kind keeps a row of its own.
    unknown = fx.any_of([F.col(k).isNull() for k in keys])
    parts = [df.withColumn("_kind", F.when(unknown, F.lit(i))) for i, df in enumerate((commits, loc, prs))]
    measures = ["commits", "prs_merged", "code_loc", "spec_lines"]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    totals = together.groupBy(*keys, "_kind").agg(*[F.sum(c).alias(c) for c in measures])
    return totals.select(
        *keys, fx.join_key("|", *keys).alias("unique_key"), *[fx.or_zero(c).alias(c) for c in measures]
    )


def focus_metrics(comms: DataFrame, working_hours: DataFrame) -> DataFrame:
    """Meeting load and focus share per tenant, e-mail and day.

    Meetings are folded per person and day first, so the working-hours join
    meets one row per person-day; of several schedules of a person the newest counts. Both ends of
    the focus share are bounded.
    """
    keys = ["tenant_id", "email"]
    meeting = F.col("event_type") == "meeting_participation"
    day = fx.parse_day("activity_date")
    daily = (
        comms.where(fx.filled("user_email"))
        .groupBy("tenant_id", F.lower("user_email").alias("email"), day.alias("day"))
        .agg(
            fx.count_where(meeting).alias("meetings_count"),
            fx.sum_where("duration_seconds", meeting).alias("_seconds"),
        )
        .where(F.col("day").isNotNull())
    )
    hours = newest_per_key(working_hours.withColumn("email", F.lower("email")), keys, ["ingested_at", "_airbyte_extracted_at"])
    hours = hours.select(*keys, "working_hours_per_day")
    joined = daily.join(hours, keys, "left")
    base = F.coalesce(F.col("working_hours_per_day"), F.lit(8.0))
    met = F.col("_seconds") / F.lit(3600.0)
    return joined.select(
        *keys,
        "day",
        fx.join_key("-", "tenant_id", "email", "day").alias("unique_key"),
        "meetings_count",
        F.round(met, 4).alias("meeting_hours"),
        base.alias("working_hours_per_day"),
        F.round(fx.clamp(100.0 - fx.ratio(met, base) * 100.0, 0, 100), 2).alias("focus_time_pct"),
        F.round(F.greatest(F.lit(0.0), base - met), 4).alias("dev_time_h"),
    )
