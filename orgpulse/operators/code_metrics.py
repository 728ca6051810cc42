"""Reports over version control: rankings, churn, repository and request properties, ticket links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx

REPO = ["tenant_id", "project_key", "repo_slug"]
# Ticket references in free text.
TICKET_PATTERN = r"([A-Z]+-[0-9]+|#[0-9]+)"
HOTFIX_PATTERN = r"(?i)(hotfix|^fix/)"
DOCS_PATTERN = r"(?i)(\.md$|\.rst$|\.txt$|(^|/)docs?/)"
EXTENSION_PATTERN = r"\.([^.]+)$"
STALE_DAYS = 90


def commit_rankings(commit_fact: DataFrame, top: int) -> DataFrame:
    ranked = commit_fact.groupBy("tenant_id", "person_key").agg(
        F.count(F.lit(1)).alias("commit_count"), F.min("date").alias("first_commit"), F.max("date").alias("last_commit")
    )
    return ranked.orderBy(F.desc("commit_count"), "tenant_id", "person_key").limit(top)


def file_hotspots(file_changes: DataFrame, top: int) -> DataFrame:
    changed = file_changes.groupBy("tenant_id", "file_path").agg(
        F.count(F.lit(1)).alias("change_count"), F.sum("lines_added").alias("total_added"), F.sum("lines_removed").alias("total_removed")
    )
    return changed.orderBy(F.desc("change_count"), "tenant_id", "file_path").limit(top)


def loc_by_extension(file_changes: DataFrame) -> DataFrame:
    """Lines and distinct commits per extension; commits are folded first so no extension holds a distinct set."""
    per_commit = file_changes.groupBy(
        "tenant_id", F.regexp_extract("file_path", EXTENSION_PATTERN, 1).alias("extension"), "commit_hash"
    ).agg(F.sum("lines_added").alias("a"), F.sum("lines_removed").alias("r"))
    return per_commit.groupBy("tenant_id", "extension").agg(
        F.sum("a").alias("lines_added"), F.sum("r").alias("lines_removed"), F.count(F.lit(1)).alias("commits")
    )


def daily_churn(file_fact: DataFrame) -> DataFrame:
    per_commit = file_fact.groupBy("tenant_id", F.to_date("committed_at").alias("day"), "commit_hash").agg(
        F.sum("lines_added").alias("a"), F.sum("lines_removed").alias("r")
    )
    return per_commit.groupBy("tenant_id", "day").agg(
        F.sum("a").alias("added"), F.sum("r").alias("removed"), F.count(F.lit(1)).alias("commits")
    )


def loc_snapshot_trend(loc: DataFrame, keys: Sequence[str]) -> DataFrame:
    return loc.groupBy(*keys, "snapshot_date").agg(F.sum("loc").alias("total_loc"), F.count(F.lit(1)).alias("files"))


def largest_files(loc: DataFrame, top: int) -> DataFrame:
    """Largest files of the newest snapshot."""
    newest = loc.agg(F.max("snapshot_date").alias("d")).scalar()
    rows = loc.where((F.col("snapshot_date") == newest) & (F.col("loc") > 0))
    return rows.orderBy(F.desc("loc"), "tenant_id", "file_id").limit(top)


def name_variants(commits: DataFrame) -> DataFrame:
    """E-mails used with more than one author name. Names are made distinct before they are listed."""
    names = commits.where(fx.filled("author_email")).select("tenant_id", F.lower("author_email").alias("email"), "author_name").distinct()
    counted = names.groupBy("tenant_id", "email").agg(F.count(F.lit(1)).alias("name_variants"))
    return names.join(counted.where(F.col("name_variants") > 1), ["tenant_id", "email"])


def stale_branches(branches: DataFrame, as_of: str, days: int) -> DataFrame:
    """Branches not read for some days, or never; never-read ones first."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return branches.where(F.col("last_synced_at").isNull() | (F.col("last_synced_at") < limit)).orderBy(
        F.asc_nulls_first("last_synced_at"), "branch_name"
    )


def eav_pivot(base: DataFrame, ext: DataFrame, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Extension rows (field_id, typed values) as columns of the base entity. ``fields`` maps field id to value column."""
    picks = [F.max(F.when(F.col("field_id") == f, F.col(v))).alias(f) for f, v in fields.items()]
    wide = ext.where(F.col("field_id").isin(list(fields))).groupBy(*keys).agg(*picks)
    return base.join(wide, list(keys), "left")


def repo_activity_props(commits: DataFrame, prs: DataFrame, as_of: str) -> DataFrame:
    """Contributors over 30/90 days and all time, commit and request frequency, last activity, stale flag."""
    end = F.lit(as_of).cast("timestamp")

    def within(col: str, days: int) -> Column:
        return (F.col(col) > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(col) <= end)

    # One row per repository and author first: distinct contributors become plain counts.
    per_author = commits.groupBy(*REPO, "person_key").agg(
        fx.count_where(within("date", 30)).alias("c30"), fx.count_where(within("date", 90)).alias("c90"), F.max("date").alias("last")
    )
    from_commits = per_author.groupBy(*REPO).agg(
        fx.count_where(F.col("c30") > 0).alias("active_contributors_30d"),
        fx.count_where(F.col("c90") > 0).alias("active_contributors_90d"),
        F.count(F.lit(1)).alias("total_contributors"),
        (F.sum("c30") / F.lit(30.0)).alias("commit_frequency_30d"),
        F.max("last").alias("last_commit"),
    )
    from_prs = prs.groupBy(*REPO).agg(
        (fx.count_where(within("created_on", 30)) / F.lit(30.0)).alias("pr_frequency_30d"), F.max("created_on").alias("last_pr")
    )
    joined = from_commits.join(from_prs, REPO, "full")
    last = F.greatest("last_commit", "last_pr")
    counts = ["active_contributors_30d", "active_contributors_90d", "total_contributors", "commit_frequency_30d", "pr_frequency_30d"]
    return joined.select(
        *REPO,
        *[fx.or_zero(c).alias(c) for c in counts],
        F.to_date(last).cast("string").alias("last_activity_date"),
        fx.flag(last < end - F.expr(f"INTERVAL {STALE_DAYS} DAYS")).alias("is_stale"),
    )


PR_KEY = [*REPO, "pr_id"]


def pr_props(prs: DataFrame, reviews: DataFrame, pr_commits: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Hours first commit to merge, creation to first review and to first approval; reviewers; hotfix and docs-only flags.

    Commits and files are folded per commit, then per request; each join is on a unique key.
    """
    commit_key = [*REPO, "commit_hash"]
    per_commit = commits.groupBy(*commit_key).agg(F.min("date").alias("date"))
    docs = files.groupBy(*commit_key).agg(F.min(fx.flag(fx.matches("file_path", DOCS_PATTERN))).alias("docs"))
    # A link given twice changes neither minimum, so links aren't dealt once more to be made distinct.
    links = pr_commits.select(*PR_KEY, "commit_hash")
    from_commits = (
        links.join(per_commit, commit_key, "left").join(docs, commit_key, "left")
        .groupBy(*PR_KEY)
        .agg(F.min("date").alias("first_commit"), F.min("docs").alias("_docs"))
    )
    per_reviewer = reviews.groupBy(*PR_KEY, "person_key").agg(
        F.min("reviewed_at").alias("first"), F.min(F.when(F.col("approved") == 1, F.col("reviewed_at"))).alias("approval")
    )
    from_reviews = per_reviewer.groupBy(*PR_KEY).agg(
        F.min("first").alias("first_review"), F.min("approval").alias("first_approval"), F.count(F.lit(1)).alias("reviewers")
    )
    merged_at = F.when(F.col("state_norm") == "merged", F.col("closed_on"))
    joined = prs.join(from_commits, PR_KEY, "left").join(from_reviews, PR_KEY, "left")
    return joined.select(
        *PR_KEY,
        "person_key",
        fx.hours_between("first_commit", merged_at).alias("cycle_time_hours"),
        fx.hours_between("created_on", "first_review").alias("pickup_time_hours"),
        fx.hours_between("created_on", "first_approval").alias("approval_velocity"),
        fx.hours_between("first_review", merged_at).alias("review_time_hours"),
        fx.or_zero("reviewers").alias("reviewers"),
        fx.flag(fx.matches("source_branch", HOTFIX_PATTERN) | fx.matches("title", HOTFIX_PATTERN)).alias("hotfix_flag"),
        fx.or_zero("_docs").alias("docs_only_flag"),
    )


def review_participation(pr_properties: DataFrame, team_sizes: DataFrame) -> DataFrame:
    """Share of the team that reviewed each request. ``team_sizes``: tenant_id, team_size."""
    return pr_properties.join(team_sizes, "tenant_id").select(
        *PR_KEY, fx.ratio("reviewers", "team_size").alias("review_participation_ratio")
    )


def ticket_refs(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """Ticket ids in commit messages, request titles and descriptions, one row per id and place."""

    def found(df: DataFrame, col: str, place: str, pr_id: Column, commit: Column) -> DataFrame:
        ids = F.array_distinct(F.regexp_extract_all(fx.or_empty(col), F.lit(TICKET_PATTERN), F.lit(1)))
        return df.select(
            "tenant_id",
            "source_id",
            F.explode(ids).alias("external_ticket_id"),
            "project_key",
            "repo_slug",
            pr_id.cast("bigint").alias("pr_id"),
            commit.cast("string").alias("commit_hash"),
            F.lit(place).alias("ticket_source"),
        )

    none = F.lit(None)
    return (
        found(commits, "message", "COMMIT_MESSAGE", none, F.col("commit_hash"))
        .unionByName(found(prs, "title", "PR_TITLE", F.col("pr_id"), none))
        .unionByName(found(prs, "description", "PR_DESCRIPTION", F.col("pr_id"), none))
    )


def code_to_tasks(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Code references beside the task they name."""
    named = tasks.select("tenant_id", F.col("id_readable").alias("external_ticket_id"), "issue_type", "status_name")
    return refs.join(named, ["tenant_id", "external_ticket_id"])


def git_team_metrics(commit_fact: DataFrame, pr_fact: DataFrame, comments: DataFrame, review_fact: DataFrame) -> DataFrame:
    """Per repository: commits per active day, merge rate, comments per request, share of requests reviewed, weekly merges."""
    days = commit_fact.groupBy(*REPO, F.to_date("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    commits = days.groupBy(*REPO).agg(F.sum("n").alias("commits"), F.count(F.lit(1)).alias("active_days"))
    weeks = pr_fact.groupBy(*REPO, fx.monday_week("closed_on").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), fx.count_where(F.col("state_norm") == "merged").alias("m")
    )
    prs = weeks.groupBy(*REPO).agg(
        F.sum("n").alias("prs"), F.sum("m").alias("merged"), fx.count_where(F.col("m") > 0).alias("merge_weeks")
    )
    talk = comments.groupBy(*REPO).agg(F.count(F.lit(1)).alias("comments"))
    reviewed = review_fact.select(*PR_KEY).distinct().groupBy(*REPO).agg(F.count(F.lit(1)).alias("reviewed"))
    out = commits.join(prs, REPO, "full").join(talk, REPO, "left").join(reviewed, REPO, "left")
    return out.select(
        *REPO,
        fx.ratio("commits", "active_days").alias("commit_frequency"),
        fx.ratio("merged", "prs").alias("merge_rate"),
        fx.ratio(fx.or_zero("comments"), "prs").alias("review_depth"),
        fx.ratio(fx.or_zero("reviewed"), "prs").alias("review_participation"),
        fx.ratio("merged", "merge_weeks").alias("weekly_throughput"),
    )


def language_mix(file_fact: DataFrame) -> DataFrame:
    """Share of added lines per extension inside each repository; the total is a second aggregate, not a window."""
    keys = REPO
    lines = file_fact.groupBy(*keys, "file_extension").agg(F.sum("lines_added").alias("lines_added"))
    totals = lines.groupBy(*keys).agg(F.sum("lines_added").alias("_t"))
    return lines.join(totals, keys).withColumn("share", fx.ratio("lines_added", "_t")).drop("_t")
