"""Version-control staging: two source families brought to one column set per entity.

``hosted_*`` reads owner/name records with ready statistics, ``workspace_*``
reads workspace/slug records whose statistics must be aggregated from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx

HOSTED = "github"
WORKSPACE = "bitbucket_cloud"


def _shape(df: DataFrame, source: str, columns: dict[str, Column], prefix: str = "") -> DataFrame:
    """Envelope keys, mapped columns, then source, version and extraction time."""
    at = F.col(f"{prefix}_airbyte_extracted_at")
    return df.select(
        *[F.col(f"{prefix}{k}") for k in ("tenant_id", "source_id", "unique_key")],
        *[c.alias(name) for name, c in columns.items()],
        F.lit(source).alias("data_source"),
        fx.to_millis(at).alias("_version"),
        at.alias("_airbyte_extracted_at"),
    )


def _texts(mapping: dict[str, str]) -> dict[str, Column]:
    return {out: fx.or_empty(src) for out, src in mapping.items()}


def _counts(mapping: dict[str, str]) -> dict[str, Column]:
    return {out: fx.or_zero(src) for out, src in mapping.items()}


HOSTED_REPO = {"project_key": "repo_owner", "repo_slug": "repo_name"}
WORKSPACE_REPO = {"project_key": "workspace", "repo_slug": "repo_slug"}
AUTHORSHIP = {"author_name": "author_name", "author_email": "author_email"}
COMMITTER = {"committer_name": "committer_name", "committer_email": "committer_email"}
CHANGED_LINES = {"lines_added": "additions", "lines_removed": "deletions"}
FILE_STATS = {"files_changed": "files_changed", "lines_added": "lines_added", "lines_removed": "lines_removed"}


# --- commits -------------------------------------------------------------------------


def hosted_commits(commits: DataFrame) -> DataFrame:
    parents = F.coalesce(F.array_size("parent_hashes"), F.lit(0))
    return _shape(
        commits,
        HOSTED,
        {
            **_texts(HOSTED_REPO),
            **_texts({"commit_hash": "oid", "branch": "branch_name"}),
            **_texts(AUTHORSHIP),
            **_texts(COMMITTER),
            **_texts({"message": "message"}),
            "date": fx.parse_iso("committed_date"),
            **_counts({"files_changed": "changed_files"}),
            **_counts(CHANGED_LINES),
            "is_merge_commit": fx.flag(parents > 1),
        },
    )


def workspace_commits(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """File statistics are aggregated per commit before the join, so the join is one row to one row."""
    keys = ["tenant_id", "workspace", "repo_slug"]
    stats = file_changes.groupBy(*keys, F.col("sha").alias("hash")).agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum(fx.or_zero("additions")).alias("lines_added"),
        F.sum(fx.or_zero("deletions")).alias("lines_removed"),
    )
    joined = commits.join(stats, [*keys, "hash"], "left")
    return _shape(
        joined,
        WORKSPACE,
        {
            **_texts(WORKSPACE_REPO),
            **_texts({"commit_hash": "hash", "branch": "branch_name"}),
            **_texts(AUTHORSHIP),
            **{name: F.lit("") for name in COMMITTER},
            **_texts({"message": "message"}),
            "date": fx.parse_iso("date"),
            **_counts(FILE_STATS),
            "is_merge_commit": fx.flag(fx.json_size("parent_hashes") > 1),
        },
    )


# --- file changes ----------------------------------------------------------------------


def _file_columns(repo: dict[str, str], hash_col: str) -> dict[str, Column]:
    return {
        **_texts(repo),
        **_texts({"commit_hash": hash_col, "file_path": "filename"}),
        "file_extension": fx.file_extension("filename"),
        **_texts({"change_type": "status"}),
        **_counts(CHANGED_LINES),
        **_texts({"source_type": "source_type"}),
    }


def hosted_file_changes(file_changes: DataFrame) -> DataFrame:
    return _shape(file_changes, HOSTED, _file_columns(HOSTED_REPO, "commit_hash"))


def workspace_file_changes(file_changes: DataFrame) -> DataFrame:
    return _shape(file_changes, WORKSPACE, _file_columns(WORKSPACE_REPO, "sha"))


# --- pull requests ----------------------------------------------------------------------


def hosted_pull_requests(prs: DataFrame) -> DataFrame:
    return _shape(
        prs,
        HOSTED,
        {
            **_texts(HOSTED_REPO),
            **_counts({"pr_id": "database_id", "pr_number": "number"}),
            **_texts({"title": "title", "description": "body", "state": "state"}),
            **_texts({"author_name": "author_login", "author_email": "author_email"}),
            **_texts({"source_branch": "head_ref", "destination_branch": "base_ref"}),
            "created_on": fx.parse_iso("created_at"),
            "updated_on": fx.parse_iso("updated_at"),
            "closed_on": fx.parse_iso("closed_at"),
            **_texts({"merge_commit_hash": "merge_commit_sha"}),
            **_counts({"files_changed": "changed_files"}),
            **_counts(CHANGED_LINES),
        },
    )


ENDED_STATES = ["MERGED", "DECLINED", "SUPERSEDED"]


def workspace_pull_requests(prs: DataFrame, pr_commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """A superseded request counts as declined; ended requests close at their last update.

    Line totals come from the files of the request's commits. Files are first
    summed per commit, so the join with the commit links never fans out twice.
    """
    keys = ["tenant_id", "workspace", "repo_slug"]
    per_commit = file_changes.groupBy(*keys, F.col("sha").alias("hash")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(fx.or_zero("additions")).alias("added"),
        F.sum(fx.or_zero("deletions")).alias("removed"),
    )
    stats = (
        pr_commits.select(*keys, "hash", F.col("pr_id").alias("id"))
        .join(per_commit, [*keys, "hash"])
        .groupBy(*keys, "id")
        .agg(
            F.sum("files").alias("files_changed"),
            F.sum("added").alias("lines_added"),
            F.sum("removed").alias("lines_removed"),
        )
    )
    joined = prs.join(stats, [*keys, "id"], "left")
    return _shape(
        joined,
        WORKSPACE,
        {
            **_texts(WORKSPACE_REPO),
            **_counts({"pr_id": "id", "pr_number": "id"}),
            **_texts({"title": "title", "description": "description"}),
            "state": F.when(F.col("state") == "SUPERSEDED", F.lit("DECLINED")).otherwise(fx.or_empty("state")),
            **_texts({"author_name": "author_display_name"}),
            "author_email": F.lit(""),
            **_texts({"source_branch": "source_branch", "destination_branch": "destination_branch"}),
            "created_on": fx.parse_iso("created_on"),
            "updated_on": fx.parse_iso("updated_on"),
            "closed_on": fx.parse_iso(F.when(F.col("state").isin(ENDED_STATES), F.col("updated_on"))),
            **_texts({"merge_commit_hash": "merge_commit_hash"}),
            **_counts(FILE_STATS),
        },
    )


# --- comments, commit links, reviewers ------------------------------------------------------


def hosted_pr_comments(comments: DataFrame) -> DataFrame:
    return _shape(
        comments,
        HOSTED,
        {
            **_texts(HOSTED_REPO),
            **_counts({"pr_id": "pr_database_id", "comment_id": "database_id"}),
            **_texts({"content": "body", "author_name": "author_login"}),
            "author_uuid": fx.or_zero("author_database_id").cast("string"),
            "created_at": fx.parse_iso("created_at"),
            "updated_at": fx.parse_iso("updated_at"),
            "is_inline": fx.flag(F.col("is_inline")),
            **_texts({"file_path": "path"}),
            **_counts({"line_number": "line"}),
        },
    )


def workspace_pr_comments(comments: DataFrame) -> DataFrame:
    return _shape(
        comments,
        WORKSPACE,
        {
            **_texts(WORKSPACE_REPO),
            **_counts({"pr_id": "pr_id", "comment_id": "comment_id"}),
            **_texts({"content": "body", "author_name": "author_display_name", "author_uuid": "author_uuid"}),
            "created_at": fx.parse_iso("created_on"),
            "updated_at": fx.parse_iso("updated_on"),
            "is_inline": fx.flag(F.col("is_inline")),
            **_texts({"file_path": "inline_path"}),
            "line_number": F.coalesce(F.col("inline_to"), F.col("inline_from"), F.lit(0)),
        },
    )


def hosted_pr_commits(links: DataFrame) -> DataFrame:
    columns = {**_texts(HOSTED_REPO), **_counts({"pr_id": "pr_database_id"}), **_texts({"commit_hash": "commit_hash"})}
    return _shape(links, HOSTED, {**columns, **_counts({"commit_order": "commit_order"})})


def workspace_pr_commits(links: DataFrame) -> DataFrame:
    columns = {**_texts(WORKSPACE_REPO), **_counts({"pr_id": "pr_id"}), **_texts({"commit_hash": "hash"})}
    return _shape(links, WORKSPACE, {**columns, "commit_order": F.lit(0)})


def hosted_reviewers(reviews: DataFrame) -> DataFrame:
    return _shape(
        reviews,
        HOSTED,
        {
            **_texts(HOSTED_REPO),
            **_counts({"pr_id": "pr_database_id"}),
            **_texts({"reviewer_name": "author_login"}),
            "reviewer_uuid": fx.or_zero("author_database_id").cast("string"),
            **_texts({"status": "state"}),
            "approved": fx.flag(F.col("state") == "APPROVED"),
            "reviewed_at": fx.parse_iso("submitted_at"),
        },
    )


def workspace_reviewers(prs: DataFrame) -> DataFrame:
    """One row per participant with the reviewer role, out of a JSON array."""
    rows = prs.withColumn("_p", F.explode(fx.json_elements("participants")))
    rows = rows.where(fx.json_text("_p", "role") == "REVIEWER")
    return _shape(
        rows,
        WORKSPACE,
        {
            **_texts(WORKSPACE_REPO),
            **_counts({"pr_id": "id"}),
            "reviewer_name": fx.json_text("_p", "display_name"),
            "reviewer_uuid": fx.json_text("_p", "uuid"),
            "status": fx.json_text("_p", "state"),
            "approved": fx.flag(fx.json_flag("_p", "approved")),
            "reviewed_at": F.lit(None).cast("timestamp"),
        },
    )


# --- repositories and branches ---------------------------------------------------------------


def _repository_columns(private: str, created: Column, updated: Column) -> dict[str, Column]:
    return {
        **_texts({"name": "name", "full_name": "full_name", "description": "description"}),
        "is_private": fx.flag(F.col(private)),
        "created_on": created,
        "updated_on": updated,
        **_counts({"size": "size"}),
        **_texts({"language": "language"}),
        "has_issues": fx.flag(F.col("has_issues")),
        "has_wiki": fx.flag(F.col("has_wiki")),
        "metadata": F.lit(""),
    }


def hosted_repositories(repos: DataFrame) -> DataFrame:
    pushed = fx.parse_iso(F.coalesce(F.col("pushed_at"), F.col("updated_at")))
    return _shape(
        repos,
        HOSTED,
        {
            "project_key": fx.json_text("owner", "login"),
            **_texts({"repo_slug": "name"}),
            "repo_uuid": fx.or_zero("id").cast("string"),
            **_repository_columns("private", fx.parse_iso("created_at"), pushed),
        },
    )


def workspace_repositories(repos: DataFrame) -> DataFrame:
    return _shape(
        repos,
        WORKSPACE,
        {
            **_texts({"project_key": "workspace", "repo_slug": "slug", "repo_uuid": "uuid"}),
            **_repository_columns("is_private", fx.parse_iso("created_on"), fx.parse_iso("updated_on")),
        },
    )


def hosted_branches(branches: DataFrame) -> DataFrame:
    return _shape(
        branches,
        HOSTED,
        {
            **_texts(HOSTED_REPO),
            **_texts({"branch_name": "name"}),
            "is_default": fx.flag(F.col("name") == F.col("default_branch_name")),
            "last_commit_hash": fx.json_text("commit", "sha"),
            "last_commit_date": fx.parse_iso("pushed_at"),
        },
    )


def workspace_branches(branches: DataFrame) -> DataFrame:
    return _shape(
        branches,
        WORKSPACE,
        {
            **_texts(WORKSPACE_REPO),
            **_texts({"branch_name": "name"}),
            "is_default": fx.flag(F.col("name") == F.col("mainbranch_name")),
            "last_commit_hash": fx.json_text("target", "hash"),
            "last_commit_date": fx.parse_iso("updated_on"),
        },
    )
