"""Row derivations over landed raw records: states, authors, nested lists, comment routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import earliest_per_key, with_row_number

# Fixed value: "Name <mail>".
AUTHOR_PATTERN = r"^(.*?)\s*<([^>]+)>\s*$"
# The editing tools whose actions are counted.
EDIT_TOOLS = ["edit_tool", "write_tool", "multi_edit_tool", "notebook_edit_tool"]


def parse_author(df: DataFrame, col: str) -> DataFrame:
    """Split "Name <email>"; text without an address is a name only."""
    raw = F.trim(fx.or_empty(col))
    hit = raw.rlike(AUTHOR_PATTERN)
    return df.withColumns(
        {
            "author_name": F.when(hit, F.trim(F.regexp_extract(raw, AUTHOR_PATTERN, 1))).otherwise(raw),
            "author_email": F.when(hit, F.trim(F.regexp_extract(raw, AUTHOR_PATTERN, 2))).otherwise(F.lit(None)),
        }
    )


def normalize_pr_state(prs: DataFrame, merged: str = "merged", state: str = "state") -> DataFrame:
    """MERGED when merged, else CLOSED when closed, else OPEN."""
    return prs.withColumn(
        state,
        fx.multi_if(
            (F.col(merged), F.lit("MERGED")), (F.col(state) == "CLOSED", F.lit("CLOSED")), default=F.lit("OPEN")
        ),
    )


def pr_nested_lists(prs: DataFrame, labels: str = "labels", requests: str = "review_requests") -> DataFrame:
    """Label names, and requested people (have a login) apart from teams (have a slug)."""
    reqs = F.col(requests)
    return prs.withColumns(
        {
            "label_names": F.filter(F.transform(F.col(labels), lambda x: x["name"]), lambda n: fx.filled(n)),
            "requested_reviewers": F.transform(F.filter(reqs, lambda r: r["login"].isNotNull()), lambda r: r["login"]),
            "requested_teams": F.transform(
                F.filter(reqs, lambda r: r["login"].isNull() & r["slug"].isNotNull()), lambda r: r["slug"]
            ),
        }
    )


def direct_push_commits(commits: DataFrame) -> DataFrame:
    """Non-merge commits on the default branch; an unknown branch counts as default."""
    parents = F.coalesce(F.array_size("parent_hashes"), F.lit(0))
    elsewhere = (
        fx.filled("branch_name") & fx.filled("default_branch_name") & (F.col("branch_name") != F.col("default_branch_name"))
    )
    return commits.where((parents <= 1) & ~elsewhere & fx.filled("oid"))


def stale_children(parents: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parents updated after their children were last read, or never read."""
    joined = parents.join(state.select(*keys, "synced_at"), list(keys), "left")
    current = fx.filled("updated_at") & fx.filled("synced_at") & (F.col("updated_at") <= F.col("synced_at"))
    return joined.where(~current)


def pr_commit_order(pr_commits: DataFrame, pr_keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Zero-based position of each commit inside its pull request."""
    rows = pr_commits.where(fx.filled("commit_hash"))
    return with_row_number(rows, pr_keys, order, bucket, "commit_order").withColumn(
        "commit_order", F.col("commit_order") - 1
    )


def reconcile_counts(pr_commits: DataFrame, prs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pull requests whose commit rows differ from the declared count by more than one."""
    seen = pr_commits.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_seen"))
    return (
        prs.where(F.col("commit_count").isNotNull())
        .join(seen, list(keys), "left")
        .select(*keys, "commit_count", fx.or_zero("rows_seen").alias("rows_seen"))
        .where(F.abs(F.col("rows_seen") - F.col("commit_count")) > 1)
    )


def pr_comments(issue_comments: DataFrame, review_comments: DataFrame, prs: DataFrame) -> DataFrame:
    """General comments of known pull requests plus inline review comments, under distinct key prefixes."""

    def shaped(df: DataFrame, url: str, prefix: str, inline: int) -> DataFrame:
        number = fx.last_segment(url, "/").try_cast("bigint")
        path = F.col("path") if inline else F.lit(None).cast("string")
        line = F.col("line").cast("bigint") if inline else F.lit(None).cast("bigint")
        return df.withColumn("pr_number", number).where(F.col("pr_number").isNotNull()).select(
            "tenant_id",
            "source_id",
            fx.join_key(":", "tenant_id", "source_id", "repo_owner", "repo_name", F.lit(prefix), "id").alias("unique_key"),
            "repo_owner",
            "repo_name",
            "pr_number",
            F.col("id").alias("database_id"),
            "body",
            path.alias("path"),
            line.alias("line"),
            F.lit(inline).alias("is_inline"),
        )

    known = prs.select("tenant_id", "source_id", "repo_owner", "repo_name", F.col("number").alias("pr_number"))
    general = shaped(issue_comments, "issue_url", "c", 0).join(
        known, ["tenant_id", "source_id", "repo_owner", "repo_name", "pr_number"], "left_semi"
    )
    inline = shaped(review_comments, "pull_request_url", "r", 1)
    return general.unionByName(inline)


def first_branch_wins(commits: DataFrame, repo_keys: Sequence[str], hash_col: str) -> DataFrame:
    """A commit seen on several branches is kept once per repository, the default branch first."""
    not_default = fx.flag(F.col("branch_name") != F.col("default_branch_name"))
    return earliest_per_key(commits, [*repo_keys, hash_col], [not_default, "branch_name"])


def channel_type(channels: DataFrame) -> DataFrame:
    """Direct, group direct, private or public, out of the flag columns."""
    return channels.withColumn(
        "channel_type",
        fx.multi_if(
            (F.col("is_im"), F.lit("im")),
            (F.col("is_mpim"), F.lit("mpim")),
            (F.col("is_private"), F.lit("private_channel")),
            default=F.lit("public_channel"),
        ),
    )


def profile_fallback(users: DataFrame) -> DataFrame:
    """Real name out of the profile, else the top-level one."""
    return users.withColumn("real_name", F.coalesce(fx.null_if("profile_real_name", ""), F.col("real_name")))


def tool_action_totals(usage: DataFrame, tools: Sequence[str] = EDIT_TOOLS) -> DataFrame:
    """Accepted and rejected actions over the named tool structs; the actor is the key name, else the e-mail."""

    def total(field: str):
        return sum((F.coalesce(F.col(f"tool_actions.{t}.{field}"), F.lit(0)) for t in tools), F.lit(0))

    return usage.withColumns(
        {
            "tool_use_accepted": total("accepted"),
            "tool_use_rejected": total("rejected"),
            "actor_identifier": F.coalesce(
                fx.null_if("actor.api_key_name", ""), fx.null_if("actor.email", ""), F.lit("")
            ),
        }
    )


def repo_filter(repos: DataFrame, skip_archived: bool, skip_forks: bool) -> DataFrame:
    if skip_archived:
        repos = repos.where(~F.coalesce(F.col("archived"), F.lit(False)))
    if skip_forks:
        repos = repos.where(~F.coalesce(F.col("fork"), F.lit(False)))
    return repos


def explode_embedded(pr_raw: DataFrame, keys: Sequence[str], child: str) -> DataFrame:
    """One row per element of an embedded array of structs, in array order."""
    rows = pr_raw.select(*keys, F.posexplode(child).alias("position", "_item"))
    return rows.select(*keys, "position", "_item.*")


def explode_threads(pr_raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Comments of review threads, each with the resolved flag of its thread."""
    threads = pr_raw.select(*keys, F.explode("threads").alias("_t"))
    comments = threads.select(*keys, F.col("_t.is_resolved").alias("is_resolved"), F.explode("_t.comments").alias("_c"))
    return comments.select(*keys, "is_resolved", "_c.*")


def participants_to_reviewers(prs: DataFrame, keys: Sequence[str], participants: str = "participants") -> DataFrame:
    """Participant structs flattened to (display_name, uuid, nickname, role, approved, state)."""
    rows = prs.select(*keys, F.explode(participants).alias("_p"))
    return rows.select(
        *keys,
        F.col("_p.user.display_name").alias("display_name"),
        F.col("_p.user.uuid").alias("uuid"),
        F.col("_p.user.nickname").alias("nickname"),
        F.col("_p.role").alias("role"),
        F.col("_p.approved").alias("approved"),
        F.col("_p.state").alias("state"),
    )


CHANGELOG_ITEM = "array<struct<field:string,fieldId:string,from:string,fromString:string,to:string,toString:string>>"


def changelog_items(history: DataFrame, keys: Sequence[str], items: str = "items") -> DataFrame:
    """One row per changed field of a changelog entry whose items are JSON text."""
    rows = history.select(*keys, F.posexplode(F.from_json(F.col(items), CHANGELOG_ITEM)).alias("item_no", "_i"))
    return rows.select(
        *keys,
        "item_no",
        F.coalesce(F.col("_i.fieldId"), F.col("_i.field")).alias("field_id"),
        F.col("_i.field").alias("field_name"),
        F.coalesce(F.col("_i.from"), F.col("_i.fromString")).alias("from_value"),
        F.coalesce(F.col("_i.to"), F.col("_i.toString")).alias("to_value"),
    )
