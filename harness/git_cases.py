"""Version-control queries: landing rules, staging, Silver facts, reports."""

from pyspark.sql import functions as F

from harness.cases import VIEWS, Tables, case
from orgpulse.functions import scalars as fx
from orgpulse.operators import code_metrics as cm
from orgpulse.operators import silver
from orgpulse.operators import staging_git as sg
from orgpulse.plans.registry import Registry, union_by_tag
from orgpulse.sources import derive, landing

V = VIEWS
_TAIL = "'{src}' AS data_source, epoch_us(_airbyte_extracted_at) // 1000 AS _version, _airbyte_extracted_at::VARCHAR AS _airbyte_extracted_at"
_GH = _TAIL.format(src="github")
_BB = _TAIL.format(src="bitbucket_cloud")
_KEYS = "tenant_id, source_id, unique_key"
_GREPO = "COALESCE(repo_owner,'') AS project_key, COALESCE(repo_name,'') AS repo_slug"
_BREPO = "COALESCE(workspace,'') AS project_key, COALESCE(repo_slug,'') AS repo_slug"
_EXT = "CASE WHEN strpos(filename, '.') > 0 THEN regexp_extract(filename, '\\.([^.]*)$', 1) ELSE '' END AS file_extension"


# Oracle views keep timestamps typed; the final SELECT of each case turns them into text.
# What the tables must hold is said of orders, lineitem and part themselves, not of the bound tables.
_ORDER = "'t' || (o_orderkey % 2) AS tenant_id, '{source}' AS source_id, '{source}:{kind}:' || o_orderkey AS unique_key, '{owner}' || (o_orderkey % 3) AS project_key, '{repo}' || (o_orderkey % {repos}) AS repo_slug"
_LANDED = "1706745600000 AS _version, '2024-02-01 00:00:00' AS _airbyte_extracted_at"
_MAIL = "if(o_custkey % 9 = 0, '', 'User' || o_custkey || '@Example.com')"
V["v_order_files"] = """
SELECT l_orderkey AS k, count(*) AS files, sum(floor(l_quantity))::BIGINT AS added, sum(if(l_linenumber = 5, 0, l_linenumber))::BIGINT AS removed
FROM <lineitem> WHERE l_partkey IN (SELECT p_partkey FROM <part>) GROUP BY l_orderkey"""
V["v_hosted_commits"] = f"""
SELECT 'github' AS data_source, {_LANDED}, {_ORDER.format(source="gh", kind="c", owner="org", repo="repo", repos=11)}, (o_orderpriority = '4-NOT SPECIFIED')::INT AS is_merge_commit,
  o_orderkey % 9 AS files_changed, floor(o_totalprice / 1000)::BIGINT AS lines_added, if(o_orderkey % 6 = 0, 0, o_orderkey % 50) AS lines_removed,
  'c' || o_orderkey AS commit_hash, if(o_orderkey % 71 = 0, NULL, o_orderdate::TIMESTAMP) AS date,
  if(o_orderkey % 5 = 0, 'dev', if(o_orderkey % 31 = 0, '', 'main')) AS branch, 'PROJ-' || (o_orderkey + 1) || ' change, closes #' || (o_orderkey % 90) || ' and #' || (o_orderkey % 7) AS message,
  'Dev ' || o_custkey AS author_name, 'Dev ' || o_custkey AS committer_name, if(o_custkey % 13 = 0, '', {_MAIL}) AS author_email, if(o_custkey % 9 = 0, '', 'c@example.com') AS committer_email
FROM <orders>"""
V["v_ws_commits"] = f"""
SELECT 'bitbucket_cloud' AS data_source, {_LANDED}, {_ORDER.format(source="bb", kind="c", owner="ws", repo="slug", repos=7)}, (o_orderpriority = '5-LOW')::INT AS is_merge_commit,
  ifnull(files, 0) AS files_changed, ifnull(added, 0) AS lines_added, ifnull(removed, 0) AS lines_removed, 'b' || o_orderkey AS commit_hash, o_orderdate::TIMESTAMP AS date,
  'main' AS branch, if(o_orderkey % 6 = 0, '', 'work on #' || (o_orderkey % 12)) AS message, 'User' || o_custkey AS author_name, {_MAIL} AS author_email, '' AS committer_name, '' AS committer_email
FROM <orders> LEFT JOIN <v_order_files> ON k = o_orderkey"""
V["v_hosted_files"] = f"""
SELECT {_KEYS}, {_GREPO}, COALESCE(commit_hash,'') AS commit_hash, COALESCE(filename,'') AS file_path, {_EXT}, COALESCE(status,'') AS change_type,
  COALESCE(additions,0) AS lines_added, COALESCE(deletions,0) AS lines_removed, COALESCE(source_type,'') AS source_type, {_GH} FROM <b_file_changes>"""
V["v_ws_files"] = f"""
SELECT {_KEYS}, {_BREPO}, COALESCE(sha,'') AS commit_hash, COALESCE(filename,'') AS file_path, {_EXT}, COALESCE(status,'') AS change_type,
  COALESCE(additions,0) AS lines_added, COALESCE(deletions,0) AS lines_removed, COALESCE(source_type,'') AS source_type, {_BB} FROM <b_ws_file_changes>"""
V["v_hosted_prs"] = f"""
SELECT 'github' AS data_source, {_LANDED}, {_ORDER.format(source="gh", kind="p", owner="org", repo="repo", repos=11)}, o_orderkey AS pr_id, o_orderkey AS pr_number,
  CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'P' THEN 'CLOSED' ELSE 'OPEN' END AS state, o_orderdate::TIMESTAMP AS created_on, o_orderdate::TIMESTAMP AS updated_on,
  if(o_orderstatus = 'O', NULL, o_orderdate::TIMESTAMP + INTERVAL 1 HOUR * ((o_orderkey * 37) % 2000 - 200)) AS closed_on,
  o_orderkey % 9 AS files_changed, floor(o_totalprice / 1000)::BIGINT AS lines_added, o_orderkey % 40 AS lines_removed, 'c' || (o_orderkey + 66) AS merge_commit_hash,
  if(o_orderkey % 25 = 0, 'Hotfix', 'Change') || ' for PROJ-' || (o_orderkey + 2) AS title, if(o_orderkey % 4 = 0, '', 'See #' || (o_orderkey % 30)) AS description,
  if(o_orderkey % 13 = 0, 'hotfix/x', 'feature/x') AS source_branch, 'main' AS destination_branch, 'Dev ' || o_custkey AS author_name, {_MAIL} AS author_email
FROM <orders>"""
# Line n of an order links its pull request to the commit of the order 42 * (n - 1) further on.
V["v_ws_prs"] = f"""
WITH reached AS (SELECT l_orderkey AS pr, sum(files)::BIGINT AS files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed
  FROM <lineitem> JOIN <v_order_files> ON k = l_orderkey + 42 * (l_linenumber - 1) GROUP BY l_orderkey),
seen AS (SELECT *, o_orderdate::TIMESTAMP + INTERVAL 1 HOUR * (o_orderkey % 100) AS touched, if(o_orderkey % 9 = 0, 'DECLINED', CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'P' THEN 'DECLINED' ELSE 'OPEN' END) AS state FROM <orders>)
SELECT 'bitbucket_cloud' AS data_source, {_LANDED}, {_ORDER.format(source="bb", kind="p", owner="ws", repo="slug", repos=7)}, o_orderkey AS pr_id, o_orderkey AS pr_number, state,
  o_orderdate::TIMESTAMP AS created_on, touched AS updated_on, if(state = 'OPEN', NULL, touched) AS closed_on,
  ifnull(files, 0) AS files_changed, ifnull(added, 0) AS lines_added, ifnull(removed, 0) AS lines_removed, if(o_orderkey % 2 = 0, '', 'b' || (o_orderkey + 42)) AS merge_commit_hash,
  'PR ' || o_orderkey AS title, if(o_orderkey % 3 = 0, '', 'text') AS description, 'feature/y' AS source_branch, 'main' AS destination_branch, 'User' || o_custkey AS author_name, '' AS author_email
FROM seen LEFT JOIN reached ON pr = o_orderkey"""
# A line of an order is a comment on its pull request, a link to a commit and, on one host, a review.
_LINE = "'t' || (l_orderkey % 2) AS tenant_id, '{source}' AS source_id, concat_ws(':', '{source}', '{kind}', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unique_key, '{owner}' || (l_orderkey % 3) AS project_key, '{repo}' || (l_orderkey % {repos}) AS repo_slug, l_orderkey AS pr_id"
_ON_HOST = f"SELECT 'github' AS data_source, {_LANDED}, " + _LINE.replace("{source}", "gh").replace("{owner}", "org").replace("{repo}", "repo").replace("{repos}", "11")
_ON_WS = f"SELECT 'bitbucket_cloud' AS data_source, {_LANDED}, " + _LINE.replace("{source}", "bb").replace("{owner}", "ws").replace("{repo}", "slug").replace("{repos}", "7")
_SAID = "l_orderkey * 10 + l_linenumber AS comment_id, l_shipdate::TIMESTAMP AS created_at, l_shipdate::TIMESTAMP AS updated_at"
V["v_hosted_comments"] = f"""
{_ON_HOST.format(kind="m")}, {_SAID}, 'note ' || l_partkey AS content, 'Dev ' || l_suppkey AS author_name, l_suppkey::VARCHAR AS author_uuid,
  1 - l_linenumber % 2 AS is_inline, ['src/a.py', ''][l_linenumber % 2 + 1] AS file_path, l_partkey * (1 - l_linenumber % 2) AS line_number FROM <lineitem>"""
V["v_ws_comments"] = f"""
{_ON_WS.format(kind="m")}, {_SAID}, 'c' || l_partkey AS content, 'User' || l_suppkey AS author_name, 'u' || l_suppkey AS author_uuid,
  (l_linenumber % 3 = 0)::INT AS is_inline, if(l_linenumber % 3 = 0, 'a/b.c', '') AS file_path, if(l_linenumber % 2 = 0, l_partkey, if(l_linenumber % 3 = 0, l_suppkey, 0)) AS line_number FROM <lineitem>"""
V["v_hosted_links"] = f"{_ON_HOST.format(kind='l')}, (l_linenumber - 1)::BIGINT AS commit_order, if(l_partkey % 83 > 0, 'c' || (l_orderkey + 66 * (l_linenumber - 1)), '') AS commit_hash FROM <lineitem>"
V["v_ws_links"] = f"{_ON_WS.format(kind='l')}, 0::BIGINT AS commit_order, 'b' || (l_orderkey + 42 * (l_linenumber - 1)) AS commit_hash FROM <lineitem>"
V["v_hosted_reviews"] = f"""
{_ON_HOST.format(kind="r")}, 'Dev ' || l_suppkey AS reviewer_name, if(l_suppkey % 10 > 0, l_suppkey, 0)::VARCHAR AS reviewer_uuid, (l_returnflag = 'R')::INT AS approved,
  CASE l_returnflag WHEN 'A' THEN 'CHANGES_REQUESTED' WHEN 'R' THEN 'APPROVED' ELSE '' END AS status, l_shipdate::TIMESTAMP AS reviewed_at FROM <lineitem>"""
# The other host lists two reviewers with each pull request: the first agrees, the second hasn't answered.
V["v_ws_reviews"] = f"""
WITH asked AS (SELECT o_orderkey, unnest([{{'u': o_custkey % 99, 'big': 'User', 'small': 'u', 'yes': 1}}, {{'u': o_orderkey % 50, 'big': 'W', 'small': 'w', 'yes': 0}}]) AS who FROM <orders> WHERE o_orderkey % 12 > 0)
SELECT 'bitbucket_cloud' AS data_source, {_LANDED}, {_ORDER.format(source="bb", kind="p", owner="ws", repo="slug", repos=7)}, o_orderkey AS pr_id, who.big || who.u AS reviewer_name, who.small || who.u AS reviewer_uuid,
  who.yes AS approved, if(who.yes = 1, 'approved', '') AS status, NULL::TIMESTAMP AS reviewed_at FROM asked"""
# Parts are repositories, told apart by their size, and also branches: 8 of a repository on one host, 4 on the other.
_PART = "'t' || (p_partkey % 2) AS tenant_id, p_size::BIGINT AS size, if(p_size % 3 = 0, '', p_name) AS description, (p_size % 3 = 0)::INT AS has_issues, '' AS metadata"
V["v_hosted_repos"] = f"""
SELECT 'github' AS data_source, {_LANDED}, {_PART}, 'gh' AS source_id, 'gh:repo:' || p_partkey AS unique_key, if(p_partkey % 21 > 0, 'org' || (p_partkey % 5), '') AS project_key, 'repo' || p_partkey AS repo_slug, 'repo' || p_partkey AS name,
  p_partkey::VARCHAR AS repo_uuid, 'org/' || p_partkey AS full_name, (p_size % 4 = 2)::INT AS is_private, (p_size % 5 = 0)::INT AS has_wiki, p_type AS language, TIMESTAMP '2020-01-01' AS created_on,
  if(p_size % 5 > 0, TIMESTAMP '2024-01-02 03:04:05', TIMESTAMP '2023-12-31') AS updated_on FROM <part>"""
V["v_ws_repos"] = f"""
SELECT 'bitbucket_cloud' AS data_source, {_LANDED}, {_PART}, 'bb' AS source_id, 'bb:repo:' || p_partkey AS unique_key, 'ws' || (p_partkey % 5) AS project_key, 'slug' || p_partkey AS repo_slug, p_name AS name,
  'uu' || p_partkey AS repo_uuid, 'ws/' || p_partkey AS full_name, 1 - p_size % 2 AS is_private, (p_size % 5 = 1)::INT AS has_wiki, if(p_size % 9 > 0, p_type, '') AS language, TIMESTAMP '2019-12-31 22:00:00' AS created_on,
  TIMESTAMP '2024-01-02 03:04:05' AS updated_on FROM <part>"""
V["v_hosted_branches"] = f"""
WITH branch AS (SELECT p_partkey AS n, p_partkey // 8 AS repo FROM <part>)
SELECT 'github' AS data_source, {_LANDED}, 't' || (repo % 2) AS tenant_id, 'gh' AS source_id, 'gh:br:' || n AS unique_key, 'org1' AS project_key, 'repo' || repo AS repo_slug, 'branch' || n AS branch_name, (n % 8 = 3)::INT AS is_default,
  'h' || (n // 2) AS last_commit_hash, TIMESTAMP '2024-01-10' + to_days((repo % 20)::INT) AS last_commit_date FROM branch"""
V["v_ws_branches"] = f"""
SELECT 'bitbucket_cloud' AS data_source, {_LANDED}, 't' || (p_partkey % 2) AS tenant_id, 'bb' AS source_id, 'bb:br:' || p_partkey AS unique_key, 'ws1' AS project_key, 'slug' || (p_partkey // 4) AS repo_slug, 'b' || (p_partkey % 4) AS branch_name,
  (p_partkey % 4 = 1)::INT AS is_default, 'x' || p_partkey AS last_commit_hash, TIMESTAMP '2024-01-02 03:04:05' AS last_commit_date FROM <part>"""

# (query name, view, time columns, builder)
STAGING = [
    ("stg_git_commits_github", "v_hosted_commits", ["date"], lambda t: sg.hosted_commits(t["b_commits"])),
    ("stg_git_commits_bitbucket", "v_ws_commits", ["date"], lambda t: sg.workspace_commits(t["b_ws_commits"], t["b_ws_file_changes"])),
    ("stg_git_file_changes_github", "v_hosted_files", [], lambda t: sg.hosted_file_changes(t["b_file_changes"])),
    ("stg_git_file_changes_bitbucket", "v_ws_files", [], lambda t: sg.workspace_file_changes(t["b_ws_file_changes"])),
    ("stg_git_pull_requests_github", "v_hosted_prs", ["created_on", "updated_on", "closed_on"], lambda t: sg.hosted_pull_requests(t["b_prs"])),
    (
        "stg_git_pull_requests_bitbucket",
        "v_ws_prs",
        ["created_on", "updated_on", "closed_on"],
        lambda t: sg.workspace_pull_requests(t["b_ws_prs"], t["b_ws_pr_commits"], t["b_ws_file_changes"]),
    ),
    ("stg_git_pr_comments_github", "v_hosted_comments", ["created_at", "updated_at"], lambda t: sg.hosted_pr_comments(t["b_pr_comments"])),
    ("stg_git_pr_comments_bitbucket", "v_ws_comments", ["created_at", "updated_at"], lambda t: sg.workspace_pr_comments(t["b_ws_pr_comments"])),
    ("stg_git_pr_commits_github", "v_hosted_links", [], lambda t: sg.hosted_pr_commits(t["b_pr_commits"])),
    ("stg_git_pr_commits_bitbucket", "v_ws_links", [], lambda t: sg.workspace_pr_commits(t["b_ws_pr_commits"])),
    ("stg_git_reviewers_github", "v_hosted_reviews", ["reviewed_at"], lambda t: sg.hosted_reviewers(t["b_reviews"])),
    ("stg_git_reviewers_bitbucket", "v_ws_reviews", ["reviewed_at"], lambda t: sg.workspace_reviewers(t["b_ws_prs"])),
    ("stg_git_repositories_github", "v_hosted_repos", ["created_on", "updated_on"], lambda t: sg.hosted_repositories(t["b_repos"])),
    ("stg_git_repositories_bitbucket", "v_ws_repos", ["created_on", "updated_on"], lambda t: sg.workspace_repositories(t["b_ws_repos"])),
    ("stg_git_branches_github", "v_hosted_branches", ["last_commit_date"], lambda t: sg.hosted_branches(t["b_branches"])),
    ("stg_git_branches_bitbucket", "v_ws_branches", ["last_commit_date"], lambda t: sg.workspace_branches(t["b_ws_branches"])),
]


def _texted(view: str, times: list[str]) -> str:
    casts = ", ".join(f"{c}::VARCHAR AS {c}" for c in times)
    return f"SELECT * REPLACE ({casts}) FROM <{view}>" if times else f"SELECT * FROM <{view}>"


CLASSES: dict[str, list] = {}
_CLASS_OF = {
    "commits": "class_git_commits",
    "file_changes": "class_git_file_changes",
    "pull_requests": "class_git_pull_requests",
    "pr_comments": "class_git_pull_requests_comments",
    "pr_commits": "class_git_pull_requests_commits",
    "reviewers": "class_git_pull_requests_reviewers",
    "repositories": "class_git_repositories",
    "branches": "class_git_repository_branches",
}
for _name, _view, _times, _build in STAGING:
    case(_name, _texted(_view, _times))(_build)
    _kind = _name.removeprefix("stg_git_").rsplit("_", 1)[0]
    CLASSES.setdefault(_CLASS_OF[_kind], []).append((_name, _view, _times, _build))


def git_class(t: Tables, name: str):
    registry = Registry()
    for model, _, _, build in CLASSES[name]:
        registry.add(model, {name}, lambda build=build: build(t))
    return union_by_tag(registry, name)


for _cls, _models in CLASSES.items():
    V[f"v_{_cls}"] = " UNION ALL BY NAME ".join(f"SELECT * FROM <{v}>" for _, v, _, _ in _models)
    case(_cls, _texted(f"v_{_cls}", _models[0][2]))(lambda t, c=_cls: git_class(t, c))

# --- Silver facts ---------------------------------------------------------------------------------

_PK = "CASE WHEN author_email <> '' THEN lower(author_email) ELSE lower(author_name) END AS person_key"
V["v_commit_fact"] = f"SELECT *, {_PK}, date_trunc('week', date)::DATE AS week FROM <v_class_git_commits>"
V["v_file_fact"] = """
SELECT f.*, CASE WHEN regexp_matches(file_path, '(?i)(\\.spec\\.|\\.test\\.|__tests__/|/tests?/)') THEN 'spec'
  WHEN regexp_matches(file_path, '(?i)(\\.lock$|package-lock\\.json|yarn\\.lock|poetry\\.lock|\\.ya?ml$|\\.toml$|\\.cfg$|\\.ini$)') THEN 'config' ELSE 'code' END AS file_category,
  c.author_name, c.author_email, c.person_key, c.date AS committed_at, c.week, c.is_merge_commit
FROM <v_class_git_file_changes> f JOIN <v_commit_fact> c USING (tenant_id, source_id, project_key, repo_slug, commit_hash)"""
V["v_pr_fact"] = f"""
SELECT *, lower(state) AS state_norm, {_PK}, CASE WHEN lower(state) = 'merged' AND closed_on IS NOT NULL AND created_on IS NOT NULL AND closed_on >= created_on
  THEN date_diff('second', created_on, closed_on) / 3600.0 END AS cycle_time_h FROM <v_class_git_pull_requests>"""
V["v_review_fact"] = "SELECT *, lower(reviewer_name) AS person_key FROM <v_class_git_pull_requests_reviewers>"


def commit_fact(t):
    return silver.git_commit_fact(git_class(t, "class_git_commits"))


def file_fact(t):
    return silver.git_file_change_fact(git_class(t, "class_git_file_changes"), commit_fact(t))


def pr_fact(t):
    return silver.git_pr_fact(git_class(t, "class_git_pull_requests"))


def review_fact(t):
    return silver.git_review_fact(git_class(t, "class_git_pull_requests_reviewers"))


case("fct_git_commit", "SELECT * REPLACE (date::VARCHAR AS date, week::VARCHAR AS week) FROM <v_commit_fact>")(commit_fact)
case("fct_git_file_change", "SELECT * REPLACE (committed_at::VARCHAR AS committed_at, week::VARCHAR AS week) FROM <v_file_fact>")(file_fact)
case(
    "fct_git_pr",
    "SELECT * REPLACE (created_on::VARCHAR AS created_on, updated_on::VARCHAR AS updated_on, closed_on::VARCHAR AS closed_on, round(cycle_time_h, 6) AS cycle_time_h) FROM <v_pr_fact>",
)(pr_fact)
case("fct_git_review", "SELECT * REPLACE (reviewed_at::VARCHAR AS reviewed_at) FROM <v_review_fact>")(review_fact)


@case(
    "mtr_git_person_totals",
    """
WITH prs AS (SELECT tenant_id, person_key, count(*) AS prs_created, count_if(state_norm = 'merged') AS prs_merged, avg(cycle_time_h) AS avg_h
    FROM <v_pr_fact> WHERE person_key <> '' GROUP BY ALL),
  commits AS (SELECT tenant_id, person_key, count(*) AS commits, sum(lines_added + lines_removed) AS loc FROM <v_commit_fact> WHERE is_merge_commit = 0 AND person_key <> '' GROUP BY ALL),
  clean AS (SELECT tenant_id, person_key, sum(lines_added) AS clean_loc FROM <v_file_fact> WHERE is_merge_commit = 0 AND file_category = 'code' AND person_key <> '' GROUP BY ALL)
SELECT tenant_id, person_key, tenant_id || '|' || person_key AS unique_key, COALESCE(prs_created,0)::BIGINT AS prs_created, COALESCE(prs_merged,0)::BIGINT AS prs_merged,
  COALESCE(commits,0)::BIGINT AS commits, COALESCE(loc,0)::BIGINT AS loc, COALESCE(clean_loc,0)::BIGINT AS clean_loc, round(avg_h, 6) AS avg_pr_cycle_time_h
FROM prs FULL JOIN commits USING (tenant_id, person_key) FULL JOIN clean USING (tenant_id, person_key)""",
)
def person_totals(t):
    return silver.git_person_totals(pr_fact(t), commit_fact(t), file_fact(t))


V["v_person_weekly"] = """
WITH commits AS (SELECT tenant_id, person_key, week, count(*) AS commits FROM <v_commit_fact> WHERE is_merge_commit = 0 AND person_key <> '' AND date IS NOT NULL GROUP BY ALL),
  loc AS (SELECT tenant_id, person_key, week, sum(CASE WHEN file_category = 'code' THEN lines_added ELSE 0 END) AS code_loc, sum(CASE WHEN file_category = 'spec' THEN lines_added ELSE 0 END) AS spec_lines
    FROM <v_file_fact> WHERE is_merge_commit = 0 AND person_key <> '' AND week IS NOT NULL GROUP BY ALL),
  prs AS (SELECT pr.tenant_id, pr.person_key, COALESCE(mc.week, date_trunc('week', pr.closed_on)::DATE) AS week, count(*) AS prs_merged
    FROM <v_pr_fact> pr LEFT JOIN <v_commit_fact> mc ON mc.tenant_id = pr.tenant_id AND mc.source_id = pr.source_id AND mc.project_key = pr.project_key AND mc.repo_slug = pr.repo_slug AND mc.commit_hash = pr.merge_commit_hash
    WHERE state_norm = 'merged' AND closed_on IS NOT NULL AND pr.person_key <> '' GROUP BY ALL)
SELECT tenant_id, person_key, week, tenant_id || '|' || person_key || '|' || week::VARCHAR AS unique_key, COALESCE(commits,0)::BIGINT AS commits, COALESCE(prs_merged,0)::BIGINT AS prs_merged,
  COALESCE(code_loc,0)::BIGINT AS code_loc, COALESCE(spec_lines,0)::BIGINT AS spec_lines
FROM commits FULL JOIN loc USING (tenant_id, person_key, week) FULL JOIN prs USING (tenant_id, person_key, week)"""


@case("mtr_git_person_weekly", "SELECT * REPLACE (week::VARCHAR AS week) FROM <v_person_weekly>")
def person_weekly(t):
    return silver.git_person_weekly(pr_fact(t), commit_fact(t), file_fact(t))


# --- landing rules over version-control records --------------------------------------------------------

_REPO = ["tenant_id", "repo_owner", "repo_name"]


@case(
    "dedup_branch_heads",
    """
WITH r AS (SELECT *, CASE WHEN name = default_branch_name THEN 1 ELSE 0 END AS is_default FROM <b_branches>),
  w AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, repo_owner, repo_name, head_sha ORDER BY is_default DESC, name) AS rn,
    count(*) OVER (PARTITION BY tenant_id, repo_owner, repo_name, head_sha) AS n FROM r WHERE head_sha <> '')
SELECT tenant_id, repo_owner, repo_name, head_sha, name, is_default, n - 1 AS skipped FROM w WHERE rn = 1
UNION ALL SELECT tenant_id, repo_owner, repo_name, head_sha, name, is_default, 0 FROM r WHERE head_sha = ''""",
)
def branch_heads(t):
    return landing.dedup_branch_heads(t["b_branches"], _REPO)


@case(
    "dedup_branch_heads_skipped",
    """
WITH w AS (SELECT *, first(name) OVER (PARTITION BY tenant_id, repo_owner, repo_name, head_sha ORDER BY CASE WHEN name = default_branch_name THEN 0 ELSE 1 END, name) AS kept FROM <b_branches> WHERE head_sha <> '')
SELECT tenant_id, repo_owner, repo_name, head_sha, name AS skipped_branch, kept AS kept_branch FROM w WHERE name <> kept""",
)
def branch_siblings(t):
    return landing.skipped_siblings(t["b_branches"], _REPO)


@case(
    "changed_partitions",
    """
SELECT b.tenant_id, b.repo_owner, b.repo_name, b.name, b.head_sha, CASE WHEN b.head_sha <> '' AND s.head_sha <> '' AND b.head_sha <> s.head_sha THEN 1 ELSE 0 END AS head_changed,
  CASE WHEN b.head_sha <> '' AND s.head_sha <> '' AND b.head_sha <> s.head_sha THEN NULL ELSE s.cursor END AS cursor
FROM <b_branches> b LEFT JOIN <b_repo_state> r USING (tenant_id, repo_owner, repo_name) LEFT JOIN <b_branch_state> s ON s.tenant_id = b.tenant_id AND s.repo_owner = b.repo_owner AND s.repo_name = b.repo_name AND s.name = b.name
WHERE NOT COALESCE(b.pushed_at <> '' AND r.pushed_at <> '' AND b.pushed_at <= r.pushed_at, false) AND NOT COALESCE(b.head_sha <> '' AND s.head_sha <> '' AND b.head_sha = s.head_sha, false)""",
)
def partitions_to_read(t):
    return landing.changed_partitions(t["b_branches"], t["b_repo_state"], t["b_branch_state"], _REPO)


@case(
    "direct_push_commits",
    "SELECT tenant_id, oid, branch_name FROM <b_commits> WHERE COALESCE(len(parent_hashes),0) <= 1 AND (branch_name IS NULL OR branch_name = default_branch_name)",
)
def direct_pushes(t):
    return derive.direct_push_commits(t["b_commits"]).select("tenant_id", "oid", "branch_name")


@case(
    "first_branch_wins",
    """
SELECT tenant_id, repo_owner, repo_name, commit_hash, branch_name FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, repo_owner, repo_name, commit_hash ORDER BY CASE WHEN branch_name <> default_branch_name THEN 1 ELSE 0 END, branch_name) AS rn
  FROM (SELECT tenant_id, repo_owner, repo_name, head_sha AS commit_hash, name AS branch_name, default_branch_name FROM <b_branches>)) WHERE rn = 1""",
)
def first_branch(t):
    seen = t["b_branches"].select("tenant_id", "repo_owner", "repo_name", F.col("head_sha").alias("commit_hash"), F.col("name").alias("branch_name"), "default_branch_name")
    return derive.first_branch_wins(seen, _REPO, "commit_hash").drop("default_branch_name")


@case(
    "stale_children",
    """
SELECT p.tenant_id, p.database_id, p.updated_at, s.synced_at FROM <b_prs> p LEFT JOIN (SELECT tenant_id, pr_database_id AS database_id, max(submitted_at) AS synced_at FROM <b_reviews> GROUP BY ALL) s USING (tenant_id, database_id)
WHERE s.synced_at IS NULL OR p.updated_at > s.synced_at""",
)
def stale(t):
    state = t["b_reviews"].groupBy("tenant_id", F.col("pr_database_id").alias("database_id")).agg(F.max("submitted_at").alias("synced_at"))
    return derive.stale_children(t["b_prs"], state, ["tenant_id", "database_id"]).select("tenant_id", "database_id", "updated_at", "synced_at")


@case(
    "pr_commit_order",
    """
SELECT tenant_id, pr_number, unique_key, commit_hash, row_number() OVER (PARTITION BY tenant_id, pr_number ORDER BY commit_committed_date, unique_key) - 1 AS commit_order
FROM <b_pr_commits> WHERE commit_hash <> ''""",
)
def commit_order(t):
    links = t["b_pr_commits"].select("tenant_id", "pr_number", "unique_key", "commit_hash", "commit_committed_date").distinct()
    ordered = derive.pr_commit_order(links, ["tenant_id", "pr_number"], ["commit_committed_date", "unique_key"], F.to_date("commit_committed_date"))
    return ordered.drop("commit_committed_date")


@case(
    "reconcile_counts",
    """
SELECT tenant_id, pr_number, p.changed_files AS commit_count, COALESCE(n, 0) AS rows_seen FROM (SELECT tenant_id, number AS pr_number, changed_files FROM <b_prs>) p
LEFT JOIN (SELECT tenant_id, pr_number, count(*) AS n FROM <b_pr_commits> GROUP BY ALL) USING (tenant_id, pr_number) WHERE abs(COALESCE(n, 0) - p.changed_files) > 1""",
)
def reconcile(t):
    prs = t["b_prs"].select("tenant_id", F.col("number").alias("pr_number"), F.col("changed_files").alias("commit_count"))
    return derive.reconcile_counts(t["b_pr_commits"], prs, ["tenant_id", "pr_number"])


V["v_issue_comments"] = "SELECT tenant_id, source_id, repo_owner, repo_name, database_id AS id, body, 'https://api/repos/x/issues/' || (pr_database_id + CASE WHEN line % 3 = 0 THEN 10000000 ELSE 0 END)::VARCHAR || '/' AS issue_url FROM <b_pr_comments>"


@case(
    "pr_comments_from_issues",
    """
SELECT g.tenant_id, g.source_id, concat_ws(':', g.tenant_id, g.source_id, g.repo_owner, g.repo_name, 'c', g.id::VARCHAR) AS unique_key, g.repo_owner, g.repo_name, g.pr AS pr_number, g.id AS database_id, g.body,
  NULL::VARCHAR AS path, NULL::BIGINT AS line, 0 AS is_inline
FROM (SELECT *, TRY_CAST(regexp_extract(issue_url, '([0-9]+)/?$', 1) AS BIGINT) AS pr FROM <v_issue_comments>) g
SEMI JOIN <b_prs> p ON p.tenant_id = g.tenant_id AND p.source_id = g.source_id AND p.repo_owner = g.repo_owner AND p.repo_name = g.repo_name AND p.number = g.pr
UNION ALL SELECT tenant_id, source_id, concat_ws(':', tenant_id, source_id, repo_owner, repo_name, 'r', database_id::VARCHAR), repo_owner, repo_name, pr_database_id, database_id, body, path, line, 1 FROM <b_pr_comments>""",
)
def comments_routed(t):
    raw = t["b_pr_comments"]
    offset = F.when(F.col("line") % 3 == 0, 10000000).otherwise(0)
    url = F.concat(F.lit("https://api/repos/x/issues/"), (F.col("pr_database_id") + offset).cast("string"), F.lit("/"))
    issue = raw.withColumns({"issue_url": url, "id": F.col("database_id")})
    review = raw.withColumns({"pull_request_url": F.concat(F.lit("https://api/repos/x/pulls/"), F.col("pr_database_id").cast("string")), "id": F.col("database_id")})
    return derive.pr_comments(issue, review, t["b_prs"])


@case(
    "parse_author",
    """
SELECT page_id, CASE WHEN raw LIKE '%>' THEN 'Writer ' || page_id ELSE raw END AS author_name, CASE WHEN raw LIKE '%>' THEN 'w' || page_id || '@x.example' END AS author_email
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'Writer ' || page_id || '  <w' || page_id || '@x.example>' END AS raw FROM <pages>)""",
)
def authors(t):
    page = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("Writer "), page, F.lit("  <w"), page, F.lit("@x.example>")))
    return derive.parse_author(t["pages"].withColumn("raw", raw), "raw").select("page_id", "author_name", "author_email")


@case(
    "normalize_pr_state",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'MERGED' WHEN o_orderstatus = 'P' THEN 'CLOSED' ELSE 'OPEN' END AS state FROM <orders>",
)
def pr_state(t):
    prs = t["orders"].select("o_orderkey", (F.col("o_orderstatus") == "F").alias("merged"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("state"))
    return derive.normalize_pr_state(prs).drop("merged")


@case(
    "pr_nested_lists",
    """
SELECT o_orderkey, concat_ws('|', 'l' || (o_orderkey % 4), CASE WHEN o_orderkey % 2 = 0 THEN 'x' END) AS label_names,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'u' || o_custkey END AS requested_reviewers, 'team' || (o_orderkey % 5) AS requested_teams FROM <orders>""",
)
def nested_lists(t):
    key = F.col("o_orderkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    none = F.lit(None).cast("string")
    rows = t["orders"].select(
        "o_orderkey",
        F.array(F.struct(text("l", key % 4).alias("name")), F.struct(F.when(key % 2 == 0, "x").alias("name"))).alias("labels"),
        F.array(
            F.struct(F.when(key % 3 != 0, text("u", F.col("o_custkey"))).alias("login"), none.alias("slug")),
            F.struct(none.alias("login"), text("team", key % 5).alias("slug")),
        ).alias("review_requests"),
    )
    return derive.pr_nested_lists(rows).select("o_orderkey", "label_names", "requested_reviewers", "requested_teams")


@case(
    "repo_filter",
    "SELECT tenant_id, name FROM <b_repos> WHERE NOT COALESCE(archived, false) AND NOT COALESCE(fork, false)",
)
def repos_kept(t):
    return derive.repo_filter(t["b_repos"], True, True).select("tenant_id", "name")


@case(
    "explode_embedded",
    """
SELECT l_orderkey, l_linenumber - 1 AS position, l_partkey AS oid, l_quantity AS size FROM (
  SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) AS l_linenumber FROM <lineitem>)""",
)
def embedded(t):
    nested = t["lineitem"].groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("oid"), F.col("l_quantity").alias("size")))).alias("commits")
    )
    return derive.explode_embedded(nested, ["l_orderkey"], "commits")


@case(
    "explode_embedded_threads",
    "SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_resolved, l_partkey AS comment_id FROM <lineitem>",
)
def threads(t):
    comments = t["lineitem"].groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_partkey").alias("comment_id"))).alias("comments"))
    nested = comments.groupBy("l_orderkey").agg(
        F.collect_list(F.struct((F.col("l_returnflag") == "R").alias("is_resolved"), "comments")).alias("threads")
    )
    return derive.explode_threads(nested, ["l_orderkey"])


@case(
    "participants_to_reviewers",
    """
SELECT tenant_id, id, p->>'display_name' AS display_name, p->>'uuid' AS uuid, NULL::VARCHAR AS nickname, p->>'role' AS role, CASE WHEN p->>'approved' = 'true' THEN 1 ELSE 0 END AS approved, p->>'state' AS state
FROM (SELECT tenant_id, id, unnest(CAST(participants AS JSON[])) AS p FROM <b_ws_prs> WHERE participants IS NOT NULL)""",
)
def flat_participants(t):
    schema = "array<struct<role:string,uuid:string,display_name:string,state:string,approved:boolean>>"
    typed = t["b_ws_prs"].withColumn("_p", F.from_json("participants", schema))
    shaped = F.transform(
        "_p",
        lambda p: F.struct(
            F.struct(p["display_name"].alias("display_name"), p["uuid"].alias("uuid"), F.lit(None).cast("string").alias("nickname")).alias("user"),
            p["role"].alias("role"),
            p["approved"].alias("approved"),
            p["state"].alias("state"),
        ),
    )
    return derive.participants_to_reviewers(typed.withColumn("participants", shaped), ["tenant_id", "id"])


# --- reports --------------------------------------------------------------------------------------------------


@case(
    "commit_rankings",
    """
SELECT tenant_id, person_key, count(*) AS commit_count, min(date)::VARCHAR AS first_commit, max(date)::VARCHAR AS last_commit FROM <v_commit_fact> GROUP BY ALL
ORDER BY commit_count DESC, tenant_id, person_key LIMIT 20""",
)
def rankings(t):
    return cm.commit_rankings(commit_fact(t), 20)


@case(
    "file_hotspots",
    """
SELECT tenant_id, file_path, count(*) AS change_count, sum(lines_added)::BIGINT AS total_added, sum(lines_removed)::BIGINT AS total_removed FROM <v_class_git_file_changes> GROUP BY ALL
ORDER BY change_count DESC, tenant_id, file_path LIMIT 20""",
)
def hotspots(t):
    return cm.file_hotspots(git_class(t, "class_git_file_changes"), 20)


@case(
    "loc_by_extension",
    """
SELECT tenant_id, regexp_extract(file_path, '\\.([^.]+)$', 1) AS extension, sum(lines_added)::BIGINT AS lines_added, sum(lines_removed)::BIGINT AS lines_removed, count(DISTINCT commit_hash) AS commits
FROM <v_class_git_file_changes> GROUP BY ALL""",
)
def by_extension(t):
    return cm.loc_by_extension(git_class(t, "class_git_file_changes"))


@case(
    "daily_churn",
    "SELECT tenant_id, committed_at::DATE::VARCHAR AS day, sum(lines_added)::BIGINT AS added, sum(lines_removed)::BIGINT AS removed, count(DISTINCT commit_hash) AS commits FROM <v_file_fact> GROUP BY tenant_id, committed_at::DATE",
)
def churn(t):
    return cm.daily_churn(file_fact(t))


V["v_loc"] = "SELECT 't' || (l_partkey % 2) AS tenant_id, 'f' || l_partkey AS file_id, l_shipdate::DATE AS snapshot_date, floor(l_quantity)::BIGINT AS loc FROM <lineitem>"


def _loc(t):
    return t["lineitem"].select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_id"),
        F.to_date("l_shipdate").alias("snapshot_date"),
        F.floor("l_quantity").alias("loc"),
    )


@case("loc_snapshot_trend", "SELECT tenant_id, snapshot_date::VARCHAR AS snapshot_date, sum(loc)::BIGINT AS total_loc, count(*) AS files FROM <v_loc> GROUP BY tenant_id, v_loc.snapshot_date")
def loc_trend(t):
    return cm.loc_snapshot_trend(_loc(t), ["tenant_id"])


@case(
    "largest_files",
    "SELECT tenant_id, file_id, snapshot_date::VARCHAR AS snapshot_date, loc FROM <v_loc> l WHERE l.snapshot_date = (SELECT max(snapshot_date) FROM <v_loc>) AND loc > 0 ORDER BY loc DESC, tenant_id, file_id LIMIT 20",
)
def big_files(t):
    return cm.largest_files(_loc(t), 20)


@case(
    "name_variants",
    """
WITH n AS (SELECT DISTINCT tenant_id, lower(author_email) AS email, author_name FROM <v_class_git_commits> WHERE author_email <> '')
SELECT * FROM (SELECT tenant_id, email, author_name, count(*) OVER (PARTITION BY tenant_id, email) AS name_variants FROM n) WHERE name_variants > 1""",
)
def variants(t):
    return cm.name_variants(git_class(t, "class_git_commits"))


@case(
    "stale_branches",
    """
SELECT tenant_id, branch_name, CASE WHEN is_default = 0 THEN last_commit_date::VARCHAR END AS last_synced_at FROM <v_class_git_repository_branches>
WHERE is_default = 1 OR last_commit_date < TIMESTAMP '2024-01-27 00:00:00' - INTERVAL 7 DAY""",
)
def stale_branch_rows(t):
    rows = git_class(t, "class_git_repository_branches").withColumn("last_synced_at", F.when(F.col("is_default") == 0, F.col("last_commit_date")))
    return cm.stale_branches(rows, "2024-01-27 00:00:00", 7).select("tenant_id", "branch_name", "last_synced_at")


@case(
    "eav_pivot",
    """
SELECT o_orderkey, o_orderstatus, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS total_loc, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS language
FROM <orders> LEFT JOIN <lineitem> ON l_orderkey = o_orderkey AND l_linenumber IN (1, 2) GROUP BY ALL""",
)
def eav(t):
    ext = t["lineitem"].select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_linenumber") == 1, "total_loc").when(F.col("l_linenumber") == 2, "language").otherwise("other").alias("field_id"),
        F.col("l_quantity").alias("field_value_float"),
        F.col("l_returnflag").alias("field_value_str"),
    )
    base = t["orders"].select("o_orderkey", "o_orderstatus")
    return cm.eav_pivot(base, ext, ["o_orderkey"], {"total_loc": "field_value_float", "language": "field_value_str"})


_AS_OF = "2001-06-30 00:00:00"


@case(
    "repo_activity_props",
    f"""
WITH c AS (SELECT tenant_id, project_key, repo_slug, count(DISTINCT CASE WHEN date > TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY AND date <= TIMESTAMP '{_AS_OF}' THEN person_key END) AS a30,
    count(DISTINCT CASE WHEN date > TIMESTAMP '{_AS_OF}' - INTERVAL 90 DAY AND date <= TIMESTAMP '{_AS_OF}' THEN person_key END) AS a90, count(DISTINCT person_key) AS total,
    count_if(date > TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY AND date <= TIMESTAMP '{_AS_OF}') / 30.0 AS cf, max(date) AS last_c FROM <v_commit_fact> GROUP BY ALL),
  p AS (SELECT tenant_id, project_key, repo_slug, count_if(created_on > TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY AND created_on <= TIMESTAMP '{_AS_OF}') / 30.0 AS pf, max(created_on) AS last_p FROM <v_pr_fact> GROUP BY ALL)
SELECT tenant_id, project_key, repo_slug, COALESCE(a30,0) AS active_contributors_30d, COALESCE(a90,0) AS active_contributors_90d, COALESCE(total,0) AS total_contributors, round(COALESCE(cf,0),6) AS commit_frequency_30d,
  round(COALESCE(pf,0),6) AS pr_frequency_30d, greatest(last_c, last_p)::DATE::VARCHAR AS last_activity_date, CASE WHEN greatest(last_c, last_p) < TIMESTAMP '{_AS_OF}' - INTERVAL 90 DAY THEN 1 ELSE 0 END AS is_stale
FROM c FULL JOIN p USING (tenant_id, project_key, repo_slug)""",
)
def repo_props(t):
    return cm.repo_activity_props(commit_fact(t), pr_fact(t), _AS_OF)


V["v_pr_props"] = """
WITH links AS (SELECT DISTINCT tenant_id, project_key, repo_slug, pr_id, commit_hash FROM <v_class_git_pull_requests_commits>),
  docs AS (SELECT tenant_id, project_key, repo_slug, commit_hash, min(CASE WHEN regexp_matches(file_path, '(?i)(\\.md$|\\.rst$|\\.txt$|(^|/)docs?/)') THEN 1 ELSE 0 END) AS docs FROM <v_class_git_file_changes> GROUP BY ALL),
  dated AS (SELECT tenant_id, project_key, repo_slug, commit_hash, min(date) AS date FROM <v_commit_fact> GROUP BY ALL),
  fc AS (SELECT tenant_id, project_key, repo_slug, pr_id, min(date) AS first_commit, min(docs) AS docs FROM links LEFT JOIN dated USING (tenant_id, project_key, repo_slug, commit_hash) LEFT JOIN docs USING (tenant_id, project_key, repo_slug, commit_hash) GROUP BY ALL),
  rv AS (SELECT tenant_id, project_key, repo_slug, pr_id, min(reviewed_at) AS fr, min(CASE WHEN approved = 1 THEN reviewed_at END) AS fa, count(DISTINCT person_key) AS reviewers FROM <v_review_fact> GROUP BY ALL)
SELECT tenant_id, project_key, repo_slug, pr_id, person_key, date_diff('second', first_commit, CASE WHEN state_norm = 'merged' THEN closed_on END) / 3600.0 AS cycle_time_hours,
  date_diff('second', created_on, fr) / 3600.0 AS pickup_time_hours, date_diff('second', created_on, fa) / 3600.0 AS approval_velocity,
  date_diff('second', fr, CASE WHEN state_norm = 'merged' THEN closed_on END) / 3600.0 AS review_time_hours, COALESCE(reviewers, 0) AS reviewers,
  CASE WHEN regexp_matches(source_branch, '(?i)(hotfix|^fix/)') OR regexp_matches(title, '(?i)(hotfix|^fix/)') THEN 1 ELSE 0 END AS hotfix_flag, COALESCE(docs, 0) AS docs_only_flag
FROM <v_pr_fact> LEFT JOIN fc USING (tenant_id, project_key, repo_slug, pr_id) LEFT JOIN rv USING (tenant_id, project_key, repo_slug, pr_id)"""


def pr_properties(t):
    return cm.pr_props(pr_fact(t), review_fact(t), git_class(t, "class_git_pull_requests_commits"), commit_fact(t), git_class(t, "class_git_file_changes"))


case(
    "pr_props",
    """SELECT * REPLACE (round(cycle_time_hours, 6) AS cycle_time_hours, round(pickup_time_hours, 6) AS pickup_time_hours, round(approval_velocity, 6) AS approval_velocity,
  round(review_time_hours, 6) AS review_time_hours) FROM <v_pr_props>""",
)(pr_properties)


@case(
    "review_participation",
    """
SELECT tenant_id, project_key, repo_slug, pr_id, round(reviewers / team_size, 6) AS review_participation_ratio FROM <v_pr_props>
JOIN (SELECT tenant_id, count(DISTINCT person_key) AS team_size FROM <v_review_fact> GROUP BY ALL) USING (tenant_id)""",
)
def participation(t):
    sizes = review_fact(t).select("tenant_id", "person_key").distinct().groupBy("tenant_id").agg(F.count(F.lit(1)).alias("team_size"))
    return cm.review_participation(pr_properties(t), sizes)


V["v_tickets"] = """
SELECT DISTINCT tenant_id, source_id, ticket AS external_ticket_id, project_key, repo_slug, NULL::BIGINT AS pr_id, commit_hash, 'COMMIT_MESSAGE' AS ticket_source, unique_key
FROM (SELECT *, unnest(regexp_extract_all(message, '([A-Z]+-[0-9]+|#[0-9]+)')) AS ticket FROM <v_class_git_commits>)
UNION ALL SELECT DISTINCT tenant_id, source_id, ticket, project_key, repo_slug, pr_id, NULL, 'PR_TITLE', unique_key FROM (SELECT *, unnest(regexp_extract_all(title, '([A-Z]+-[0-9]+|#[0-9]+)')) AS ticket FROM <v_class_git_pull_requests>)
UNION ALL SELECT DISTINCT tenant_id, source_id, ticket, project_key, repo_slug, pr_id, NULL, 'PR_DESCRIPTION', unique_key FROM (SELECT *, unnest(regexp_extract_all(description, '([A-Z]+-[0-9]+|#[0-9]+)')) AS ticket FROM <v_class_git_pull_requests>)"""


def tickets(t):
    return cm.ticket_refs(git_class(t, "class_git_commits"), git_class(t, "class_git_pull_requests"))


case("ticket_refs", "SELECT * EXCLUDE (unique_key) FROM <v_tickets>")(tickets)


@case(
    "git_team_metrics",
    """
WITH c AS (SELECT tenant_id, project_key, repo_slug, count(*) AS n, count(DISTINCT date::DATE) + max(CASE WHEN date IS NULL THEN 1 ELSE 0 END) AS d FROM <v_commit_fact> GROUP BY ALL),
  p AS (SELECT tenant_id, project_key, repo_slug, count(*) AS prs, count_if(state_norm = 'merged') AS merged, count(DISTINCT CASE WHEN state_norm = 'merged' THEN date_trunc('week', closed_on) END) AS weeks FROM <v_pr_fact> GROUP BY ALL),
  m AS (SELECT tenant_id, project_key, repo_slug, count(*) AS comments FROM <v_class_git_pull_requests_comments> GROUP BY ALL),
  r AS (SELECT tenant_id, project_key, repo_slug, count(DISTINCT pr_id) AS reviewed FROM <v_review_fact> GROUP BY ALL)
SELECT tenant_id, project_key, repo_slug, round(n / d, 6) AS commit_frequency, round(merged / nullif(prs, 0), 6) AS merge_rate, round(COALESCE(comments, 0) / nullif(prs, 0), 6) AS review_depth,
  round(COALESCE(reviewed, 0) / nullif(prs, 0), 6) AS review_participation, round(merged / nullif(weeks, 0), 6) AS weekly_throughput
FROM c FULL JOIN p USING (tenant_id, project_key, repo_slug) LEFT JOIN m USING (tenant_id, project_key, repo_slug) LEFT JOIN r USING (tenant_id, project_key, repo_slug)""",
)
def team_metrics(t):
    return cm.git_team_metrics(commit_fact(t), pr_fact(t), git_class(t, "class_git_pull_requests_comments"), review_fact(t))


@case(
    "language_mix",
    """
SELECT tenant_id, project_key, repo_slug, file_extension, lines_added, round(lines_added / nullif(sum(lines_added) OVER (PARTITION BY tenant_id, project_key, repo_slug), 0), 6) AS share
FROM (SELECT tenant_id, project_key, repo_slug, file_extension, sum(lines_added)::BIGINT AS lines_added FROM <v_class_git_file_changes> GROUP BY ALL)""",
)
def languages(t):
    return cm.language_mix(git_class(t, "class_git_file_changes"))


@case(
    "file_extension",
    "SELECT page_id, CASE WHEN strpos(url, '.') > 0 THEN regexp_extract(url, '\\.([^.]*)$', 1) ELSE '' END AS ext FROM <pages>",
)
def extensions(t):
    return t["pages"].select("page_id", fx.file_extension("url").alias("ext"))
