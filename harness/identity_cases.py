"""Change tracking, seeds, matching, grouping, golden record, organisation."""

import uuid

from pyspark.sql import functions as F

from harness.cases import VIEWS, Tables, case
from orgpulse.functions import scalars as fx
from orgpulse.operators import components, history, identity, matching, org
from orgpulse.operators.history import TRACKED
from orgpulse.session import ensure_checkpoint_dir
from orgpulse.sources import versioned

V = VIEWS
_MEMBER_COLS = ["name", "role", "isRemoved"]
_TEXT = "concat_ws('~', name, role, isRemoved::VARCHAR)"

# --- versions and field history ------------------------------------------------------------------

V["v_versions"] = f"SELECT * FROM <b_member_log> WINDOW w AS (PARTITION BY unique_key ORDER BY _tracked_at, event_id) QUALIFY COALESCE(lag({_TEXT}) OVER w <> {_TEXT}, true)"


def member_versions(t: Tables):
    return history.versions_from_log(t["b_member_log"], ["unique_key"], _MEMBER_COLS, ["_tracked_at", "event_id"], F.to_date("_tracked_at"))


@case("snapshot_versions", "SELECT unique_key, event_id, name, role, isRemoved::INT AS isRemoved FROM <v_versions>")
def versions(t):
    return member_versions(t).select("unique_key", "event_id", "name", "role", "isRemoved")


@case(
    "snapshot_scd2",
    f"""
WITH last AS (SELECT unique_key, max_by({_TEXT}, _tracked_at) AS was FROM <v_versions> GROUP BY ALL)
SELECT n.unique_key, n.name, n.role, n.isRemoved::INT AS isRemoved, '2024-03-01 00:00:00' AS _tracked_at FROM <b_members_now> n LEFT JOIN last USING (unique_key) WHERE was IS NULL OR was <> {_TEXT.replace('name', 'n.name').replace('role', 'n.role').replace('isRemoved', 'n.isRemoved')}""",
)
def snapshot(t):
    at = F.lit("2024-03-01").cast("timestamp")
    out = history.snapshot_scd2(t["b_members_now"], member_versions(t), "unique_key", _MEMBER_COLS, at)
    return out.select("unique_key", "name", "role", "isRemoved", "_tracked_at")


@case(
    "snapshot_hr_employees",
    """
WITH a AS (SELECT * FROM <b_employees> WHERE _airbyte_extracted_at < TIMESTAMP '2024-02-02'), b AS (SELECT * FROM <b_employees_now>)
SELECT b.unique_key, b.displayName, b.jobTitle, b.department FROM b LEFT JOIN a USING (unique_key)
WHERE a.unique_key IS NULL OR b.displayName IS DISTINCT FROM a.displayName OR b.jobTitle IS DISTINCT FROM a.jobTitle OR b.department IS DISTINCT FROM a.department OR (b.raw_data::JSON->>'shirt') IS DISTINCT FROM (a.raw_data::JSON->>'shirt')""",
)
def snapshot_hr(t):
    rows = t["b_employees"]
    first = rows.where(F.col("_airbyte_extracted_at") < F.lit("2024-02-02").cast("timestamp"))
    at = F.col("_airbyte_extracted_at")
    stored = history.snapshot_model("hr_employees", first, None, at, ["shirt"])
    return history.snapshot_model("hr_employees", t["b_employees_now"], stored, at, ["shirt"]).select("unique_key", "displayName", "jobTitle", "department")


_HR_FIELDS = list(TRACKED["hr_employees"].fields)
_HR_LOG = " UNION ALL ".join(
    f"SELECT tenant_id, source_id, unique_key, id AS entity_id, _airbyte_extracted_at AS at, '{f}' AS field_name, {f}::VARCHAR AS now, lag({f}::VARCHAR) OVER w AS was, row_number() OVER w AS vn FROM <b_employees> WINDOW w AS (PARTITION BY unique_key ORDER BY _airbyte_extracted_at)"
    for f in _HR_FIELDS
)


@case(
    "history_hr_employees",
    f"SELECT entity_id, tenant_id, source_id, field_name, CASE WHEN vn = 1 THEN '' ELSE was END AS old_value, now AS new_value, x.at::VARCHAR AS updated_at FROM ({_HR_LOG}) x WHERE (vn = 1 AND now <> '') OR (vn > 1 AND now <> was)",
)
def hr_field_log(t):
    return history.history_model("hr_employees", t["b_employees"].withColumn("_tracked_at", F.col("_airbyte_extracted_at")))


# Tracked fields of chat and call accounts, said of the events that change them.
_KEYED = "SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM <events>"
_SLACK_NOW = {
    "email": "'User' || user_id || '@Example.com'", "display_name": "CASE WHEN k % 2 = 0 THEN 'Nick0' ELSE 'Nick1' END", "real_name": "'Real ' || (k // 50)", "is_admin": "k % 7 = 0", "is_owner": "false", "is_restricted": "k % 11 = 0",
    "is_ultra_restricted": "false", "is_bot": "CASE WHEN k % 13 > 0 THEN k % 2 = 0 END", "deleted": "event_type = 'error'", "tz": "'zone ' || (user_id % 3)",
}
_ZOOM_NOW = {
    "first_name": "'First' || (user_id % 50)", "last_name": "'Last' || (k // 40)", "display_name": "CASE WHEN k % 6 > 0 THEN 'Shown ' || (k % 2) ELSE '' END", "email": "'User' || user_id || '@Example.com'", "dept": "'dept ' || (k // 30)",
    "status": "CASE event_type WHEN 'error' THEN 'inactive' ELSE 'active' END", "role_id": "k % 3", "timezone": "'UTC'", "language": "CASE WHEN k % 17 > 0 THEN 'en' END", "phone_number": "'+1' || (user_id % 9)", "employee_unique_id": "'E' || user_id", "type": "1 + k % 2",
}


def _changed_accounts(letter: str, fields: dict[str, str]) -> str:
    """Accounts whose newest event leaves any field otherwise than their first one did."""
    state = "struct_pack(" + ", ".join(f"{f} := ({e})::VARCHAR" for f, e in fields.items()) + ")"
    return f"""WITH ends AS (SELECT user_id, min_by({state}, (ts, event_id)) AS was, max_by({state}, (ts, event_id)) AS now FROM ({_KEYED}) GROUP BY user_id)
SELECT '{letter}' || user_id AS unique_key, now.email AS email, now.display_name AS display_name FROM ends WHERE was IS DISTINCT FROM now"""


def _field_changes(letter: str, source: str, fields: dict[str, str]) -> str:
    """Every event that sets a field otherwise than the event before it, and first values that aren't empty."""
    values = ", ".join(f"struct_pack(f := '{f}', v := ({e})::VARCHAR)" for f, e in fields.items())
    return f"""WITH told AS (SELECT user_id, ts, event_id, x.f AS f, x.v AS v FROM (SELECT *, unnest([{values}]) AS x FROM ({_KEYED}))), beside AS (SELECT *, lag(v) OVER w AS was, row_number() OVER w AS nth FROM told WINDOW w AS (PARTITION BY user_id, f ORDER BY ts, event_id))
SELECT '{letter}' || user_id AS entity_id, 't' || (user_id % 2) AS tenant_id, '{source}' AS source_id, f AS field_name, CASE WHEN nth > 1 THEN was ELSE '' END AS old_value, v AS new_value, ts::VARCHAR AS updated_at FROM beside WHERE v <> CASE WHEN nth > 1 THEN was ELSE '' END"""


def _account_snapshot(t, source: str, log: str):
    """First states stored, then the newest ones offered."""
    rows = t[log].withColumn("at_", F.struct("_tracked_at", "event_id"))
    at = F.col("_tracked_at")

    def end(pick):
        return rows.groupBy("unique_key").agg(pick(F.struct(*[c for c in rows.columns if c not in ("unique_key", "at_")]), "at_").alias("r")).select("unique_key", "r.*")

    stored = history.snapshot_model(source, end(F.min_by), None, at)
    return history.snapshot_model(source, end(F.max_by), stored, at).select("unique_key", "email", "display_name")


case("snapshot_slack_users", _changed_accounts("s", _SLACK_NOW))(lambda t: _account_snapshot(t, "slack_users", "b_slack_log"))
case("snapshot_zoom_users", _changed_accounts("z", _ZOOM_NOW))(lambda t: _account_snapshot(t, "zoom_users", "b_zoom_log"))
case("history_slack_users", _field_changes("s", "slack", _SLACK_NOW))(lambda t: history.history_model("slack_users", t["b_slack_log"], order=["event_id"]))
case("history_zoom_users", _field_changes("z", "zoom", _ZOOM_NOW))(lambda t: history.history_model("zoom_users", t["b_zoom_log"], order=["event_id"]))

_MEMBER_LOG = " UNION ALL ".join(
    f"SELECT id AS entity_id, tenant_id, source_id, '{f}' AS field_name, CASE WHEN vn = 1 THEN '' ELSE was_{f} END AS old_value, now_{f} AS new_value, _tracked_at::VARCHAR AS updated_at FROM v WHERE (vn = 1 AND now_{f} <> '') OR (vn > 1 AND now_{f} <> was_{f})"
    for f in _MEMBER_COLS
)


@case(
    "history_cursor_members",
    "WITH v AS (SELECT *, row_number() OVER w AS vn, "
    + ", ".join(f"{f}::VARCHAR AS now_{f}, lag({f}::VARCHAR) OVER w AS was_{f}" for f in _MEMBER_COLS)
    + f" FROM <v_versions> WINDOW w AS (PARTITION BY unique_key ORDER BY _tracked_at, event_id)) {_MEMBER_LOG}",
)
def member_field_log(t):
    return history.history_model("cursor_members", member_versions(t), order=["event_id"])


_LOGGED = ["name", "role", "isRemoved", "label"]
_FIELD_UNION = " UNION ALL ".join(
    f"SELECT id AS entity_id, tenant_id, source_id, '{f}' AS field_name, CASE WHEN vn = 1 THEN '' ELSE was_{f} END AS old_value, now_{f} AS new_value, _tracked_at FROM v WHERE (vn = 1 AND now_{f} <> '') OR (vn > 1 AND now_{f} <> was_{f})"
    for f in [*_LOGGED, "team"]
)
_FIELD_TEXT = {**{f: f"{f}::VARCHAR" for f in _LOGGED}, "team": "COALESCE(raw_data::JSON->>'team','')"}
V["v_fields_history"] = (
    "WITH v AS (SELECT *, row_number() OVER w AS vn, "
    + ", ".join(f"{e} AS now_{f}, lag({e}) OVER w AS was_{f}" for f, e in _FIELD_TEXT.items())
    + " FROM <b_member_log> WINDOW w AS (PARTITION BY unique_key ORDER BY _tracked_at, event_id)) "
    + _FIELD_UNION
)


@case("fields_history", "SELECT entity_id, tenant_id, source_id, field_name, old_value, new_value, _tracked_at::VARCHAR AS updated_at FROM <v_fields_history>")
def field_log(t):
    return history.fields_history(t["b_member_log"], "id", _LOGGED, ["team"], order=["event_id"])


_ZOOM = {"email": ("email", "bronze_zoom.users.email"), "employee_unique_id": ("employee_id", "bronze_zoom.users.employee_unique_id"), "display_name": ("display_name", "bronze_zoom.users.display_name")}
V["v_zoom_inputs"] = " UNION ALL ".join(
    f"SELECT tenant_id, source_id, 'zoom' AS source_type, entity_id AS source_account_id, '{kind}' AS alias_type, new_value AS alias_value, '{path}' AS alias_field_name, 'UPSERT' AS operation_type, updated_at AS _synced_at FROM <b_field_log> WHERE field_name = '{f}' AND new_value <> ''"
    f" UNION ALL SELECT tenant_id, source_id, 'zoom', entity_id, '{kind}', '', '{path}', 'DELETE', updated_at FROM <b_field_log> WHERE field_name = 'status' AND new_value = 'inactive'"
    for f, (kind, path) in _ZOOM.items()
)


def zoom_inputs(t):
    return history.bootstrap_inputs_from_history(t["b_field_log"], "zoom", TRACKED["zoom_users"])


case("bootstrap_inputs_from_history", "SELECT * REPLACE (_synced_at::VARCHAR AS _synced_at) FROM <v_zoom_inputs>")(zoom_inputs)

# --- seeds ---------------------------------------------------------------------------------------------

CURSOR = identity.MemberSource("cursor", "bronze_cursor.cursor_members", "isRemoved")
ADMIN = identity.MemberSource("ai_admin", "bronze_ai_admin.users")
_AS_OF = "2024-03-01 00:00:00"


def _uuid(*parts: str) -> str:
    digest = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {s}, {n})" for s, n in cuts) + ")"


# A customer is one member, seen twice; the second time stands. Every 33rd has an empty e-mail and every 35th none.
V["v_latest_members"] = f"""
SELECT {_uuid("'tenant'", "'t' || (c_custkey % 2)")} AS tenant_uuid, 'm' || c_custkey || '-1' AS id, 'user' || c_custkey || '@example.com' AS mail, ' User' || c_custkey || '@Example.com' AS email,
  CASE WHEN c_custkey % 12 > 0 THEN c_name || ' ' END AS name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS role, c_acctbal < 0 AS isRemoved
FROM <customer> WHERE c_custkey % 33 > 0 AND c_custkey % 35 > 0"""
V["v_persons"] = f"""
SELECT {_uuid("'person'", "tenant_uuid", "mail")} AS id, tenant_uuid, COALESCE(name,'') AS display_name, CASE WHEN isRemoved THEN 'inactive' ELSE 'active' END AS status, mail AS email, COALESCE(role,'') AS role,
  ((CASE WHEN name <> '' THEN 1 ELSE 0 END) + 1 + (CASE WHEN role <> '' THEN 1 ELSE 0 END)) / 7.0 AS completeness_score FROM <v_latest_members>"""
_SEEDED = "id, tenant_uuid, display_name, status, email, role, round(completeness_score,6) AS completeness_score"


def _known_third(persons):
    """Persons already stored: those whose e-mail digest starts with a digit below five."""
    return persons.where(F.substring(F.md5("email"), 1, 1) < "5")


_KNOWN = "SELECT * FROM <v_persons> WHERE substr(md5(email), 1, 1) < '5'"
_SEED_COLS = ["id", "tenant_uuid", "display_name", "status", "email", "role", "completeness_score"]


@case("seed_persons", f"SELECT {_SEEDED} FROM <v_persons>")
def persons(t):
    return identity.seed_persons(t["b_members"], None, CURSOR, _AS_OF).select(_SEED_COLS)


@case("seed_persons_incremental", f"SELECT {_SEEDED.replace('status', chr(39) + 'active' + chr(39) + ' AS status')} FROM <v_persons> p ANTI JOIN ({_KNOWN}) k USING (tenant_uuid, email)")
def persons_again(t):
    stored = _known_third(identity.seed_persons(t["b_members"], None, CURSOR, _AS_OF))
    return identity.seed_persons(t["b_members"], stored, ADMIN, _AS_OF).select(_SEED_COLS)


V["v_seed_aliases"] = " UNION ALL ".join(
    f"SELECT m.tenant_uuid, p.id AS person_id, '{kind}' AS alias_type, {value} AS alias_value, 'bronze_cursor.cursor_members.{path}' AS alias_field_name, 'cursor' AS source_type, m.id AS source_account_id FROM <v_latest_members> m JOIN <v_persons> p ON m.mail = p.email AND m.tenant_uuid = p.tenant_uuid WHERE {value} <> ''"
    for kind, value, path in (("email", "m.mail", "email"), ("platform_id", "trim(m.id)", "id"), ("display_name", "trim(m.name)", "name"))
)
_ALIAS_COLS = ["tenant_uuid", "person_id", "alias_type", "alias_value", "alias_field_name", "source_type", "source_account_id"]


def seeded_aliases(t, stored=None):
    return identity.seed_aliases(t["b_members"], identity.seed_persons(t["b_members"], None, CURSOR, _AS_OF), stored, CURSOR, _AS_OF)


case("seed_aliases", "SELECT * FROM <v_seed_aliases>")(lambda t: seeded_aliases(t).select(_ALIAS_COLS))
case("seed_aliases_incremental", "SELECT * FROM <v_seed_aliases> WHERE alias_type <> 'email'")(
    lambda t: seeded_aliases(t, seeded_aliases(t).where(F.col("alias_type") == "email")).select(_ALIAS_COLS)
)
V["v_seed_inputs"] = " UNION ALL ".join(
    f"SELECT tenant_uuid, 'cursor' AS source_type, id AS source_account_id, '{kind}' AS alias_type, {value} AS alias_value, 'bronze_cursor.cursor_members.{path}' AS alias_field_name, 'UPSERT' AS operation_type FROM <v_latest_members> WHERE {value} <> ''"
    for kind, value, path in (("email", "email", "email"), ("platform_id", "id", "id"), ("display_name", "name", "name"))
)


def seeded_inputs(t, existing=None):
    return identity.seed_bootstrap_inputs(t["b_members"], existing, CURSOR, _AS_OF)


_IN_COLS = ["tenant_uuid", "source_type", "source_account_id", "alias_type", "alias_value", "alias_field_name", "operation_type"]
case("seed_bootstrap_inputs", "SELECT * FROM <v_seed_inputs>")(lambda t: seeded_inputs(t).select(_IN_COLS))
case("seed_bootstrap_inputs_incremental", "SELECT * FROM <v_seed_inputs> WHERE alias_type <> 'display_name'")(
    lambda t: seeded_inputs(t, seeded_inputs(t).where(F.col("alias_type") == "display_name")).select(_IN_COLS)
)


@case(
    "bootstrap_inputs",
    """SELECT source_type, source_account_id, alias_type, alias_value, alias_field_name, operation_type FROM <v_zoom_inputs> UNION ALL SELECT source_type, source_account_id, alias_type, alias_value, alias_field_name, operation_type FROM <v_seed_inputs>""",
)
def all_inputs(t):
    from orgpulse.plans.registry import Registry, union_by_tag

    registry = Registry().add("zoom", {"bootstrap_inputs"}, lambda: zoom_inputs(t)).add("cursor", {"bootstrap_inputs"}, lambda: seeded_inputs(t))
    return union_by_tag(registry, "bootstrap_inputs").select(_IN_COLS[1:])


# --- people store ----------------------------------------------------------------------------------------

V["v_store"] = """
SELECT tenant_id, id, lower(workEmail) AS person_id, workEmail AS email, COALESCE(displayName,'') AS display_name, COALESCE(firstName,'') AS first_name, COALESCE(lastName,'') AS last_name, COALESCE(department,'') AS department, COALESCE(division,'') AS division,
  COALESCE(jobTitle,'') AS job_title, status, lower(supervisorEmail) AS supervisor_id, supervisor AS supervisor_name FROM <b_employees> WHERE status = 'Active' AND workEmail <> ''
QUALIFY row_number() OVER (PARTITION BY tenant_id, id ORDER BY _airbyte_extracted_at DESC) = 1"""


def store(t):
    return identity.person_store(t["b_employees"])


def one_tenant_store(t):
    """Reporting lines cross the two bound tenants, so the tree runs with one."""
    return store(t).withColumn("tenant_id", F.lit("t"))


case("person_store", "SELECT * FROM <v_store>")(store)
case("person_lookup", "SELECT * FROM <v_store> WHERE person_id = 'user1@example.com'")(lambda t: identity.person_lookup(store(t), "USER1@example.com"))


@case(
    "subordinates",
    """
WITH RECURSIVE tree AS (SELECT person_id AS root_id, person_id, 0 AS depth, [person_id] AS path FROM <v_store>
  UNION ALL SELECT root_id, s.person_id, depth + 1, list_append(path, s.person_id) FROM tree JOIN <v_store> s ON s.supervisor_id = tree.person_id WHERE NOT list_contains(path, s.person_id))
SELECT 't' AS tenant_id, root_id, person_id, depth, array_to_string(path, '|') AS path FROM tree WHERE depth > 0""",
)
def reports(t):
    return identity.subordinates(one_tenant_store(t))


@case(
    "people_tree",
    """
WITH RECURSIVE tree AS (SELECT person_id, 0 AS depth, [person_id] AS path FROM <v_store> WHERE person_id = 'user1@example.com'
  UNION ALL SELECT s.person_id, depth + 1, list_append(path, s.person_id) FROM tree JOIN <v_store> s ON s.supervisor_id = tree.person_id WHERE NOT list_contains(path, s.person_id))
SELECT 't' AS tenant_id, person_id, depth, array_to_string(path, '|') AS path, COALESCE((SELECT string_agg(c.person_id, '|' ORDER BY c.person_id) FROM tree c WHERE c.path[-2] = t.person_id), '') AS direct_reports FROM tree t""",
)
def tree_of_one(t):
    return identity.people_tree(one_tenant_store(t), "user1@example.com")


# --- aliases -----------------------------------------------------------------------------------------------


@case(
    "resolve_aliases",
    """
SELECT e.tenant_id, event_id, mail, person_id FROM <b_ev> e LEFT JOIN (SELECT tenant_id, alias_value, min(person_id) AS person_id FROM <b_aliases> WHERE alias_type = 'email' AND is_active = 1 AND is_deleted = 0 GROUP BY ALL) a
ON a.tenant_id = e.tenant_id AND a.alias_value = lower(trim(e.mail))""",
)
def resolved(t):
    return identity.resolve_aliases(t["b_ev"].select("tenant_id", "event_id", "mail"), t["b_aliases"], "email", "mail")


@case(
    "normalize_alias",
    """
WITH o AS (SELECT DISTINCT tenant_id, source_type, alias_type, alias_value FROM <b_obs>), n AS (SELECT *, CASE WHEN alias_type = 'email' THEN regexp_replace(lower(trim(alias_value)), '\\+[^@]*@', '@') ELSE lower(trim(alias_value)) END AS normal_value FROM o)
SELECT *, 'direct' AS via FROM n UNION ALL SELECT tenant_id, source_type, alias_type, alias_value, replace(normal_value, 'example.com', 'example.org'), 'domain_alias' FROM n WHERE alias_type = 'email' AND normal_value LIKE '%@example.com'""",
)
def normalized(t):
    domains = t["b_domains"].select(F.lit("example.com").alias("domain"), F.col("domain").alias("equivalent"))
    return identity.normalize_alias(t["b_obs"].select("tenant_id", "source_type", "alias_type", "alias_value").distinct(), domains)


@case(
    "alias_conflicts",
    """
WITH l AS (SELECT DISTINCT tenant_id, alias_type, alias_value, person_id FROM <b_aliases> WHERE is_deleted = 0), m AS (SELECT *, min(person_id) OVER w AS a, count(*) OVER w AS persons FROM l WINDOW w AS (PARTITION BY tenant_id, alias_type, alias_value))
SELECT tenant_id, alias_type, alias_value, a AS person_id_a, person_id AS person_id_b, persons FROM m WHERE persons > 1 AND person_id <> a""",
)
def conflicts(t):
    return identity.alias_conflicts(t["b_aliases"])


V["v_known_aliases"] = """
SELECT tenant_id, 'P' || id AS person_id, 'hr' AS source_type, id AS source_account_id, 'email' AS alias_type, lower(workEmail) AS alias_value FROM <b_employees_now> WHERE workEmail <> '' AND id::BIGINT % 3 < 2
UNION ALL SELECT tenant_id, 'P' || id, 'hr', id, 'username', 'user' || id FROM <b_employees_now> WHERE id::BIGINT % 4 = 0"""


def known_aliases(t):
    rows = t["b_employees_now"]
    number = F.col("id").cast("bigint")
    mails = rows.where(fx.filled("workEmail") & (number % 3 < 2)).select("tenant_id", F.concat(F.lit("P"), "id").alias("person_id"), F.lit("hr").alias("source_type"), F.col("id").alias("source_account_id"), F.lit("email").alias("alias_type"), F.lower("workEmail").alias("alias_value"))
    users = rows.where(number % 4 == 0).select("tenant_id", F.concat(F.lit("P"), "id").alias("person_id"), F.lit("hr").alias("source_type"), F.col("id").alias("source_account_id"), F.lit("username").alias("alias_type"), F.concat(F.lit("user"), "id").alias("alias_value"))
    return mails.unionByName(users)


def domain_groups(t):
    return t["b_domains"].select("domain", "domain_group")


_RULE_CONF = "CASE rule " + " ".join(f"WHEN '{r}' THEN {c}" for r, c in matching.CONFIDENCE.items()) + " END::DOUBLE"
V["v_candidates"] = f"""
WITH o AS (SELECT DISTINCT tenant_id, source_type, alias_type, alias_value, trim(alias_value) AS tr, lower(trim(alias_value)) AS lo, regexp_replace(lower(trim(alias_value)), '\\+[^@]*@', '@') AS un FROM <b_obs>),
  a AS (SELECT *, alias_value AS tr2, lower(alias_value) AS lo2, regexp_replace(lower(alias_value), '\\+[^@]*@', '@') AS un2 FROM <v_known_aliases>),
  pairs AS (
    SELECT o.*, a.person_id, 'email' AS grp, CASE WHEN tr = tr2 THEN 'email_exact' WHEN lo = lo2 THEN 'email_case_norm' WHEN un = un2 THEN 'email_plus_tag' ELSE 'email_domain_alias' END AS rule
    FROM o JOIN a USING (tenant_id) WHERE o.alias_type = 'email' AND a.alias_type = 'email' AND replace(un, 'example.org', 'example.com') = replace(un2, 'example.org', 'example.com')
    UNION ALL SELECT o.*, a.person_id, 'username', CASE WHEN o.source_type = a.source_type THEN 'username_same_sys' ELSE 'username_cross_sys' END FROM o JOIN a USING (tenant_id) WHERE o.alias_type = 'username' AND a.alias_type = 'username' AND lo = lo2
    UNION ALL SELECT o.*, a.person_id, 'cross', 'email_to_username' FROM o JOIN a USING (tenant_id) WHERE o.source_type <> a.source_type AND ((o.alias_type = 'email' AND a.alias_type = 'username' AND split_part(un, '@', 1) = lo2) OR (o.alias_type = 'username' AND a.alias_type = 'email' AND lo = split_part(un2, '@', 1)))),
  rated AS (SELECT *, {_RULE_CONF} AS c FROM pairs)
SELECT tenant_id, source_type, alias_type, alias_value, person_id, grp, max_by(rule, c) AS rule, max(c) AS confidence FROM rated GROUP BY ALL"""


def candidates(t):
    return matching.match_candidates(t["b_obs"], known_aliases(t), domain_groups(t))


case("match_rules", "SELECT * EXCLUDE (grp) FROM <v_candidates>")(candidates)
V["v_verdicts"] = """
WITH s AS (SELECT tenant_id, source_type, alias_type, alias_value, person_id, avg(confidence) AS confidence FROM <v_candidates> GROUP BY ALL),
  r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY tenant_id, source_type, alias_type, alias_value) AS n FROM s WINDOW w AS (PARTITION BY tenant_id, source_type, alias_type, alias_value ORDER BY confidence DESC, person_id DESC))
SELECT tenant_id, source_type, alias_type, alias_value, person_id, round(confidence,6) AS confidence, n AS persons_considered, CASE WHEN confidence >= 1 THEN 'link' WHEN confidence >= 0.5 THEN 'suggest' ELSE 'unmapped' END AS decision FROM r WHERE rn = 1"""
case("composite_confidence", "SELECT * FROM <v_verdicts>")(lambda t: matching.composite_confidence(candidates(t)))


def _boot(t):
    return matching.bootstrap_job(t["b_obs"], known_aliases(t), None, domain_groups(t))


V["v_seen"] = """
SELECT tenant_id, source_type, source_account_id, alias_type, lower(trim(alias_value)) AS alias_value, count(*) AS occurrences, max(_synced_at) AS last_at FROM <b_obs> WHERE operation_type = 'UPSERT' AND alias_value <> '' GROUP BY tenant_id, source_type, source_account_id, alias_type, lower(trim(alias_value))"""
V["v_owned"] = """
SELECT s.*, o.owner_id, c.account_person FROM <v_seen> s LEFT JOIN (SELECT tenant_id, alias_type, alias_value, min(person_id) AS owner_id FROM <v_known_aliases> GROUP BY ALL) o USING (tenant_id, alias_type, alias_value)
LEFT JOIN (SELECT tenant_id, source_type, source_account_id, min(person_id) AS account_person FROM <v_known_aliases> GROUP BY ALL) c USING (tenant_id, source_type, source_account_id)"""


@case(
    "bootstrap_job",
    """SELECT tenant_id, alias_type, alias_value, source_type, source_account_id, owner_id AS person_id, 1.0::DOUBLE AS confidence, 'touch' AS action, last_at::VARCHAR AS last_observed_at FROM <v_owned> WHERE owner_id IS NOT NULL AND (account_person IS NULL OR account_person = owner_id)""",
)
def boot_aliases(t):
    return _boot(t).aliases


@case("bootstrap_job_unmapped")
def boot_unmapped(t):
    return _boot(t).unmapped


@case(
    "bootstrap_job_conflicts",
    """SELECT tenant_id, alias_type, alias_value, owner_id AS person_id_a, account_person AS person_id_b, source_type AS source_type_b, 'open' AS status FROM (
  SELECT s.*, o.owner_id, c.account_person FROM (SELECT tenant_id, source_type, (source_account_id::BIGINT + 2)::VARCHAR AS source_account_id, alias_type, alias_value FROM <v_seen>) s
  JOIN (SELECT tenant_id, alias_type, alias_value, min(person_id) AS owner_id FROM <v_known_aliases> GROUP BY ALL) o USING (tenant_id, alias_type, alias_value)
  JOIN (SELECT tenant_id, source_type, source_account_id, min(person_id) AS account_person FROM <v_known_aliases> GROUP BY ALL) c USING (tenant_id, source_type, source_account_id)) WHERE account_person <> owner_id""",
)
def boot_conflicts(t):
    shifted = t["b_obs"].withColumn("source_account_id", (F.col("source_account_id").cast("bigint") + 2).cast("string"))
    return matching.bootstrap_job(shifted, known_aliases(t), None, domain_groups(t)).conflicts


# --- grouping ------------------------------------------------------------------------------------------------

# Recursive closure over the star of each token: the oracle reaches the smallest account id of a group.
_COMPONENT_SQL = """
WITH RECURSIVE star AS (SELECT DISTINCT rid, min(rid) OVER (PARTITION BY token) AS low FROM {pairs}), edges AS (SELECT rid AS a, low AS b FROM star UNION SELECT low, rid FROM star),
  reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), g AS (SELECT a AS rid, min(b) AS group_id FROM reach GROUP BY a)
SELECT rid, group_id, dense_rank() OVER (ORDER BY group_id) AS profile_group_id FROM g"""
V["v_groups"] = _COMPONENT_SQL.format(pairs="<b_sparse_tokens>")


def groups(t):
    return components.identity_components(t["b_sparse_tokens"])


case("identity_components", "SELECT * FROM <v_groups>")(groups)


@case("identity_merge_batch", "SELECT rid, group_id FROM <v_groups>")
def grouped_in_batches(t):
    """Three batches of pairs, each merged into stored versioned tables of accounts and tokens."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/groups-{uuid.uuid4().hex}"
    accounts, tokens = f"{folder}/accounts", f"{folder}/tokens"
    pairs = t["b_sparse_tokens"]
    for part in range(3):
        batch = pairs.where(F.pmod(F.xxhash64("token", "rid"), F.lit(3)) == part)
        number = F.lit(part).alias("_batch")
        if part == 0:
            known, seen = (t.spark.createDataFrame([], f"{key} {kind}, group_id bigint, _batch int") for key, kind in (("rid", "bigint"), ("token", "string")))
        else:
            known, seen = versioned.read(t.spark, accounts), versioned.read(t.spark, tokens)
        changed, changed_tokens = components.merge_batch(known, seen, batch)
        versioned.upsert(changed.select("*", number), accounts, ["rid"], ["_batch"])
        versioned.upsert(changed_tokens.select("*", number), tokens, ["token"], ["_batch"])
    return versioned.read(t.spark, accounts).select("rid", "group_id")


@case("profile_link", "SELECT profile_group_id, min(CASE WHEN o_orderstatus = 'F' THEN 'a' || o_orderkey END) AS F_id, min(CASE WHEN o_orderstatus = 'O' THEN 'a' || o_orderkey END) AS O_id, min(CASE WHEN o_orderstatus = 'P' THEN 'a' || o_orderkey END) AS P_id FROM <orders> JOIN <v_groups> ON rid = o_orderkey GROUP BY ALL")
def links(t):
    accounts = t["orders"].select(F.col("o_orderstatus").alias("source"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("source_account_id"), F.col("o_orderkey").alias("rid"))
    return components.profile_link(components.final_groups(accounts, groups(t)), ["F", "O", "P"])


V["v_mail_pairs"] = """
SELECT 'alexei ' || lower(c_mktsegment) || ' ' || floor(c_custkey / 4)::BIGINT AS token, c_custkey AS rid FROM <customer> WHERE c_custkey % 4 < 2
UNION ALL SELECT 'alexey ' || lower(c_mktsegment) || ' ' || floor(c_custkey / 4)::BIGINT, c_custkey FROM <customer> WHERE c_custkey % 4 = 2
UNION ALL SELECT 'user' || floor(c_custkey / 2)::BIGINT || CASE WHEN c_custkey % 2 = 0 THEN '@gmail.test' ELSE '@corp.test' END, c_custkey FROM <customer> WHERE c_custkey % 3 > 0"""


def mail_pairs(t):
    c, k = t["customer"], F.col("c_custkey")
    part = lambda n: F.floor(k / n).cast("bigint").cast("string")
    named = lambda first: F.concat_ws(" ", F.lit(first), F.lower("c_mktsegment"), part(4)).alias("token")
    host = F.when(k % 2 == 0, "@gmail.test").otherwise("@corp.test")
    return (
        c.where(k % 4 < 2).select(named("alexei"), k.alias("rid"))
        .unionByName(c.where(k % 4 == 2).select(named("alexey"), k.alias("rid")))
        .unionByName(c.where(k % 3 > 0).select(F.concat(F.lit("user"), part(2), host).alias("token"), k.alias("rid")))
    )


V["v_enriched"] = """
SELECT DISTINCT token, rid, '' AS meta FROM <v_mail_pairs>
UNION SELECT 'alexey' || substr(token, 7), rid, 'alias' FROM <v_mail_pairs> WHERE token LIKE 'alexei %'
UNION SELECT replace(token, '@gmail.test', '@corp.test'), rid, 'domain' FROM <v_mail_pairs> WHERE token LIKE '%@gmail.test'
UNION SELECT replace(token, '@corp.test', '@gmail.test'), rid, 'domain' FROM <v_mail_pairs> WHERE token LIKE '%@corp.test'
UNION SELECT 'bridge@x.test', rid, 'manual' FROM <v_mail_pairs> WHERE token = 'user1@gmail.test'
UNION SELECT 'user1@gmail.test', rid, 'manual' FROM <v_mail_pairs> WHERE token = 'bridge@x.test'"""


def enriched(t):
    spark = t.spark
    manual = spark.createDataFrame([("user1@gmail.test", "bridge@x.test")], "token_a string, token_b string")
    names = spark.createDataFrame([("alexei", "alexey")], "first_name string, alias string")
    domains = spark.createDataFrame([("gmail.test",), ("corp.test",)], "domain string")
    return components.identity_enrichment(mail_pairs(t), manual, names, domains)


case("identity_enrichment", "SELECT * FROM <v_enriched>")(enriched)
V["v_natural"] = _COMPONENT_SQL.format(pairs="(SELECT token, rid FROM <v_enriched> WHERE meta = '')")


@case(
    "augmented_groups",
    """
WITH placed AS (SELECT e.*, COALESCE(group_id, e.rid) AS g FROM <v_enriched> e LEFT JOIN <v_natural> USING (rid)), b AS (SELECT token FROM placed GROUP BY token HAVING min(g) <> max(g))
SELECT token, rid, meta FROM <v_enriched> WHERE meta <> '' AND token IN (SELECT token FROM b)""",
)
def bridging(t):
    return components.augmented_groups(enriched(t))


@case("profile_emails", "SELECT DISTINCT lower(token) AS email, profile_group_id FROM <v_mail_pairs> JOIN (" + _COMPONENT_SQL.format(pairs="<v_mail_pairs>") + ") USING (rid) WHERE token LIKE '%@%'")
def mails_of_groups(t):
    pairs = mail_pairs(t)
    return components.profile_emails(pairs, components.identity_components(pairs))


@case(
    "lastname_review_list",
    """
WITH terms AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS last_name, p_size AS name_group FROM <part> WHERE split_part(p_name, ' ', 2) <> 'gear'),
  words AS (SELECT s_suppkey, lower(CASE s_suppkey % 3 WHEN 0 THEN 'a' || w WHEN 1 THEN w || 's' ELSE left(w, 3) || 'x' END) AS word FROM (SELECT s_suppkey, split_part(p_name, ' ', 2) AS w FROM <supplier> JOIN <part> ON p_partkey = s_suppkey)),
  hits AS (SELECT *, list_max([n FOR n IN range(1, length(last_name) + 1) IF contains(word, left(last_name, n))]) / length(last_name) - abs(length(word) - length(last_name)) / greatest(length(word), length(last_name)) / 2 AS score FROM terms JOIN words ON name_group <> s_suppkey)
SELECT last_name, name_group, word || '.' || s_suppkey || '@x.test' AS email, s_suppkey AS email_group, word AS best_word, round(score, 6) AS score FROM hits WHERE score >= 0.5""",
)
def review_list(t):
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    names = t["part"].select(last.alias("last_name"), F.col("p_size").alias("group_id"))
    k, w = F.col("s_suppkey"), F.col("w")
    rows = t["supplier"].join(t["part"], F.col("p_partkey") == k).withColumn("w", last)
    word = F.lower(F.when(k % 3 == 0, F.concat(F.lit("a"), w)).when(k % 3 == 1, F.concat(w, F.lit("s"))).otherwise(F.concat(F.substring(w, 1, 3), F.lit("x"))))
    emails = rows.select(F.concat(word, F.lit("."), k.cast("string"), F.lit("@x.test")).alias("email"), k.alias("group_id"))
    return components.lastname_review_list(names, emails, ["gear"], 0.5)


# --- golden record -----------------------------------------------------------------------------------------------

_RANK = "CASE source_kind WHEN 'manual' THEN 1 WHEN 'hr' THEN 2 WHEN 'git' THEN 3 WHEN 'communication' THEN 4 WHEN 'auto' THEN 5 ELSE 6 END"
_GOLD_ATTRS = ["display_name", "email", "role", "location"]


@case(
    "golden_record",
    f"WITH b AS (SELECT tenant_id, person_id, attribute, value, source_kind FROM <b_attr> WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY tenant_id, person_id, attribute ORDER BY {_RANK}, observed_at DESC, value) = 1) SELECT tenant_id, person_id, "
    + ", ".join(f"max(CASE WHEN attribute = '{a}' THEN value END) AS {a}, max(CASE WHEN attribute = '{a}' THEN source_kind END) AS {a}_source" for a in _GOLD_ATTRS)
    + ", round(count(*) / 7.0, 6) AS completeness_score FROM b GROUP BY tenant_id, person_id",
)
def golden(t):
    return identity.golden_record(t["b_attr"], _GOLD_ATTRS)


@case(
    "attribute_conflicts",
    f"""
WITH v AS (SELECT tenant_id, person_id, attribute, value, min({_RANK}) AS r FROM <b_attr> WHERE value <> '' GROUP BY ALL), q AS (SELECT * FROM v QUALIFY r = min(r) OVER (PARTITION BY tenant_id, person_id, attribute))
SELECT tenant_id, person_id, attribute, count(*) AS values_at_top, min(value) AS value_a, max(value) AS value_b, 'needs_review' AS conflict_status FROM q GROUP BY ALL HAVING count(*) > 1""",
)
def disputes(t):
    return identity.attribute_conflicts(t["b_attr"])


@case(
    "contribution_changed",
    """SELECT c_custkey, c_mktsegment, c_nationkey, sha256(concat_ws(chr(31), c_mktsegment, c_nationkey::VARCHAR)) AS record_hash FROM <customer> WHERE c_custkey % 3 <> 1""",
)
def moved(t):
    rows = t["customer"].select("c_custkey", "c_mktsegment", "c_nationkey")
    digest = F.sha2(fx.join_key("\x1f", "c_mktsegment", "c_nationkey"), 256)
    key = F.col("c_custkey") % 3
    stored = rows.where(key > 0).select("c_custkey", F.when(key == 1, digest).otherwise(F.lit("old")).alias("record_hash"))
    return identity.contribution_changed(rows, stored, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


_MERGED = "SELECT alias_id, CASE WHEN person_id = 'P3' THEN 'P7' ELSE person_id END AS person_id FROM <b_aliases>"
case("merge_persons", _MERGED)(lambda t: identity.merge_persons(t["b_aliases"], "P3", "P7", "a1", _AS_OF)[0].select("alias_id", "person_id"))
case(
    "merge_persons_audit",
    """SELECT 'a1' AS audit_id, alias_id, '{"alias_id":"' || alias_id || '","person_id":"' || person_id || '"}' AS snapshot_before, '{"alias_id":"' || alias_id || '","person_id":"P7"}' AS snapshot_after FROM <b_aliases> WHERE person_id IN ('P3','P7')""",
)(lambda t: identity.merge_persons(t["b_aliases"], "P3", "P7", "a1", _AS_OF)[1].select("audit_id", "alias_id", "snapshot_before", "snapshot_after"))


@case("split_persons", "SELECT alias_id, person_id FROM <b_aliases>")
def split_back(t):
    merged, audit = identity.merge_persons(t["b_aliases"], "P3", "P7", "a1", _AS_OF)
    return identity.split_persons(merged, audit, "a1")[0].select("alias_id", "person_id")


def _purged(t):
    gone = t["b_employees_now"].where(F.col("status") == "Inactive").select(F.concat(F.lit("P"), "id").alias("person_id"))
    return identity.gdpr_purge(t["b_aliases"], gone, _AS_OF)


_GONE = "(SELECT 'P' || id AS person_id FROM <b_employees_now> WHERE status = 'Inactive')"
case("gdpr_purge", f"SELECT alias_id, person_id FROM <b_aliases> ANTI JOIN {_GONE} g USING (person_id)")(lambda t: _purged(t)[0].select("alias_id", "person_id"))
case("gdpr_purge_archive", f"SELECT alias_id, person_id, 1 AS is_deleted FROM <b_aliases> SEMI JOIN {_GONE} g USING (person_id)")(lambda t: _purged(t)[1].select("alias_id", "person_id", "is_deleted"))


@case(
    "availability_normalise",
    """
WITH cal AS (SELECT DISTINCT o_orderdate::DATE AS day FROM <orders>), absent AS (SELECT DISTINCT l.tenant_id, l.source_person_id AS person_id, d.day FROM (SELECT *, unnest(generate_series(start_date::DATE, end_date::DATE - 1, INTERVAL 1 DAY))::DATE AS day FROM <v_leave> WHERE end_date > start_date) d JOIN <v_leave> l USING (unique_key))
SELECT tenant_id, id AS person_id, COALESCE(n, 0) AS absent_days, (SELECT count(*) FROM cal) - COALESCE(n, 0) AS available_days FROM <b_employees_now> LEFT JOIN (SELECT tenant_id, person_id AS id, count(*) AS n FROM absent SEMI JOIN cal USING (day) GROUP BY ALL) USING (tenant_id, id)""",
)
def available(t):
    from harness.work_cases import leave_events

    absences = leave_events(t).select("tenant_id", F.col("source_person_id").alias("person_id"), F.to_date("start_date").alias("absent_from"), F.to_date("end_date").alias("absent_to"))
    calendar = t["orders"].select(F.to_date("o_orderdate").alias("day")).distinct()
    return identity.availability(t["b_employees_now"].select("tenant_id", F.col("id").alias("person_id")), absences, calendar)


# --- dated rows -------------------------------------------------------------------------------------------------------

V["v_open"] = "SELECT 't0' AS tenant_id, c_custkey AS person_id, c_nationkey AS unit, TIMESTAMP '2020-01-01' AS valid_from, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2021-01-01' END AS valid_to FROM <customer> WHERE c_custkey % 4 <> 3"
V["v_incoming"] = "SELECT 't0' AS tenant_id, c_custkey AS person_id, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE c_nationkey END AS unit FROM <customer> WHERE c_custkey % 5 <> 4"
_SCD_SQL = """
SELECT tenant_id, person_id, unit, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM <v_open> WHERE valid_to IS NOT NULL
UNION ALL SELECT o.tenant_id, o.person_id, o.unit, o.valid_from::VARCHAR, CASE WHEN i.unit IS NOT NULL AND i.unit <> o.unit THEN '2024-01-01 00:00:00' END FROM <v_open> o LEFT JOIN <v_incoming> i USING (tenant_id, person_id) WHERE o.valid_to IS NULL
UNION ALL SELECT i.tenant_id, i.person_id, i.unit, '2024-01-01 00:00:00', NULL FROM <v_incoming> i LEFT JOIN (SELECT * FROM <v_open> WHERE valid_to IS NULL) o USING (tenant_id, person_id) WHERE o.unit IS NULL OR o.unit <> i.unit"""


def _scd(t, kernel):
    k = F.col("c_custkey")
    at = F.lit("2024-01-01").cast("timestamp")
    current = t["customer"].where(k % 4 != 3).select(
        F.lit("t0").alias("tenant_id"), k.alias("person_id"), F.col("c_nationkey").alias("unit"), F.lit("2020-01-01").cast("timestamp").alias("valid_from"), F.when(k % 10 == 0, F.lit("2021-01-01").cast("timestamp")).alias("valid_to")
    )
    incoming = t["customer"].where(k % 5 != 4).select(F.lit("t0").alias("tenant_id"), k.alias("person_id"), F.when(k % 3 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).alias("unit"))
    return kernel(current, incoming, ["tenant_id", "person_id"], ["unit"], at)


case("scd2_merge", _SCD_SQL)(lambda t: _scd(t, history.scd2_merge))
case("scd2_close_and_insert", _SCD_SQL)(lambda t: _scd(t, org.scd2_close_and_insert))


@case(
    "scd2_source_priority",
    """SELECT user_id, event_id, event_type AS source FROM <b_ev> QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_type, event_id) = 1""",
)
def priority_rows(t):
    first = t["b_ev"].groupBy("user_id", "k", F.col("event_type").alias("source")).agg(F.min("event_id").alias("event_id"))
    return history.highest_source(first, ["user_id", "k"], {"signup": 1, "view": 2}).select("user_id", "event_id", "source")


@case(
    "custom_attribute_maps",
    """SELECT c_custkey, concat_ws('|', 'name=' || c_name, 'segment=' || CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END) AS custom_str_attrs, 'nation=' || c_nationkey || '.0' AS custom_num_attrs FROM <customer>""",
)
def attribute_maps(t):
    rows = t["customer"].withColumn("seg", F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).otherwise(""))
    return history.custom_attribute_maps(rows, {"name": "c_name", "segment": "seg"}, {"nation": "c_nationkey", "bad": "c_name"}).select("c_custkey", "custom_str_attrs", "custom_num_attrs")


# --- organisation ------------------------------------------------------------------------------------------------------

V["v_paths"] = """
WITH RECURSIVE p AS (SELECT tenant_id, unit_id, parent_id, '/' || lower(replace(name, ' ', '-')) AS path, 0 AS depth FROM <b_units> WHERE parent_id IS NULL
  UNION ALL SELECT u.tenant_id, u.unit_id, u.parent_id, p.path || '/' || lower(replace(u.name, ' ', '-')), p.depth + 1 FROM <b_units> u JOIN p ON u.parent_id = p.unit_id AND u.tenant_id = p.tenant_id)
SELECT * FROM p"""


def paths(t):
    return org.org_paths(t["b_units"])


case("org_paths", "SELECT * FROM <v_paths>")(paths)
case("org_subtree", "SELECT * FROM <v_paths> WHERE path = '/unit-0/unit-2' OR path LIKE '/unit-0/unit-2/%'")(lambda t: org.org_subtree(paths(t), "/unit-0/unit-2"))


@case(
    "org_ancestors",
    """
SELECT a.tenant_id, a.person_id, u.unit_id AS ancestor_id, u.path, o.depth - u.depth AS distance FROM <b_assignments> a JOIN <v_paths> o ON o.unit_id = a.unit_id JOIN <v_paths> u ON o.path = u.path OR o.path LIKE u.path || '/%' WHERE a.valid_to IS NULL""",
)
def ancestors(t):
    return org.org_ancestors(paths(t), t["b_assignments"])


@case(
    "org_rollup",
    """
WITH m AS (SELECT f.tenant_id, amount, nullif(split_part(path, '/', 2), '') AS company, nullif(split_part(path, '/', 3), '') AS division, nullif(split_part(path, '/', 4), '') AS department FROM <b_facts> f JOIN <v_paths> USING (tenant_id, unit_id))
SELECT tenant_id, company, division, department, sum(amount) AS amount, 3 AS rollup_depth FROM m GROUP BY ALL UNION ALL SELECT tenant_id, company, division, NULL, sum(amount), 2 FROM m GROUP BY ALL
UNION ALL SELECT tenant_id, company, NULL, NULL, sum(amount), 1 FROM m GROUP BY ALL UNION ALL SELECT tenant_id, NULL, NULL, NULL, sum(amount), 0 FROM m GROUP BY ALL""",
)
def rolled_up(t):
    return org.org_rollup(t["b_facts"], paths(t), ["company", "division", "department"], {"amount": F.sum("amount")})


@case("org_repath", "SELECT unit_id, CASE WHEN path = '/unit-0/unit-2' OR path LIKE '/unit-0/unit-2/%' THEN '/unit-0/unit-1/unit-2' || substr(path, 15) ELSE path END AS path, CASE WHEN path = '/unit-0/unit-2' OR path LIKE '/unit-0/unit-2/%' THEN depth + 1 ELSE depth END AS depth FROM <v_paths>")
def repathed(t):
    return org.repath_descendants(paths(t), "/unit-0/unit-2", "/unit-0/unit-1/unit-2").select("unit_id", "path", "depth")


@case("as_of_state", "SELECT person_id, unit_id, o_orderkey FROM <b_assignments> WHERE valid_from <= TIMESTAMP '1999-01-01' AND (valid_to IS NULL OR TIMESTAMP '1999-01-01' < valid_to)")
def state_then(t):
    return org.as_of_state(t["b_assignments"], "1999-01-01").select("person_id", "unit_id", "o_orderkey")


_TJ = "FROM <b_facts> f {how} JOIN <b_assignments> a ON a.tenant_id = f.tenant_id AND a.person_id = f.person_id AND a.valid_from <= f.at AND (a.valid_to IS NULL OR f.at < a.valid_to)"


@case("temporal_join", "SELECT f.fact_id, f.person_id, f.amount, a.unit_id AS assigned_unit " + _TJ.format(how="LEFT"))
def at_the_time(t):
    assigned = t["b_assignments"].withColumn("assigned_unit", F.col("unit_id"))
    return org.temporal_join(t["b_facts"], assigned, ["tenant_id", "person_id"], "at", ["assigned_unit"]).select("fact_id", "person_id", "amount", "assigned_unit")


@case("follow_the_unit", "SELECT f.fact_id, f.person_id " + _TJ.format(how="") + " WHERE a.unit_id IN (SELECT unit_id FROM <v_paths> WHERE path = '/unit-0/unit-1' OR path LIKE '/unit-0/unit-1/%')")
def visible(t):
    return org.follow_the_unit(t["b_facts"], t["b_assignments"], paths(t), "/unit-0/unit-1", "at").select("fact_id", "person_id")


@case(
    "data_scope",
    """SELECT fact_id, unit_id FROM <b_facts> f WHERE source IN ('A','N') AND f.at >= TIMESTAMP '1996-01-01' AND f.at < TIMESTAMP '1999-01-01' AND unit_id IN (SELECT unit_id FROM <v_paths> WHERE path LIKE '/unit-0/unit-3%' OR path LIKE '/unit-0/unit-5%')""",
)
def scoped(t):
    scope = org.Scope("t0", ("/unit-0/unit-3", "/unit-0/unit-5"), "1996-01-01", "1999-01-01", ("A", "N"))
    return org.data_scope(t["b_facts"], scope, paths(t), "at", "source").select("fact_id", "unit_id")


@case(
    "cohort_benchmark",
    """
SELECT *, round(percent_rank() OVER (PARTITION BY tenant_id, functional_team ORDER BY score), 6) AS percentile, round(avg(score) OVER (PARTITION BY tenant_id, functional_team), 6) AS cohort_avg, count(*) OVER (PARTITION BY tenant_id, functional_team) AS cohort_size
FROM (SELECT 't0' AS tenant_id, c_custkey AS person_id, floor(c_acctbal / 50)::DOUBLE AS score, c_mktsegment AS functional_team FROM <customer>)""",
)
def benchmark(t):
    rows = t["customer"].select(F.lit("t0").alias("tenant_id"), F.col("c_custkey").alias("person_id"), F.floor(F.col("c_acctbal") / 50).cast("double").alias("score"), F.col("c_mktsegment").alias("functional_team"))
    return org.cohort_benchmark(rows.drop("functional_team"), rows, "score")


V["v_scd_distinct"] = "SELECT tenant_id, person_id, valid_from, max(valid_to) AS valid_to FROM <b_scd> GROUP BY ALL"


@case(
    "no_overlap_check",
    """SELECT tenant_id, person_id, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, nf::VARCHAR AS next_from FROM (SELECT *, lead(valid_from) OVER (PARTITION BY tenant_id, person_id ORDER BY valid_from) AS nf FROM <v_scd_distinct>) WHERE nf IS NOT NULL AND (valid_to IS NULL OR valid_to > nf)""",
)
def overlaps(t):
    rows = t["b_scd"].groupBy("tenant_id", "person_id", "valid_from").agg(F.max("valid_to").alias("valid_to"))
    return org.overlap_violations(rows, ["tenant_id", "person_id"])


@case("one_open_row_check", "SELECT tenant_id, person_id, count_if(valid_to IS NULL) AS open_rows FROM <b_scd> GROUP BY ALL HAVING count_if(valid_to IS NULL) <> 1")
def open_rows(t):
    return org.open_row_violations(t["b_scd"], ["tenant_id", "person_id"])
