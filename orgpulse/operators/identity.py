"""Person seeds, alias seeds, lookup, reporting lines."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import latest_per_key
from orgpulse.session import cut_lineage
from orgpulse.sources.landing import qualify_latest

ZERO_UUID = "00000000-0000-0000-0000-000000000000"
OPEN_END = "1970-01-01 00:00:00"
# Fixed value: attributes that count towards completeness.
GOLDEN = ["display_name", "email", "username", "role", "manager_person_id", "org_unit_id", "location"]


@dataclass(frozen=True)
class MemberSource:
    """Where a member list comes from, and which column (if any) marks a removed member."""

    source_type: str
    table: str
    removed_col: str | None = None


def _tenant_uuid(col: str = "tenant_id") -> Column:
    return fx.stable_uuid(F.lit("tenant"), fx.or_empty(col))


def _latest_members(members: DataFrame) -> DataFrame:
    named = members.where(fx.filled(F.trim("email")))
    return qualify_latest(named, "email", "tenant_id", ["_airbyte_extracted_at", "id"])


def seed_persons(members: DataFrame, persons: DataFrame | None, source: MemberSource, as_of: str) -> DataFrame:
    """Person rows for the latest member row per (e-mail, tenant) that has no live person yet."""
    rows = _latest_members(members).withColumns({"_mail": F.lower(F.trim("email")), "_tenant": _tenant_uuid()})
    if persons is not None:
        live = persons.where(F.col("is_deleted") == 0).select(F.lower("email").alias("_mail"), F.col("tenant_uuid").alias("_tenant"))
        rows = rows.join(live, ["_mail", "_tenant"], "left_anti")
    status = F.lit("active")
    if source.removed_col:
        status = F.when(F.col(source.removed_col), F.lit("inactive")).otherwise(F.lit("active"))
    unknown = F.lit(ZERO_UUID)
    origin = F.lit(source.source_type)
    blank = F.lit("")
    complete = fx.flag(fx.filled("name")) + fx.flag(fx.filled("email")) + fx.flag(fx.filled("role"))
    at = F.lit(as_of).cast("timestamp")
    return rows.select(
        fx.stable_uuid(F.lit("person"), "_tenant", "_mail").alias("id"),
        F.col("_tenant").alias("tenant_uuid"),
        fx.or_empty("name").alias("display_name"),
        origin.alias("display_name_source"),
        status.alias("status"),
        F.col("_mail").alias("email"),
        origin.alias("email_source"),
        blank.alias("username"),
        blank.alias("username_source"),
        fx.or_empty("role").alias("role"),
        origin.alias("role_source"),
        unknown.alias("manager_person_id"),
        blank.alias("manager_person_id_source"),
        unknown.alias("org_unit_id"),
        blank.alias("org_unit_id_source"),
        blank.alias("location"),
        blank.alias("location_source"),
        (complete / F.lit(float(len(GOLDEN)))).alias("completeness_score"),
        F.lit("clean").alias("conflict_status"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(0).alias("is_deleted"),
    )


def _alias_rows(table: str, normalised: bool) -> Column:
    """The up to three aliases of a member: e-mail, platform id, display name."""
    raw = {"email": ("email", "email"), "platform_id": ("id", "id"), "display_name": ("name", "name")}

    def value(kind: str, col: str) -> Column:
        if not normalised:
            return F.col(col)
        return F.lower(F.trim(col)) if kind == "email" else F.trim(col)

    items = F.array(
        *[
            F.struct(F.lit(kind).alias("alias_type"), value(kind, col).alias("alias_value"), F.lit(f"{table}.{path}").alias("alias_field_name"))
            for kind, (col, path) in raw.items()
        ]
    )
    return F.filter(items, lambda a: fx.filled(a["alias_value"]))


def seed_aliases(members: DataFrame, persons: DataFrame, aliases: DataFrame | None, source: MemberSource, as_of: str) -> DataFrame:
    """Aliases of members that have a person, without those already stored."""
    rows = _latest_members(members).withColumns({"_mail": F.lower(F.trim("email")), "tenant_uuid": _tenant_uuid()})
    known = persons.select(F.lower("email").alias("_mail"), "tenant_uuid", F.col("id").alias("person_id"))
    joined = rows.join(known, ["_mail", "tenant_uuid"]).withColumn("_a", F.explode(_alias_rows(source.table, True)))
    at = F.lit(as_of).cast("timestamp")
    out = joined.select(
        fx.stable_uuid(F.lit("alias"), F.lit(source.source_type), "tenant_uuid", "_a.alias_type", "_a.alias_value", "id").alias("id"),
        "tenant_uuid",
        "person_id",
        "_a.*",
        F.lit(ZERO_UUID).alias("source_uuid"),
        F.lit(source.source_type).alias("source_type"),
        F.col("id").alias("source_account_id"),
        F.lit(1.0).alias("confidence"),
        F.lit(1).alias("is_active"),
        at.alias("effective_from"),
        F.lit(OPEN_END).cast("timestamp").alias("effective_to"),
        at.alias("first_observed_at"),
        at.alias("last_observed_at"),
        F.lit(0).alias("is_deleted"),
    )
    if aliases is None:
        return out
    live = aliases.where(F.col("is_deleted") == 0)
    return out.join(live, ["tenant_uuid", "alias_type", "alias_value", "source_type", "source_account_id"], "left_anti").select(out.columns)


def seed_bootstrap_inputs(members: DataFrame, existing: DataFrame | None, source: MemberSource, as_of: str) -> DataFrame:
    """Raw alias observations of members, without those already stored."""
    rows = _latest_members(members).withColumn("_a", F.explode(_alias_rows(source.table, False)))
    out = rows.select(
        _tenant_uuid().alias("tenant_uuid"),
        F.lit(ZERO_UUID).alias("source_uuid"),
        F.lit(source.source_type).alias("source_type"),
        F.col("id").alias("source_account_id"),
        "_a.*",
        F.lit("UPSERT").alias("operation_type"),
        F.lit(as_of).cast("timestamp").alias("_synced_at"),
    )
    if existing is None:
        return out
    keys = ["tenant_uuid", "source_type", "source_account_id", "alias_type", "alias_value"]
    return out.join(existing.select(keys), keys, "left_anti").select(out.columns)


# --- people store ------------------------------------------------------------------------------


def person_store(employees: DataFrame) -> DataFrame:
    """Active employees with an e-mail, newest row per id."""
    usable = employees.where((F.col("status") == "Active") & fx.filled("workEmail"))
    latest = latest_per_key(usable, ["tenant_id", "id"], ["_airbyte_extracted_at", "unique_key"])
    texts = {
        "display_name": "displayName",
        "first_name": "firstName",
        "last_name": "lastName",
        "department": "department",
        "division": "division",
        "job_title": "jobTitle",
    }
    return latest.select(
        "tenant_id",
        "id",
        F.lower("workEmail").alias("person_id"),
        F.col("workEmail").alias("email"),
        *[fx.or_empty(src).alias(out) for out, src in texts.items()],
        "status",
        F.lower("supervisorEmail").alias("supervisor_id"),
        F.col("supervisor").alias("supervisor_name"),
    )


def person_lookup(people: DataFrame, email: str) -> DataFrame:
    return people.where(F.col("person_id") == email.lower())


def subordinates(people: DataFrame, root: str | None = None) -> DataFrame:
    """All direct and indirect reports as (root, person, depth, path); a person shows once per root.

    Without ``root`` every person with reports is a root. Each round moves one level down and keeps
    who was not found before, so depth is the shortest one and cycles end; of several shortest paths
    the smallest stays. The loop ends on the first empty level.
    """
    line = people.where(F.col("supervisor_id").isNotNull()).select(
        "tenant_id", F.col("supervisor_id").alias("person_id"), F.col("person_id").alias("_report")
    ).distinct()
    roots = people.where(F.col("person_id").isNotNull()).select("tenant_id", "person_id").distinct()
    if root is not None:
        roots = roots.where(F.col("person_id") == root.lower())
    level = roots.select("tenant_id", F.col("person_id").alias("root_id"), "person_id", F.array("person_id").alias("path"))
    key = ["tenant_id", "root_id", "person_id"]
    seen, found = level.select(*key), None
    for depth in itertools.count(1):
        below = level.join(line, ["tenant_id", "person_id"]).select(
            "tenant_id", "root_id", F.col("_report").alias("person_id"), F.concat("path", F.array("_report")).alias("path")
        )
        fresh = below.join(seen, key, "left_anti").groupBy(*key).agg(F.min("path").alias("path"))
        level = cut_lineage(fresh.select(*key, F.lit(depth).alias("depth"), "path"))
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            return found
        seen = seen.unionByName(level.select(*key))


def people_tree(people: DataFrame, root: str) -> DataFrame:
    """Rows of one root with the direct reports of each person, ready to nest at the edge."""
    below = subordinates(people, root).select("tenant_id", "person_id", "depth", "path")
    top = people.where(F.col("person_id") == root.lower()).select(
        "tenant_id", "person_id", F.lit(0).alias("depth"), F.array("person_id").alias("path")
    )
    rows = top.unionByName(below)
    reports = below.groupBy("tenant_id", F.get("path", F.col("depth") - 1).alias("person_id")).agg(
        F.array_sort(F.collect_list("person_id")).alias("direct_reports")
    )
    return rows.join(reports, ["tenant_id", "person_id"], "left").withColumn(
        "direct_reports", F.coalesce("direct_reports", F.array().cast("array<string>"))
    )


# --- alias service -------------------------------------------------------------------------------


def resolve_aliases(facts: DataFrame, aliases: DataFrame, alias_type: str, col: str) -> DataFrame:
    """Attach the person of an alias value; facts without a match stay, with NULL.

    The alias side is reduced to one row per value; no broadcast is forced,
    AQE broadcasts it when its measured size allows.
    """
    live = aliases.where(
        (F.col("alias_type") == alias_type) & (F.col("is_active") == 1) & (F.col("is_deleted") == 0)
    )
    lookup = live.groupBy("tenant_id", F.col("alias_value").alias("_value")).agg(F.min("person_id").alias("person_id"))
    value = F.lower(F.trim(col)) if alias_type in ("email", "username") else F.trim(col)
    return facts.withColumn("_value", value).join(lookup, ["tenant_id", "_value"], "left").drop("_value")


def strip_plus_tag(email: Column) -> Column:
    return F.regexp_replace(email, r"\+[^@]*@", "@")


def normalize_alias(df: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Normal form per alias type; e-mails lose their plus tag and gain a row per equivalent domain.

    ``domains`` has rows (domain, equivalent).
    """
    raw = F.col("alias_value")
    folded = F.lower(F.trim(raw))
    normal = fx.multi_if(
        (F.col("alias_type") == "email", strip_plus_tag(folded)),
        (F.col("alias_type") == "username", folded),
        default=F.trim(raw),
    )
    own = df.withColumns({"normal_value": normal, "via": F.lit("direct")})
    if domains is None:
        return own
    mails = own.where(F.col("alias_type") == "email").withColumn("domain", F.substring_index("normal_value", "@", -1))
    variants = mails.join(domains, "domain").where(F.col("equivalent") != F.col("domain"))
    local = F.substring_index("normal_value", "@", 1)
    swapped = variants.withColumns(
        {"normal_value": F.concat(local, F.lit("@"), F.col("equivalent")), "via": F.lit("domain_alias")}
    )
    return own.unionByName(swapped.select(own.columns))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Alias values claimed by more than one person, with the count of persons and the first of them.

    One row per claiming person beyond the first: a value held by n persons
    gives n - 1 rows against its smallest person, never n*(n-1)/2 pairs.
    """
    keys = ["tenant_id", "alias_type", "alias_value"]
    live = aliases.where(F.col("is_deleted") == 0).select(*keys, "person_id").distinct()
    claims = live.groupBy(*keys).agg(F.min("person_id").alias("person_id_a"), F.count(F.lit(1)).alias("persons"))
    return (
        live.join(claims.where(F.col("persons") > 1), keys)
        .where(F.col("person_id") != F.col("person_id_a"))
        .select(*keys, "person_id_a", F.col("person_id").alias("person_id_b"), "persons")
    )


# --- audit, merge, split, purge --------------------------------------------------------------------


def merge_persons(
    aliases: DataFrame, source_person: str, target_person: str, audit_id: str, at: str
) -> tuple[DataFrame, DataFrame]:
    """Give all aliases of one person to another. Returns (aliases, audit rows).

    The audit holds one row per touched alias with its JSON before and after,
    so a person with very many accounts never becomes one huge value.
    """
    moved = F.when(F.col("person_id") == source_person, F.lit(target_person)).otherwise(F.col("person_id"))

    def state(owner: Column) -> Column:
        return F.to_json(F.struct("alias_id", owner.alias("person_id")))

    audit = aliases.where(F.col("person_id").isin(source_person, target_person)).select(
        F.lit(audit_id).alias("audit_id"),
        F.lit("merge").alias("action"),
        F.lit(source_person).alias("source_person_id"),
        F.lit(target_person).alias("target_person_id"),
        "alias_id",
        state(F.col("person_id")).alias("snapshot_before"),
        state(moved).alias("snapshot_after"),
        F.lit(at).cast("timestamp").alias("performed_at"),
        F.lit(0).alias("is_rolled_back"),
    )
    return aliases.withColumn("person_id", moved), audit


def split_persons(aliases: DataFrame, audits: DataFrame, audit_id: str) -> tuple[DataFrame, DataFrame]:
    """Restore alias owners from an audit's snapshots and mark it rolled back; a second rollback changes nothing."""
    usable = (F.col("audit_id") == audit_id) & (F.col("is_rolled_back") == 0)
    saved = audits.where(usable).select(
        F.from_json("snapshot_before", "alias_id string, person_id string").alias("_s")
    )
    owners = saved.select("_s.alias_id", F.col("_s.person_id").alias("_owner"))
    out = aliases.join(owners, "alias_id", "left").withColumn("person_id", F.coalesce("_owner", "person_id"))
    marked = audits.withColumn("is_rolled_back", F.when(usable, F.lit(1)).otherwise(F.col("is_rolled_back")))
    return out.select(aliases.columns), marked


def gdpr_purge(aliases: DataFrame, persons: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Aliases of the given persons move to an archive; the rest stays. Returns (kept, archive)."""
    gone = persons.select("person_id").distinct()
    kept = aliases.join(gone, "person_id", "left_anti")
    archive = aliases.join(gone, "person_id", "left_semi").withColumns(
        {"is_deleted": F.lit(1), "purged_at": F.lit(at).cast("timestamp")}
    )
    return kept, archive


# --- golden record ------------------------------------------------------------------------------------

# Source kinds by trust, best first.
SOURCE_PRIORITY = {"manual": 1, "hr": 2, "git": 3, "communication": 4, "auto": 5}


def _ranked(observations: DataFrame) -> DataFrame:
    rank = F.create_map(*[x for s, p in SOURCE_PRIORITY.items() for x in (F.lit(s), F.lit(p))])[F.col("source_kind")]
    return observations.where(fx.filled("value")).withColumn("_rank", F.coalesce(rank, F.lit(len(SOURCE_PRIORITY) + 1)))


def golden_record(observations: DataFrame, attributes: Sequence[str] = GOLDEN) -> DataFrame:
    """Per person, each attribute from its most trusted source (newest on a tie), with that source, and completeness."""
    best = F.min_by(F.struct("value", "source_kind"), F.struct("_rank", (-F.unix_micros("observed_at")).alias("t"), "value"))
    chosen = _ranked(observations).groupBy(*["tenant_id", "person_id"], "attribute").agg(best.alias("_b"))
    picks = []
    for a in attributes:
        mine = F.col("attribute") == a
        picks += [F.max(F.when(mine, F.col("_b.value"))).alias(a), F.max(F.when(mine, F.col("_b.source_kind"))).alias(f"{a}_source")]
    wide = chosen.groupBy("tenant_id", "person_id").agg(*picks)
    count = sum((fx.flag(F.col(a).isNotNull()) for a in attributes), F.lit(0))
    return wide.withColumn("completeness_score", count / F.lit(float(len(GOLDEN))))


def attribute_conflicts(observations: DataFrame) -> DataFrame:
    """Attributes whose most trusted sources disagree. Values are reduced to distinct ones first."""
    keys = ["tenant_id", "person_id", "attribute"]
    values = _ranked(observations).groupBy(*keys, "value").agg(F.min("_rank").alias("_rank"))
    top = values.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return (
        values.join(top, [*keys, "_rank"])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("values_at_top"), F.min("value").alias("value_a"), F.max("value").alias("value_b"))
        .where(F.col("values_at_top") > 1)
        .withColumn("conflict_status", F.lit("needs_review"))
    )


def contribution_changed(new: DataFrame, stored: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows whose digest is new or moved since it was stored."""
    digest = F.sha2(fx.join_key("\x1f", *cols), 256)
    rows = new.withColumn("record_hash", digest)
    old = stored.select(*keys, F.col("record_hash").alias("_old"))
    return rows.join(old, list(keys), "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("record_hash"))).drop("_old")


def availability(people: DataFrame, absences: DataFrame, calendar: DataFrame) -> DataFrame:
    """Working days and absent days per person over a calendar.

    Absences are expanded to their own days (bounded by their length), never joined with every day.
    """
    span = calendar.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi, total = (span.select(c).scalar() for c in ("lo", "hi", "n"))
    start, end = F.greatest(F.col("absent_from"), lo), F.least(F.date_sub("absent_to", 1), hi)
    inside = absences.where(start <= end)
    days = inside.select("tenant_id", "person_id", F.explode(F.sequence(start, end)).alias("day")).distinct()
    absent = days.join(calendar, "day", "left_semi").groupBy("tenant_id", "person_id").agg(F.count(F.lit(1)).alias("absent_days"))
    return people.join(absent, ["tenant_id", "person_id"], "left").select(
        "tenant_id",
        "person_id",
        fx.or_zero("absent_days").alias("absent_days"),
        (total - fx.or_zero("absent_days")).alias("available_days"),
    )
