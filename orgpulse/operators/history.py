"""Change tracking: versions of a record, field-level changes, identity observations, dated rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import with_neighbour

# Fixed value: stands for NULL inside a row hash.
NULL_MARKER = "__null__"


def hashed_rows(df: DataFrame, cols: Sequence[str], raw_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``_row_hash`` over tracked columns and keys of the ``raw_data`` JSON."""
    raw = [fx.json_text("raw_data", c) for c in raw_cols]
    return df.withColumn("_row_hash", fx.row_hash([*cols, *raw], NULL_MARKER))


def snapshot_scd2(
    source: DataFrame,
    target: DataFrame | None,
    key: str | Sequence[str],
    cols: Sequence[str],
    at: Column,
    raw_cols: Sequence[str] = (),
) -> DataFrame:
    """Rows to append to the version log: new keys, and keys whose tracked columns changed.

    The log is folded to one hash per key before the join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = hashed_rows(source, cols, raw_cols)
    if target is not None:
        stored = target.groupBy(*keys).agg(F.max_by("_row_hash", "_tracked_at").alias("_stored"))
        rows = rows.join(stored, keys, "left").where(F.col("_stored").isNull() | (F.col("_row_hash") != F.col("_stored")))
        rows = rows.drop("_stored")
    return rows.withColumn("_tracked_at", at)


def versions_from_log(
    log: DataFrame, key: Sequence[str], cols: Sequence[str], order: Sequence[str], bucket: Column, raw_cols: Sequence[str] = ()
) -> DataFrame:
    """Rows of a full history that differ from the row before, as repeated snapshots would have stored them."""
    rows = hashed_rows(log, cols, raw_cols)
    near = with_neighbour(rows, key, order, {"_before": "_row_hash"}, bucket, "previous")
    return near.where(F.col("_before").isNull() | (F.col("_before") != F.col("_row_hash"))).drop("_before")


def fields_history(
    snapshot: DataFrame,
    entity: str,
    fields: Sequence[str],
    raw_fields: Sequence[str] = (),
    key: str = "unique_key",
    order: Sequence[str] = (),
) -> DataFrame:
    """One row per changed field and version step; the first version emits its filled fields with old = ''.

    One pass: the previous version's fields travel along as neighbours, then a
    single explode turns fields into rows. ``order`` breaks ties of the tracking time.
    """
    texts = {f: F.col(f).cast("string") for f in fields} | {f: fx.json_text("raw_data", f) for f in raw_fields}
    names = list(texts)
    rows = snapshot.select(
        F.col(key).alias("_key"),
        F.col(entity).alias("entity_id"),
        "tenant_id",
        "source_id",
        F.col("_tracked_at").alias("updated_at"),
        *[F.col(o).alias(f"order_{i}") for i, o in enumerate(order)],
        *[texts[n].alias(f"now_{i}") for i, n in enumerate(names)],
    ).withColumn("_seen", F.lit(True))
    near = with_neighbour(
        rows,
        ["_key"],
        ["updated_at", *[f"order_{i}" for i in range(len(order))]],
        {"_had": "_seen", **{f"was_{i}": f"now_{i}" for i in range(len(names))}},
        F.to_date("updated_at"),
        "previous",
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("field_name"), F.col(f"was_{i}").alias("was"), F.col(f"now_{i}").alias("now")) for i, n in enumerate(names)]
    )
    first = F.col("_had").isNull()
    changed = F.filter(
        pairs, lambda p: F.when(first, p["now"] != "").otherwise(p["now"] != p["was"])
    )
    return near.withColumn("_p", F.explode(changed)).select(
        "entity_id",
        "tenant_id",
        "source_id",
        "_p.field_name",
        F.when(first, F.lit("")).otherwise(F.col("_p.was")).alias("old_value"),
        F.col("_p.now").alias("new_value"),
        "updated_at",
    )


@dataclass(frozen=True)
class TrackedSource:
    """What to watch on one source: entity column, tracked fields, identity fields and what ends an account."""

    entity: str
    fields: tuple[str, ...]
    identity: tuple[tuple[str, str, str], ...] = ()
    ended_field: str = "status"
    ended_values: tuple[str, ...] = ()


# Tracked and identity fields per source.
TRACKED = {
    "cursor_members": TrackedSource("id", ("name", "role", "isRemoved")),
    "slack_users": TrackedSource(
        "unique_key",
        ("email", "display_name", "real_name", "is_admin", "is_owner", "is_restricted", "is_ultra_restricted", "is_bot", "deleted", "tz"),
    ),
    "zoom_users": TrackedSource(
        "id",
        ("first_name", "last_name", "display_name", "email", "dept", "status", "role_id", "timezone", "language", "phone_number", "employee_unique_id", "type"),
        (
            ("email", "email", "bronze_zoom.users.email"),
            ("employee_unique_id", "employee_id", "bronze_zoom.users.employee_unique_id"),
            ("display_name", "display_name", "bronze_zoom.users.display_name"),
        ),
        "status",
        ("inactive",),
    ),
    "hr_employees": TrackedSource(
        "id",
        ("displayName", "firstName", "lastName", "workEmail", "employeeNumber", "jobTitle", "department", "division", "status", "employmentHistoryStatus", "supervisorEId", "supervisorEmail", "location", "country", "city", "hireDate", "terminationDate"),
        (
            ("workEmail", "email", "bronze_bamboohr.employees.workEmail"),
            ("employeeNumber", "employee_id", "bronze_bamboohr.employees.employeeNumber"),
            ("displayName", "display_name", "bronze_bamboohr.employees.displayName"),
        ),
        "status",
        ("Inactive", "Terminated"),
    ),
}


def snapshot_model(source: str, rows: DataFrame, target: DataFrame | None, at: Column, raw_cols: Sequence[str] = ()) -> DataFrame:
    """Version-log rows of one of the tracked sources."""
    return snapshot_scd2(rows, target, "unique_key", TRACKED[source].fields, at, raw_cols)


def history_model(source: str, snapshot: DataFrame, raw_fields: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Field-change log of one of the tracked sources."""
    spec = TRACKED[source]
    return fields_history(snapshot, spec.entity, spec.fields, raw_fields, order=order)


def bootstrap_inputs_from_history(history: DataFrame, source_type: str, spec: TrackedSource) -> DataFrame:
    """UPSERT per identity field change, and on deactivation one DELETE per identity field.

    Each history row expands to its observations in place: no scan per field and no join.
    """
    of_field = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), F.lit(p).alias("path")) for f, t, p in spec.identity])
    upsert = F.filter(of_field, lambda m: (m["field"] == F.col("field_name")) & (F.col("new_value") != ""))
    ended = (F.col("field_name") == spec.ended_field) & F.col("new_value").isin(list(spec.ended_values))
    delete = F.when(ended, of_field).otherwise(F.filter(of_field, lambda m: F.lit(False)))

    def tagged(rows: Column, operation: str, value: Column) -> Column:
        return F.transform(
            rows, lambda m: F.struct(m["type"].alias("alias_type"), value.alias("alias_value"), m["path"].alias("alias_field_name"), F.lit(operation).alias("operation_type"))
        )

    observations = F.concat(tagged(upsert, "UPSERT", F.col("new_value")), tagged(delete, "DELETE", F.lit("")))
    return history.withColumn("_o", F.explode(observations)).select(
        "tenant_id",
        "source_id",
        F.lit(source_type).alias("source_type"),
        F.col("entity_id").alias("source_account_id"),
        "_o.*",
        F.col("updated_at").alias("_synced_at"),
    )


# --- dated rows ---------------------------------------------------------------------------------


def scd2_merge(current: DataFrame, incoming: DataFrame, keys: Sequence[str], cols: Sequence[str], at: Column) -> DataFrame:
    """Compare incoming rows with the open row of each key: equal rows stay, changed rows close and reopen, new rows open.

    ``current`` holds keys, cols, valid_from, valid_to (NULL = open). Closed rows pass through.
    """
    shape = [*keys, *cols, "valid_from", "valid_to"]
    closed = current.where(F.col("valid_to").isNotNull()).select(shape)
    was = F.struct(*[F.col(c) for c in [*cols, "valid_from"]]).alias("_was")
    new = F.struct(*[F.col(c) for c in cols]).alias("_new")
    pair = current.where(F.col("valid_to").isNull()).select(*keys, was).join(incoming.select(*keys, new), list(keys), "full")
    same = fx.all_of(F.col(f"_was.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in cols)
    gone, fresh = F.col("_new").isNull(), F.col("_was").isNull()

    def version(side: str, start: Column, end: Column) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in cols], start.alias("valid_from"), end.alias("valid_to"))

    open_end = F.lit(None).cast("timestamp")
    kept = F.array(version("_was", F.col("_was.valid_from"), open_end))
    opened = F.array(version("_new", at, open_end))
    both = F.array(version("_was", F.col("_was.valid_from"), at), version("_new", at, open_end))
    rows = fx.multi_if((gone, kept), (fresh, opened), (same, kept), default=both)
    return closed.unionByName(pair.withColumn("_r", F.explode(rows)).select(*keys, "_r.*"))


def highest_source(incoming: DataFrame, keys: Sequence[str], priority: dict[str, int], source_col: str = "source") -> DataFrame:
    """Whole row of the most trusted source per key; fields of different sources are never mixed."""
    from orgpulse.operators.ordered import earliest_per_key

    rank = F.create_map(*[x for s, p in priority.items() for x in (F.lit(s), F.lit(p))])[F.col(source_col)]
    return earliest_per_key(incoming, keys, [F.coalesce(rank, F.lit(len(priority) + 1)), F.col(source_col)])


def custom_attribute_maps(df: DataFrame, texts: dict[str, str], numbers: dict[str, str]) -> DataFrame:
    """Route configured source fields into one text map and one numeric map; empty values are left out."""

    def pack(fields: dict[str, str], kind: str) -> Column:
        if not fields:
            return fx.empty_map(kind)
        keys = F.array(*[F.lit(name) for name in fields])
        values = F.array(*[F.col(src).cast("string").try_cast(kind) for src in fields.values()])
        return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: v.isNotNull() & (v.cast("string") != ""))

    return df.withColumns({"custom_str_attrs": pack(texts, "string"), "custom_num_attrs": pack(numbers, "double")})
