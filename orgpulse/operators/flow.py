"""Task flow: full field values out of deltas, status periods, lead time, work in progress, sprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import latest_per_key, with_neighbour, with_row_number
from orgpulse.operators.org import temporal_join

FIELD = ["tenant_id", "issue_id", "field_id"]
# Events of a field that are compared with what is held during them at once.
CHUNK_EVENTS = 256


def field_history_full_values(deltas: DataFrame) -> DataFrame:
    """Complete value list of a field after each event.

    ``deltas``: tenant, issue, field, event_at, event_id, field_cardinality
    (single/multi), delta_action (set/add/remove), delta_value. A single field
    holds what its event set. In a multi field each added value holds until the
    next event on that value, and an event's list is the values whose interval
    covers it. A field's events are cut into chunks of CHUNK_EVENTS, and an interval is carried into
    the chunks that it reaches: events meet the intervals of their own chunk, so the work follows the
    events and what is held, however many events a field has in a month.
    """
    single = F.col("field_cardinality") == "single"
    gives = F.col("delta_action").isin("set", "add") & F.col("delta_value").isNotNull()
    alone = deltas.where(single).withColumn(
        "value_ids", F.when(gives, F.array("delta_value")).otherwise(F.array().cast("array<string>"))
    )
    month, order = F.date_trunc("month", F.col("event_at")), ["event_at", "event_id"]
    numbered = with_row_number(deltas.where(~single), FIELD, order, month, "_n")
    rows = numbered.withColumn("_chunk", F.floor((F.col("_n") - 1) / CHUNK_EVENTS)).withColumn("_pos", F.struct(*order)).drop("_n")
    near = with_neighbour(rows, [*FIELD, "delta_value"], order, {"_until": "_pos", "_until_chunk": "_chunk"}, month, "next")
    ends = rows.groupBy(*FIELD).agg(F.max("_chunk").alias("_end"))
    held = near.where(gives).join(ends, FIELD).select(
        *FIELD,
        F.explode(F.sequence("_chunk", F.coalesce("_until_chunk", "_end"))).alias("_chunk"),
        F.col("_pos").alias("_from"),
        "_until",
        "delta_value",
    )
    left, right = rows.alias("e"), held.alias("h")
    same = fx.all_of(F.col(f"e.{k}") == F.col(f"h.{k}") for k in [*FIELD, "_chunk"])
    covers = (F.col("h._from") <= F.col("e._pos")) & (F.col("h._until").isNull() | (F.col("e._pos") < F.col("h._until")))
    several = (
        left.join(right, same & covers, "left")
        .groupBy(*[F.col(f"e.{c}") for c in deltas.columns])
        .agg(F.array_sort(F.collect_set("h.delta_value")).alias("value_ids"))
    )
    return alone.unionByName(several)


def initial_state(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """Values at creation: removed before ever added, or held now without any event."""
    value_key = [*FIELD, "value"]
    first = deltas.withColumn("value", F.col("delta_value")).groupBy(*value_key).agg(
        F.min_by("delta_action", F.struct("event_at", "event_id")).alias("_first")
    )
    untouched = snapshot.join(first, value_key, "left_anti").select(*value_key)
    removed = first.where(F.col("_first") == "remove").select(*value_key)
    return untouched.unionByName(removed).distinct()


def snapshot_diff_deltas(snapshots: DataFrame, keys: Sequence[str], at: str, values: str) -> DataFrame:
    """Add and remove rows between successive snapshots of an array field."""
    near = with_neighbour(snapshots, keys, [at], {"_was": values}, F.to_date(at), "previous")
    steps = near.where(F.col("_was").isNotNull())

    def tagged(gone_from: str, compared: str, action: str) -> Column:
        return F.transform(
            F.array_except(gone_from, compared), lambda v: F.struct(F.lit(action).alias("delta_action"), v.alias("delta_value"))
        )

    moves = F.concat(tagged(values, "_was", "add"), tagged("_was", values, "remove"))
    return steps.withColumn("_m", F.explode(moves)).select(*keys, F.col(at).alias("event_at"), "_m.*")


def explode_tag_snapshot(df: DataFrame, col: str, sep_pattern: str = r"[;,]\s*") -> DataFrame:
    """Split a separated list into an array; empty text gives an empty array."""
    parts = F.filter(F.split(fx.or_empty(col), sep_pattern), lambda t: t != "")
    return df.withColumn("tags", F.transform(parts, lambda t: F.trim(t)))


# --- status periods -----------------------------------------------------------------------------


def status_periods(history: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, at: str) -> DataFrame:
    """(task, status, entered_at, exited_at, hours); the last period is open."""
    near = with_neighbour(history, keys, order, {"exited_at": at}, F.to_date(at), "next")
    return near.select(
        *keys,
        F.col(status).alias("status"),
        F.col(at).alias("entered_at"),
        "exited_at",
        fx.hours_between(at, "exited_at").alias("hours"),
    )


def category_of(status: str, categories: dict[str, Sequence[str]]) -> Column:
    return fx.multi_if(*[(F.col(status).isin(list(names)), F.lit(cat)) for cat, names in categories.items()], default=F.lit(None))


def lifecycle_summary(periods: DataFrame, keys: Sequence[str], categories: dict[str, Sequence[str]]) -> DataFrame:
    """created, started, testing and done times; lead hours from first start to first done."""
    cat = category_of("status", categories)
    out = periods.groupBy(*keys).agg(
        F.min("entered_at").alias("created_at"),
        *[
            F.min(F.when(cat == name, F.col("entered_at"))).alias(col)
            for name, col in (("in_progress", "started_at"), ("testing", "testing_started_at"), ("done", "done_at"))
        ],
    )
    return out.withColumn("lead_time_h", fx.hours_between("started_at", "done_at"))


def throughput(lifecycle: DataFrame, grain: str, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Tasks done per period."""
    done = lifecycle.where(F.col("done_at").isNotNull())
    return done.groupBy(*keys, fx.grain_of("done_at", grain).alias("period")).agg(F.count(F.lit(1)).alias("tasks_done"))


def wip_snapshots(periods: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open items per key and calendar day: entered on or before the day, left after it.

    Entries and exits are folded to one net change per key and day, and a
    running sum over days gives the stock, so period length does not matter.
    """
    moves = periods.select(*keys, F.to_date("entered_at").alias("day"), F.lit(1).alias("_d")).unionByName(
        periods.where(F.col("exited_at").isNotNull()).select(*keys, F.to_date("exited_at").alias("day"), F.lit(-1).alias("_d"))
    )
    net = moves.groupBy(*keys, "day").agg(F.sum("_d").alias("_d"))
    span = calendar.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    # One row per key and day of the calendar: bounded by statuses x days.
    grid = net.select(*keys).distinct().withColumn("day", F.explode(F.sequence(lo, hi))).withColumn("_d", F.lit(0))
    early = net.withColumn("day", F.greatest(F.col("day"), lo)).where(F.col("day") <= hi)
    daily = grid.unionByName(early).groupBy(*keys, "day").agg(F.sum("_d").alias("_d"))
    run = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, "day", F.sum("_d").over(run).alias("items")).join(calendar, "day", "left_semi")


# --- sprints and work ----------------------------------------------------------------------------


def sprint_velocity(done: DataFrame, memberships: DataFrame) -> DataFrame:
    """Story points and tasks finished per sprint, by the sprint the task was in when it was done."""
    placed = temporal_join(done, memberships, ["tenant_id", "task_id"], "done_at", ["sprint_id"], "inner")
    return placed.groupBy("tenant_id", "sprint_id").agg(
        F.sum("story_points").alias("points_done"), F.count(F.lit(1)).alias("tasks_done")
    )


def sprint_carryover(memberships: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Tasks that left a sprint before they were done."""
    left = memberships.where(F.col("valid_to").isNotNull())
    joined = left.join(lifecycle.select("tenant_id", "task_id", "done_at"), ["tenant_id", "task_id"], "left")
    undone = F.col("done_at").isNull() | (F.col("done_at") >= F.col("valid_to"))
    return joined.where(undone).select("tenant_id", "sprint_id", "task_id", "valid_to")


def worklog_hours(worklogs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return worklogs.groupBy(*keys).agg((F.sum("seconds") / F.lit(3600.0)).alias("hours"))


def comment_volume(comments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return comments.groupBy(*keys).agg(F.count(F.lit(1)).alias("comments"))


def blocker_rate(issues: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of issues that another issue blocks."""
    blocked = links.where(F.col("link_type") == "blocks").select("tenant_id", F.col("target_id").alias("issue_id")).distinct()
    flagged = issues.join(blocked.withColumn("_b", F.lit(1)), ["tenant_id", "issue_id"], "left")
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("issues"), F.count("_b").alias("blocked"), fx.ratio(F.count("_b"), F.count(F.lit(1))).alias("blocker_rate")
    )


def wip_per_person(periods: DataFrame, at: str, states: Sequence[str]) -> DataFrame:
    """Issues a person holds in the given states at a moment."""
    moment = F.lit(at).cast("timestamp")
    open_then = (F.col("entered_at") <= moment) & (F.col("exited_at").isNull() | (F.col("exited_at") > moment))
    return periods.where(open_then & F.col("status").isin(list(states))).groupBy("tenant_id", "assignee").agg(
        F.count(F.lit(1)).alias("open_items")
    )


# --- latest state of event streams --------------------------------------------------------------

ISSUE = ["tenant_id", "issue_ref"]
ISSUE_ORDER = ["event_date", "event_id"]


def issue_latest(events: DataFrame) -> DataFrame:
    return latest_per_key(events, ISSUE, ISSUE_ORDER)


def children_latest(events: DataFrame, parent_ref: str) -> DataFrame:
    return issue_latest(events.where(F.col("parent_issue_ref") == parent_ref))


def _stories(events: DataFrame, story_type: str) -> DataFrame:
    return issue_latest(events.where(F.col("type") == story_type))


def stories_with_bug_children(events: DataFrame, story_type: str = "User Story", bug_type: str = "Bug") -> DataFrame:
    """Stories with at least one child of the bug type; children are reduced to distinct parents first."""
    parents = events.where(F.col("type") == bug_type).select("tenant_id", F.col("parent_issue_ref").alias("issue_ref")).distinct()
    return _stories(events, story_type).join(parents, ISSUE, "left_semi").select(*ISSUE, "state", "assignee")


def stories_with_open_children(
    events: DataFrame, ended: Sequence[str] = ("done", "new"), story_type: str = "User Story"
) -> DataFrame:
    """Stories with a child whose latest state is neither done nor new."""
    children = issue_latest(events.where(fx.filled("parent_issue_ref")))
    parents = children.where(~F.col("state").isin(list(ended))).select(
        "tenant_id", F.col("parent_issue_ref").alias("issue_ref")
    ).distinct()
    return _stories(events, story_type).join(parents, ISSUE, "left_semi").select(*ISSUE, "state")


def map_field_filter(events: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Rows whose map holds a key (with a value, if given), and that entry as a column."""
    entry = fx.map_value("fields_map", key)
    cond = fx.map_has("fields_map", key) if value is None else entry == value
    return events.where(cond).withColumn("field_value", entry)
