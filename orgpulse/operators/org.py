"""Organisation tree, dated membership and what a viewer may see."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx
from orgpulse.operators.history import scd2_merge
from orgpulse.operators.ordered import percent_rank_by, with_neighbour
from orgpulse.session import cut_lineage

LEVELS = ["company", "division", "department", "team", "squad"]


def org_paths(units: DataFrame) -> DataFrame:
    """Path and depth of each unit from parent links (parent NULL = root).

    One join per tree level; a unit whose parents loop never reaches a root and is left out.
    """
    segment = F.lower(F.regexp_replace("name", r"\s+", "-"))
    base = units.select("tenant_id", "unit_id", "parent_id", segment.alias("_seg"))
    level = cut_lineage(
        base.where(F.col("parent_id").isNull()).select(
            "tenant_id", "unit_id", "parent_id", F.concat(F.lit("/"), F.col("_seg")).alias("path"), F.lit(0).alias("depth")
        )
    )
    children = cut_lineage(base.where(F.col("parent_id").isNotNull()))
    found = level
    depth = 0
    while not level.isEmpty():
        depth += 1
        parents = level.select("tenant_id", F.col("unit_id").alias("parent_id"), F.col("path").alias("_up"))
        level = cut_lineage(
            children.join(parents, ["tenant_id", "parent_id"]).select(
                "tenant_id", "unit_id", "parent_id", F.concat_ws("/", "_up", "_seg").alias("path"), F.lit(depth).alias("depth")
            )
        )
        found = found.unionByName(level)
    return found


def in_subtree(path_col: str, root: str) -> Column:
    """The unit at ``root`` or anything below it."""
    return (F.col(path_col) == root) | F.col(path_col).startswith(root + "/")


def org_subtree(units: DataFrame, root: str) -> DataFrame:
    """Current units of a subtree."""
    rows = units.where(in_subtree("path", root))
    return rows.where(F.col("valid_to").isNull()) if "valid_to" in units.columns else rows


def path_prefixes(path: Column) -> Column:
    """['/a', '/a/b', ...] for '/a/b/...'."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )


def org_ancestors(units: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each person's current unit and every unit above it, with the distance."""
    current = assignments.where(F.col("valid_to").isNull()).join(units.select("tenant_id", "unit_id", "path", "depth"), ["tenant_id", "unit_id"])
    up = current.select("tenant_id", "person_id", F.col("depth").alias("_own"), F.explode(path_prefixes(F.col("path"))).alias("path"))
    above = units.select("tenant_id", "path", F.col("unit_id").alias("ancestor_id"), F.col("depth").alias("ancestor_depth"))
    return up.join(above, ["tenant_id", "path"]).select(
        "tenant_id", "person_id", "ancestor_id", "path", (F.col("_own") - F.col("ancestor_depth")).alias("distance")
    )


def level_columns(df: DataFrame, levels: Sequence[str] = LEVELS, path: str = "path") -> DataFrame:
    """Path segments as one column per level."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(levels)})


def org_rollup(metrics: DataFrame, units: DataFrame, levels: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Roll metrics up the tree: one row per prefix of the level columns."""
    joined = level_columns(metrics.join(units.select("tenant_id", "unit_id", "path"), ["tenant_id", "unit_id"]), levels)
    out = joined.rollup("tenant_id", *levels).agg(F.grouping_id().alias("_g"), *[c.alias(n) for n, c in measures.items()])
    # Keep subtotals per tenant, and drop subtotals of levels that a shallow path does not have.
    depth = fx.any_of([F.col("_g") == (1 << (len(levels) - i)) - 1 for i in range(len(levels) + 1)])
    return out.where(F.col("tenant_id").isNotNull() & depth).withColumn(
        "rollup_depth", F.lit(len(levels)) - F.floor(F.log2(F.col("_g") + 1)).cast("int")
    ).drop("_g")


def scd2_close_and_insert(current: DataFrame, changes: DataFrame, keys: Sequence[str], cols: Sequence[str], at: Column) -> DataFrame:
    """Transfer, rename or move: close the open row at a date and open its successor. Unchanged keys stay."""
    return scd2_merge(current, changes, keys, cols, at)


def ancestors(units: DataFrame) -> DataFrame:
    """(unit_id, ancestor) for every unit above a unit, however deep; what was found before ends a cycle."""
    parents = units.where(F.col("parent_id").isNotNull()).select("unit_id", "parent_id").distinct()
    found = level = cut_lineage(parents.withColumnRenamed("parent_id", "ancestor"))
    above = parents.select(F.col("unit_id").alias("ancestor"), "parent_id")
    while not level.isEmpty():
        higher = level.join(above, "ancestor").select("unit_id", F.col("parent_id").alias("ancestor")).distinct()
        level = cut_lineage(higher.join(found, ["unit_id", "ancestor"], "left_anti"))
        found = found.unionByName(level)
    return found


def repath_descendants(units: DataFrame, old_path: str, new_path: str) -> DataFrame:
    """Paths and depths after a subtree moved."""
    shift = new_path.count("/") - old_path.count("/")
    inside = in_subtree("path", old_path)
    tail = F.substring(F.col("path"), F.lit(len(old_path) + 1), F.length("path"))
    return units.withColumns(
        {
            "path": F.when(inside, F.concat(F.lit(new_path), tail)).otherwise(F.col("path")),
            "depth": F.when(inside, F.col("depth") + shift).otherwise(F.col("depth")),
        }
    )


def valid_at(when: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open test; a NULL end is open."""
    return (F.col(start) <= when) & (F.col(end).isNull() | (when < F.col(end)))


def as_of_state(scd: DataFrame, at: str) -> DataFrame:
    return scd.where(valid_at(F.lit(at).cast("timestamp")))


# Assignments of one key above which they and its facts are dealt by month.
HOT_ASSIGNMENTS = 100


def temporal_join(
    facts: DataFrame,
    assignments: DataFrame,
    keys: Sequence[str],
    at: str,
    carry: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Facts beside the assignment valid at the fact's time; a transfer keeps history.

    A key meets its assignments as they are; where its facts are very many, AQE splits the join. A key of
    more than HOT_ASSIGNMENTS also joins on the month, and its assignments are expanded to the months they
    cover, never past the last fact.
    """
    held = assignments.select(*keys, *carry, "valid_from", "valid_to")
    hot = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") > HOT_ASSIGNMENTS).select(*keys)
    if hot.isEmpty():
        return _covered(facts, held, keys, at, carry, how)
    by_month = _by_month(facts.join(hot, list(keys), "left_semi"), held.join(hot, list(keys), "left_semi"), keys, at, carry, how)
    return _covered(facts.join(hot, list(keys), "left_anti"), held, keys, at, carry, how).unionByName(by_month)


def _by_month(facts: DataFrame, held: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str], how: str) -> DataFrame:
    """``_covered`` with both sides dealt by month too."""
    month = F.date_trunc("month", F.col(at)).cast("timestamp")
    last = facts.agg(F.max(at).cast("timestamp").alias("m")).scalar()
    first = facts.agg(F.min(at).cast("timestamp").alias("m")).scalar()
    start = F.greatest(F.date_trunc("month", "valid_from"), F.date_trunc("month", first))
    stop = F.date_trunc("month", F.least(F.coalesce(F.col("valid_to"), last), last))
    spread = held.where(start <= stop).withColumn("_month", F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 MONTH"))))
    return _covered(facts.withColumn("_month", month), spread, [*keys, "_month"], at, carry, how).drop("_month")


def _covered(facts: DataFrame, held: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str], how: str) -> DataFrame:
    """Facts beside the rows of ``held`` of the same keys whose time covers theirs."""
    side = held.select(*[F.col(c).alias(f"_held_{c}") for c in held.columns])
    on = fx.all_of([F.col(k) == F.col(f"_held_{k}") for k in keys])
    inside = (F.col("_held_valid_from") <= F.col(at)) & (F.col("_held_valid_to").isNull() | (F.col(at) < F.col("_held_valid_to")))
    return facts.join(side, on & inside, how).select(*facts.columns, *[F.col(f"_held_{c}").alias(c) for c in carry])


def follow_the_unit(facts: DataFrame, assignments: DataFrame, units: DataFrame, viewer_path: str, at: str) -> DataFrame:
    """Rows of people only while they were members of the viewer's subtree.

    Membership intervals of one person do not overlap (see ``overlap_violations``), so no row repeats.
    """
    visible = org_subtree(units, viewer_path).select("tenant_id", "unit_id")
    members = assignments.join(visible, ["tenant_id", "unit_id"], "left_semi")
    # Finding members is most of the work, so they aren't counted before they are joined.
    held = members.select("tenant_id", "person_id", "valid_from", "valid_to")
    return _by_month(facts, held, ["tenant_id", "person_id"], at, [], "inner").select(*facts.columns)


@dataclass(frozen=True)
class Scope:
    """What a viewer may read: one workspace, unit subtrees, a time span, and source kinds."""

    tenant: str
    subtrees: tuple[str, ...]
    valid_from: str
    valid_to: str
    sources: tuple[str, ...]


def data_scope(df: DataFrame, scope: Scope, units: DataFrame, at: str, source_col: str) -> DataFrame:
    """Apply the scope predicates to any fact table that carries ``unit_id``."""
    inside = fx.any_of([in_subtree("path", p) for p in scope.subtrees])
    visible = units.where((F.col("tenant_id") == scope.tenant) & inside).select("tenant_id", "unit_id")
    when = F.col(at)
    spanned = (when >= F.lit(scope.valid_from).cast("timestamp")) & (when < F.lit(scope.valid_to).cast("timestamp"))
    rows = df.where((F.col("tenant_id") == scope.tenant) & spanned & F.col(source_col).isin(list(scope.sources)))
    return rows.join(visible, ["tenant_id", "unit_id"], "left_semi")


def cohort_benchmark(metrics: DataFrame, assignments: DataFrame, value: str, cohort: str = "functional_team") -> DataFrame:
    """A person's value against the average and percentile rank inside their functional team."""
    keys = ["tenant_id", cohort]
    placed = metrics.join(assignments.select("tenant_id", "person_id", cohort), ["tenant_id", "person_id"])
    means = placed.groupBy(*keys).agg(F.avg(value).alias("cohort_avg"), F.count(F.lit(1)).alias("cohort_size"))
    return percent_rank_by(placed, keys, value, "percentile").join(means, keys)


def overlap_violations(scd: DataFrame, keys: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Rows whose interval runs into the next one of the same key."""
    rows = scd.withColumn("_row", F.lit(1))
    near = with_neighbour(
        rows, keys, ["valid_from"], {"next_from": "valid_from"}, F.year("valid_from") if bucket is None else bucket, "next"
    )
    runs_over = F.col("next_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("next_from")))
    return near.where(runs_over).select(*keys, "valid_from", "valid_to", "next_from")


def open_row_violations(scd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that do not have exactly one open row."""
    return scd.groupBy(*keys).agg(fx.count_where(F.col("valid_to").isNull()).alias("open_rows")).where(F.col("open_rows") != 1)
