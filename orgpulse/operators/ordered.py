"""Latest-row, neighbour and rank operators that hold when one key owns a large share of the rows.

* Latest row: ``max_by`` on a struct. It combines on the map side, so a hot key
  reaches the reducer as one row per map task, unlike ``row_number``.
* Neighbours (lag/lead): a key of up to HOT_ROWS rows is one window. Of larger keys windows run
  per (key, time bucket); only the first row of each bucket looks across, through one summary row per bucket. A bucket of one key
  that holds very many rows is cut at values of the order drawn from a sample, so no
  window is longer than about HOT_ROWS whatever the data.
* Ranks: equal values are counted first, the value range is cut into buckets, and
  positions come from bucket offsets plus a window inside the bucket. No window ever
  spans a whole group of rows. The dense rank over a whole table deals its distinct values by ranges.
* Exact quantiles: a sketch says between which values each one must lie; only rows in
  that range are ordered, the ones below it are a number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orgpulse.session import cut_lineage

# Rows of one key and bucket from which on they are cut, about as many to a part, and sampled rows of a part that the cuts are drawn from.
HOT_ROWS = 200_000
CUT_SAMPLE = 8
# Stretches that a key's values are cut into at most (a square number), and distinct values that one stretch should have.
RANK_BUCKETS = 1024
RANK_VALUES = 32_768
# Relative error of the sketch that brackets a quantile is one in so many; the bracket is four times as wide on either side.
SKETCH = 1000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Row with the greatest ``order`` per key. Give a full tie-break in ``order`` for repeatable output."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in set(keys)]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    )
    return _unpack(picked, df.columns, keys)


def newest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ("_airbyte_extracted_at",)) -> DataFrame:
    """One row per key: the newest by those columns of ``by`` that there are, of equally new ones that with the greatest values.

    For dimensions whose log can hold several rows of a key, before facts are joined to them.
    """
    order = [c for c in by if c in df.columns]
    return latest_per_key(df, keys, [*order, *[c for c in df.columns if c not in {*keys, *order}]])


def _unpack(picked: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return picked.select(*[F.col(c) if c in set(keys) else F.col(f"_row.{c}").alias(c) for c in columns])


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Row with the smallest ``order`` per key."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in set(keys)]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    )
    return _unpack(picked, df.columns, keys)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where NULL equals NULL."""
    other = right.select(*[F.col(c).alias(f"_right_{c}") for c in on], *[c for c in right.columns if c not in set(on)])
    equal = F.lit(True)
    for c in on:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(other, equal, how).drop(*[f"_right_{c}" for c in on])


def _bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, which doesn't fall as ``order`` rises and of which a key has about ``hot_rows`` rows at most.

    Buckets within that size stay whole. Of a larger one a sample of its rows' orders gives the cuts;
    rows of equal order stay together, so what follows is exact wherever they lie.
    """
    hot_rows = hot_rows or HOT_ROWS
    marked = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    hot = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    if hot.isEmpty():
        return marked.withColumn("_bucket", F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("cut")))
    place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    # A row is drawn by a hash of its order, as many for each part.
    one_in = F.greatest(F.lit(1), F.lit(hot_rows // CUT_SAMPLE))
    drawn = null_safe_join(marked.select(*by, place.alias("_place")), hot, by).where(F.pmod(F.xxhash64("_place"), one_in) == 0)
    cuts = drawn.groupBy(*by).agg(F.sort_array(F.collect_set("_place")).alias("_drawn"))
    cuts = cuts.select(*by, F.filter("_drawn", lambda _, i: (i + 1) % CUT_SAMPLE == 0).alias("_cuts"))
    # Two short looks: which stretch of cuts, then where in it.
    step = F.ceil(F.sqrt(F.greatest(F.size("_cuts"), F.lit(1)))).cast("int")
    cuts = cuts.select(*by, "_cuts", step.alias("_step"), F.filter("_cuts", lambda _, i: i % step == 0).alias("_heads"))
    stretch = F.greatest(F.size(F.filter("_heads", lambda c: c < place)) - 1, F.lit(0)) * F.col("_step")
    inside = F.size(F.filter(F.slice("_cuts", stretch + 1, F.col("_step")), lambda c: c < place))
    cut = F.when(F.col("_cuts").isNull(), 0).otherwise(stretch + inside)
    placed = null_safe_join(marked, cuts, by, "left").withColumn("_bucket", F.struct(F.col("_bucket").alias("b"), cut.alias("cut")))
    return placed.drop("_cuts", "_step", "_heads")


def _split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that one window each holds, and rows of keys with more than ``hot_rows`` rows (None, if there are none)."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (hot_rows or HOT_ROWS)).select(*keys)
    if hot.isEmpty():
        return df, None
    return null_safe_join(df, hot, keys, "left_anti"), null_safe_join(df, hot, keys, "left_semi")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: dict[str, str],
    following: dict[str, str],
    bucket: Column,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add columns of the previous and of the next row of the same key, each a map of new column name to source column.

    ``bucket`` must not fall as ``order`` rises (for example the day of the timestamp). It splits keys with very
    many rows; the others take one window each.
    """
    few, many = _split_hot(df, keys, hot_rows)
    own = Window.partitionBy(*keys).orderBy(*[F.col(o).asc() for o in order])
    near = {
        name: shift(F.struct(*[F.col(src).alias(new) for new, src in values.items()])).over(own)
        for name, values, shift in (("_prev", previous, F.lag), ("_next", following, F.lead))
        if values
    }
    found = few.select("*", *[c.alias(name) for name, c in near.items()])
    out = found.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in previous], *[F.col(f"_next.{new}").alias(new) for new in following])
    return out if many is None else out.unionByName(_neighbours_by_bucket(many, keys, order, previous, following, bucket, hot_rows))


def _neighbours_by_bucket(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: dict[str, str],
    following: dict[str, str],
    bucket: Column,
    hot_rows: int | None,
) -> DataFrame:
    """``with_neighbours`` by windows of one bucket each, and one row per bucket that carries values across."""
    marked = _bucketed(df, keys, order, bucket, hot_rows)
    by_bucket = [*keys, "_bucket"]
    position = F.struct(*[F.col(o) for o in order])
    step = Window.partitionBy(*by_bucket).orderBy(*[F.col(o).asc() for o in order])
    across = Window.partitionBy(*keys).orderBy("_bucket")
    sides = [s for s in (("_prev", previous, F.lag, F.max_by), ("_next", following, F.lead, F.min_by)) if s[1]]
    inside, edges, carried = marked, [], []
    for name, values, shift, edge in sides:
        fields = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
        # The neighbour inside the bucket; the first or last row of a bucket has none there.
        inside = inside.withColumn(name, shift(F.struct(fields.alias("row"))).over(step))
        edges.append(edge(fields, position).alias(f"{name}_edge"))
        carried.append(shift(f"{name}_edge").over(across).alias(f"{name}_far"))
    summary = marked.groupBy(*by_bucket).agg(*edges).select(*by_bucket, *carried)
    joined = null_safe_join(inside, summary, by_bucket)
    near = {name: F.when(F.col(name).isNotNull(), F.col(f"{name}.row")).otherwise(F.col(f"{name}_far")) for name, *_ in sides}
    return joined.select(*df.columns, *[near[name][new].alias(new) for name, values, *_ in sides for new in values])


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    bucket: Column,
    direction: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add columns of the previous or next row of the same key, see ``with_neighbours``."""
    back = direction == "previous"
    return with_neighbours(df, keys, order, values if back else {}, {} if back else values, bucket, hot_rows)


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str, hot_rows: int | None = None) -> DataFrame:
    """1-based position per key. ``bucket`` must not fall as ``order`` rises; of keys with very many rows windows span one bucket, or a part of one, each."""
    few, many = _split_hot(df, keys, hot_rows)
    own = Window.partitionBy(*keys).orderBy(*order)
    numbered = few.select(*df.columns, F.row_number().over(own).cast("bigint").alias(out))
    return numbered if many is None else numbered.unionByName(_numbers_by_bucket(many, keys, order, bucket, out, hot_rows))


def _numbers_by_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str, hot_rows: int | None) -> DataFrame:
    """``with_row_number`` by windows of one bucket each and the rows of the buckets before."""
    placed = _bucketed(df, keys, order, bucket, hot_rows)
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = placed.withColumn("_rn", F.row_number().over(within))
    joined = null_safe_join(numbered, offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_rn") + F.col("_before")).alias(out))


def as_of_join(facts: DataFrame, log: DataFrame, keys: Sequence[str], at: str, value: str, bucket: Callable[[Column], Column], hot_rows: int | None = None) -> DataFrame:
    """``facts`` with the ``value`` that ``log`` held for the same keys at or before ``at``; NULL if none.

    Both sides have columns ``keys`` and ``at``. Of log rows with one key and time the largest value
    counts; log rows without time or value never do, and facts without time find nothing. NULL keys
    meet each other. ``bucket`` must not fall as time rises: it splits a hot key, a hot bucket is cut
    again, and what was seen before a bucket is carried in by one row per key and bucket.
    """
    seen = log.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias(value))
    sides = seen.withColumn("_side", F.lit(0)).unionByName(facts.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = _bucketed(sides, keys, [at], bucket(F.col(at)), hot_rows)
    by_bucket = [*keys, "_bucket"]
    inside = Window.partitionBy(*by_bucket).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.last(value, ignorenulls=True).over(inside)).where(F.col("_side") == 1)
    summary = rows.groupBy(*by_bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*by_bucket, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = null_safe_join(near, carried, by_bucket)
    return joined.select(*facts.columns, F.coalesce("_near", "_carried").alias(value))


def value_positions(df: DataFrame, keys: Sequence[str], value: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Per key and distinct value: rows with it (``n``), rows strictly below (``below``), values below
    (``values_below``) and rows of the key (``total``). NULL values are left out, a NULL key is a group of its own.

    Bucket bounds are quantiles of the key's own distinct values, so that an outlier or a long tail
    leaves the buckets even; a key with few values has few. Positions are exact whatever the bounds;
    ``buckets`` only sets how many tasks share a key at most.
    """
    keys = list(keys) or ["_all"]
    rows = df if keys != ["_all"] else df.withColumn("_all", F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    step = max(1, math.isqrt(buckets))
    marks = [(i + 1) / (step * step) for i in range(step * step - 1)]
    bounds = F.array_distinct(F.percentile_approx("_v", marks, 10 * len(marks))) if marks else F.array(F.min("_v"))
    stride = F.greatest(F.lit(1), F.floor(F.lit(step * step * RANK_VALUES) / F.count(F.lit(1))))
    bounds = F.filter(bounds, lambda _, i: (i + 1) % stride == 0)
    spans = counts.groupBy(*keys).agg(bounds.alias("_bounds"), F.sum("n").alias("total"))
    v = F.col("_v")
    # Two short looks instead of one long one: which stretch of bounds, then where in it.
    heads = F.filter("_bounds", lambda _, i: i % step == 0)
    stretch = F.greatest(F.size(F.filter(heads, lambda b: b < v)) - 1, F.lit(0)) * step
    inside = F.size(F.filter(F.slice("_bounds", stretch + 1, F.lit(step)), lambda b: b < v))
    placed = null_safe_join(counts, spans, keys).withColumn("_bucket", stretch + inside).drop("_bounds")
    per_bucket = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_vals"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_vals").over(before), F.lit(0)).alias("_vals_before"),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    ranked = null_safe_join(placed, offsets, [*keys, "_bucket"]).select(
        *keys,
        F.col("_v").alias(value),
        "n",
        (F.col("_rows_before") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("below"),
        (F.col("_vals_before") + F.row_number().over(within) - 1).alias("values_below"),
        "total",
    )
    return ranked.drop("_all")


def _selected(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """``exact_quantiles`` of numbers, in two passes over the rows."""
    by = list(keys) or ["_all"]
    rows = df.select(*([F.lit(1).alias("_all")] if by == ["_all"] else by), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    near = F.col("_v").cast("double")  # rises as the value does, so it can bracket values of any number type
    margin = 4 / SKETCH
    inner = sorted({x for p, _ in wanted.values() for x in (p - margin, p + margin) if 0 < x < 1})
    sketch = F.percentile_approx(near, inner, SKETCH) if inner else F.array()

    def bound(x: float, edge: str) -> Column:
        """A few values are all in the range; of more, four times the sketch's error is several rows."""
        return F.when(F.col("_total") > SKETCH, F.col("_marks")[inner.index(x)]).otherwise(F.col(edge)) if 0 < x < 1 else F.col(edge)

    spans = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"), F.min(near).alias("_low"), F.max(near).alias("_high"), sketch.alias("_marks"))
    ranges = [F.struct(F.lit(n).alias("name"), bound(p - margin, "_low").alias("low"), bound(p + margin, "_high").alias("high"), index(F.col("_total")).alias("at")) for n, (p, index) in wanted.items()]
    spans = spans.select(*by, F.array(*ranges).alias("_ranges"))
    # What is above a range plays no part, and what is below it is one row of a count.
    open_ = null_safe_join(rows, spans, by).select(*by, "_v", F.explode(F.filter("_ranges", lambda r: near <= r["high"])).alias("_r"))
    inside = F.when(near >= F.col("_r.low"), F.col("_v")).alias("_v")
    counts = open_.select(*by, F.col("_r.name").alias("_name"), F.col("_r.at").alias("_at"), inside).groupBy(*by, "_name", "_at", "_v").agg(F.count(F.lit(1)).alias("_n"))
    until = F.sum("_n").over(Window.partitionBy(*by, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_until", until).where(F.col("_v").isNotNull() & (F.col("_at") < F.col("_until")) & (F.col("_at") >= F.col("_until") - F.col("_n")))
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in wanted]).drop("_all")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """Per key the elements at given zero-based indexes of its sorted values, one column each; NULL values are left out.

    ``wanted`` gives each column its share of the way through the values and its index as a function of
    their number. A NULL key is a group of its own.
    """
    if isinstance(df.schema[value].dataType, T.NumericType):
        return _selected(df, keys, value, wanted)
    placed = value_positions(df, keys, value)
    hit = {n: (F.col("below") <= index(F.col("total"))) & (index(F.col("total")) < F.col("below") + F.col("n")) for n, (_, index) in wanted.items()}
    return placed.groupBy(*keys).agg(*[F.max(F.when(hit[n], F.col(value))).alias(n) for n in wanted])


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """Element at zero-based index floor(n*p) of the sorted values per key (the upper median for p = 0.5)."""
    return exact_quantiles(df, keys, value, {out: (p, lambda total: F.least(F.floor(total * F.lit(p)), total - 1))})


def percent_rank_by(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Percent rank of each row's value inside its key: rows below / (rows - 1), 0 for a single row.

    Rows whose value is NULL have no rank and don't count.
    """
    ranks = value_positions(df, keys, value).select(
        *keys, value, F.coalesce(F.try_divide(F.col("below"), F.col("total") - 1), F.lit(0.0)).alias(out)
    )
    return null_safe_join(df, ranks, [*keys, value], "left")


def dense_rank_all(df: DataFrame, value: str, out: str) -> DataFrame:
    """Dense rank of a column over the whole table, starting at 1, without one global window; NULL has no rank.

    Distinct values are dealt by ranges, so a rank is a value's place in its part and the values of the parts before.
    """
    values = df.where(F.col(value).isNotNull()).select(value).distinct()
    # The id's upper bits number the part, its lower 33 the value in it. Another run may draw other ranges, so ids are kept.
    dealt = values.repartitionByRange(value).sortWithinPartitions(value).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(dealt).select(value, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranks = placed.join(offsets, "_part").select(value, (F.col("_before") + F.col("_at") + 1).cast("bigint").alias(out))
    return df.join(ranks, value, "left")
