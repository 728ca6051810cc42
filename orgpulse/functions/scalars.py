"""Column helpers. Each returns a Column built from JVM-side functions only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- NULL handling and branching ---------------------------------------------


def or_empty(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def or_zero(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def filled(c: ColumnLike) -> Column:
    """True when the text is neither NULL nor empty; never NULL itself."""
    return F.coalesce(as_col(c) != "", F.lit(False))


def null_if(c: ColumnLike, value) -> Column:
    return F.nullif(as_col(c), F.lit(value))


def multi_if(*branches: tuple[Column, object], default=None) -> Column:
    """First branch whose condition is true wins; a NULL condition counts as false."""
    (cond, value), *rest = branches
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(default)


def flag(cond: Column) -> Column:
    """0/1 integer; NULL counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


# --- keys and hashes -----------------------------------------------------------


def join_key(sep: str, *parts: ColumnLike) -> Column:
    """Join parts with ``sep``; NULL parts become '' so that the number of separators is fixed."""
    return F.concat_ws(sep, *[or_empty(as_col(p).cast("string")) for p in parts])


def digest_key(sep: str, *parts: ColumnLike) -> Column:
    return F.md5(join_key(sep, *parts))


def row_hash(columns: Sequence[ColumnLike], null_marker: str) -> Column:
    """SHA-256 over the text of all columns, each with its length before it; NULL differs from ''."""
    texts = [F.coalesce(as_col(c).cast("string"), F.lit(null_marker)) for c in columns]
    return F.sha2(F.concat_ws("|", *[x for t in texts for x in (F.length(t).cast("string"), t)]), 256)


def stable_uuid(*parts: ColumnLike) -> Column:
    """Repeatable id in UUID layout, derived from the natural key."""
    digest = F.md5(join_key("\x1f", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def person_key(email: ColumnLike, name: ColumnLike) -> Column:
    """Lower-cased e-mail, or lower-cased name when there is no e-mail."""
    return F.when(as_col(email) != "", F.lower(as_col(email))).otherwise(F.lower(as_col(name)))


# --- JSON in text columns ------------------------------------------------------


def json_path(*path: str) -> str:
    return "$" + "".join(f"['{step}']" for step in path)


def json_text(c: ColumnLike, *path: str) -> Column:
    """Text at a path; missing key or bad JSON gives ''."""
    return or_empty(F.get_json_object(as_col(c), json_path(*path)))


def json_number(c: ColumnLike, *path: str) -> Column:
    """Number at a path; missing key or non-number gives 0."""
    raw = F.get_json_object(as_col(c), json_path(*path))
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def json_flag(c: ColumnLike, *path: str) -> Column:
    return F.coalesce(F.get_json_object(as_col(c), json_path(*path)) == "true", F.lit(False))


def json_size(c: ColumnLike) -> Column:
    return F.coalesce(F.json_array_length(as_col(c)), F.lit(0))


def json_elements(c: ColumnLike) -> Column:
    """Array of the raw JSON texts of a JSON array's elements."""
    return F.from_json(F.coalesce(as_col(c), F.lit("[]")), "array<string>")


def json_of_map(pairs: dict[str, ColumnLike]) -> Column:
    """JSON object of text values with NULL written as ''."""
    items: list[Column] = []
    for key, value in pairs.items():
        items += [F.lit(key), or_empty(as_col(value).cast("string"))]
    return F.to_json(F.create_map(*items))


def empty_map(value_type: str) -> Column:
    return F.create_map().cast(f"map<string,{value_type}>")


# --- time ------------------------------------------------------------------------

# Layouts tried after ISO-8601.
FALLBACK_LAYOUTS = ["yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "d MMM yyyy"]


def parse_time(c: ColumnLike) -> Column:
    """Timestamp out of ISO-8601, epoch seconds or milliseconds, or a few common layouts; NULL on garbage."""
    text = F.trim(as_col(c).cast("string"))
    # No text fits two of the first three; the most usual one is tried first.
    tries = [
        F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp")),
        F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(text.try_cast("bigint"))),
        F.when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("bigint"))),
        *[F.try_to_timestamp(text, F.lit(layout)) for layout in FALLBACK_LAYOUTS],
    ]
    return F.coalesce(*tries)


def parse_iso(c: ColumnLike) -> Column:
    """Timestamp out of ISO-8601 text only. One cast, for columns known to hold nothing else."""
    return as_col(c).try_cast("timestamp")


def parse_day(c: ColumnLike) -> Column:
    return F.to_date(parse_time(c))


def time_from_millis(c: ColumnLike) -> Column:
    return F.timestamp_millis(as_col(c).try_cast("bigint"))


def time_from_seconds(c: ColumnLike) -> Column:
    """Timestamp out of a float-second text such as a chat message id."""
    return F.timestamp_seconds(as_col(c).try_cast("double"))


def to_millis(c: ColumnLike) -> Column:
    return F.unix_millis(as_col(c).cast("timestamp"))


def seconds_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole seconds from start to end; may be negative, NULL if either is NULL."""
    return F.unix_timestamp(as_col(end).cast("timestamp")) - F.unix_timestamp(as_col(start).cast("timestamp"))


def hours_between(start: ColumnLike, end: ColumnLike) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def duration_seconds(c: ColumnLike) -> Column:
    """Seconds in an ISO-8601 duration such as PT1H2M3S; NULL or other text gives 0."""

    def unit(letter: str) -> Column:
        return F.coalesce(F.regexp_extract(as_col(c), rf"T.*?(\d+){letter}", 1).try_cast("bigint"), F.lit(0))

    days = F.coalesce(F.regexp_extract(as_col(c), r"^P(\d+)D", 1).try_cast("bigint"), F.lit(0))
    return days * 86400 + unit("H") * 3600 + unit("M") * 60 + unit("S")


def monday_week(c: ColumnLike) -> Column:
    return F.to_date(F.date_trunc("week", as_col(c)))


def sunday_week(c: ColumnLike) -> Column:
    day = F.to_date(as_col(c))
    return F.date_sub(day, F.dayofweek(day) - 1)


def month_of(c: ColumnLike) -> Column:
    return F.to_date(F.date_trunc("month", as_col(c)))


def grain_of(c: ColumnLike, grain: str) -> Column:
    """First day of the day, week (Monday), month or quarter."""
    return F.to_date(F.date_trunc(grain, as_col(c)))


# --- numbers -----------------------------------------------------------------------


def clamp(c: Column, low: float, high: float) -> Column:
    """Bound a number; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def tidy_round(c: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value: binary noise such as 3.8499999999999996 counts as 3.85."""
    return F.round(F.round(c, 9), digits)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a/b as double; NULL when b is 0 or NULL."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def percent(a: ColumnLike, b: ColumnLike, digits: int) -> Column:
    return tidy_round(ratio(a, b) * 100, digits)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(value: ColumnLike, cond: Column) -> Column:
    """Sum over matching rows, 0 when none match."""
    return F.coalesce(F.sum(F.when(cond, as_col(value))), F.lit(0))


def avg_where(value: ColumnLike, cond: Column) -> Column:
    """Average over matching rows, NULL when none match."""
    return F.avg(F.when(cond, as_col(value)))


def latest_filled(value: ColumnLike, order: ColumnLike, tie: ColumnLike) -> Column:
    """Aggregate: value of the newest row where it is not NULL; ties go to the greater ``tie``."""
    value = as_col(value)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(as_col(order), as_col(tie))))


# --- text ------------------------------------------------------------------------------


def matches(c: ColumnLike, pattern: str) -> Column:
    return as_col(c).rlike(pattern)


def ilike_any(c: ColumnLike, patterns: Sequence[str]) -> Column:
    return any_of(as_col(c).ilike(p) for p in patterns)


def file_extension(c: ColumnLike) -> Column:
    """Text after the last dot, '' when there is none."""
    text = or_empty(c)
    return F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(F.lit(""))


def last_segment(c: ColumnLike, sep: str) -> Column:
    return F.substring_index(F.regexp_replace(as_col(c), f"{sep}+$", ""), sep, -1)


def split_part(c: ColumnLike, sep: str, index: int) -> Column:
    return F.split_part(as_col(c), F.lit(sep), F.lit(index))


# --- sketch-free array helpers ------------------------------------------------------------


def distinct_flat(c: ColumnLike) -> Column:
    """Aggregate: distinct elements over all array values of the group, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(as_col(c)))))


def upper_median_of(values: ColumnLike) -> Column:
    """Element floor(n/2) (zero-based) of the sorted array. For groups of bounded size."""
    values = F.array_sort(as_col(values))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def array_difference(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_except(as_col(a), as_col(b))


def map_value(c: ColumnLike, key: str) -> Column:
    return as_col(c)[key]


def map_has(c: ColumnLike, key: str) -> Column:
    return F.map_contains_key(as_col(c), key)
