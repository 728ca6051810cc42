"""The metric-query interface as plain calls with typed arguments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orgpulse.functions import scalars as fx

# Paging bounds, threshold vocabulary.
DEFAULT_TOP, MIN_TOP, MAX_TOP = 25, 1, 200
LEVELS = ["good", "warning", "critical"]
EQUAL_WITHIN = 2.220446049250313e-16


# --- filter predicates ------------------------------------------------------------------

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
}


@dataclass(frozen=True)
class Filter:
    """``Filter("amount", "ge", 5)``; combine with ``&``, ``|`` and ``~``."""

    column: str
    op: str
    value: object

    def build(self) -> Column:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        return OPERATORS[self.op](F.col(self.column), self.value)

    def __and__(self, other):
        return Combined("and", (self, other))

    def __or__(self, other):
        return Combined("or", (self, other))

    def __invert__(self):
        return Combined("not", (self,))


@dataclass(frozen=True)
class Combined:
    kind: str
    parts: tuple

    def build(self) -> Column:
        built = [p.build() for p in self.parts]
        if self.kind == "not":
            return ~built[0]
        return reduce(lambda a, b: a & b if self.kind == "and" else a | b, built)

    __and__ = Filter.__and__
    __or__ = Filter.__or__
    __invert__ = Filter.__invert__


def filter_rows(df: DataFrame, *filters: Filter | Combined) -> DataFrame:
    return reduce(lambda d, f: d.where(f.build()), filters, df)


# --- catalogue and query -----------------------------------------------------------------------


@dataclass(frozen=True)
class MetricSpec:
    """A named metric: ``rows`` gives the input rows, ``compute`` turns filtered rows into the result."""

    name: str
    description: str
    rows: Callable[[], DataFrame]
    compute: Callable[[DataFrame], DataFrame]
    thresholds: tuple["Threshold", ...] = ()
    enabled: bool = True


@dataclass
class Catalog:
    metrics: dict[str, MetricSpec] = field(default_factory=dict)

    def add(self, spec: MetricSpec) -> "Catalog":
        self.metrics[spec.name] = spec
        return self

    def enabled(self, name: str) -> MetricSpec:
        spec = self.metrics.get(name)
        if spec is None or not spec.enabled:
            raise LookupError(f"no enabled metric {name!r}")
        return spec


def date_range_inside(rows: DataFrame, date_from: str | None, date_to: str | None, col: str = "metric_date") -> DataFrame:
    """Keep [from, to) before any per-person aggregation."""
    if date_from is not None:
        rows = rows.where(F.col(col) >= F.lit(date_from))
    if date_to is not None:
        rows = rows.where(F.col(col) < F.lit(date_to))
    return rows


def page_size(top: int | None) -> int:
    """Rows of one page: the default if none is asked for. What is outside the bounds is refused, not cut; ask for further pages."""
    if top is None:
        return DEFAULT_TOP
    if not MIN_TOP <= top <= MAX_TOP:
        raise ValueError(f"a page has {MIN_TOP} to {MAX_TOP} rows, not {top}; go on with after= for more")
    return top


def top_with_has_next(df: DataFrame, top: int, order: Sequence[Column]) -> DataFrame:
    """First ``top`` rows in order, each telling whether more rows exist.

    One pass: ``top + 1`` rows are read, and the windows span only those.
    """
    head = df.orderBy(*order).limit(top + 1)
    everything = Window.partitionBy(F.lit(0))
    placed = head.withColumns(
        {"_rank": F.row_number().over(everything.orderBy(*order)), "has_next": F.count(F.lit(1)).over(everything) > top}
    )
    return placed.where(F.col("_rank") <= top).orderBy("_rank").drop("_rank")


def round_floats(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every float column, half away from zero."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ordering(*keys: str) -> list[Column]:
    """``"name"`` or ``"name desc"`` to sort columns; anything else is refused."""
    out = []
    for key in keys:
        name, _, way = key.partition(" ")
        if not name.replace("_", "a").isalnum() or name[0].isdigit() or way.lower() not in ("", "asc", "desc"):
            raise ValueError(f"not an ordering: {key!r}")
        out.append(F.col(name).desc() if way.lower() == "desc" else F.col(name).asc())
    return out


def query_metric(
    catalog: Catalog,
    name: str,
    date_from: str | None = None,
    date_to: str | None = None,
    person_id: str | None = None,
    org_unit_id: str | None = None,
    drill_id: str | None = None,
    select: Sequence[str] | None = None,
    orderby: Sequence[str] = (),
    top: int | None = None,
    after: Sequence[object] | None = None,
) -> DataFrame:
    """Run a catalogued metric. Dates bound the input rows; scope filters are on result columns,
    which Catalyst pushes below the aggregate when they are grouping keys.

    A page with ``has_next`` is followed by the one ``after`` the values its last row has in the
    ordering's columns, which must then tell all rows apart. Values are those of the page, rounded
    as they are there; nulls come first in ascending and last in descending order.
    """
    spec = catalog.enabled(name)
    out = spec.compute(date_range_inside(spec.rows(), date_from, date_to))
    for col, wanted in (("person_id", person_id), ("org_unit_id", org_unit_id), ("drill_id", drill_id)):
        if wanted is not None:
            out = out.where(F.col(col) == wanted)
    if select:
        out = out.select(*select)
    out = round_floats(out)
    keys = list(orderby) or [c for c in out.columns if c not in ("ai_tools", "columns", "rows")]
    order = ordering(*keys)
    if after is not None:
        out = out.where(_past(keys, after))
    return top_with_has_next(out, page_size(top), order)


def _past(keys: Sequence[str], values: Sequence[object]) -> Column:
    """Rows that come after one with the given values, in the order of the keys."""
    if len(values) != len(keys):
        raise ValueError(f"{len(keys)} values are needed, one for each of {list(keys)}")
    out, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        name, _, way = key.partition(" ")
        col = F.col(name)
        if way.lower() == "desc":
            beyond = F.lit(False) if value is None else col.isNull() | (col < F.lit(value))
        else:
            beyond = col.isNotNull() if value is None else col > F.lit(value)
        out = out | (same & F.coalesce(beyond, F.lit(False)))
        same = same & col.eqNullSafe(F.lit(value))
    return out


def tenant_query(
    df: DataFrame,
    tenant: str,
    filters: Sequence[Filter | Combined] = (),
    select: Sequence[str] | None = None,
    orderby: Sequence[str] = (),
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """Rows of one tenant; the tenant filter always comes first."""
    if not tenant:
        raise ValueError("a tenant is required")
    out = filter_rows(df.where(F.col("tenant_id") == tenant), *filters)
    if orderby:
        out = out.orderBy(*ordering(*orderby))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*select) if select else out


def keyset_page(
    df: DataFrame,
    sort_keys: Sequence[tuple[str, bool]],
    cursor: Sequence[object] | None,
    limit: int,
    forward: bool = True,
) -> DataFrame:
    """One page of a stable order. ``sort_keys`` are (column, ascending) and must end in a unique column.

    The row predicate is the lexicographic comparison with the cursor; a
    backward page is read in reverse and returned in the canonical order.
    """

    def beyond(col: Column, value: object, ascending: bool) -> Column:
        return col > value if ascending == forward else col < value

    rows = df
    if cursor is not None:
        alternatives = []
        for i, (name, ascending) in enumerate(sort_keys):
            same = [F.col(n) == v for (n, _), v in zip(sort_keys[:i], cursor[:i])]
            alternatives.append(fx.all_of([*same, beyond(F.col(name), cursor[i], ascending)]))
        rows = rows.where(fx.any_of(alternatives))

    def order(reverse: bool) -> list[Column]:
        return [F.col(n).desc() if asc == reverse else F.col(n).asc() for n, asc in sort_keys]

    return rows.orderBy(*order(not forward)).limit(limit).orderBy(*order(False))


# --- thresholds and alerts -------------------------------------------------------------------------


@dataclass(frozen=True)
class Threshold:
    field_name: str
    operator: str
    value: float
    level: str

    def __post_init__(self):
        if self.operator not in ("gt", "ge", "lt", "le", "eq"):
            raise ValueError(f"unknown comparison {self.operator!r}")
        if self.level not in LEVELS:
            raise ValueError(f"unknown level {self.level!r}")

    def matches(self) -> Column:
        value = F.col(self.field_name).cast("double")
        if self.operator == "eq":
            return F.abs(value - F.lit(self.value)) < F.lit(EQUAL_WITHIN)
        return OPERATORS[self.operator](value, F.lit(self.value))


def evaluate_thresholds(df: DataFrame, thresholds: Sequence[Threshold], out: str = "_thresholds") -> DataFrame:
    """Map of field to the highest matching level; fields without a match are absent."""
    entries = []
    for name in dict.fromkeys(t.field_name for t in thresholds):
        branches = []
        for level in reversed(LEVELS):
            conds = [t.matches() for t in thresholds if t.field_name == name and t.level == level]
            if conds:
                branches.append((fx.any_of(conds), F.lit(level)))
        entries.append(F.struct(F.lit(name).alias("key"), fx.multi_if(*branches, default=F.lit(None)).alias("value")))
    found = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.withColumn(out, F.map_from_entries(found))


def alert_evaluation(values: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Long metric rows against rule rows (metric_key, operator, threshold, level) -> fired alerts."""
    value, bound = F.col("metric_value"), F.col("threshold")
    hit = fx.multi_if(
        (F.col("operator") == "gt", value > bound),
        (F.col("operator") == "ge", value >= bound),
        (F.col("operator") == "lt", value < bound),
        (F.col("operator") == "le", value <= bound),
        (F.col("operator") == "eq", F.abs(value - bound) < F.lit(EQUAL_WITHIN)),
        default=F.lit(False),
    )
    keys = ["tenant_id", "metric_key"]
    return values.join(rules, keys).where(hit).withColumn("fired_at", F.lit(as_of).cast("timestamp"))
