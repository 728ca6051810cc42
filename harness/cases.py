"""Case registry: a query, its SQL, and the input bindings both use.

Bindings give the driver's tables the shape of workplace records. A binding
only renames, derives keys and filters; it is one SQL text that both engines
run, so the operator under test is the only difference between them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

BINDINGS: dict[str, str] = {}
VIEWS: dict[str, str] = {}
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_REF = re.compile(r"<(\w+)>")


class Tables:
    """Bound inputs of one run: ``t["b_commits"]`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # One view per input folder and table, so that file listing and schema reading happen once.
        self._prefix = f"in_{zlib.crc32(sf_dir.encode()):08x}_"

    def _base(self, name: str) -> str:
        view = self._prefix + name
        if not self.spark.catalog.tableExists(view):
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            df.createOrReplaceTempView(view)
        return view

    def _text(self, name: str) -> str:
        if name in BASE_TABLES:
            return self._base(name)
        return "(" + _REF.sub(lambda m: self._text(m.group(1)), BINDINGS[name]) + ")"

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {self._text(name)}")


def portable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Types that read the same from any engine: dates and times as text, flags as integers, floats rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        elif isinstance(f.dataType, T.MapType):
            entries = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
            c = F.array_join(F.array_sort(entries), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def case(name: str, sql: str | None = None):
    """Register a query; ``sql`` names bindings and views as <name>."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"{name} is registered twice")
        CASES[name] = lambda spark, sf_dir: portable(fn(Tables(spark, sf_dir)))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def oracle_text(name: str) -> str:
    """Full SQL of a case: every view and binding it reaches becomes a CTE, inner ones first."""
    ordered: dict[str, str] = {}

    def visit(text: str) -> str:
        for ref in _REF.findall(text):
            if ref in BASE_TABLES or ref in ordered:
                continue
            inner = visit(BINDINGS.get(ref) or VIEWS[ref])
            ordered[ref] = inner
        return _REF.sub(lambda m: m.group(1), text)

    body = visit(SQL[name])
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in ordered.items())
    return f"WITH {ctes}\nSELECT * FROM (\n{body}\n) AS result" if ctes else body
