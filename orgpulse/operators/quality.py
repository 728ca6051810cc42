"""Data-quality checks. Each returns the violating rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions import scalars as fx


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.where(fx.any_of(F.col(c).isNull() for c in cols)).withColumn("missing", F.array_join(missing, ","))


def unique(df: DataFrame, col: str) -> DataFrame:
    return unique_combination(df, [col])


def unique_combination(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def accepted_values(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Values outside the list, with how often they occur; NULL is not a value."""
    return df.where(~F.col(col).isin(list(values))).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def freshness(df: DataFrame, ts: str, as_of: str, keys: Sequence[str]) -> DataFrame:
    """Age in hours of the newest row per source."""
    return df.groupBy(*keys).agg(F.max(ts).alias("newest")).withColumn(
        "age_h", fx.hours_between("newest", F.lit(as_of).cast("timestamp"))
    )
