"""Reading landed streams, de-duplicating them, and writing model output."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.functions import scalars as fx
from orgpulse.operators.ordered import latest_per_key


def read_bronze(spark: SparkSession, path: str, schema: T.StructType, fmt: str, stream: bool = False) -> DataFrame:
    """Landed records under a declared schema: unknown fields are dropped, missing ones are NULL."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    return reader.format(fmt).load(path)


def add_envelope(df: DataFrame, tenant: str, source: str, data_source: str, at: datetime) -> DataFrame:
    """Stamp tenant, source instance, source kind and collection time on every record."""
    return df.withColumns(
        {
            "tenant_id": F.lit(tenant),
            "source_id": F.lit(source),
            "data_source": F.lit(data_source),
            "collected_at": F.lit(at),
        }
    )


def make_unique_key(df: DataFrame, parts: Sequence[str], sep: str, hashed: bool = False, out: str = "unique_key") -> DataFrame:
    """Composite key over the natural-key parts, optionally as a digest."""
    key = fx.digest_key(sep, *parts) if hashed else fx.join_key(sep, *parts)
    return df.withColumn(out, key)


def append_dedup(stored: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Stored rows plus a batch, newest row per key kept."""
    rows = batch if stored is None else stored.unionByName(batch)
    return latest_per_key(rows, keys, order)


def qualify_latest(
    df: DataFrame, email_col: str, tenant_col: str, order: Sequence[Column | str]
) -> DataFrame:
    """Newest row per (normalised e-mail, tenant)."""
    keyed = df.withColumns(
        {"_mail": F.lower(F.trim(F.col(email_col))), "_tenant": fx.or_empty(tenant_col)}
    )
    return latest_per_key(keyed, ["_mail", "_tenant"], order).drop("_mail", "_tenant")


def replacing_read(df: DataFrame, keys: Sequence[str], version: Sequence[Column | str], deleted_col: str) -> DataFrame:
    """Last version of each key of an append-only table, without the keys last marked deleted."""
    return latest_per_key(df, keys, version).where(F.coalesce(F.col(deleted_col), F.lit(0)) == 0)


def dedup_branch_heads(branches: DataFrame, repo_keys: Sequence[str]) -> DataFrame:
    """One branch per head commit of a repository, the default branch first; siblings are listed.

    Branches without a head commit are all kept.
    """
    is_default = fx.flag(F.col("name") == F.col("default_branch_name"))
    rows = branches.withColumn("is_default", is_default)
    with_head = rows.where(fx.filled("head_sha"))
    headless = rows.where(~fx.filled("head_sha")).select(
        *repo_keys, "head_sha", "name", "is_default", F.lit(0).cast("bigint").alias("skipped")
    )
    # Smallest name among the default branch, else among all: one aggregate, no sort of the group.
    preferred = F.struct((1 - F.col("is_default")).alias("a"), F.col("name").alias("b"))
    kept = (
        with_head.groupBy(*repo_keys, "head_sha")
        .agg(F.min(preferred).alias("_p"), F.count(F.lit(1)).alias("_n"))
        .select(
            *repo_keys,
            "head_sha",
            F.col("_p.b").alias("name"),
            (1 - F.col("_p.a")).alias("is_default"),
            (F.col("_n") - 1).alias("skipped"),
        )
    )
    return kept.unionByName(headless)


def skipped_siblings(branches: DataFrame, repo_keys: Sequence[str]) -> DataFrame:
    """Each branch that ``dedup_branch_heads`` left out, beside the branch kept in its place."""
    kept = dedup_branch_heads(branches, repo_keys).where(fx.filled("head_sha")).select(
        *repo_keys, "head_sha", F.col("name").alias("kept_branch")
    )
    return (
        branches.where(fx.filled("head_sha"))
        .join(kept, [*repo_keys, "head_sha"])
        .where(F.col("name") != F.col("kept_branch"))
        .select(*repo_keys, "head_sha", F.col("name").alias("skipped_branch"), "kept_branch")
    )


def changed_partitions(branches: DataFrame, repo_state: DataFrame, branch_state: DataFrame, repo_keys: Sequence[str]) -> DataFrame:
    """Branches to read again, with the cursor to start from.

    A repository whose push time did not move is skipped; so is a branch whose
    head did not change. A branch whose head moved away from a stored head is
    read in full (cursor NULL). A branch of one repository is not ahead of the
    default when it carries the default's head.
    """
    joined = (
        branches.join(repo_state.withColumnRenamed("pushed_at", "stored_pushed_at"), [*repo_keys], "left")
        .join(branch_state.withColumnRenamed("head_sha", "stored_head"), [*repo_keys, "name"], "left")
    )
    fresh = fx.filled("pushed_at") & fx.filled("stored_pushed_at") & (F.col("pushed_at") <= F.col("stored_pushed_at"))
    same_head = fx.filled("head_sha") & fx.filled("stored_head") & (F.col("head_sha") == F.col("stored_head"))
    moved = fx.filled("head_sha") & fx.filled("stored_head") & (F.col("head_sha") != F.col("stored_head"))
    return joined.where(~fresh & ~same_head).select(
        *repo_keys,
        "name",
        "head_sha",
        fx.flag(moved).alias("head_changed"),
        F.when(moved, F.lit(None)).otherwise(F.col("cursor")).alias("cursor"),
    )


def flatten_record(df: DataFrame, lifted: dict[str, str], rest: str, rest_out: str) -> DataFrame:
    """Lift nested fields to columns and keep the whole nested struct as JSON text."""
    return df.select(
        *[F.col(path).alias(name) for name, path in lifted.items()],
        F.to_json(F.col(rest)).alias(rest_out),
    )


# --- sinks -------------------------------------------------------------------------


def write_sink(
    df: DataFrame,
    path: str,
    mode: str,
    keys: Sequence[str] = (),
    order: Sequence[Column | str] = (),
    partition_by: Sequence[str] = (),
    staging: str | None = None,
) -> None:
    """Write model output: ``table`` (replace), ``append``, ``incremental`` (replace rows by key), or ``versioned``
    (replace rows by key in a versioned table, which publishes in one step)."""
    if mode == "table":
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)
    elif mode == "append":
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    elif mode == "incremental":
        from orgpulse.streaming.incremental import upsert_by_key

        upsert_by_key(df, path, keys, order, partition_by, staging)
    elif mode == "versioned":
        from orgpulse.sources import versioned

        versioned.upsert(df, path, keys, order)
    else:
        raise ValueError(f"unknown sink mode {mode!r}")


def export_csv(df: DataFrame, path: str) -> None:
    """Result as CSV with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def expire_rows(df: DataFrame, ts_col: str, as_of: str, keep: str) -> DataFrame:
    """Rows not older than the retention span, for example ``keep='INTERVAL 1 YEAR'``."""
    return df.where(F.col(ts_col) >= F.lit(as_of).cast("timestamp") - F.expr(keep))
