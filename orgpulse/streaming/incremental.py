"""Incremental rules as batch functions, and the foreachBatch writers that turn them into streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.operators.history import snapshot_scd2
from orgpulse.operators.ordered import latest_per_key


def incremental_by_version(df: DataFrame, target: DataFrame, version_col: str) -> DataFrame:
    """Rows newer than anything stored; all rows when nothing is stored."""
    stored = target.agg(F.max(version_col).alias("v")).scalar()
    return df.where(stored.isNull() | (F.col(version_col) > stored))


def incremental_with_lookback(df: DataFrame, target: DataFrame, day_col: str, days: int) -> DataFrame:
    """Rows after the newest stored day less a look-back; the first run takes all."""
    newest = target.agg(F.max(day_col).alias("d")).scalar()
    return df.where(newest.isNull() | (F.col(day_col) > F.date_sub(newest, days)))


def late_data_switch(final: DataFrame, provisional: DataFrame, day: Column, as_of: str) -> DataFrame:
    """Settled rows for days before ``as_of``, provisional rows for that day only."""
    today = F.lit(as_of).cast("date")
    return final.where(day < today).unionByName(provisional.where(day == today))


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """What a path holds, or nothing if there is no such path or no file in it. Any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def in_partitions(batch: DataFrame, partition_by: Sequence[str], max_values: int = 10_000) -> Column:
    """Condition on the partition columns that holds for every partition a batch touches.

    Its values stand in the query, so that the scan lists and reads only these folders. They are
    folded on the executors; the driver gets at most ``max_values`` of each column. A column with more
    (a batch that touches most of the table) gets a range instead, which holds for all of them too.
    """
    keep = F.lit(True)
    for name in partition_by:
        found = [r[0] for r in batch.select(name).distinct().limit(max_values + 1).collect()]
        if len(found) > max_values:
            low, high = batch.agg(F.min(name), F.max(name)).first()
            inside, nulls = F.col(name).between(F.lit(low), F.lit(high)), True
        else:
            values = [v for v in found if v is not None]
            inside, nulls = F.col(name).isin(values), len(values) < len(found)
        keep = keep & (inside | F.col(name).isNull() if nulls else inside)
    return keep


def upsert_by_key(
    batch: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[Column | str],
    partition_by: Sequence[str] = (),
    staging: str | None = None,
) -> None:
    """Replace stored rows that share a key with the batch; newest by ``order`` wins.

    ``partition_by`` columns must follow from the key. Only partitions that have
    the batch's values of each column are read and rewritten. The merged rows are staged first, so
    the target is never read while it is overwritten; running a batch twice
    gives the same target.
    """
    spark = batch.sparkSession
    stored = read_if_exists(spark, path)
    rows = batch
    if stored is not None:
        if partition_by:
            stored = stored.where(in_partitions(batch, partition_by))
        rows = stored.unionByName(batch.select(stored.columns))
    merged = latest_per_key(rows, keys, order)
    stage = staging or f"{path.rstrip('/')}__staging"
    merged.write.mode("overwrite").parquet(stage)
    mode = "dynamic" if partition_by else "static"
    out = spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", mode)
    out.partitionBy(*partition_by).parquet(path)


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Append a micro-batch under its own partition; a retried batch overwrites only itself."""
    tagged = batch.withColumn("_batch", F.lit(batch_id))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)


def snapshot_batch(batch: DataFrame, path: str, key: str, cols: Sequence[str], at: Column, batch_id: int, order: Sequence[str]) -> None:
    """Append changed versions of a micro-batch to the log at ``path``; a retry compares with earlier batches only."""
    log = read_if_exists(batch.sparkSession, path)
    if log is not None:
        log = log.where(F.col("_batch") < batch_id)
    newest = latest_per_key(batch, [key], order)
    append_batch(snapshot_scd2(newest, log, key, cols, at), path, batch_id)


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str
) -> None:
    """Process everything available now in micro-batches through ``write``, then stop."""
    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
