"""Time windows for batch and streaming frames alike, and the streams that keep their results in tables.

A stream needs a watermark. ``append`` gives a window once, when the watermark has passed its end;
``update`` gives it again with every batch that changes it, so its rows replace earlier ones by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.sources import versioned
from orgpulse.streaming.incremental import append_batch, read_if_exists, run_available

# The epoch was a Thursday: shifts that make seven-day windows start on Monday or Sunday.
GRAINS = {
    "day": ("1 day", "0 days"),
    "monday_week": ("7 days", "4 days"),
    "sunday_week": ("7 days", "3 days"),
}


def _flat(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("_w", *keys)]
    return df.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, ts: str, grain: str, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    length, start = GRAINS[grain]
    grouped = df.groupBy(*keys, F.window(ts, length, None, start).alias("_w"))
    return _flat(grouped.agg(*[c.alias(n) for n, c in measures.items()]), keys)


def sliding(df: DataFrame, ts: str, length: str, slide: str, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Overlapping windows. Rows should be folded to the slide first: each is copied length/slide times."""
    grouped = df.groupBy(*keys, F.window(ts, length, slide).alias("_w"))
    return _flat(grouped.agg(*[c.alias(n) for n, c in measures.items()]), keys)


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Bursts of rows of a key with no pause of ``gap`` or more."""
    grouped = df.groupBy(*keys, F.session_window(ts, gap).alias("_w"))
    return _flat(grouped.agg(*[c.alias(n) for n, c in measures.items()]), keys)


def keep_sessions(stream: DataFrame, ts: str, gap: str, delay: str, keys: Sequence[str], measures: dict[str, Column], path: str, checkpoint: str) -> None:
    """Append the sessions that the stream has closed so far: those that ``gap`` and ``delay`` of later time have passed.

    An open session is state of its key, and a row that falls between two open ones joins them.
    """
    closed = sessions(stream.withWatermark(ts, delay), ts, gap, keys, measures)
    run_available(closed, lambda batch, i: append_batch(batch, path, i), checkpoint, "append")


def keep_sliding(stream: DataFrame, ts: str, length: str, slide: str, delay: str, keys: Sequence[str], measures: dict[str, Column], path: str, checkpoint: str) -> None:
    """Keep a versioned table of overlapping windows up to date; each batch replaces the windows that it changed."""
    counted = sliding(stream.withWatermark(ts, delay), ts, length, slide, keys, measures)

    def write(batch: DataFrame, batch_id: int) -> None:
        versioned.upsert(batch.withColumn("_batch", F.lit(batch_id)), path, [*keys, "window_start"], ["_batch"])

    run_available(counted, write, checkpoint, "update")


def keep_days(stream: DataFrame, ts: str, delay: str, keys: Sequence[str], measures: dict[str, Column], final: str, provisional: str, checkpoint: str) -> None:
    """Keep day totals in two tables: provisional ones from the first row on, and final ones once a day has settled.

    A day has settled when the watermark has passed its end, so that no row can change it any more.
    """
    days = tumbling(stream.withWatermark(ts, delay), ts, "day", keys, measures)

    def write(batch: DataFrame, batch_id: int) -> None:
        versioned.upsert(batch.withColumn("_batch", F.lit(batch_id)), provisional, [*keys, "window_start"], ["_batch"])

    run_available(days, lambda batch, i: append_batch(batch, final, i), f"{checkpoint}/final", "append")
    run_available(days, write, f"{checkpoint}/provisional", "update")


def settled_days(spark: SparkSession, final: str, provisional: str, keys: Sequence[str]) -> DataFrame:
    """Each day once: its final row (``settled`` is true) where there is one, else the provisional one."""
    settled = read_if_exists(spark, final)
    live = versioned.read(spark, provisional).drop("_batch")
    if settled is None:
        return live.withColumn("settled", F.lit(False))
    settled = settled.drop("_batch")
    same = [live[k].eqNullSafe(settled[k]) for k in [*keys, "window_start"]]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return settled.withColumn("settled", F.lit(True)).unionByName(live.join(settled, condition, "left_anti").withColumn("settled", F.lit(False)))
