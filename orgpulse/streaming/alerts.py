"""Alert stream: each tick compares fresh metric rows with rules and appends what fired."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orgpulse.plans.query import alert_evaluation
from orgpulse.streaming.incremental import append_batch

TICK = "5 minutes"


def alert_batch(values: DataFrame, rules: Callable[[], DataFrame], as_of: str | None, path: str, batch_id: int) -> None:
    """Evaluate one micro-batch; a retried batch replaces its own alerts."""
    tick = as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    append_batch(alert_evaluation(values, rules(), tick), path, batch_id)


def alert_stream(
    values: DataFrame, rules: Callable[[], DataFrame], path: str, checkpoint: str, as_of: str | None = None, available_now: bool = False
) -> StreamingQuery:
    """Fired alerts of a stream of metric rows, every five minutes or once over what is available.

    ``rules`` is called at each tick, so changed rules hold from the next one on. Alerts carry the
    time of their tick (UTC), or ``as_of`` for a replay.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": TICK}
    return (
        values.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(lambda batch, batch_id: alert_batch(batch, rules, as_of, path, batch_id))
        .start()
    )
