"""Late-event handling relative to the newest event of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import WATERMARK_LAG_MS


def max_event_ts(events: DataFrame) -> DataFrame:
    """One row with the newest event time."""
    return events.agg(F.max("event_ts").alias("max_event_ts"))


def drop_late(
    events: DataFrame, newest: DataFrame | None = None, lag_ms: int = WATERMARK_LAG_MS
) -> DataFrame:
    """Keep events no older than ``lag_ms`` before the newest one; the boundary is kept.

    ``newest`` is a one-row frame, by default the maximum over ``events`` itself. It is used as a
    scalar subquery, so no join is planned.
    """
    newest = max_event_ts(events) if newest is None else newest
    return events.filter(F.col("event_ts") >= newest.scalar() - F.lit(lag_ms))
