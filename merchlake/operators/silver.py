"""Conformed rows: one wide table for every kind of event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import SILVER_EXTRA, SILVER_SCHEMA, WATERMARK_LAG_MS
from merchlake.operators.dedupe import dedupe_events
from merchlake.operators.joins import join_latest_payment
from merchlake.operators.late import drop_late, max_event_ts

_RENAMED = {"kafka_partition": "partition", "kafka_offset": "offset"}


def flatten(events: DataFrame, extra: bool = False) -> DataFrame:
    """Silver columns of wide event rows; fields a kind does not have are NULL already."""
    fields = list(SILVER_SCHEMA) + (list(SILVER_EXTRA) if extra else [])
    columns = []
    for field in fields:
        source = _RENAMED.get(field.name, field.name)
        value = F.col(source) if source in events.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return events.select(*columns)


def dedupe_and_drop_late(accepted: DataFrame, lag_ms: int = WATERMARK_LAG_MS) -> DataFrame:
    """Keep-first per kind and event id, then drop late rows.

    The cutoff comes from all accepted rows, before deduplication, as one number for every kind.
    """
    unique = dedupe_events(accepted, keys=("kind", "event_id"))
    return drop_late(unique, max_event_ts(accepted), lag_ms)


def unique_events(accepted: DataFrame) -> DataFrame:
    """Keep-first per kind and event id, with no more columns than silver rows come from."""
    unique = dedupe_events(accepted, keys=("kind", "event_id"))
    names = [_RENAMED.get(field.name, field.name) for field in (*SILVER_SCHEMA, *SILVER_EXTRA)]
    return unique.select(*[name for name in unique.columns if name in names])


def split_late(unique: DataFrame, lag_ms: int, newest_ms: int | None) -> tuple[DataFrame, DataFrame]:
    """Unique rows on time, and those older than ``lag_ms`` before ``newest_ms``; None makes no row late."""
    late = F.lit(False) if newest_ms is None else F.coalesce(F.col("event_ts") < newest_ms - lag_ms, F.lit(True))
    return unique.filter(~late), unique.filter(late)


def silver_batch(accepted: DataFrame, lag_ms: int = WATERMARK_LAG_MS, extra: bool = False) -> DataFrame:
    """Silver rows of one batch: dedupe, late drop, latest payment on orders, all kinds together."""
    return conformed(dedupe_and_drop_late(accepted, lag_ms), extra)


def conformed(kept: DataFrame, extra: bool = False) -> DataFrame:
    """Latest payment on orders, all kinds together."""
    orders = kept.filter(F.col("kind") == "orders")
    payments = kept.filter(F.col("kind") == "payments")
    others = kept.filter(F.col("kind") != "orders")
    joined = join_latest_payment(orders, payments)
    return flatten(joined, extra).unionByName(flatten(others, extra))
