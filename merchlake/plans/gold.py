"""Gold: facts, hourly metrics, stockouts and progress of a batch, and their repair."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.operators import metrics
from merchlake.operators.bloom import block_count, bloom_filter, maybe_in
from merchlake.operators.dedupe import dedupe_events
from merchlake.operators.merge import stamped
from merchlake.plans import serving
from merchlake.session import keep, together

JOB_NAME = "gold"
EVENT_KEY = ("kind", "event_id")
FACT_TABLES = {"orders": "fact_orders", "payments": "fact_payments"}
DAY_MS = 86_400_000
MAX_RANGES = 64


def day_ranges(days: Iterable[int], limit: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Closed ranges that hold all ``days``: at most ``limit``, parted at the widest gaps."""
    days = sorted(set(days))
    gaps = sorted((a - b, i) for i, (a, b) in enumerate(pairwise(days)) if b - a > 1)[: limit - 1]
    cuts = [0, *sorted(i + 1 for _, i in gaps), len(days)]
    return [(days[first], days[end - 1]) for first, end in pairwise(cuts) if first < end]


def stored_ids(spark: SparkSession, root: str, upto: int, ranges: list[tuple[int, int]]) -> DataFrame:
    """Kind and id of the facts stored up to a batch whose event time lies in one of the ranges of days."""
    parts = []
    for kind, table in FACT_TABLES.items():
        inside = F.lit(False)
        for first, last in ranges:
            start, end = (F.timestamp_millis(F.lit(day * DAY_MS)) for day in (first, last + 1))
            inside = inside | ((F.col("event_ts") >= start) & (F.col("event_ts") < end))
        stored = serving.read_versions(spark, root, table, upto).filter(inside)
        parts.append(stored.select(F.lit(kind).alias("kind"), "event_id"))
    return reduce(DataFrame.unionByName, parts)


def new_rows(unique: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Rows of a batch, one per event (and persisted), whose orders and payments no earlier gold batch has counted.

    A copy of an event carries its event time, so of the stored facts only the days are read that the batch has events
    of; one very old event adds its own day. Of these facts, those pass that a Bloom filter of the batch's ids finds, so
    stored facts are scanned and not shuffled, and the exact join sees copies and one other id in a hundred.
    """
    if serving.last_batch(unique.sparkSession, root, "fact_orders") < 0:
        return unique
    facts = unique.filter(F.col("kind").isin(*FACT_TABLES))
    # One row per day of the batch.
    per_day = facts.groupBy(F.floor(F.col("event_ts") / F.lit(DAY_MS)).alias("day")).count().collect()
    if not per_day:
        return unique
    stored = stored_ids(unique.sparkSession, root, batch_id - 1, day_ranges(row["day"] for row in per_day))
    blocks = block_count(sum(row["count"] for row in per_day))
    copies = maybe_in(stored, bloom_filter(facts, EVENT_KEY, blocks), EVENT_KEY, blocks).distinct()
    return unique.join(copies, list(EVENT_KEY), "left_anti").select(*unique.columns)


def gold_deltas(silver: DataFrame, batch_id: int, updated_at: Column) -> dict[str, DataFrame]:
    """Rows each serving table gains from one batch of silver rows, events counted before left out."""
    orders = silver.filter(F.col("kind") == "orders")
    payments = silver.filter(F.col("kind") == "payments")
    inventory = silver.filter(F.col("kind") == "inventory")
    facts = metrics.fact_orders(orders, F.col("ingest_ts"))
    rows = {
        # In order of time, so that readers of some days pass over most of a file.
        "fact_orders": facts.sortWithinPartitions("event_ts"),
        "fact_payments": metrics.fact_payments(payments).sortWithinPartitions("event_ts"),
        "gold_hourly_gmv": metrics.gmv_rows(metrics.hourly_gmv(orders)),
        "gold_payment_stats": metrics.gmv_rows(metrics.payment_stats(payments)),
        "gold_stockouts": metrics.stockout_rows(inventory),
        "pipeline_watermarks": metrics.watermark_row(facts, JOB_NAME, batch_id),
    }
    return {table: stamped(frame, table, updated_at) for table, frame in rows.items()}


def write_gold_batch(silver: DataFrame, root: str, batch_id: int, updated_at: Column | None = None) -> None:
    """Write every delta of a batch. The progress row goes last and marks the batch as complete."""
    stamp = F.current_timestamp() if updated_at is None else updated_at
    # Copies inside the batch are cut to the first that arrived.
    unique = dedupe_events(silver, keys=EVENT_KEY, arrival=("topic", "kafka_partition", "kafka_offset"))
    unique = keep(unique)
    fresh = keep(new_rows(unique, root, batch_id))
    try:
        # Filled before the writes share it.
        fresh.count()
        deltas = gold_deltas(fresh, batch_id, stamp)
        progress = deltas.pop("pipeline_watermarks")
        together(
            silver.sparkSession,
            *[partial(serving.write_delta, rows, root, table, batch_id) for table, rows in deltas.items()],
        )
        serving.write_delta(progress, root, "pipeline_watermarks", batch_id)
    finally:
        fresh.unpersist()
        unique.unpersist()


def order_facts(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Order facts with payments of later batches resolved."""
    return serving.resolve_payment_status(
        serving.read_table(spark, root, "fact_orders", upto),
        serving.read_table(spark, root, "fact_payments", upto),
    )


def rebuild_gold(spark: SparkSession, root: str, updated_at: Column | None = None) -> int:
    """Recompute the hourly tables from the facts and make them the new base.

    Facts are keyed by event id, so whatever the stream counted twice is corrected here. Deltas of
    batches that arrive afterwards are added on top.
    """
    stamp = F.current_timestamp() if updated_at is None else updated_at
    version = serving.last_batch(spark, root, "pipeline_watermarks")
    rebuilt = {
        "gold_hourly_gmv": metrics.rebuild_gmv(serving.read_table(spark, root, "fact_orders", version)),
        "gold_payment_stats": metrics.rebuild_payment_stats(
            serving.read_table(spark, root, "fact_payments", version)
        ),
    }
    for table, rows in rebuilt.items():
        serving.write_base(stamped(rows, table, stamp), root, table, version)
    return version


def gmv_last_24h(spark: SparkSession, root: str, as_of: Column | None = None) -> DataFrame:
    stamp = F.current_timestamp() if as_of is None else as_of
    return metrics.gmv_last_24h(serving.read_table(spark, root, "gold_hourly_gmv"), stamp)
