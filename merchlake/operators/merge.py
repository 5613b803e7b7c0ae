"""Keyed merges as associative folds.

A merge rule says for every column of a serving table whether the first value of a key is kept,
the last one wins, or values add up. Folding all versions of a key gives the same table as
applying the versions one by one, so a table can be stored as a base plus small deltas.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import SERVING_KEYS, SERVING_SCHEMAS
from merchlake.functions.scalars import guarded_ratio


@dataclass(frozen=True)
class MergeRule:
    keys: tuple[str, ...]
    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    added: tuple[str, ...] = ()
    # Keys are unique within a version, so combining before the shuffle cannot shrink anything.
    unique_per_version: bool = False


RULES = {
    "fact_orders": MergeRule(
        SERVING_KEYS["fact_orders"],
        first=(
            "order_id", "customer_id", "currency", "event_ts", "ingest_ts",
            "kafka_partition", "kafka_offset",
        ),
        last=("status", "payment_status", "amount_cents", "coupon_code", "updated_at"),
        unique_per_version=True,
    ),
    "fact_payments": MergeRule(
        SERVING_KEYS["fact_payments"],
        first=("payment_id", "order_id", "amount_cents", "currency", "event_ts"),
        last=("status", "updated_at"),
        unique_per_version=True,
    ),
    "gold_hourly_gmv": MergeRule(
        SERVING_KEYS["gold_hourly_gmv"], last=("updated_at",), added=("gmv_cents", "order_count")
    ),
    "gold_payment_stats": MergeRule(
        SERVING_KEYS["gold_payment_stats"], last=("updated_at",), added=("paid_count", "failed_count")
    ),
    "gold_stockouts": MergeRule(
        SERVING_KEYS["gold_stockouts"], first=("quantity", "event_ts"), unique_per_version=True
    ),
    "pipeline_watermarks": MergeRule(
        SERVING_KEYS["pipeline_watermarks"],
        last=("last_batch_id", "last_event_ts", "updated_at"),
        added=("rows_written",),
    ),
}


def fold(rows: DataFrame, table: str, version: str = "version", keep_last: Sequence[str] = ()) -> DataFrame:
    """Current state of ``table`` from all versions of its rows.

    Columns in ``keep_last`` ignore NULLs when the last value is picked.
    """
    rule = RULES[table]
    order = F.col(version)
    aggregates: list[Column] = []
    if rule.first:
        aggregates.append(F.min_by(F.struct(*rule.first), order).alias("_first"))
    last = [c for c in rule.last if c not in keep_last]
    if last:
        aggregates.append(F.max_by(F.struct(*last), order).alias("_last"))
    for column in keep_last:
        aggregates.append(F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column))
    for column in rule.added:
        aggregates.append(F.coalesce(F.sum(column), F.lit(0)).alias(column))
    source = rows.repartition(*rule.keys) if rule.unique_per_version else rows
    state = source.groupBy(*rule.keys).agg(*aggregates)

    columns = []
    for field in SERVING_SCHEMAS[table]:
        name = field.name
        if name in rule.first:
            value = F.col("_first")[name]
        elif name in last:
            value = F.col("_last")[name]
        elif name == "failure_rate":
            value = guarded_ratio(F.col("failed_count"), F.col("paid_count") + F.col("failed_count"))
        else:
            value = F.col(name)
        columns.append(value.cast(field.dataType).alias(name))
    return state.select(*columns)


def stamped(rows: DataFrame, table: str, updated_at: Column) -> DataFrame:
    """Give new rows their ``updated_at`` and put the columns in table order."""
    if "updated_at" in SERVING_SCHEMAS[table].names:
        rows = rows.withColumn("updated_at", updated_at)
    return rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SERVING_SCHEMAS[table]]
    )


def merge(
    current: DataFrame, batch: DataFrame, table: str, keep_last: Sequence[str] = ()
) -> DataFrame:
    """``current`` after one batch has been merged into it; both have the table's schema."""
    both = current.withColumn("version", F.lit(0)).unionByName(batch.withColumn("version", F.lit(1)))
    return fold(both, table, keep_last=keep_last)
