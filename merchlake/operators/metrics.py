"""Hourly metrics, stockouts and fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from merchlake.functions.scalars import (
    currency_or_default,
    guarded_ratio,
    hour_bucket_ms,
    millis_to_timestamp,
)


def not_cancelled() -> Column:
    """A NULL status counts as not cancelled."""
    return ~F.col("status").eqNullSafe("cancelled")


def hourly_gmv(orders: DataFrame) -> DataFrame:
    """Order value and order events per hour and currency, cancelled events left out."""
    return (
        orders.filter(not_cancelled())
        .groupBy(
            hour_bucket_ms(F.col("event_ts")).alias("hour_ts_ms"),
            currency_or_default(F.col("currency")).alias("currency"),
        )
        .agg(F.sum("amount_cents").alias("gmv_cents"), F.count("*").alias("order_count"))
    )


def _with_rate(counts: DataFrame) -> DataFrame:
    total = F.col("paid_count") + F.col("failed_count")
    return counts.withColumn("failure_rate", guarded_ratio(F.col("failed_count"), total))


def payment_stats(payments: DataFrame) -> DataFrame:
    """Paid and failed payment events per hour; everything that is not ``failed`` is paid."""
    failed = F.col("status").eqNullSafe("failed")
    counts = payments.groupBy(hour_bucket_ms(F.col("event_ts")).alias("hour_ts_ms")).agg(
        F.count_if(~failed).alias("paid_count"), F.count_if(failed).alias("failed_count")
    )
    return _with_rate(counts)


def stockouts(inventory: DataFrame) -> DataFrame:
    """Inventory events with nothing left; an absent quantity counts as zero."""
    return inventory.filter(F.coalesce("quantity", F.lit(0)) <= 0)


def fact_orders(joined: DataFrame, ingest_ts: Column) -> DataFrame:
    """Fact rows of order events that carry their latest payment."""
    return joined.select(
        "event_id",
        "order_id",
        "customer_id",
        "status",
        "payment_status",
        F.col("amount_cents").cast("bigint").alias("amount_cents"),
        currency_or_default(F.col("currency")).alias("currency"),
        "coupon_code",
        millis_to_timestamp(F.col("event_ts")).alias("event_ts"),
        ingest_ts.alias("ingest_ts"),
        "kafka_partition",
        "kafka_offset",
    )


def fact_payments(payments: DataFrame) -> DataFrame:
    return payments.select(
        "event_id",
        "payment_id",
        "order_id",
        "status",
        F.col("amount_cents").cast("bigint").alias("amount_cents"),
        currency_or_default(F.col("currency")).alias("currency"),
        millis_to_timestamp(F.col("event_ts")).alias("event_ts"),
    )


def gmv_rows(gmv: DataFrame) -> DataFrame:
    """Hourly metrics with the hour as a timestamp, as the serving table has it."""
    hour = millis_to_timestamp(F.col("hour_ts_ms")).alias("hour_ts")
    return gmv.select(hour, *[c for c in gmv.columns if c != "hour_ts_ms"])


def stockout_rows(inventory: DataFrame) -> DataFrame:
    return stockouts(inventory).select(
        "sku",
        "warehouse_id",
        F.coalesce("quantity", F.lit(0)).cast("int").alias("quantity"),
        "event_id",
        millis_to_timestamp(F.col("event_ts")).alias("event_ts"),
    )


def rebuild_gmv(facts: DataFrame) -> DataFrame:
    """Hourly order value recomputed from the order facts."""
    return (
        facts.filter(F.col("status") != "cancelled")
        .groupBy(F.date_trunc("hour", "event_ts").alias("hour_ts"), "currency")
        .agg(F.sum("amount_cents").alias("gmv_cents"), F.count("*").alias("order_count"))
    )


def rebuild_payment_stats(facts: DataFrame) -> DataFrame:
    """Hourly payment counts and failure rate recomputed from the payment facts."""
    return facts.groupBy(F.date_trunc("hour", "event_ts").alias("hour_ts")).agg(
        F.count_if(F.col("status") != "failed").alias("paid_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        guarded_ratio(F.count_if(F.col("status") == "failed"), F.count("*")).alias("failure_rate"),
    )


def gmv_last_24h(gmv: DataFrame, as_of: Column) -> DataFrame:
    """Hours of the last day before ``as_of``, newest first."""
    recent = F.col("hour_ts") >= as_of - F.expr("INTERVAL 24 HOURS")
    return (
        gmv.filter(recent)
        .select("hour_ts", "currency", "gmv_cents", "order_count")
        .orderBy(F.col("hour_ts").desc())
    )


def watermark_row(facts: DataFrame, job_name: str, batch_id: int) -> DataFrame:
    """Progress of one batch: newest fact time (NULL without facts) and facts written."""
    return facts.agg(
        F.max("event_ts").alias("last_event_ts"), F.count("*").alias("rows_written")
    ).select(
        F.lit(job_name).alias("job_name"),
        F.lit(batch_id).cast("bigint").alias("last_batch_id"),
        "last_event_ts",
        "rows_written",
    )


def intake_numbers() -> dict[str, Column]:
    """What a checked batch reports: rejected rows and the newest accepted event."""
    return {
        "quarantined": F.count_if(F.col("reason").isNotNull()),
        "max_event_ts": F.max(F.when(F.col("reason").isNull(), F.col("event_ts"))),
    }


def silver_numbers() -> dict[str, Column]:
    """What conformed rows report: all, order facts, hour buckets, stockouts.

    Buckets are a set of as many entries as a batch has hours and currencies, so the numbers can be observed while the
    rows are written.
    """
    order = F.col("kind") == "orders"
    bucket = F.when(
        order & not_cancelled(),
        F.struct(hour_bucket_ms(F.col("event_ts")), currency_or_default(F.col("currency"))),
    )
    empty = (F.col("kind") == "inventory") & (F.coalesce("quantity", F.lit(0)) <= 0)
    return {
        "valid": F.count(F.lit(1)),
        "orders": F.count_if(order),
        "gmv_buckets": F.size(F.collect_set(bucket)).cast("bigint"),
        "stockouts": F.count_if(empty),
    }


def _named(numbers: dict[str, Column]) -> list[Column]:
    return [number.alias(name) for name, number in numbers.items()]


def observed(rows: DataFrame, numbers: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has the numbers once they have been written."""
    watch = Observation()
    return rows.observe(watch, *_named(numbers)), watch


def batch_metrics(checked: DataFrame, silver: DataFrame) -> DataFrame:
    """Counts a batch reports: accepted, quarantined, newest event, facts, hour buckets, stockouts."""
    intake = checked.agg(F.struct(*_named(intake_numbers()))).scalar()
    return silver.agg(*_named(silver_numbers())).select(
        "valid",
        intake["quarantined"].alias("quarantined"),
        intake["max_event_ts"].alias("max_event_ts"),
        "orders",
        "gmv_buckets",
        "stockouts",
    )
