"""Order-to-payment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.operators.dedupe import first_per_key
from merchlake.operators.skew import skew_left_join


def latest_payments(payments: DataFrame, arrival=("partition", "offset")) -> DataFrame:
    """Newest payment of each order: by event time (NULL as 0), then last arrived."""
    newest = [F.coalesce("event_ts", F.lit(0)).desc()]
    newest += [F.col(c).desc() for c in arrival] + [F.col("event_id").asc()]
    return first_per_key(payments.filter(F.col("order_id").isNotNull()), ["order_id"], newest).select(
        "order_id",
        F.col("status").alias("payment_status"),
        F.col("event_id").alias("payment_event_id"),
    )


def join_latest_payment(
    orders: DataFrame,
    payments: DataFrame,
    arrival=("partition", "offset"),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add ``payment_status`` and ``payment_event_id`` to every order event.

    Payments are cut to one per order first; adaptive execution splits an order id with very many events. ``hot`` may
    list such ids where adaptive execution is off, see :func:`hot_keys`.
    """
    kept = orders.select(*[c for c in orders.columns if c not in ("payment_status", "payment_event_id")])
    latest = latest_payments(payments, arrival)
    if hot is not None:
        return skew_left_join(kept, latest, "order_id", spread=["event_id"], hot=hot)
    return kept.join(latest, "order_id", "left").select(*kept.columns, "payment_status", "payment_event_id")


def unpaid_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Non-cancelled order events whose order has no payment event at all."""
    paid = payments.select("order_id").distinct()
    return orders.filter(F.col("status") != "cancelled").join(paid, "order_id", "left_anti").select(*orders.columns)


def count_unpaid(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """One row counting :func:`unpaid_orders`, without moving the order rows themselves."""
    per_order = (
        orders.filter(F.col("status") != "cancelled").groupBy("order_id").agg(F.count("*").alias("_n"))
    )
    paid = payments.select("order_id").distinct()
    return per_order.join(paid, "order_id", "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("unpaid_non_cancelled")
    )
