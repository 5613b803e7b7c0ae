"""Business rules: the first rule a row breaks becomes its ``reason``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import ORDER_STATUSES, PAYMENT_STATUSES, QUARANTINE_SCHEMA
from merchlake.functions.scalars import is_missing


def _any_missing(*columns: str) -> Column:
    test = is_missing(F.col(columns[0]))
    for name in columns[1:]:
        test = test | is_missing(F.col(name))
    return test


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def _null_or_below(column: str, bound: int) -> Column:
    return F.col(column).isNull() | (F.col(column) < bound)


def order_reason() -> Column:
    return (
        F.when(_any_missing("event_id", "order_id"), "missing_keys")
        .when(_null_or_below("amount_cents", 0), "invalid_amount")
        .when(_outside("status", ORDER_STATUSES), "invalid_status")
        .when(_null_or_below("quantity", 1), "invalid_quantity")
    )


def payment_reason() -> Column:
    return (
        F.when(_any_missing("event_id", "order_id"), "missing_keys")
        .when(_outside("status", PAYMENT_STATUSES), "invalid_status")
        .when(_null_or_below("amount_cents", 0), "invalid_amount")
    )


def inventory_reason() -> Column:
    return F.when(_any_missing("event_id", "sku", "warehouse_id"), "missing_keys").when(
        F.col("quantity").isNull(), "invalid_quantity"
    )


def click_reason() -> Column:
    return F.when(_any_missing("event_id", "session_id", "page"), "missing_keys")


RULES: dict[str, Callable[[], Column]] = {
    "orders": order_reason,
    "payments": payment_reason,
    "inventory": inventory_reason,
    "clickstream": click_reason,
}


def rule_reason(kind: Column) -> Column:
    """The rules of whichever kind a wide row has."""
    chosen = None
    for name, rule in RULES.items():
        chosen = F.when(kind == name, rule()) if chosen is None else chosen.when(kind == name, rule())
    return chosen


def with_reason(events: DataFrame) -> DataFrame:
    """Complete ``reason``: an earlier one (topic, header, body) wins over the rules."""
    rules = rule_reason(F.col("kind"))
    if "reason" in events.columns:
        return events.withColumn("reason", F.coalesce("reason", rules))
    return events.withColumn("reason", rules)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def quarantine_rows(checked: DataFrame) -> DataFrame:
    """Rejected rows with their original bytes and their place in the source."""
    return rejected(checked).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUARANTINE_SCHEMA]
    )
