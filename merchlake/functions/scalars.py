"""Column functions used by several operators. All stay in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.contracts import DEFAULT_CURRENCY, HOUR_MS


def hour_bucket_ms(ts: Column) -> Column:
    """Start of the hour of an epoch-millis value; floors below zero too."""
    return ts - F.pmod(ts, F.lit(HOUR_MS))


def millis_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def timestamp_to_millis(ts: Column) -> Column:
    """Epoch millis of a timestamp (or of a zone-less timestamp read as UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def day_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def age_seconds(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6)


def is_missing(value: Column) -> Column:
    """NULL and the empty string both count as missing."""
    return F.coalesce(value, F.lit("")) == ""


def currency_or_default(currency: Column) -> Column:
    return F.coalesce(F.nullif(currency, F.lit("")), F.lit(DEFAULT_CURRENCY))


def guarded_ratio(part: Column, total: Column) -> Column:
    """part / total as double, zero when the total is zero."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total.cast("double"))


def additive(left: Column, right: Column) -> Column:
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
