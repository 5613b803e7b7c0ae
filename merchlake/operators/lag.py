"""Source positions: how far each topic goes and how far a consumer has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ends(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def topic_high_water(envelopes: DataFrame) -> DataFrame:
    """End offsets of every topic, summed over its partitions."""
    return _ends(envelopes).groupBy("topic").agg(F.sum("end_offset").alias("high_water"))


def consumer_positions(rows: DataFrame, consumer: str) -> DataFrame:
    """Next offset of a consumer per topic partition, from the rows it has written."""
    return _ends(rows).select(
        F.lit(consumer).alias("consumer"), "topic", "partition", F.col("end_offset").alias("position")
    )


def consumer_lag(envelopes: DataFrame, positions: DataFrame) -> DataFrame:
    """Records each consumer has still to read per topic.

    A partition the consumer has never touched counts from its first landed offset.
    """
    ends = envelopes.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("end_offset"), F.min("offset").alias("first_offset")
    )
    consumers = positions.select("consumer", "topic").distinct()
    behind = F.col("end_offset") - F.coalesce("position", "first_offset")
    return (
        ends.join(consumers, "topic")
        .join(positions, ["consumer", "topic", "partition"], "left")
        .groupBy("consumer", "topic")
        .agg(F.sum(behind).alias("lag"))
    )
