"""Dead-letter routing of quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import DLQ_TOPICS


def dlq_topic(topic: Column) -> Column:
    pairs = [F.lit(x) for item in DLQ_TOPICS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), topic)


def dlq_records(quarantine: DataFrame) -> DataFrame:
    """One Kafka record per rejected row: original key and bytes, reason in the headers.

    The ``topic`` column lets a single write serve every dead-letter topic. Rows of a topic that
    is not ours have no dead-letter topic and stay in quarantine only.
    """
    reason = F.struct(F.lit("reason").alias("key"), F.col("reason").cast("binary").alias("value"))
    return (
        quarantine.withColumn("_to", dlq_topic(F.col("topic")))
        .filter(F.col("_to").isNotNull())
        .select("key", "value", F.col("_to").alias("topic"), F.array(reason).alias("headers"))
    )


def dead_letter_rows(quarantine: DataFrame) -> DataFrame:
    """Rows of the dead-letter table."""
    return quarantine.select(
        "topic",
        "partition",
        "offset",
        F.when(F.col("event_id") != "", F.col("event_id")).alias("event_id"),
        "reason",
        F.base64("value").alias("payload"),
        F.col("ingest_ts").alias("observed_at"),
    )
