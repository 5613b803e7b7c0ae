"""From a Kafka record to a landed envelope row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.contracts import ENVELOPE_SCHEMA, TOPICS
from merchlake.functions.scalars import day_string


def kind_of_topic(topic: Column) -> Column:
    """Event kind of a topic, NULL for a topic that is not ours."""
    pairs = [F.lit(x) for kind, name in TOPICS.items() for x in (name, kind)]
    return F.try_element_at(F.create_map(*pairs), topic)


def envelope(records: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Rows of the landing table; ``ingest_ts`` defaults to the batch time."""
    stamp = F.current_timestamp() if ingest_ts is None else ingest_ts
    return records.select(
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_ts"),
        F.col("key").cast("string").alias("key"),
        "value",
        stamp.alias("ingest_ts"),
        day_string(stamp).alias("dt"),
    ).select(*ENVELOPE_SCHEMA.names)
