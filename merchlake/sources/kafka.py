"""Kafka source and sink. Needs the Kafka connector of Spark on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader

from merchlake.contracts import TOPICS

RECORD_COLUMNS = ("topic", "partition", "offset", "timestamp", "key", "value")


def _options(reader: DataStreamReader, servers: str, topics, max_offsets: int, fail_on_loss: bool) -> DataStreamReader:
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", str(fail_on_loss).lower())
        .option("maxOffsetsPerTrigger", max_offsets)
    )


def kafka_stream(
    spark: SparkSession, servers: str, topics=None, max_offsets: int = 50_000_000, fail_on_loss: bool = True
) -> DataFrame:
    """All topics from their beginning, at most ``max_offsets`` records per batch.

    Offsets that the brokers no longer hold end the stream, unless ``fail_on_loss`` is false.
    """
    topics = list(TOPICS.values()) if topics is None else topics
    return _options(spark.readStream, servers, topics, max_offsets, fail_on_loss).load().select(*RECORD_COLUMNS)


def write_kafka(records: DataFrame, servers: str) -> None:
    """Write rows with ``topic``, ``key``, ``value`` and ``headers`` in a single job."""
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true")
        .save()
    )
