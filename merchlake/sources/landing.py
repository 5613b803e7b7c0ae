"""The landed (bronze) table, partitioned by topic and day, and the conformed (silver) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.contracts import ENVELOPE_SCHEMA, QUARANTINE_SCHEMA, SILVER_EXTRA, SILVER_SCHEMA
from merchlake.plans.commit_log import CommitLog

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
    ]
)
_BATCH = [T.StructField("dt", T.StringType()), T.StructField("batch_id", T.LongType())]
SILVER_TABLE_SCHEMA = T.StructType(list(SILVER_SCHEMA) + list(SILVER_EXTRA) + _BATCH)
QUARANTINE_TABLE_SCHEMA = T.StructType(list(QUARANTINE_SCHEMA) + _BATCH)
LATE_TABLE_SCHEMA = T.StructType([*SILVER_SCHEMA, *SILVER_EXTRA, T.StructField("reason", T.StringType()), *_BATCH])


def record_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of Kafka-shaped records from files, for replay without a broker."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def bronze_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ENVELOPE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def bronze_table(
    spark: SparkSession, path: str, topics: Sequence[str] | None = None, days: Sequence[str] | None = None
) -> DataFrame:
    """Landed rows; ``topics`` and ``days`` prune partitions."""
    rows = spark.read.schema(ENVELOPE_SCHEMA).parquet(path)
    if topics is not None:
        rows = rows.filter(F.col("topic").isin(*topics))
    if days is not None:
        rows = rows.filter(F.col("dt").isin(*days))
    return rows


def silver_log(spark: SparkSession, path: str) -> CommitLog:
    """The log of complete conformed batches, beside the table (or beside its quarantine)."""
    return CommitLog(spark, f"{path.rstrip('/').rsplit('/', 1)[0]}/silver_log")


def silver_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of complete conformed batches: ``version`` of each, not its rows.

    A batch appears once, when it is committed, however often its rows were written.
    """
    log = silver_log(spark, path).create()
    reader = spark.readStream.schema("version long, run string, batch_id long")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(log.folder)


def _complete(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Versions are numbered without gaps, so one number tells what is complete.
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("batch_id") <= silver_log(spark, path).newest())


def silver_table(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark, path, SILVER_TABLE_SCHEMA)


def silver_versions(spark: SparkSession, path: str, versions: Sequence[int]) -> DataFrame:
    """Rows of some conformed batches; no other is listed."""
    reader = spark.read.schema(SILVER_TABLE_SCHEMA).option("basePath", path)
    return reader.parquet(*[f"{path}/batch_id={v}" for v in versions])


def quarantine_table(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark, path, QUARANTINE_TABLE_SCHEMA)


def late_table(spark: SparkSession, path: str) -> DataFrame:
    """Accepted rows that came too late for their batch."""
    return _complete(spark, path, LATE_TABLE_SCHEMA)
