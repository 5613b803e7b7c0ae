"""Serving tables stored as a base snapshot plus one delta per batch.

A micro-batch writes only its own rows, under its own version, and a replay replaces what the first attempt
wrote. Each table has a log of complete bases and deltas, written after the data, so that readers need one
listing and neither a success file nor a call per version. Readers fold base and deltas; a compaction or rebuild job
writes the fold as the next base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.contracts import SERVING_SCHEMAS
from merchlake.operators.dedupe import first_per_key
from merchlake.operators.merge import fold
from merchlake.operators.skew import skew_left_join
from merchlake.plans.commit_log import CommitLog


def _log(spark: SparkSession, root: str, table: str, kind: str) -> CommitLog:
    return CommitLog(spark, f"{root}/{table}/_log/{kind}")


def _versions(spark: SparkSession, root: str, table: str, kind: str, above: int = -1) -> list[int]:
    """Numbers past ``above`` of the complete bases or deltas."""
    return [v.number for v in _log(spark, root, table, kind).versions() if v.number > above]


def write_delta(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{table}/deltas/batch_id={batch_id}")
    _log(rows.sparkSession, root, table, "deltas").commit(batch_id, "delta", batch_id)


def write_base(rows: DataFrame, root: str, table: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{table}/base/version={version}")
    _log(rows.sparkSession, root, table, "base").commit(version, "base", version)


def last_batch(spark: SparkSession, root: str, table: str) -> int:
    """Newest batch held by the table, -1 for an empty one."""
    base = max(_versions(spark, root, table, "base"), default=-1)
    return max(_versions(spark, root, table, "deltas", above=base), default=base)


def read_versions(spark: SparkSession, root: str, table: str, upto: int | None = None) -> DataFrame:
    """Rows of the newest base and of every later delta, with their ``version``."""
    schema = SERVING_SCHEMAS[table]
    limit = (lambda v: True) if upto is None else (lambda v: v <= upto)
    bases = [v for v in _versions(spark, root, table, "base") if limit(v)]
    base = max(bases, default=-1)
    parts = []
    if bases:
        frame = spark.read.schema(schema).parquet(f"{root}/{table}/base/version={base}")
        parts.append(frame.withColumn("version", F.lit(base).cast("bigint")))
    folder = f"{root}/{table}/deltas"
    deltas = [v for v in _versions(spark, root, table, "deltas", above=base) if limit(v)]
    if deltas:
        frame = (
            spark.read.schema(schema)
            .option("basePath", folder)
            .parquet(*[f"{folder}/batch_id={v}" for v in deltas])
        )
        parts.append(frame.withColumn("version", F.col("batch_id").cast("bigint")).drop("batch_id"))
    if not parts:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("version", F.lit(0).cast("bigint"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_table(
    spark: SparkSession, root: str, table: str, upto: int | None = None, keep_last: Sequence[str] = ()
) -> DataFrame:
    """Current rows of a serving table, or its rows as of batch ``upto``."""
    return fold(read_versions(spark, root, table, upto), table, keep_last=keep_last)


def compact(spark: SparkSession, root: str, table: str) -> int:
    """Write the folded table as the next base and return its version."""
    version = last_batch(spark, root, table)
    write_base(read_table(spark, root, table, version), root, table, version)
    return version


def resolve_payment_status(facts: DataFrame, payments: DataFrame) -> DataFrame:
    """Order facts with the newest payment over all batches.

    A batch can only join the payments it holds; this brings in those that came later.
    """
    newest = [F.col("event_ts").desc(), F.col("event_id").asc()]
    latest = first_per_key(payments, ["order_id"], newest).select(
        "order_id", F.col("status").alias("_status")
    )
    joined = skew_left_join(facts, latest, "order_id", spread=["event_id"])
    return joined.withColumn("payment_status", F.coalesce("_status", "payment_status")).drop("_status")
