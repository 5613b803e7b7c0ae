"""Hourly tables as a view of the facts: only days whose facts have changed are computed again.

Each table is plain Parquet with a partition per day, written by dynamic partition overwrite, so days without changed
facts are not touched. A run that fails between two days is taken up by the next, as its progress is noted last. Facts
that are thin over a long time take a coarser ``grain`` (``week``, ``month``), as every partition is a file of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.contracts import SERVING_SCHEMAS
from merchlake.operators import metrics
from merchlake.operators.merge import fold, stamped
from merchlake.plans import serving
from merchlake.plans.commit_log import CommitLog
from merchlake.session import path_exists

SOURCES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "gold_hourly_gmv": ("fact_orders", metrics.rebuild_gmv),
    "gold_payment_stats": ("fact_payments", metrics.rebuild_payment_stats),
}


def _path(root: str, table: str) -> str:
    return f"{root}/hours/{table}"


def _log(spark: SparkSession, root: str, table: str) -> CommitLog:
    return CommitLog(spark, f"{root}/hours/_log/{table}")


def _partition(at: str, grain: str) -> Column:
    return F.date_trunc(grain, at).cast("date")


def overwrite_days(rows: DataFrame, days: DataFrame, path: str, grain: str = "day") -> None:
    """Replace the partitions of ``days`` by ``rows``, all of these days. A day left without rows becomes empty."""
    # A row without an hour marks a day as written; otherwise a day that has lost its rows would keep the old ones.
    written = rows.withColumn("dt", _partition("hour_ts", grain)).unionByName(days.select("dt"), allowMissingColumns=True)
    gathered = written.hint("rebalance", "dt")
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def refresh_hours(
    spark: SparkSession, root: str, table: str, updated_at: Column | None = None, grain: str = "day"
) -> int:
    """Bring one hourly table up to the newest facts and return their version.

    Days are taken from facts that later versions have added or changed. Of the facts, only the span between the first
    and the last of these days is read, as a copy of an event carries its event time. After a compaction all facts
    count as changed once. The first refresh settles the ``grain`` of the table; later ones keep it.
    """
    stamp = F.current_timestamp() if updated_at is None else updated_at
    source, build = SOURCES[table]
    log = _log(spark, root, table)
    newest = log.newest()
    noted = log.content(newest)
    since, grain = noted.get("version", -1), noted.get("grain", "day" if noted else grain)
    version = serving.last_batch(spark, root, source)
    if version <= since:
        return since
    facts = serving.read_versions(spark, root, source, version)
    days = facts.filter(F.col("version") > since).select(_partition("event_ts", grain).alias("dt")).distinct()
    first, last = days.agg(F.min("dt"), F.max("dt")).first()
    if first is not None:
        after = F.lit(last).cast("timestamp") + F.expr(f"interval 1 {grain}")
        span = (F.col("event_ts") >= F.lit(first)) & (F.col("event_ts") < after)
        inside = facts.filter(span).withColumn("dt", _partition("event_ts", grain))
        changed = inside.join(days, "dt", "left_semi").drop("dt")
        rows = stamped(build(fold(changed, source)), table, stamp)
        overwrite_days(rows, days, _path(root, table), grain)
    log.commit(newest + 1, "hours", newest + 1, version=version, grain=grain)
    return version


def read_hours(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Hours of the table as of its last refresh."""
    schema, path = SERVING_SCHEMAS[table], _path(root, table)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, dt date")
    return stored.parquet(path).filter(F.col("hour_ts").isNotNull()).select(*schema.names)
