"""The three streams: land, conform, serve.

Each function returns a configured writer; :func:`run` starts it. Checkpoints live below the same
root as the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from merchlake.contracts import WATERMARK_LAG_MS
from merchlake.functions.scalars import day_string
from merchlake.operators.dead_letters import dlq_records
from merchlake.operators.envelope import envelope
from merchlake.operators.metrics import intake_numbers, observed, silver_numbers
from merchlake.operators.silver import conformed, flatten, split_late, unique_events
from merchlake.operators.validate import accepted, quarantine_rows, with_reason
from merchlake.operators.wire_codec import decode_wire
from merchlake.plans.commit_log import CommitLog, run_id
from merchlake.plans.gold import write_gold_batch
from merchlake.session import holds_data, keep, together
from merchlake.sources.kafka import write_kafka
from merchlake.sources.landing import silver_log, silver_versions

BRONZE_INTERVAL = "10 seconds"
SILVER_INTERVAL = "10 seconds"
GOLD_INTERVAL = "15 seconds"
LATE = "late"


def run(writer: DataStreamWriter, once: bool, interval: str = BRONZE_INTERVAL) -> StreamingQuery:
    """Start a stream: drain what is there and stop, or keep going at an interval."""
    if once:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.trigger(processingTime=interval).start()


def bronze_writer(records: DataFrame, root: str, ingest_ts: Column | None = None) -> DataStreamWriter:
    """Append raw records to the landing table. Its progress reports the ``landed`` rows and the newest record."""
    landed = [F.count(F.lit(1)).alias("rows"), F.max("kafka_ts").alias("newest")]
    return (
        envelope(records, ingest_ts)
        .observe("landed", *landed)
        .writeStream.format("parquet")
        .option("path", f"{root}/bronze")
        .option("checkpointLocation", f"{root}/checkpoints/bronze")
        .partitionBy("topic", "dt")
        .outputMode("append")
        .queryName("bronze_events")
    )


def _write_batch(rows: DataFrame, path: str, version: int, by: str) -> None:
    """Write one batch as a folder of its own, in place of any earlier attempt.

    Rows are gathered by ``by`` first, so the number of files follows the size of the batch; adaptive execution cuts
    a large share into several.
    """
    rows = rows.withColumn("dt", day_string(F.col("ingest_ts"))).hint("rebalance", by)
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch_id={version}")


def conform_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    writers: dict[int, str] | None = None,
    lag_ms: int = WATERMARK_LAG_MS,
    dlq_servers: str | None = None,
    redo: bool = False,
    late_after: str = "completed",
    run: str | None = None,
) -> None:
    """Write silver rows, quarantine, late rows, dead letters and metrics of one batch of envelopes.

    The batch gets the next version of the silver log and is committed last, so readers see all of it or nothing. A
    batch that its run has committed is not written again (unless ``redo``, for repair: readers that have taken the
    version do not take it twice). ``late_after`` says what makes a row late: the newest event of its own ``batch``,
    or that of all ``completed`` batches, which does not depend on how large a batch is. Late rows are kept apart with
    that reason and counted.
    """
    spark = batch.sparkSession
    log, run = silver_log(spark, f"{root}/silver"), run or run_id(spark, silver_checkpoint(root))
    version, complete = log.place(run, batch_id)
    if complete and not redo:
        return
    checked = with_reason(decode_wire(batch, writers))
    # Only rejected rows are kept with their bytes.
    checked = keep(checked.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))))
    unique = None
    try:
        # One action fills the cache before several jobs share it.
        intake = checked.agg(*[n.alias(name) for name, n in intake_numbers().items()]).first()
        own = intake["max_event_ts"]
        before = log.content(version - 1).get("newest_event_ts")
        # Reduced once for silver rows, their payments and late rows.
        unique = keep(unique_events(accepted(checked)))
        kept, late = split_late(unique, lag_ms, own if late_after == "batch" else before)
        silver, seen = observed(conformed(kept, extra=True), silver_numbers())
        late, seen_late = observed(flatten(late, extra=True).withColumn("reason", F.lit(LATE)), {"late": F.count(F.lit(1))})
        rejects = quarantine_rows(checked)

        def dead_letters() -> None:
            if dlq_servers:
                write_kafka(dlq_records(rejects), dlq_servers)
            else:
                letters = dlq_records(rejects).write.mode("overwrite").partitionBy("topic")
                letters.parquet(f"{root}/dlq/batch_id={version}")

        together(
            spark,
            lambda: _write_batch(silver, f"{root}/silver", version, "kind"),
            lambda: _write_batch(rejects, f"{root}/quarantine", version, "topic"),
            lambda: _write_batch(late, f"{root}/late", version, "kind"),
            dead_letters,
        )
        # Observed while the rows were written, so nothing is read back. A plan found to be empty observes nothing.
        numbers = intake.asDict()
        for name, watch, names in (("silver", seen, silver_numbers()), ("late", seen_late, ["late"])):
            written = holds_data(spark, f"{root}/{name}/batch_id={version}")
            numbers |= watch.get if written else dict.fromkeys(names, 0)
        write_metrics(spark, f"{root}/metrics/batch_id={version}", numbers)
    finally:
        checked.unpersist()
        if unique is not None:
            unique.unpersist()
    newest = max((t for t in (own, before) if t is not None), default=None)
    log.commit(version, run, batch_id, newest_event_ts=newest)


def write_metrics(spark: SparkSession, path: str, numbers: dict[str, int | None]) -> None:
    """One row of numbers of a batch."""
    names = "valid quarantined max_event_ts orders gmv_buckets stockouts late".split()
    schema = ", ".join(f"{name} bigint" for name in names)
    rows = spark.createDataFrame([tuple(numbers[name] for name in names)], schema)
    rows.coalesce(1).write.mode("overwrite").parquet(path)


class BatchProgress(StreamingQueryListener):
    """Live numbers of running streams: per query the latest batch, its rows, and the source offsets it has reached.

    Spark commits no offsets to consumer groups, so the lag of a query is told from these. Add it to a session with
    ``spark.streams.addListener``.
    """

    def __init__(self):
        self.latest: dict[str, dict] = {}
        self.failed: dict[str, str] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        numbers = {name: row.asDict() for name, row in progress.observedMetrics.items()}
        self.latest[progress.name or str(progress.id)] = {
            "batch_id": progress.batchId,
            "input_rows": progress.numInputRows,
            "offsets": [(source.description, source.endOffset) for source in progress.sources],
            "state_rows": sum(op.numRowsTotal for op in progress.stateOperators),
            "observed": numbers,
        }

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[self._names.get(str(event.id), str(event.id))] = event.exception


def silver_checkpoint(root: str) -> str:
    return f"{root}/checkpoints/silver"


def silver_writer(bronze: DataFrame, root: str, checkpoint: str | None = None, **options) -> DataStreamWriter:
    """Conform landed rows batch by batch; ``options`` go to :func:`conform_batch`."""
    spark, checkpoint = bronze.sparkSession, checkpoint or silver_checkpoint(root)
    return (
        bronze.writeStream.foreachBatch(
            lambda df, n: conform_batch(df, n, root, run=run_id(spark, checkpoint), **options)
        )
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .queryName("silver_events")
    )


def _inside(number: int, ranges: list[list[int]]) -> bool:
    return any(first <= number <= last for first, last in ranges)


def _with(numbers: list[int], ranges: list[list[int]]) -> list[list[int]]:
    """Ranges that hold the numbers as well."""
    merged: list[list[int]] = []
    for first, last in sorted([*ranges, *([n, n] for n in numbers)]):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(last, merged[-1][1])
        else:
            merged.append([first, last])
    return merged


def gold_writer(
    silver: DataFrame, root: str, updated_at: Column | None = None, checkpoint: str | None = None
) -> DataStreamWriter:
    """Turn newly committed silver batches into serving-table deltas. Clicks feed no serving table.

    The gold log remembers which silver versions went into the tables, so neither a replay nor a new checkpoint
    counts one twice.
    """
    spark, serving = silver.sparkSession, f"{root}/gold"
    checkpoint = checkpoint or f"{root}/checkpoints/gold"

    def write(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(spark, f"{serving}/_log")
        run = run_id(spark, checkpoint)
        version, complete = log.place(run, batch_id)
        if complete:
            return
        taken = log.content(version - 1).get("silver", [])
        # As many rows as the batch has files of the log.
        fresh = [n for n in sorted(r["version"] for r in batch.select("version").collect()) if not _inside(n, taken)]
        if fresh:
            rows = silver_versions(spark, f"{root}/silver", fresh).filter(F.col("kind") != "clickstream")
            write_gold_batch(rows, serving, version, updated_at)
            log.commit(version, run, batch_id, silver=_with(fresh, taken))

    return (
        silver.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .queryName("gold_metrics")
    )
