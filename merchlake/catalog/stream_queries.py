"""Stream queries: the derived deliveries arrive in five waves, each drained by its own run.

Every wave starts the stream again from its checkpoint, so each query also passes through four
restarts. The result is read back from the tables the streams wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake import fixtures as fx
from merchlake.catalog.batch_queries import AS_OF_MS, checked_deliveries, stamp
from merchlake.contracts import EVENT_FIELDS
from merchlake.operators.dedupe import first_per_key
from merchlake.operators.validate import accepted
from merchlake.plans import serving
from merchlake.plans.gold import order_facts
from merchlake.session import ROCKSDB, run_folder, temporary_conf
from merchlake.sources import landing
from merchlake.streaming import jobs, stateful

# One wave is six days long, so a batch keeps what is at most a wave older than its newest event.
SILVER_LAG_MS = fx.WAVE_DAYS * fx.DAY_MS
# Late is told within each wave here; stream_late_rows takes the rule that jobs have by default.
CONFORM = {"writers": fx.SCHEMA_IDS, "lag_ms": SILVER_LAG_MS, "late_after": "batch"}


def _stream_conf(spark: SparkSession) -> dict[str, str]:
    """State is bound to the number of shuffle partitions, so a stream pins it to the cluster."""
    return {
        "spark.sql.shuffle.partitions": str(max(8, spark.sparkContext.defaultParallelism)),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # Counting the rows of a store costs a look-up per write; ``stateful.state_sizes`` counts them when asked.
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    }


def _run_waves(
    spark: SparkSession,
    arrivals: DataFrame,
    path: str,
    writers: list[Callable[[], object]],
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    extra: DataFrame | None = None,
    confs: list[dict[str, str]] | None = None,
) -> None:
    """Land the rows of each wave, then drain every stream; ``confs`` are settings of each writer."""
    with temporary_conf(spark, _stream_conf(spark)):
        waves = [prepare(arrivals.filter(F.col("wave") == k)).drop("wave") for k in range(fx.WAVES)]
        for rows in [*waves, *([extra] if extra is not None else [])]:
            rows.write.mode("append").parquet(path)
            for writer, conf in zip(writers, confs or [{}] * len(writers), strict=True):
                with temporary_conf(spark, conf):
                    jobs.run(writer(), once=True)


def _record_stream(spark: SparkSession, d: str, stages: tuple[str, ...]) -> str:
    """Run wire records through the named streams and return the root of their tables."""
    root = run_folder(spark, "-".join(("stream", *stages)))
    path = f"{root}/records"
    writers = {
        "bronze": lambda: jobs.bronze_writer(landing.record_files(spark, path), root, F.col("timestamp")),
        "silver": lambda: jobs.silver_writer(landing.bronze_stream(spark, f"{root}/bronze"), root, **CONFORM),
        "gold": lambda: jobs.gold_writer(
            landing.silver_stream(spark, f"{root}/silver"), root, stamp(AS_OF_MS)
        ),
    }
    _run_waves(
        spark, fx.all_deliveries(spark, d), path, [writers[s] for s in stages], prepare=fx.kafka_records
    )
    return root


def stream_late_rows(spark, d):
    """What is late against completed batches at the real lag, and what is kept."""
    root = run_folder(spark, "stream-late-rows")
    path = f"{root}/records"
    writers = [
        lambda: jobs.bronze_writer(landing.record_files(spark, path), root, F.col("timestamp")),
        lambda: jobs.silver_writer(
            landing.bronze_stream(spark, f"{root}/bronze"), root, writers=fx.SCHEMA_IDS, late_after="completed"
        ),
    ]
    _run_waves(spark, fx.all_deliveries(spark, d), path, writers, prepare=fx.kafka_records)
    columns = ["kind", "event_id", "event_ts", "batch_id"]
    kept = landing.silver_table(spark, f"{root}/silver").select(*columns, F.lit("kept").alias("outcome"))
    late = landing.late_table(spark, f"{root}/late").select(*columns, F.col("reason").alias("outcome"))
    return kept.unionByName(late)


def stream_gold_backlog(spark, d):
    """All conformed batches, the first delivered once more, drained by one gold batch."""
    root = _record_stream(spark, d, ("bronze", "silver"))
    again = fx.kafka_records(fx.all_deliveries(spark, d).filter(F.col("wave") == 0)).drop("wave")
    again.write.mode("append").parquet(f"{root}/records")
    silver = landing.silver_stream(spark, f"{root}/silver")
    with temporary_conf(spark, _stream_conf(spark)):
        jobs.run(jobs.bronze_writer(landing.record_files(spark, f"{root}/records"), root, F.col("timestamp")), True)
        bronze = landing.bronze_stream(spark, f"{root}/bronze")
        jobs.run(jobs.silver_writer(bronze, root, **CONFORM), True)
        jobs.run(jobs.gold_writer(silver, root, stamp(AS_OF_MS)), True)
    return _serving_rows(spark, f"{root}/gold")


def stream_gold_replayed(spark, d):
    """After a full run both streams lose their checkpoints and start over."""
    root = _record_stream(spark, d, ("bronze", "silver", "gold"))
    bronze = landing.bronze_stream(spark, f"{root}/bronze")
    silver = landing.silver_stream(spark, f"{root}/silver")
    with temporary_conf(spark, _stream_conf(spark)):
        jobs.run(jobs.silver_writer(bronze, root, checkpoint=f"{root}/checkpoints/silver-2", **CONFORM), True)
        jobs.run(jobs.gold_writer(silver, root, stamp(AS_OF_MS), checkpoint=f"{root}/checkpoints/gold-2"), True)
    return _serving_rows(spark, f"{root}/gold")


def stream_bronze(spark, d):
    root = _record_stream(spark, d, ("bronze",))
    rows = landing.bronze_table(spark, f"{root}/bronze")
    return rows.select("topic", "partition", "offset", "kafka_ts", "key", "ingest_ts", "dt")


def stream_silver(spark, d):
    root = _record_stream(spark, d, ("bronze", "silver"))
    return landing.silver_table(spark, f"{root}/silver").drop("stock_reason", "payment_event_id")


def stream_quarantine(spark, d):
    root = _record_stream(spark, d, ("bronze", "silver"))
    rows = landing.quarantine_table(spark, f"{root}/quarantine")
    return rows.select("topic", "reason", "key", "partition", "offset", "event_id", "dt", "batch_id")


def stream_gold(spark, d):
    """All serving tables after the last batch, in one long table."""
    root = _record_stream(spark, d, ("bronze", "silver", "gold"))
    return _serving_rows(spark, f"{root}/gold")


def _serving_rows(spark, gold):
    read = lambda table: serving.read_table(spark, gold, table)

    def rows(df, table, key, label, amount, number):
        return df.select(
            F.lit(table).alias("table_name"),
            key.cast("string").alias("row_key"),
            label.cast("string").alias("label"),
            amount.cast("bigint").alias("amount"),
            number.cast("bigint").alias("number"),
        )

    hour = F.unix_millis("hour_ts")
    parts = [
        rows(order_facts(spark, gold), "fact_orders", F.col("event_id"),
             F.concat_ws("|", "status", "payment_status", "currency", "coupon_code"), F.col("amount_cents"),
             F.col("kafka_offset")),
        rows(read("fact_payments"), "fact_payments", F.col("event_id"), F.concat_ws("|", "payment_id", "status"),
             F.col("amount_cents"), F.unix_millis("event_ts")),
        rows(read("gold_hourly_gmv"), "gold_hourly_gmv", hour, F.col("currency"), F.col("gmv_cents"),
             F.col("order_count")),
        rows(read("gold_payment_stats"), "gold_payment_stats", hour, F.lit(None), F.col("paid_count"),
             F.col("failed_count")),
        rows(read("gold_stockouts"), "gold_stockouts", F.col("event_id"), F.concat_ws("|", "sku", "warehouse_id"),
             F.col("quantity"), F.unix_millis("event_ts")),
        rows(read("pipeline_watermarks"), "pipeline_watermarks", F.col("job_name"), F.lit(None),
             F.col("last_batch_id"), F.col("rows_written")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- typed streams ----------------------------------------------------------------------------------

_META = ["topic", "partition", "offset"]


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(*_META, *EVENT_FIELDS.names, "wave")


def _on_time(rows: DataFrame) -> DataFrame:
    """Put every row in the wave of its own event time."""
    natural = F.floor((F.col("event_ts") - fx.EPOCH_2024_MS) / (fx.WAVE_DAYS * fx.DAY_MS)).cast("int")
    return rows.withColumn("wave", F.least(F.lit(fx.WAVES - 1), natural))


def _kind(spark, d, kind):
    return accepted(checked_deliveries(spark, d)).filter(F.col("kind") == kind)


def _typed_stream(spark, path):
    meta = [field for field in landing.RECORD_SCHEMA if field.name in _META]
    return spark.readStream.schema(T.StructType(meta + list(EVENT_FIELDS))).parquet(path)


def _dedupe_run(spark, d, label, arrivals, salts):
    root = run_folder(spark, label)
    path = f"{root}/events"

    def writer():
        kept = stateful.dedupe_stream(_typed_stream(spark, path), salts=salts)
        columns = ["event_id", "order_id", "status", "amount_cents", "event_ts"]
        return stateful.append_writer(kept.select(*columns), f"{root}/out", f"{root}/checkpoint")

    _run_waves(spark, _typed(arrivals), path, [writer])
    return spark.read.parquet(f"{root}/out")


def stream_dedupe(spark, d):
    orders = _on_time(fx.widen(fx.event_table(spark, d, "orders_in")))
    return _dedupe_run(spark, d, "stream-dedupe", orders, stateful.DEDUPE_SALTS)


def stream_drop_late(spark, d):
    orders = fx.widen(fx.event_table(spark, d, "orders_in"))
    return _dedupe_run(spark, d, "stream-late", orders, 1)


def stream_marks(spark, d):
    """Each event once, unless late by the common mark of four kinds; clicks come a wave after all others."""
    rows = accepted(checked_deliveries(spark, d))
    behind = F.least(F.lit(fx.WAVES - 1), F.col("wave") + (F.col("kind") == "clickstream").cast("int"))
    arrivals = _typed(rows.withColumn("wave", behind))
    path = f"{run_folder(spark, 'stream-marks')}/events"
    roots = {policy: run_folder(spark, f"stream-marks-{policy}") for policy in ("min", "max")}

    def writer(root):
        source = _typed_stream(spark, path)
        kinds = {kind: source.filter(F.col("topic") == topic) for kind, topic in fx.TOPICS.items()}
        events = stateful.dedupe_kinds_stream(kinds).select("kind", "event_id", "event_ts")
        return stateful.append_writer(events, f"{root}/out", f"{root}/checkpoint")

    # Rows are landed once for both policies, those of one topic together: a stream of one topic passes over the others.
    _run_waves(
        spark, arrivals, path, [partial(writer, root) for root in roots.values()],
        prepare=lambda rows: rows.sortWithinPartitions("topic"),
        confs=[{stateful.MARK_POLICY: policy} for policy in roots],
    )
    kept = [spark.read.parquet(f"{root}/out").withColumn("policy", F.lit(policy)) for policy, root in roots.items()]
    return kept[0].unionByName(kept[1])


def _window_run(spark, label, arrivals, aggregate, keys):
    root = run_folder(spark, label)
    path = f"{root}/events"

    def writer():
        updates = aggregate(_typed_stream(spark, path))
        return stateful.window_updates_writer(updates, f"{root}/updates", f"{root}/checkpoint")

    _run_waves(spark, _typed(arrivals), path, [writer])
    rows = spark.read.parquet(f"{root}/updates")
    return first_per_key(rows, keys, [F.col("batch_id").desc()]).drop("batch_id")


def stream_hourly_gmv(spark, d):
    orders = _kind(spark, d, "orders")
    return _window_run(spark, "stream-gmv", orders, stateful.windowed_gmv, ["hour_ts", "currency"])


def stream_payment_stats(spark, d):
    payments = _kind(spark, d, "payments")
    return _window_run(spark, "stream-stats", payments, stateful.windowed_payment_stats, ["hour_ts"])


def stream_orders_payments(spark, d):
    """Deduplicated orders with the newest payment at most 30 minutes away."""
    root = run_folder(spark, "stream-join")
    path = f"{root}/events"
    arrivals = _typed(_on_time(accepted(checked_deliveries(spark, d)).filter(F.col("kind").isin("orders", "payments"))))

    # One order and one payment two days after everything else let the last open rows out.
    newest = arrivals.agg(F.max("event_ts").alias("event_ts"))
    tick = newest.select((F.col("event_ts") + 2 * fx.DAY_MS).alias("event_ts"))
    tick = tick.select("event_ts", F.inline(F.array(*[
        F.struct(F.lit(topic).alias("topic"), F.lit(kind).alias("event_id"))
        for kind, topic in (("tick-o", fx.TOPICS["orders"]), ("tick-p", fx.TOPICS["payments"]))
    ])))
    tick = tick.withColumns(
        {"order_id": F.lit("tick"), "partition": F.lit(0), "offset": F.lit(0).cast("bigint"), "wave": F.lit(fx.WAVES)}
    )
    extra = _typed(fx.widen(tick)).drop("wave")

    def writer():
        source = _typed_stream(spark, path)
        orders = source.filter(F.col("topic") == fx.TOPICS["orders"])
        payments = source.filter(F.col("topic") == fx.TOPICS["payments"])
        latest = stateful.latest_payment_stream(orders, payments)
        return stateful.append_writer(latest, f"{root}/out", f"{root}/checkpoint")

    _run_waves(spark, arrivals, path, [writer], extra=extra)
    latest = spark.read.parquet(f"{root}/out").filter(F.col("order_id") != "tick")
    return latest.select("order_event_id", "order_id", "order_status", "payment_event_id", "payment_status")


QUERIES = {
    "stream_bronze": stream_bronze,
    "stream_silver": stream_silver,
    "stream_quarantine": stream_quarantine,
    "stream_gold": stream_gold,
    "stream_gold_backlog": stream_gold_backlog,
    "stream_gold_replayed": stream_gold_replayed,
    "stream_late_rows": stream_late_rows,
    "stream_dedupe": stream_dedupe,
    "stream_drop_late": stream_drop_late,
    "stream_marks": stream_marks,
    "stream_hourly_gmv": stream_hourly_gmv,
    "stream_payment_stats": stream_payment_stats,
    "stream_orders_payments": stream_orders_payments,
}
