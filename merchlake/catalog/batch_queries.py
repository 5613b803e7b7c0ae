"""Batch queries: every operator over the whole derived event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake import fixtures as fx
from merchlake.contracts import EVENT_FIELDS, TOPICS, contract
from merchlake.functions import wire
from merchlake.functions.scalars import currency_or_default
from merchlake.operators import lag, metrics, quality
from merchlake.operators.dead_letters import dead_letter_rows, dlq_records
from merchlake.operators.dedupe import dedupe_events
from merchlake.operators.envelope import envelope, kind_of_topic
from merchlake.operators.joins import join_latest_payment, unpaid_orders
from merchlake.operators.late import drop_late
from merchlake.operators.merge import merge, stamped
from merchlake.operators.silver import flatten, silver_batch
from merchlake.operators.validate import accepted, quarantine_rows, with_reason
from merchlake.operators.wire_codec import (
    DECODE_ERROR,
    UNKNOWN_TOPIC,
    conform_to_reader,
    decode_wire,
    encode_events,
)
from merchlake.plans import hours, serving
from merchlake.session import run_folder
from merchlake.sources.landing import bronze_table

DAY_MS = fx.DAY_MS
UNION_LAG_MS = 10 * DAY_MS
DROP_LAG_MS = 7 * DAY_MS
AS_OF_MS = fx.EPOCH_2024_MS + 30 * DAY_MS
MERGED_AT_MS = AS_OF_MS - 600_000
# Re-sent orders overlap the stored ones between these two instants; payments split at one.
ORDERS_STORED_BEFORE_MS = 915_148_800_000  # 1999-01-01
ORDERS_RESENT_SINCE_MS = 820_454_400_000  # 1996-01-01
PAYMENTS_SPLIT_MS = 896_659_200_000  # 1998-06-01
STOCK_STORED_BEFORE_MS = fx.EPOCH_2024_MS + 20 * DAY_MS
STOCK_RESENT_SINCE_MS = fx.EPOCH_2024_MS + 10 * DAY_MS


def portable(df: DataFrame) -> DataFrame:
    """Timestamps as epoch millis and bytes as hex, so that any engine prints the same values."""
    columns = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            value = F.unix_millis(value)
        elif isinstance(field.dataType, T.BinaryType):
            value = F.hex(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def stamp(ms: int):
    return F.timestamp_millis(F.lit(ms))


# --- shared inputs --------------------------------------------------------------------------------


def checked_kind(spark: SparkSession, d: str, table: str) -> DataFrame:
    return with_reason(fx.widen(fx.event_table(spark, d, table)))


def good(spark: SparkSession, d: str, table: str) -> DataFrame:
    return accepted(checked_kind(spark, d, table))


def good_unique(spark: SparkSession, d: str, table: str) -> DataFrame:
    return dedupe_events(good(spark, d, table))


def checked_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with the reason the wire path would find for them."""
    early = F.when(kind_of_topic(F.col("topic")).isNull(), UNKNOWN_TOPIC).when(
        F.col("poison") == 1, DECODE_ERROR
    )
    rows = fx.all_deliveries(spark, d).withColumn("reason", early)
    return with_reason(rows.withColumn("ingest_ts", fx.wave_stamp(F.col("wave"))))


def delivered_records(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as Kafka-shaped rows with a readable payload."""
    rows = fx._with_transport(fx.all_deliveries(spark, d))
    return rows.select(
        "topic", "partition", "offset", fx.wave_stamp(F.col("wave")).alias("timestamp"), "key", "value", "wave"
    )


def _latest_joined(spark: SparkSession, d: str) -> DataFrame:
    orders = good(spark, d, "orders_ev")
    payments = good_unique(spark, d, "payments_ev")
    return join_latest_payment(dedupe_events(orders), payments, ["offset"])


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    named = _latest_joined(spark, d).withColumnsRenamed({"partition": "kafka_partition", "offset": "kafka_offset"})
    return metrics.fact_orders(named, stamp(AS_OF_MS))


def payment_facts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fact_payments(good_unique(spark, d, "payments_ev"))


# --- landing --------------------------------------------------------------------------------------


def bronze_envelope(spark, d):
    records = delivered_records(spark, d)
    return envelope(records, F.col("timestamp"))


def bronze_scan(spark, d):
    path = run_folder(spark, "bronze-scan") + "/bronze"
    landed = envelope(delivered_records(spark, d), F.col("timestamp"))
    landed.write.partitionBy("topic", "dt").parquet(path)
    rows = bronze_table(spark, path, topics=[TOPICS["orders"], TOPICS["payments"]])
    return rows.groupBy("topic", "dt").agg(
        F.count("*").alias("n_rows"),
        F.max("offset").alias("max_offset"),
        F.sum(F.octet_length("value")).alias("n_bytes"),
    )


def topic_kind(spark, d):
    rows = fx.all_deliveries(spark, d)
    return rows.select("topic", "event_id", "offset", kind_of_topic(F.col("topic")).alias("found_kind"))


def wire_header(spark, d):
    rows = fx.source_table(spark, d, "events").selectExpr("event_id", f"{fx.WIRE_EXPR} AS value")
    return rows.select(
        "event_id",
        wire.header_reason(F.col("value")).alias("reason"),
        wire.schema_id(F.col("value")).alias("schema_id"),
    )


def wire_decode(spark, d):
    decoded = decode_wire(fx.kafka_records(fx.all_deliveries(spark, d)), fx.SCHEMA_IDS)
    return decoded.select("topic", "partition", "offset", "kind", "schema_id", *EVENT_FIELDS.names, "reason")


def wire_roundtrip(spark, d):
    rows = accepted(with_reason(fx.all_events(spark, d)))
    rows = rows.withColumn(
        "currency",
        F.when(F.col("kind").isin("orders", "payments"), currency_or_default(F.col("currency"))),
    )
    newest = F.when(F.col("kind") == "orders", F.lit("orders_v11")).otherwise(F.col("kind"))
    ids = F.create_map(*[F.lit(x) for number, name in fx.SCHEMA_IDS.items() for x in (name, number)])
    sent = encode_events(rows.withColumn("sku", F.when(F.col("kind") != "payments", F.col("sku"))), newest, ids[newest])
    back = decode_wire(sent.select("topic", "partition", "offset", "value"), fx.SCHEMA_IDS)
    return back.select("topic", "partition", "offset", *EVENT_FIELDS.names, "reason")


def evolve_orders(spark, d):
    first_version = fx.event_table(spark, d, "orders_ev").select(*contract("orders").names)
    return conform_to_reader(first_version, contract("orders_v11"))


# --- rules, quarantine, dead letters ---------------------------------------------------------------


def _validate(table: str, *columns: str):
    def query(spark, d):
        return checked_kind(spark, d, table).select("event_id", "offset", *columns, "reason")

    return query


def accepted_events(spark, d):
    rows = accepted(with_reason(fx.all_events(spark, d)))
    return rows.select("kind", "topic", "partition", "offset", "event_id", "status", "amount_cents", "event_ts")


def quarantine(spark, d):
    return quarantine_rows(with_reason(fx.all_events(spark, d)))


def dlq_route(spark, d):
    records = dlq_records(quarantine_rows(checked_for_dlq(spark, d)))
    return records.select("topic", "key", "value", F.col("headers")[0]["value"].cast("string").alias("reason"))


def checked_for_dlq(spark: SparkSession, d: str) -> DataFrame:
    rows = checked_deliveries(spark, d)
    transport = fx._with_transport(rows.drop("ingest_ts"))
    return transport.withColumn("ingest_ts", fx.wave_stamp(F.col("wave")))


def dead_letters(spark, d):
    return dead_letter_rows(quarantine_rows(checked_for_dlq(spark, d)))


# --- conforming -------------------------------------------------------------------------------------


def silver_flatten(spark, d):
    return flatten(accepted(with_reason(fx.all_events(spark, d))))


def silver_union(spark, d):
    return silver_batch(accepted(checked_deliveries(spark, d)), UNION_LAG_MS)


def dedupe(spark, d):
    return good_unique(spark, d, "payments_ev").select("event_id", "order_id", "offset", "status", "amount_cents")


def late(spark, d):
    rows = drop_late(fx.all_deliveries(spark, d), lag_ms=DROP_LAG_MS)
    return rows.select("kind", "event_id", "offset", "event_ts")


def orders_latest_payment(spark, d):
    rows = _latest_joined(spark, d)
    return rows.select("event_id", "order_id", "status", "payment_status", "payment_event_id")


def unpaid(spark, d):
    rows = unpaid_orders(good(spark, d, "orders_ev"), good(spark, d, "payments_ev"))
    return rows.select("event_id", "order_id", "status", "amount_cents")


# --- serving ----------------------------------------------------------------------------------------


def hourly_gmv(spark, d):
    return metrics.hourly_gmv(good_unique(spark, d, "orders_ev"))


def payment_stats(spark, d):
    return metrics.payment_stats(good_unique(spark, d, "payments_ev"))


def stockouts(spark, d):
    return metrics.stockout_rows(good(spark, d, "inventory_ev"))


def gmv_last_24h(spark, d):
    orders = accepted(checked_deliveries(spark, d)).filter(F.col("kind") == "orders")
    gmv = metrics.gmv_rows(metrics.hourly_gmv(dedupe_events(orders)))
    return metrics.gmv_last_24h(gmv, stamp(AS_OF_MS))


def rebuild_gmv(spark, d):
    return metrics.rebuild_gmv(order_facts(spark, d))


def rebuild_payment_stats(spark, d):
    return metrics.rebuild_payment_stats(payment_facts(spark, d))


def _order_batches(spark, d):
    """Stored order facts, and facts sent again with other values."""
    facts = order_facts(spark, d)
    stored = facts.filter(F.col("event_ts") < stamp(ORDERS_STORED_BEFORE_MS))
    resent = facts.filter(F.col("event_ts") >= stamp(ORDERS_RESENT_SINCE_MS)).withColumns(
        {
            "status": F.when(F.col("status") == "created", "paid").otherwise(F.col("status")),
            "payment_status": F.lit(None).cast("string"),
            "amount_cents": F.col("amount_cents") + 100,
            "coupon_code": F.lit("LATE"),
            "currency": F.lit("CHF"),
            "kafka_offset": F.col("kafka_offset") + 1,
        }
    )
    return stamped(stored, "fact_orders", stamp(MERGED_AT_MS)), stamped(resent, "fact_orders", stamp(AS_OF_MS))


def upsert_fact_orders(spark, d):
    return merge(*_order_batches(spark, d), "fact_orders")


def refresh_gmv(spark, d):
    """Hourly order value kept as a view: stored facts first, then only the months of facts sent again."""
    root = run_folder(spark, "refresh-gmv")
    for version, (facts, at_ms) in enumerate(zip(_order_batches(spark, d), (MERGED_AT_MS, AS_OF_MS))):
        serving.write_delta(facts, root, "fact_orders", version)
        hours.refresh_hours(spark, root, "gold_hourly_gmv", stamp(at_ms), grain="month")
    return hours.read_hours(spark, root, "gold_hourly_gmv")


def upsert_fact_payments(spark, d):
    rows = good(spark, d, "payments_ev")
    split = F.col("event_ts") < PAYMENTS_SPLIT_MS
    return merge(
        stamped(metrics.fact_payments(dedupe_events(rows.filter(split))), "fact_payments", stamp(MERGED_AT_MS)),
        stamped(metrics.fact_payments(dedupe_events(rows.filter(~split))), "fact_payments", stamp(AS_OF_MS)),
        "fact_payments",
    )


def _two_batches(spark, d, table, source, build):
    """The rows of one source partition as the stored state, those of the others as the batch."""
    rows = good(spark, d, source)
    stored = build(dedupe_events(rows.filter(F.col("partition") == 0)))
    batch = build(dedupe_events(rows.filter(F.col("partition") != 0)))
    return merge(
        stamped(stored, table, stamp(MERGED_AT_MS)), stamped(batch, table, stamp(AS_OF_MS)), table
    )


def merge_hourly_gmv(spark, d):
    build = lambda rows: metrics.gmv_rows(metrics.hourly_gmv(rows))
    return _two_batches(spark, d, "gold_hourly_gmv", "orders_ev", build)


def merge_payment_stats(spark, d):
    build = lambda rows: metrics.gmv_rows(metrics.payment_stats(rows))
    return _two_batches(spark, d, "gold_payment_stats", "payments_ev", build)


def insert_new_stockouts(spark, d):
    rows = metrics.stockout_rows(good(spark, d, "inventory_ev"))
    stored = rows.filter(F.col("event_ts") < stamp(STOCK_STORED_BEFORE_MS))
    resent = rows.filter(F.col("event_ts") >= stamp(STOCK_RESENT_SINCE_MS)).withColumn("quantity", F.lit(-99))
    table = "gold_stockouts"
    return merge(stamped(stored, table, stamp(AS_OF_MS)), stamped(resent, table, stamp(AS_OF_MS)), table)


def _progress(facts: DataFrame, batch_id: int, at_ms: int) -> DataFrame:
    return stamped(metrics.watermark_row(facts, "gold", batch_id), "pipeline_watermarks", stamp(at_ms))


def job_watermark(spark, d):
    facts = order_facts(spark, d)
    split = F.col("event_ts") < stamp(ORDERS_STORED_BEFORE_MS)
    return merge(
        _progress(facts.filter(split), 0, MERGED_AT_MS),
        _progress(facts.filter(~split), 1, AS_OF_MS),
        "pipeline_watermarks",
    )


# --- reports ----------------------------------------------------------------------------------------


def key_uniqueness(spark, d):
    return quality.key_uniqueness(metrics.fact_payments(good(spark, d, "payments_ev")))


def quality_report(spark, d):
    orders, payments = good_unique(spark, d, "orders_ev"), good_unique(spark, d, "payments_ev")
    facts = order_facts(spark, d)
    return quality.quality_report(
        facts,
        metrics.gmv_rows(metrics.hourly_gmv(orders)),
        metrics.gmv_rows(metrics.payment_stats(payments)),
        _progress(facts, 0, MERGED_AT_MS),
        stamp(AS_OF_MS),
    )


def _failing_report(spark, d):
    """Judged on payments that were not deduplicated, so some expectations fail."""
    rows = good(spark, d, "payments_ev")
    facts = metrics.fact_payments(rows)
    progress = stamped(
        metrics.watermark_row(facts, "gold", 0), "pipeline_watermarks", stamp(AS_OF_MS - 3_600_000)
    )
    return quality.quality_report(
        facts,
        metrics.gmv_rows(metrics.hourly_gmv(rows)),
        metrics.gmv_rows(metrics.payment_stats(rows)),
        progress,
        stamp(AS_OF_MS),
    )


def quality_summary(spark, d):
    summary = quality.quality_summary(_failing_report(spark, d))
    return summary.select("passed", F.array_join("failed", ",").alias("failed"))


def quality_results(spark, d):
    """The results that the summary carries."""
    return quality.quality_summary(_failing_report(spark, d)).select(F.inline("results"))


def quality_gates(spark, d):
    """What each gate does: let pass, skip or raise."""

    def outcome(gate, report):
        try:
            return "skipped" if gate(report) is False else "passed"
        except quality.QualityFailure:
            return "raised"

    rows = [
        ("quality", outcome(quality.quality_gate, _failing_report(spark, d))),
        ("reconcile", outcome(quality.reconcile_gate, reconcile(spark, d))),
    ]
    return spark.createDataFrame(rows, "gate string, outcome string")


def reconcile(spark, d):
    return quality.reconcile(
        metrics.fact_orders(
            flatten(good_unique(spark, d, "orders_ev").withColumn("ingest_ts", stamp(AS_OF_MS))),
            F.col("ingest_ts"),
        ),
        payment_facts(spark, d),
        dead_letter_rows(quarantine_rows(with_reason(fx.all_events(spark, d)))),
    )


def batch_metrics(spark, d):
    checked = checked_deliveries(spark, d)
    return metrics.batch_metrics(checked, silver_batch(accepted(checked), UNION_LAG_MS))


def topic_high_water(spark, d):
    return lag.topic_high_water(delivered_records(spark, d))


def consumer_lag(spark, d):
    """Two consumers: one has everything that arrived in the first wave, one in the first three."""
    records = delivered_records(spark, d)
    slow = lag.consumer_positions(records.filter(F.col("wave") < 1), "gold")
    fast = lag.consumer_positions(records.filter(F.col("wave") < 3), "silver")
    return lag.consumer_lag(records, slow.unionByName(fast))


QUERIES = {
    "bronze_envelope": bronze_envelope,
    "bronze_scan": bronze_scan,
    "topic_kind": topic_kind,
    "wire_header": wire_header,
    "wire_decode": wire_decode,
    "wire_roundtrip": wire_roundtrip,
    "evolve_orders": evolve_orders,
    "validate_orders": _validate("orders_ev", "order_id", "status", "amount_cents", "quantity"),
    "validate_payments": _validate("payments_ev", "order_id", "status", "amount_cents"),
    "validate_inventory": _validate("inventory_ev", "sku", "warehouse_id", "quantity"),
    "validate_clicks": _validate("clicks_ev", "session_id", "page"),
    "accepted": accepted_events,
    "quarantine": quarantine,
    "dlq_route": dlq_route,
    "dead_letters": dead_letters,
    "silver_flatten": silver_flatten,
    "silver_union": silver_union,
    "dedupe_events": dedupe,
    "drop_late": late,
    "orders_latest_payment": orders_latest_payment,
    "unpaid_orders": unpaid,
    "hourly_gmv": hourly_gmv,
    "payment_stats": payment_stats,
    "stockouts": stockouts,
    "fact_orders": order_facts,
    "fact_payments": payment_facts,
    "gmv_last_24h": gmv_last_24h,
    "rebuild_gmv": rebuild_gmv,
    "refresh_gmv": refresh_gmv,
    "rebuild_payment_stats": rebuild_payment_stats,
    "upsert_fact_orders": upsert_fact_orders,
    "upsert_fact_payments": upsert_fact_payments,
    "merge_hourly_gmv": merge_hourly_gmv,
    "merge_payment_stats": merge_payment_stats,
    "insert_new_stockouts": insert_new_stockouts,
    "job_watermark": job_watermark,
    "key_uniqueness": key_uniqueness,
    "quality_report": quality_report,
    "quality_summary": quality_summary,
    "quality_results": quality_results,
    "quality_gates": quality_gates,
    "reconcile": reconcile,
    "batch_metrics": batch_metrics,
    "topic_high_water": topic_high_water,
    "consumer_lag": consumer_lag,
}
