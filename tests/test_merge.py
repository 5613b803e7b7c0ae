"""Keyed merges, base-and-delta tables, rebuild."""

import datetime as dt

from pyspark.sql import functions as F

from merchlake.contracts import SERVING_SCHEMAS
from merchlake.operators.merge import fold, merge
from merchlake.plans import serving
from merchlake.plans.gold import rebuild_gold
from merchlake.session import run_folder

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def rows(spark, table, *values):
    return spark.createDataFrame(list(values), SERVING_SCHEMAS[table])


def order(event_id, status, amount, at, **more):
    base = dict(
        event_id=event_id, order_id="o", customer_id="c", status=status, payment_status=None, amount_cents=amount,
        currency="USD", coupon_code=None, event_ts=T0, ingest_ts=T0, kafka_partition=0, kafka_offset=1, updated_at=at,
    )
    return {**base, **more}


def test_fact_upsert_keeps_first_and_replaces_last(spark):
    current = rows(spark, "fact_orders", order("a", "created", 1, T0, payment_status="captured"), order("b", "paid", 2, T0))
    batch = rows(
        spark, "fact_orders",
        order("a", "paid", 9, T1, currency="EUR", kafka_offset=77, coupon_code="C", customer_id="z"),
        order("n", "paid", 3, T1),
    )
    got = {r.event_id: r for r in merge(current, batch, "fact_orders").collect()}
    assert set(got) == {"a", "b", "n"}
    a = got["a"]
    assert (a.status, a.amount_cents, a.coupon_code, a.payment_status, a.updated_at) == ("paid", 9, "C", None, T1)
    assert (a.currency, a.kafka_offset, a.customer_id) == ("USD", 1, "c")
    assert got["b"].updated_at == T0


def test_additive_merge_and_ratio(spark):
    current = rows(spark, "gold_payment_stats", (T0, 1, 1, 0.5, T0), (T1, 0, 0, 0.0, T0))
    batch = rows(spark, "gold_payment_stats", (T0, 0, 2, 1.0, T1))
    got = {r.hour_ts: r for r in merge(current, batch, "gold_payment_stats").collect()}
    assert (got[T0].paid_count, got[T0].failed_count, got[T0].failure_rate) == (1, 3, 0.75)
    assert got[T1].failure_rate == 0.0


def test_watermark_merge_with_and_without_keeping(spark):
    current = rows(spark, "pipeline_watermarks", ("gold", 1, T0, 5, T0))
    batch = rows(spark, "pipeline_watermarks", ("gold", 2, None, 0, T1))
    plain = merge(current, batch, "pipeline_watermarks").first()
    assert (plain.last_batch_id, plain.last_event_ts, plain.rows_written) == (2, None, 5)
    kept = merge(current, batch, "pipeline_watermarks", keep_last=["last_event_ts"]).first()
    assert (kept.last_batch_id, kept.last_event_ts, kept.updated_at) == (2, T0, T1)


def test_fold_equals_merging_one_by_one(spark):
    versions = [
        rows(spark, "fact_orders", order("a", "created", 1, T0), order("b", "created", 2, T0)),
        rows(spark, "fact_orders", order("b", "paid", 5, T1, currency="EUR")),
        rows(spark, "fact_orders", order("b", "fulfilled", 6, T1), order("c", "paid", 7, T1)),
    ]
    stepwise = versions[0]
    for nxt in versions[1:]:
        stepwise = merge(stepwise, nxt, "fact_orders")
    stacked = versions[0].withColumn("version", F.lit(0))
    for i, nxt in enumerate(versions[1:], 1):
        stacked = stacked.unionByName(nxt.withColumn("version", F.lit(i)))
    assert sorted(fold(stacked, "fact_orders").collect()) == sorted(stepwise.collect())


def test_deltas_replay_compaction_and_time_travel(spark):
    root = run_folder(spark, "deltas")
    read = lambda **k: sorted(map(tuple, serving.read_table(spark, root, "gold_hourly_gmv", **k).collect()))
    assert read() == []
    one = rows(spark, "gold_hourly_gmv", (T0, "USD", 10, 1, T0))
    two = rows(spark, "gold_hourly_gmv", (T0, "USD", 5, 1, T1), (T1, "EUR", 3, 1, T1))
    serving.write_delta(one, root, "gold_hourly_gmv", 0)
    serving.write_delta(two, root, "gold_hourly_gmv", 1)
    serving.write_delta(two, root, "gold_hourly_gmv", 1)  # the same batch again
    want = [(T0, "USD", 15, 2, T1), (T1, "EUR", 3, 1, T1)]
    assert read() == want
    assert read(upto=0) == [(T0, "USD", 10, 1, T0)]
    assert serving.compact(spark, root, "gold_hourly_gmv") == 1
    assert read() == want
    serving.write_delta(one, root, "gold_hourly_gmv", 2)
    assert read() == [(T0, "USD", 25, 3, T0), want[1]]


def test_rebuild_corrects_double_counting(spark):
    root = run_folder(spark, "rebuild")
    fact = rows(spark, "fact_orders", order("a", "paid", 10, T0), order("x", "cancelled", 99, T0))
    for batch_id in (0, 1):  # the same event in two batches
        serving.write_delta(fact, root, "fact_orders", batch_id)
        serving.write_delta(rows(spark, "gold_hourly_gmv", (T0, "USD", 10, 1, T0)), root, "gold_hourly_gmv", batch_id)
        serving.write_delta(rows(spark, "pipeline_watermarks", ("gold", batch_id, T0, 2, T0)), root, "pipeline_watermarks", batch_id)
    before = serving.read_table(spark, root, "gold_hourly_gmv").first()
    assert before.gmv_cents == 20
    assert rebuild_gold(spark, root, F.lit(T1)) == 1
    after = serving.read_table(spark, root, "gold_hourly_gmv").first()
    assert (after.gmv_cents, after.order_count) == (10, 1)
    serving.write_delta(rows(spark, "gold_hourly_gmv", (T0, "USD", 7, 1, T1)), root, "gold_hourly_gmv", 2)
    assert serving.read_table(spark, root, "gold_hourly_gmv").first().gmv_cents == 17
