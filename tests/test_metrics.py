"""Hourly metrics, stockouts, facts and scalar functions."""

import datetime as dt

from pyspark.sql import functions as F

from merchlake.functions import scalars
from merchlake.operators import metrics
from merchlake.operators.lag import consumer_lag, consumer_positions, topic_high_water

HOUR = 3_600_000


def test_hour_bucket_floors(spark):
    frame = spark.createDataFrame([(0,), (HOUR - 1,), (HOUR,), (-1,), (-HOUR,)], "ts bigint")
    buckets = [r[0] for r in frame.select(scalars.hour_bucket_ms(F.col("ts"))).collect()]
    assert buckets == [0, 0, HOUR, -HOUR, -HOUR]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.guarded_ratio(F.lit(1), F.lit(0)).alias("none"),
        scalars.guarded_ratio(F.lit(1), F.lit(4)).alias("quarter"),
        scalars.age_seconds(F.timestamp_millis(F.lit(90_500)), F.timestamp_millis(F.lit(0))).alias("age"),
        scalars.timestamp_to_millis(F.lit("1970-01-01 00:00:01").cast("timestamp_ntz")).alias("ms"),
        scalars.additive(F.lit(None).cast("int"), F.lit(3)).alias("sum"),
        scalars.day_string(F.timestamp_millis(F.lit(86_400_000))).alias("day"),
    ).first()
    assert row.asDict() == {"none": 0.0, "quarter": 0.25, "age": 90.5, "ms": 1000, "sum": 3, "day": "1970-01-02"}


def test_gmv_skips_cancelled_and_defaults_currency(spark):
    rows = [
        ("created", 1, "USD", 100),
        ("cancelled", 1, "USD", 999),
        ("paid", HOUR, "USD", 50),
        (None, 2, "", 7),
        ("paid", 3, None, 5),
        ("paid", -1, "EUR", 4),
    ]
    frame = spark.createDataFrame(rows, "status string, event_ts bigint, currency string, amount_cents bigint")
    found = {(r.hour_ts_ms, r.currency): (r.gmv_cents, r.order_count) for r in metrics.hourly_gmv(frame).collect()}
    assert found == {(0, "USD"): (112, 3), (HOUR, "USD"): (50, 1), (-HOUR, "EUR"): (4, 1)}


def test_payment_stats(spark):
    rows = [("captured", 10), ("failed", 11), ("failed", 12), (None, HOUR), ("authorized", HOUR)]
    frame = spark.createDataFrame(rows, "status string, event_ts bigint")
    found = {r.hour_ts_ms: r for r in metrics.payment_stats(frame).collect()}
    assert (found[0].paid_count, found[0].failed_count) == (1, 2)
    assert abs(found[0].failure_rate - 2 / 3) < 1e-9
    assert (found[HOUR].paid_count, found[HOUR].failure_rate) == (2, 0.0)


def test_stockouts(spark):
    rows = [("a", "e", 0, "1"), ("b", "e", 4, "2"), ("c", "e", None, "3"), ("d", "e", -2, "4")]
    frame = spark.createDataFrame(rows, "sku string, warehouse_id string, quantity int, event_id string")
    assert sorted(r.sku for r in metrics.stockouts(frame).collect()) == ["a", "c", "d"]


def test_last_24h_keeps_the_boundary(spark):
    day = dt.datetime(2024, 1, 31)
    hours = [day - dt.timedelta(hours=h) for h in (24, 25, 1)]
    frame = spark.createDataFrame([(h, "USD", 1, 1) for h in hours], "hour_ts timestamp, currency string, gmv_cents bigint, order_count bigint")
    got = [r.hour_ts for r in metrics.gmv_last_24h(frame, F.lit(day)).collect()]
    assert got == [hours[2], hours[0]]


def test_watermark_row_without_facts(spark):
    facts = spark.createDataFrame([], "event_ts timestamp")
    row = metrics.watermark_row(facts, "gold", 3).first()
    assert (row.last_batch_id, row.last_event_ts, row.rows_written) == (3, None, 0)


def test_lag(spark):
    rows = [("t", 0, 0), ("t", 0, 9), ("t", 1, 4), ("u", 0, 2)]
    frame = spark.createDataFrame(rows, "topic string, partition int, offset bigint")
    assert {r.topic: r.high_water for r in topic_high_water(frame).collect()} == {"t": 15, "u": 3}
    done = consumer_positions(frame.filter("topic = 't' AND partition = 0 AND offset = 0"), "silver")
    lag = {(r.consumer, r.topic): r.lag for r in consumer_lag(frame, done).collect()}
    assert lag == {("silver", "t"): 9 + 1}
