"""Deduplication, late drop, latest payment and skewed joins."""

import random

from pyspark.sql import functions as F

from merchlake.operators.dedupe import dedupe_events
from merchlake.operators.joins import count_unpaid, join_latest_payment, unpaid_orders
from merchlake.operators.late import drop_late
from merchlake.operators.skew import hot_keys, skew_left_join
from merchlake.session import temporary_conf

ORDERS = "event_id string, order_id string, status string, event_ts bigint"
PAYMENTS = ORDERS + ", partition int, offset bigint"


def test_dedupe_keeps_first_arrival(spark):
    rows = [("a", 2, "t", 0, 5), ("a", 1, "t", 0, 2), ("b", 3, "t", 1, 9), ("", 4, "t", 0, 0), (None, 5, "t", 0, 1)]
    frame = spark.createDataFrame(rows, "event_id string, n int, topic string, partition int, offset bigint")
    assert sorted(r.n for r in dedupe_events(frame).collect()) == [1, 3]


def test_dedupe_limits_groups_before_the_shuffle(spark):
    frame = spark.range(100).selectExpr("concat('x', id % 3) AS event_id", "'t' AS topic", "0 AS partition", "id AS offset")
    plan = dedupe_events(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_drop_late(spark):
    frame = spark.createDataFrame([("late", 1), ("ok", 3_600_000)], "event_id string, event_ts bigint")
    assert [r.event_id for r in drop_late(frame, lag_ms=60_000).collect()] == ["ok"]


def test_drop_late_boundary_and_null(spark):
    newest = 10_000_000
    rows = [("edge", newest - 1_800_000), ("late", newest - 1_800_001), ("null", None), ("new", newest)]
    frame = spark.createDataFrame(rows, "event_id string, event_ts bigint")
    assert sorted(r.event_id for r in drop_late(frame).collect()) == ["edge", "new"]
    negative = spark.createDataFrame([("a", -5), ("b", -1_800_006)], "event_id string, event_ts bigint")
    assert [r.event_id for r in drop_late(negative).collect()] == ["a"]


def test_latest_payment(spark):
    orders = spark.createDataFrame([("o1", "ord", "created", 10), ("o2", "none", "created", 1)], ORDERS)
    payments = spark.createDataFrame(
        [("p1", "ord", "failed", 11, 0, 0), ("p2", "ord", "captured", 12, 0, 1)], PAYMENTS
    )
    found = {r.event_id: r for r in join_latest_payment(orders, payments).collect()}
    assert (found["o1"].payment_status, found["o1"].payment_event_id) == ("captured", "p2")
    assert (found["o2"].payment_status, found["o2"].payment_event_id) == (None, None)


def test_latest_payment_ties_and_missing_times(spark):
    orders = spark.createDataFrame([("o1", "x", "created", 1), ("o2", "y", "created", 1)], ORDERS)
    payments = spark.createDataFrame(
        [
            ("tie-first", "x", "failed", 7, 0, 1),
            ("tie-last", "x", "captured", 7, 0, 2),
            ("no-time", "y", "failed", None, 0, 9),
            ("negative", "y", "captured", -1, 0, 10),
        ],
        PAYMENTS,
    )
    found = {r.event_id: r.payment_event_id for r in join_latest_payment(orders, payments).collect()}
    assert found == {"o1": "tie-last", "o2": "no-time"}


def test_skewed_join_against_brute_force(spark):
    rng = random.Random(7)
    keys = ["hot"] * 700 + [None] * 100 + [f"k{rng.randrange(400)}" for _ in range(1200)]
    orders = [(f"o{i}", k, rng.choice(["created", "cancelled"]), i) for i, k in enumerate(keys)]
    names = ["hot"] + [f"k{i}" for i in range(0, 400, 2)] + ["\u00003"]
    payments = [
        (f"p{n}-{j}", n, rng.choice(["failed", "captured"]), rng.randrange(5), 0, j)
        for n in names
        for j in range(rng.randrange(1, 5))
    ]
    left, right = spark.createDataFrame(orders, ORDERS), spark.createDataFrame(payments, PAYMENTS)

    best = {}
    for event_id, key, status, ts, _, offset in payments:
        if key not in best or (ts, offset) > best[key][0]:
            best[key] = ((ts, offset), status, event_id)
    want = sorted((o[0], *(best[o[1]][1:] if o[1] in best else (None, None))) for o in orders)
    got = join_latest_payment(left, right).select("event_id", "payment_status", "payment_event_id")
    assert sorted(tuple(r) for r in got.collect()) == want

    unpaid = [o[0] for o in orders if o[2] != "cancelled" and o[1] not in best]
    assert sorted(r.event_id for r in unpaid_orders(left, right).collect()) == sorted(unpaid)
    assert count_unpaid(left, right).first()[0] == len(unpaid)


def test_hot_keys_are_bounded(spark):
    frame = spark.range(1000).select(F.when(F.col("id") < 400, "big").otherwise(F.col("id").cast("string")).alias("k"))
    hot = hot_keys(frame, "k", pieces=10).collect()
    assert [(r.k, r.salts) for r in hot] == [("big", 4)]
    assert hot_keys(frame, "k", pieces=100).count() <= 100


def test_hot_rows_spread_over_the_shuffle(spark):
    left = spark.range(1000).selectExpr("'hot' AS k", "cast(id AS string) AS event_id")
    left = left.unionByName(spark.range(200).selectExpr("NULL AS k", "concat('n', id) AS event_id"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    plain_shuffle = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    with temporary_conf(spark, plain_shuffle):
        joined = skew_left_join(left, right, "k", spread=["event_id"], pieces=200)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert joined.filter("k = 'hot' AND v = 1").count() == 1000
        assert joined.filter("k IS NULL AND v IS NULL").count() == 200
    assert sum(r["count"] for r in sizes) == 1200
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1200 / 8 * 2
