"""Bloom filters find every key put in and few others; gold reads of the stored facts only what a batch can repeat."""

import random

import pytest
from pyspark.sql import functions as F
from test_streams import BASE, HOUR, order, payment

from merchlake.operators.bloom import KEYS_PER_BLOCK, MAX_BLOCKS, block_count, bloom_filter, maybe_in
from merchlake.plans import gold, serving
from merchlake.session import run_folder
from merchlake.sources.landing import SILVER_TABLE_SCHEMA

KEY = ("kind", "event_id")
DAY = 24 * HOUR


def keys(spark, first, end):
    return spark.range(first, end).select(F.lit("orders").alias("kind"), F.col("id").cast("string").alias("event_id"))


def test_all_keys_are_found_and_few_others(spark):
    put, blocks = keys(spark, 0, 20_000), block_count(20_000)
    bloom = bloom_filter(put, KEY, blocks)
    assert blocks == 8 and bloom.count() == 8
    assert maybe_in(put, bloom, KEY, blocks).count() == 20_000
    others = maybe_in(keys(spark, 20_000, 60_000), bloom, KEY, blocks)
    assert others.columns == ["kind", "event_id"] and 0 < others.count() < 40_000 * 0.03
    plan = others._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    assert maybe_in(keys(spark, 0, 9), bloom_filter(keys(spark, 0, 0), KEY, 1), KEY, 1).count() == 0


def test_null_keys_and_repeated_rows(spark):
    rows = spark.createDataFrame([("orders", None), ("orders", "a"), ("orders", "a"), (None, "b")], "kind string, event_id string")
    bloom = bloom_filter(rows, KEY, 3)
    assert maybe_in(rows.withColumn("bits", F.lit(1)).drop("bits"), bloom, KEY, 3).count() == 4


def test_blocks_follow_the_keys_up_to_a_bound():
    assert [block_count(n) for n in (0, 1, KEYS_PER_BLOCK, KEYS_PER_BLOCK + 1)] == [1, 1, 1, 2]
    assert block_count(10**12) == MAX_BLOCKS


def test_day_ranges_hold_every_day():
    assert gold.day_ranges([]) == [] and gold.day_ranges([7, 7]) == [(7, 7)]
    assert gold.day_ranges([1, 2, 3, 9, 20, 21]) == [(1, 3), (9, 9), (20, 21)]
    assert gold.day_ranges([1, 2, 3, 9, 20, 21], limit=2) == [(1, 9), (20, 21)]
    assert gold.day_ranges([1, 9, 20], limit=1) == [(1, 20)]
    rng = random.Random(1)
    for _ in range(50):
        days = [rng.randrange(-500, 500) for _ in range(rng.randrange(1, 80))]
        ranges = gold.day_ranges(days, limit=5)
        assert len(ranges) <= 5 and all(any(a <= d <= b for a, b in ranges) for d in days)
        assert {d for r in ranges for d in r} <= set(days)


def silver(spark, *events):
    rows = [{**dict.fromkeys(SILVER_TABLE_SCHEMA.names), "topic": e["kind"], "kafka_partition": 0, "kafka_offset": n, **e}
            for n, e in enumerate(events)]
    return spark.createDataFrame([tuple(r[c] for c in SILVER_TABLE_SCHEMA.names) for r in rows], SILVER_TABLE_SCHEMA)


@pytest.fixture
def stored(spark):
    """Facts of 40 days, a batch per day."""
    root = run_folder(spark, "bloom-gold")
    for day in range(40):
        rows = [order(100 * day + n, day * DAY + n) for n in range(20)]
        facts = gold.gold_deltas(silver(spark, *rows), day, F.current_timestamp())["fact_orders"]
        serving.write_delta(facts, root, "fact_orders", day)
    return root


def test_one_old_event_reads_its_own_day(spark, stored):
    batch = silver(spark, order(0, 0), order(3905, 39 * DAY + 5), order(9999, 39 * DAY + 6)).persist()
    fresh = gold.new_rows(batch, stored, 40)
    assert [r.event_id for r in fresh.collect()] == ["o9999"]
    ids = gold.stored_ids(spark, stored, 39, gold.day_ranges((BASE // DAY, (BASE + 39 * DAY) // DAY)))
    assert ids.count() == 2 * 20
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_ts" in plan and "ReadSchema: struct<event_id:string,event_ts:timestamp>" in plan
    batch.unpersist()


def test_stored_facts_are_not_shuffled(spark, stored):
    batch = silver(spark, *[order(n, n % 20) for n in range(500)], payment(1, 1, 5, "captured")).persist()
    fresh = gold.new_rows(batch, stored, 40)
    assert sorted(r.event_id for r in fresh.collect()) == sorted([f"o{n}" for n in range(20, 500)] + ["p1"])
    copies = gold.new_rows(silver(spark, *[order(n, n) for n in range(20)]).persist(), stored, 40)
    assert copies.count() == 0
    # Ids stored by the batch itself, in an attempt that failed, do not count.
    assert gold.new_rows(batch, stored, 0).count() == 501
