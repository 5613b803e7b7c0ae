"""Streams end to end: restart, replay, late data, serving tables, command line."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.__main__ import main
from merchlake.contracts import EVENT_FIELDS, TOPICS
from merchlake.operators import metrics
from merchlake.operators.wire_codec import encode_events
from merchlake.plans import serving
from merchlake.plans.gold import order_facts, write_gold_batch
from merchlake.session import ROCKSDB, run_folder, temporary_conf
from merchlake.sources import landing
from merchlake.streaming import jobs, stateful

HOUR = 3_600_000
BASE = 1_700_000_000_000 - 1_700_000_000_000 % HOUR


def order(n, ts, status="created", **more):
    return dict(
        kind="orders", event_id=f"o{n}", trace_id="t", order_id=f"ord{n}", customer_id="c", status=status,
        amount_cents=100, currency="", sku="s", quantity=1, event_ts=BASE + ts, **more,
    )


def payment(n, order_n, ts, status):
    return dict(
        kind="payments", event_id=f"p{n}", trace_id="t", payment_id=f"pay{n}", order_id=f"ord{order_n}",
        status=status, amount_cents=100, currency="USD", event_ts=BASE + ts,
    )


def stock(n, ts, quantity):
    return dict(
        kind="inventory", event_id=f"i{n}", trace_id="t", sku="s", warehouse_id="w", quantity=quantity,
        stock_reason="sale", event_ts=BASE + ts,
    )


FIRST = [
    order(1, 1000),
    order(1, 1000),  # exact copy
    order(2, 2000, "cancelled"),
    order(3, 3000, amount_cents_bad=True),
    payment(1, 1, 2500, "authorized"),
    stock(1, 10, 0),
    stock(2, 11, 5),
    order(9, -3 * HOUR),  # too late for this batch
]
SECOND = [
    order(4, HOUR + 5),
    payment(2, 1, HOUR + 6, "captured"),  # for an order of the first batch
    payment(3, 4, HOUR + 7, "failed"),
    stock(1, 10, 0),  # known stockout, but late by now
]


def land(spark, root, batch, events, poison=False):
    rows = []
    for i, event in enumerate(events):
        event = dict(event)
        if event.pop("amount_cents_bad", False):
            event["amount_cents"] = -1
        rows.append({**event, "topic": TOPICS[event["kind"]], "partition": 0, "offset": batch * 100 + i})
    schema = T.StructType([*EVENT_FIELDS]).add("kind", "string").add("topic", "string")
    schema = schema.add("partition", "integer").add("offset", "long")
    frame = encode_events(spark.createDataFrame(rows, schema), F.col("kind"), F.lit(1))
    records = frame.select(
        "topic", "partition", "offset", F.timestamp_millis(F.lit(BASE)).alias("timestamp"),
        F.col("order_id").cast("binary").alias("key"), "value",
    )
    if poison:
        bad = spark.createDataFrame(
            [(TOPICS["orders"], 0, batch * 100 + 90, None, bytearray(b"\x00\x00\x00\x00\x01not-avro"))],
            "topic string, partition int, offset bigint, key binary, value binary",
        )
        records = records.unionByName(bad.withColumn("timestamp", F.timestamp_millis(F.lit(BASE))))
    records.write.mode("append").parquet(f"{root}/records")


def drain(spark, root):
    stamp = F.timestamp_millis(F.lit(BASE))
    jobs.run(jobs.bronze_writer(landing.record_files(spark, f"{root}/records"), root, F.col("timestamp")), True)
    jobs.run(jobs.silver_writer(landing.bronze_stream(spark, f"{root}/bronze"), root, late_after="batch"), True)
    jobs.run(jobs.gold_writer(landing.silver_stream(spark, f"{root}/silver"), root, stamp), True)


@pytest.fixture(scope="module")
def lake(spark):
    root = run_folder(spark, "lake")
    land(spark, root, 0, FIRST, poison=True)
    drain(spark, root)
    land(spark, root, 1, SECOND)
    drain(spark, root)
    drain(spark, root)  # nothing new: nothing may change
    return root


def silver_ids(spark, lake):
    return sorted(r.event_id for r in landing.silver_table(spark, f"{lake}/silver").collect())


def gmv(spark, lake):
    rows = serving.read_table(spark, f"{lake}/gold", "gold_hourly_gmv").collect()
    return sorted((r.hour_ts.timestamp(), r.currency, r.gmv_cents, r.order_count) for r in rows)


def test_silver_and_quarantine(spark, lake):
    assert landing.bronze_table(spark, f"{lake}/bronze").count() == len(FIRST) + 1 + len(SECOND)
    assert silver_ids(spark, lake) == ["i1", "i2", "o1", "o2", "o4", "p1", "p2", "p3"]
    rejects = landing.quarantine_table(spark, f"{lake}/quarantine").collect()
    assert sorted((r.reason, r.offset) for r in rejects) == [("decode_error", 90), ("invalid_amount", 3)]
    statuses = {r.event_id: r.payment_status for r in landing.silver_table(spark, f"{lake}/silver").collect()}
    assert (statuses["o1"], statuses["o2"], statuses["o4"]) == ("authorized", None, "failed")
    metrics = spark.read.parquet(f"{lake}/metrics").filter("batch_id = 0").first()
    assert (metrics.valid, metrics.quarantined, metrics.orders, metrics.stockouts) == (5, 2, 2, 1)
    assert metrics.max_event_ts == BASE + 3000 - 500
    letters = spark.read.parquet(f"{lake}/dlq")
    assert letters.count() == 2 and {r.topic for r in letters.collect()} == {TOPICS["orders"] + ".dlq"}


def test_serving_tables(spark, lake):
    hour = BASE / 1000
    assert gmv(spark, lake) == [(hour, "USD", 100, 1), (hour + 3600, "USD", 100, 1)]
    stored = {r.event_id: r.payment_status for r in serving.read_table(spark, f"{lake}/gold", "fact_orders").collect()}
    resolved = {r.event_id: r.payment_status for r in order_facts(spark, f"{lake}/gold").collect()}
    assert stored["o1"] == "authorized" and resolved == {"o1": "captured", "o2": None, "o4": "failed"}
    progress = serving.read_table(spark, f"{lake}/gold", "pipeline_watermarks").first()
    assert (progress.last_batch_id, progress.rows_written) == (1, 3)
    assert [r.event_id for r in serving.read_table(spark, f"{lake}/gold", "gold_stockouts").collect()] == ["i1"]


def test_replayed_batches_change_nothing(spark, lake):
    ids, value = silver_ids(spark, lake), gmv(spark, lake)
    bronze = landing.bronze_table(spark, f"{lake}/bronze").filter("offset < 100")
    before = landing.silver_table(spark, f"{lake}/silver").inputFiles()
    jobs.conform_batch(bronze, 0, lake, late_after="batch")
    assert sorted(landing.silver_table(spark, f"{lake}/silver").inputFiles()) == sorted(before)
    jobs.conform_batch(bronze, 0, lake, redo=True, late_after="batch")
    assert silver_ids(spark, lake) == ids
    assert landing.quarantine_table(spark, f"{lake}/quarantine").count() == 2
    batch = landing.silver_table(spark, f"{lake}/silver").filter("batch_id = 1")
    write_gold_batch(batch, f"{lake}/gold", 1, F.timestamp_millis(F.lit(BASE)))
    assert gmv(spark, lake) == value


def test_command_line(spark):
    root = run_folder(spark, "cli")
    land(spark, root, 0, FIRST)
    for job in ("bronze", "silver", "gold", "rebuild", "compact", "last24h", "quality", "reconcile"):
        main([job, "--lake", root, "--records", f"{root}/records", "--late-after", "batch", "--once"])
    assert serving.read_table(spark, f"{root}/gold", "fact_orders").count() == 2
    assert gmv(spark, root) == [(BASE / 1000, "USD", 100, 1)]


def test_salted_stream_join_equals_plain(spark):
    schema = T.StructType([*EVENT_FIELDS]).add("partition", "integer").add("offset", "long")
    orders = [{k: v for k, v in order(n, n * 1000).items() if k != "kind"} | {"order_id": "hot"} for n in range(20)]
    pays = [payment(n, 0, 500, "captured") | {"order_id": "hot"} for n in range(3)]
    pays.append(payment(9, 0, 31 * 60_000, "failed") | {"order_id": "hot"})
    flush = [order(99, 3 * HOUR) | {"order_id": "x"}], [payment(99, 0, 3 * HOUR, "captured") | {"order_id": "y"}]
    results = []
    for hot in (None, spark.createDataFrame([("hot", 4)], "order_id string, salts int")):
        root = run_folder(spark, "join")
        with temporary_conf(spark, {"spark.sql.shuffle.partitions": "2"}):
            for step in ((orders, pays), flush):
                for side, rows in zip(("o", "p"), step):
                    frame = spark.createDataFrame([{f: r.get(f) for f in EVENT_FIELDS.names} for r in rows], schema)
                    frame.write.mode("append").parquet(f"{root}/{side}")
                joined = stateful.join_orders_payments_stream(
                    spark.readStream.schema(schema).parquet(f"{root}/o"),
                    spark.readStream.schema(schema).parquet(f"{root}/p"),
                    hot=hot,
                )
                jobs.run(stateful.append_writer(joined, f"{root}/out", f"{root}/ck"), True)
        rows = spark.read.parquet(f"{root}/out").filter("order_id = 'hot'")
        results.append(sorted((r.order_event_id, r.payment_event_id) for r in rows.collect()))
    want = [(f"o{n}", f"p{p}") for n in range(20) for p in (0, 1, 2)]
    want += [(f"o{n}", "p9") for n in range(20) if 31 * 60 - n <= 30 * 60]
    assert results == [sorted(want)] * 2


def test_latest_payment_has_linear_state_and_output(spark):
    """A thousand orders and a thousand payments of one id, twice each, in one hour."""
    schema = T.StructType([*EVENT_FIELDS])
    orders = [order(n, n * 3000) | {"order_id": "hot"} for n in range(1000)]
    pays = [payment(n, 0, n * 3500 - 20 * 60_000, f"s{n}") | {"order_id": "hot"} for n in range(1000)]
    pays.append(payment(0, 0, pays[-1]["event_ts"] - BASE, "tie") | {"order_id": "hot", "event_id": "a"})
    alone = order(5000, 10) | {"order_id": None}
    lost = payment(5000, 0, 10, "captured") | {"order_id": None}
    flush = [order(9000, 9 * HOUR)], [payment(9000, 9000, 9 * HOUR, "captured")]
    root = run_folder(spark, "latest")
    conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    states = []
    with temporary_conf(spark, conf):
        for step in ((orders + [alone], pays + [lost]), (orders[::-1], pays), flush, ([], [])):
            for side, rows in zip(("o", "p"), step):
                frame = spark.createDataFrame([{f: r.get(f) for f in EVENT_FIELDS.names} for r in rows], schema)
                frame.write.mode("append").parquet(f"{root}/{side}")
            latest = stateful.latest_payment_stream(
                spark.readStream.schema(schema).parquet(f"{root}/o"),
                spark.readStream.schema(schema).parquet(f"{root}/p"),
            )
            query = jobs.run(stateful.append_writer(latest, f"{root}/out", f"{root}/ck"), True)
            states.append(max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators))
    rows = spark.read.parquet(f"{root}/out").filter("order_event_id <> 'o9000'").collect()
    assert len(rows) == 1001
    want = {"o5000": None}
    for o in orders:
        near = [p for p in pays if abs(p["event_ts"] - o["event_ts"]) <= 30 * 60_000]
        want[o["event_id"]] = min(near, key=lambda p: (-p["event_ts"], p["event_id"]))["event_id"] if near else None
    assert {r.order_event_id: r.payment_event_id for r in rows} == want
    # Orders once, payments in two slices at most, and the timers of a few slices; nothing is left of them at the end.
    assert states[0] <= 3 * 1002 + 20 and states[1] == states[0] and states[-1] <= 10


def test_latest_payment_of_many_orders_is_held_in_few_groups(spark):
    """Six hundred orders of one hour, copies in two batches: groups of state follow slices and buckets, not order ids."""
    schema = T.StructType([*EVENT_FIELDS])
    orders = [order(n, n * 5000) for n in range(600)]
    pays = [payment(n, k, n * 5000 + (k * 23 - 20) * 60_000, f"s{k}") for n in range(600) if n % 3 for k in range(3)]
    flush = [order(9000, 9 * HOUR)], [payment(9000, 9000, 9 * HOUR, "captured")]
    root = run_folder(spark, "latest-many")
    conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    states = []
    with temporary_conf(spark, conf):
        for step in ((orders + orders[:50], pays), (orders[:50], pays[:50]), flush):
            for side, rows in zip(("o", "p"), step):
                frame = spark.createDataFrame([{f: r.get(f) for f in EVENT_FIELDS.names} for r in rows], schema)
                frame.write.mode("append").parquet(f"{root}/{side}")
            latest = stateful.latest_payment_stream(
                spark.readStream.schema(schema).parquet(f"{root}/o"),
                spark.readStream.schema(schema).parquet(f"{root}/p"),
                buckets=4,
            )
            query = jobs.run(stateful.append_writer(latest, f"{root}/out", f"{root}/ck"), True)
            states.append(max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators))
    rows = spark.read.parquet(f"{root}/out").filter("order_event_id <> 'o9000'").collect()
    want = {}
    for o in orders:
        near = [p for p in pays if p["order_id"] == o["order_id"] and abs(p["event_ts"] - o["event_ts"]) <= 30 * 60_000]
        best = min(near, key=lambda p: (-p["event_ts"], p["event_id"])) if near else {}
        want[o["event_id"]] = (best.get("event_id"), best.get("status"))
    assert sorted((r.order_event_id, r.payment_event_id, r.payment_status) for r in rows) == sorted(
        (event, *paid) for event, paid in want.items()
    )
    # Three slices of four buckets, each with two lists and a timer in both of its indexes.
    assert states[0] <= 3 * 4 * 4


def test_unique_rows_of_a_batch_are_made_once_and_kept_narrow(spark, monkeypatch):
    root, seen = run_folder(spark, "unique"), []
    split = jobs.split_late
    monkeypatch.setattr(jobs, "split_late", lambda rows, *args: seen.append((rows, rows.is_cached)) or split(rows, *args))
    land(spark, root, 0, FIRST, poison=True)
    drain(spark, root)
    assert [cached for _, cached in seen] == [True] and not {"value", "key"} & set(seen[0][0].columns)
    # Rejected rows have their bytes all the same.
    rejects = landing.quarantine_table(spark, f"{root}/quarantine")
    assert rejects.count() and not rejects.filter("value IS NULL").count()


def test_progress_is_observed_without_reading_tables_back(spark):
    root = run_folder(spark, "progress")
    seen = jobs.BatchProgress()
    spark.streams.addListener(seen)
    try:
        land(spark, root, 0, FIRST, poison=True)
        drain(spark, root)
        deadline = time.time() + 30
        while not {"bronze_events", "silver_events"} <= seen.latest.keys() and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert seen.failed == {}
    assert seen.latest["bronze_events"]["observed"]["landed"]["rows"] == len(FIRST) + 1
    assert seen.latest["silver_events"]["input_rows"] == len(FIRST) + 1
    assert seen.latest["silver_events"]["offsets"][0][1] is not None
    # The stored numbers are those of a second look at the tables.
    stored = spark.read.parquet(f"{root}/metrics").first()
    silver = landing.silver_table(spark, f"{root}/silver")
    again = silver.agg(*[n.alias(name) for name, n in metrics.silver_numbers().items()]).first()
    assert {k: stored[k] for k in again.asDict()} == again.asDict()
    assert stored["quarantined"] == landing.quarantine_table(spark, f"{root}/quarantine").count()
    assert stored["late"] == landing.late_table(spark, f"{root}/late").count()
