"""Watermarks of several kinds under both policies, and what the state stores hold after each wave."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from merchlake.catalog import stream_queries
from merchlake.contracts import EVENT_FIELDS
from merchlake.session import ROCKSDB, run_folder, temporary_conf
from merchlake.streaming import jobs, stateful

MINUTE = 60_000
BASE = 1_700_000_000_000
SCHEMA = T.StructType(
    [T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), *EVENT_FIELDS]
)

EMPTY = T.StructType([*SCHEMA, *[T.StructField(name, T.StringType()) for name in ("kind", "topic", "reason")],
                      T.StructField("wave", T.IntegerType())])


def conf(policy="min", partitions=2):
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        stateful.MARK_POLICY: policy,
    }


def put(spark, path, *events):
    """Append events given as id and minute."""
    rows = [
        {**dict.fromkeys(SCHEMA.names), "partition": 0, "offset": n, "event_id": event_id, "event_ts": BASE + minute * MINUTE}
        for n, (event_id, minute) in enumerate(events)
    ]
    spark.createDataFrame([tuple(r[c] for c in SCHEMA.names) for r in rows], SCHEMA).write.mode("append").parquet(path)


def start(spark, root, kinds, lag_ms):
    sources = {kind: spark.readStream.schema(SCHEMA).parquet(f"{root}/{kind}") for kind in kinds}
    kept = stateful.dedupe_kinds_stream(sources, salts=4, lag_ms=lag_ms).select("kind", "event_id")
    return jobs.run(stateful.append_writer(kept, f"{root}/out", f"{root}/ck"), True)


@pytest.mark.parametrize("policy", ["min", "max"])
def test_slow_kinds_hold_the_mark_back_or_do_not(spark, policy):
    root, lag = run_folder(spark, f"marks-{policy}"), 30 * MINUTE
    waves = [
        ({"orders": [("a", 0), ("b", 100)], "clicks": [("a", 10), ("a", 10), ("", 10)]}),
        # Ten minutes behind the clicks of before, ninety behind the orders.
        ({"orders": [("c", 200)], "clicks": [("b", 12), ("c", 70), ("d", 69)]}),
        # Copies of old events stay out, whichever mark counts.
        ({"orders": [("c", 200), ("d", 201)], "clicks": [("e", 71), ("c", 70)]}),
    ]
    with temporary_conf(spark, conf(policy)):
        for wave in waves:
            for kind, events in wave.items():
                put(spark, f"{root}/{kind}", *events)
            start(spark, root, ("orders", "clicks"), lag)
    kept = sorted((r.kind, r.event_id) for r in spark.read.parquet(f"{root}/out").collect())
    clicks = {"min": ["a", "b", "c", "d", "e"], "max": ["a", "c"]}[policy]
    assert kept == [("clicks", c) for c in clicks] + [("orders", o) for o in "abcd"]


def test_a_silent_kind_lets_nothing_go(spark):
    root = run_folder(spark, "marks-silent")
    with temporary_conf(spark, conf()):
        put(spark, f"{root}/clicks")
        for minute in (0, 500, 1):
            put(spark, f"{root}/orders", (f"o{minute}", minute))
            start(spark, root, ("orders", "clicks"), MINUTE)
    assert spark.read.parquet(f"{root}/out").count() == 3


def test_state_follows_the_mark(spark):
    root = run_folder(spark, "marks-state")
    sizes = []
    with temporary_conf(spark, conf()):
        for wave in range(4):
            put(spark, f"{root}/orders", *[(f"o{wave}-{n}", wave * 100 + n % 20) for n in range(200)])
            start(spark, root, ("orders",), 30 * MINUTE)
            held = stateful.state_sizes(spark, f"{root}/ck").collect()
            assert {r.operator for r in held} == {"dedupeWithinWatermark"} and {r.operator_id for r in held} == {0, 1}
            sizes.append([r.rows for r in sorted(held, key=lambda r: r.operator_id)])
    # Every wave is past the reach of the one before: 200 ids are held, not 800.
    assert sizes == [[200, 200]] * 4
    first = stateful.state_sizes(spark, f"{root}/ck", batch_id=0).collect()
    assert [r.rows for r in first] == [200, 200]
    assert spark.read.parquet(f"{root}/out").count() == 800


def test_state_of_a_processor_is_counted_by_variable(spark):
    root = run_folder(spark, "marks-processor")
    with temporary_conf(spark, conf()):
        put(spark, f"{root}/orders", ("o1", 0), ("o2", 0), ("o2", 0))
        put(spark, f"{root}/payments", ("p1", 1))
        sides = [spark.readStream.schema(SCHEMA).parquet(f"{root}/{side}").fillna("one", ["order_id", "status"])
                 for side in ("orders", "payments")]
        found = stateful.latest_payment_stream(*sides)
        jobs.run(stateful.append_writer(found, f"{root}/out", f"{root}/ck"), True)
    held = {r.store: r.rows for r in stateful.state_sizes(spark, f"{root}/ck").collect()}
    # The payment is near the end of a slice or not: one slice or two.
    assert held["orders"] == 2 and held["payments"] in (1, 2) and set(held) == {"orders", "payments"}


def test_both_policies_read_one_landing(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(stream_queries, "_run_waves", lambda *args, **options: calls.append((args, options)))
    monkeypatch.setattr(stream_queries, "checked_deliveries", lambda s, d: s.createDataFrame([], EMPTY))
    with pytest.raises(AnalysisException):
        stream_queries.stream_marks(spark, "")
    ((args, options),) = calls
    assert len(args[3]) == 2
    assert options["confs"] == [{stateful.MARK_POLICY: "min"}, {stateful.MARK_POLICY: "max"}]
    assert stream_queries._stream_conf(spark)["spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"] == "false"
