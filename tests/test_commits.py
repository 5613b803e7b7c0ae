"""Crashes, replays and new checkpoints neither lose nor double events."""

import pytest
from pyspark.sql import functions as F
from test_streams import BASE, HOUR, SECOND, FIRST, drain, gmv, land, order, payment, silver_ids

from merchlake.plans import serving
from merchlake.plans.commit_log import CommitLog, run_id
from merchlake.plans.gold import order_facts
from merchlake.session import run_folder
from merchlake.sources import landing
from merchlake.streaming import jobs


def stamp():
    return F.timestamp_millis(F.lit(BASE))


def bronze(spark, root):
    jobs.run(jobs.bronze_writer(landing.record_files(spark, f"{root}/records"), root, F.col("timestamp")), True)


def silver(spark, root, late_after="batch", **options):
    options["late_after"] = late_after
    jobs.run(jobs.silver_writer(landing.bronze_stream(spark, f"{root}/bronze"), root, **options), True)


def gold(spark, root, **options):
    jobs.run(jobs.gold_writer(landing.silver_stream(spark, f"{root}/silver"), root, stamp(), **options), True)


def state(spark, root):
    """What the serving tables say, without the number of the last batch."""
    progress = serving.read_table(spark, f"{root}/gold", "pipeline_watermarks").first()
    facts = sorted((r.event_id, r.payment_status or "") for r in order_facts(spark, f"{root}/gold").collect())
    stock = sorted(r.event_id for r in serving.read_table(spark, f"{root}/gold", "gold_stockouts").collect())
    return gmv(spark, root), progress.rows_written, facts, stock


@pytest.fixture(scope="module")
def undisturbed(spark):
    root = run_folder(spark, "undisturbed")
    for number, events in enumerate((FIRST, SECOND)):
        land(spark, root, number, events)
        drain(spark, root)
    return state(spark, root)


def test_crash_between_silver_and_metrics(spark, undisturbed, monkeypatch):
    root = run_folder(spark, "crash")
    land(spark, root, 0, FIRST)
    bronze(spark, root)

    def crash(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(jobs, "write_metrics", crash)
        with pytest.raises(Exception, match="executor lost"):
            silver(spark, root)
    # Silver rows are there, but nobody sees them.
    assert landing.silver_versions(spark, f"{root}/silver", [0]).count() > 0
    assert landing.silver_table(spark, f"{root}/silver").count() == 0
    gold(spark, root)
    silver(spark, root)
    gold(spark, root)
    land(spark, root, 1, SECOND)
    drain(spark, root)
    assert state(spark, root) == undisturbed


def test_redone_batch_is_not_counted_again(spark, undisturbed):
    root = run_folder(spark, "redo")
    for number, events in enumerate((FIRST, SECOND)):
        land(spark, root, number, events)
        drain(spark, root)
    jobs.conform_batch(landing.bronze_table(spark, f"{root}/bronze").filter("offset < 100"), 0, root, redo=True, late_after="batch")
    gold(spark, root)
    assert state(spark, root) == undisturbed


def test_new_checkpoints_over_old_tables(spark, undisturbed):
    root = run_folder(spark, "checkpoints")
    land(spark, root, 0, FIRST)
    drain(spark, root)
    # The new silver run counts its batches from 0 again and reads what was landed before, too.
    land(spark, root, 1, SECOND)
    bronze(spark, root)
    silver(spark, root, checkpoint=f"{root}/checkpoints/silver-b", late_after="completed")
    numbers = [v.number for v in landing.silver_log(spark, f"{root}/silver").versions()]
    assert numbers == [0, 1]
    for table in serving.SERVING_SCHEMAS:
        serving.compact(spark, f"{root}/gold", table)
    gold(spark, root, checkpoint=f"{root}/checkpoints/gold-b")
    gold(spark, root, checkpoint=f"{root}/checkpoints/gold-c")
    assert state(spark, root) == undisturbed
    assert serving.last_batch(spark, f"{root}/gold", "fact_orders") == 1


def test_gold_counts_an_event_once(spark):
    root = run_folder(spark, "copies")
    for number in range(2):
        land(spark, root, number, [order(1, 1000), payment(1, 1, 2000, "captured")])
        bronze(spark, root)
        silver(spark, root)
    assert silver_ids(spark, root) == ["o1", "o1", "p1", "p1"]
    gold(spark, root)  # both batches at once
    land(spark, root, 2, [order(1, 1000), order(2, 3000)])
    bronze(spark, root)
    silver(spark, root)
    gold(spark, root)
    assert gmv(spark, root) == [(BASE / 1000, "USD", 200, 2)]
    written = serving.read_versions(spark, f"{root}/gold", "fact_orders").collect()
    assert sorted((r.version, r.event_id) for r in written) == [(0, "o1"), (1, "o2")]


def test_late_rows_are_kept_apart_whatever_the_batch_size(spark):
    batches = [[order(1, 4 * HOUR)], [order(2, 3 * HOUR), order(3, 4 * HOUR + 1)], [order(4, 9 * HOUR), order(5, 5 * HOUR)]]
    for sizes in ((1, 1, 1), (1, 2)):
        root, waiting = run_folder(spark, "late"), list(batches)
        for size in sizes:
            events = [e for batch in waiting[:size] for e in batch]
            del waiting[:size]
            land(spark, root, len(waiting), events)
            bronze(spark, root)
            silver(spark, root, late_after="completed")
        late = landing.late_table(spark, f"{root}/late").collect()
        # o2 is late against the first batch; o5 only against its own.
        assert [(r.event_id, r.reason) for r in late] == [("o2", "late")]
        assert silver_ids(spark, root) == ["o1", "o3", "o4", "o5"]
        metrics = spark.read.parquet(f"{root}/metrics").agg(F.sum("late"), F.sum("valid")).first()
        assert tuple(metrics) == (1, 4)


def test_batches_write_few_files(spark):
    root = run_folder(spark, "files")
    land(spark, root, 0, [order(n, n) for n in range(200)] + [payment(n, n, n, "captured") for n in range(200)])
    bronze(spark, root)
    silver(spark, root)
    assert len(landing.silver_table(spark, f"{root}/silver").inputFiles()) == 2


def test_reads_take_one_listing_however_many_versions(spark, monkeypatch):
    root = run_folder(spark, "listing")
    calls = []
    plain = CommitLog.versions
    monkeypatch.setattr(CommitLog, "versions", lambda self: calls.append(1) or plain(self))
    schema = serving.SERVING_SCHEMAS["gold_hourly_gmv"]
    counts = []
    for number in range(6):
        frame = spark.createDataFrame([], schema)
        serving.write_delta(frame, root, "gold_hourly_gmv", number)
        calls.clear()
        serving.read_table(spark, root, "gold_hourly_gmv")
        counts.append(len(calls))
    assert set(counts) == {2}


def test_commit_log(spark):
    log = CommitLog(spark, run_folder(spark, "log"))
    assert log.versions() == [] and log.newest() == -1 and log.place("a", 7) == (0, False)
    log.commit(0, "a", 7, note="x")
    log.commit(0, "a", 7, note="y")
    assert log.place("a", 7) == (0, True) and log.place("b", 7) == (1, False) and log.content(0)["note"] == "x"
    checkpoint = run_folder(spark, "checkpoint")
    assert run_id(spark, checkpoint) == run_id(spark, checkpoint)
