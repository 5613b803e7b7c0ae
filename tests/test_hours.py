"""Hourly tables refreshed by touched days equal a full rebuild."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from merchlake.operators import metrics
from merchlake.plans import hours, serving
from merchlake.session import run_folder


def at(day, hour=0):
    return datetime(2024, 3, day, hour, 10, tzinfo=timezone.utc)


def facts(spark, *rows):
    """Order facts given as id, status, currency, amount, time."""
    schema = serving.SERVING_SCHEMAS["fact_orders"]
    names = ("event_id", "status", "currency", "amount_cents", "event_ts")
    rows = [{**dict.fromkeys(schema.names), **dict(zip(names, row))} for row in rows]
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)


def rebuilt(spark, root):
    rows = metrics.rebuild_gmv(serving.read_table(spark, root, "fact_orders")).collect()
    return sorted((r.hour_ts, r.currency, r.gmv_cents, r.order_count) for r in rows)


def refreshed(spark, root):
    rows = hours.read_hours(spark, root, "gold_hourly_gmv").collect()
    return sorted((r.hour_ts, r.currency, r.gmv_cents, r.order_count) for r in rows)


def files(spark, root):
    """Files of the table by day."""
    found = hours.read_hours(spark, root, "gold_hourly_gmv").select(F.input_file_name().alias("f")).distinct()
    stored = [r.f for r in found.collect()]
    return {f.split("dt=")[1].split("/")[0]: f for f in stored}


def refresh(spark, root):
    return hours.refresh_hours(spark, root, "gold_hourly_gmv")


def test_only_touched_days_are_written(spark):
    root = run_folder(spark, "hours")
    assert refresh(spark, root) == -1 and refreshed(spark, root) == []
    rows = [(f"o{day}-{n}", "created", "USD" if n % 2 else "EUR", n, at(day, n)) for day in range(1, 6) for n in range(4)]
    serving.write_delta(facts(spark, *rows), root, "fact_orders", 0)
    assert refresh(spark, root) == 0
    before = files(spark, root)
    assert refreshed(spark, root) == rebuilt(spark, root) and sorted(before) == [f"2024-03-0{d}" for d in range(1, 6)]

    # A late order on day 2, a corrected one on day 4, and a day that loses all it had.
    serving.write_delta(facts(spark, ("late", "paid", "USD", 7, at(2, 1))), root, "fact_orders", 1)
    changed = [("o4-1", "created", "USD", 99, at(4, 1))]
    changed += [(f"o5-{n}", "cancelled", "USD", n, at(5, n)) for n in range(4)]
    serving.write_delta(facts(spark, *changed), root, "fact_orders", 2)
    assert refresh(spark, root) == 2
    after = files(spark, root)
    assert refreshed(spark, root) == rebuilt(spark, root)
    assert {day for day in before if before[day] != after.get(day)} == {"2024-03-02", "2024-03-04", "2024-03-05"}
    assert "2024-03-05" not in after

    # Nothing new: nothing is written. A batch without facts is only noted.
    assert refresh(spark, root) == 2 and files(spark, root) == after
    serving.write_delta(facts(spark), root, "fact_orders", 3)
    assert refresh(spark, root) == 3 and files(spark, root) == after


def test_a_failed_run_is_taken_up(spark, monkeypatch):
    root = run_folder(spark, "hours-failed")
    serving.write_delta(facts(spark, ("a", "created", "USD", 1, at(1))), root, "fact_orders", 0)
    refresh(spark, root)
    serving.write_delta(facts(spark, ("b", "created", "USD", 2, at(2))), root, "fact_orders", 1)
    plain = hours.CommitLog.commit

    def crash(*_, **__):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(hours.CommitLog, "commit", crash)
    try:
        refresh(spark, root)
    except RuntimeError:
        pass
    monkeypatch.setattr(hours.CommitLog, "commit", plain)
    assert refresh(spark, root) == 1 and refreshed(spark, root) == rebuilt(spark, root)


def test_compacted_facts_and_payments(spark):
    root = run_folder(spark, "hours-compact")
    serving.write_delta(facts(spark, ("a", "created", "USD", 1, at(1))), root, "fact_orders", 0)
    refresh(spark, root)
    serving.write_delta(facts(spark, ("a", "paid", "USD", 5, at(1)), ("b", None, "USD", 2, at(2))), root, "fact_orders", 1)
    serving.compact(spark, root, "fact_orders")
    assert refresh(spark, root) == 1 and refreshed(spark, root) == rebuilt(spark, root)

    schema = serving.SERVING_SCHEMAS["fact_payments"]
    pays = [{**dict.fromkeys(schema.names), "event_id": s, "status": s, "event_ts": at(3)} for s in ("failed", "paid", "x")]
    serving.write_delta(spark.createDataFrame([tuple(p.values()) for p in pays], schema), root, "fact_payments", 0)
    hours.refresh_hours(spark, root, "gold_payment_stats")
    row = hours.read_hours(spark, root, "gold_payment_stats").first()
    assert (row.paid_count, row.failed_count, round(row.failure_rate, 6)) == (2, 1, 0.333333)


def test_the_first_refresh_settles_the_grain(spark):
    root = run_folder(spark, "months")
    rows = [(f"o{day}", "created", "USD", day, at(day)) for day in (1, 15, 31)]
    serving.write_delta(facts(spark, *rows), root, "fact_orders", 0)
    hours.refresh_hours(spark, root, "gold_hourly_gmv", grain="month")
    assert refreshed(spark, root) == rebuilt(spark, root) and list(files(spark, root)) == ["2024-03-01"]
    # A later one keeps it, and one changed day brings all days of its month along.
    serving.write_delta(facts(spark, ("o15", "created", "USD", 99, at(15))), root, "fact_orders", 1)
    refresh(spark, root)
    assert refreshed(spark, root) == rebuilt(spark, root) and list(files(spark, root)) == ["2024-03-01"]
    assert sorted(r[2] for r in refreshed(spark, root)) == [1, 31, 99]
