"""Expectations, summary, gates and reconciliation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from merchlake.operators import quality

NOW = dt.datetime(2024, 1, 2)


def report(spark, ids, lowest=0, rate=0.2, age=30):
    facts = spark.createDataFrame([(i,) for i in ids], "event_id string")
    gmv = spark.createDataFrame([] if lowest is None else [(lowest,)], "gmv_cents bigint")
    stats = spark.createDataFrame([] if rate is None else [(rate,)], "failure_rate double")
    marks = [] if age is None else [("gold", NOW - dt.timedelta(seconds=age)), ("other", dt.datetime(2000, 1, 1))]
    frame = spark.createDataFrame(marks, "job_name string, updated_at timestamp")
    return quality.quality_report(facts, gmv, stats, frame, F.lit(NOW))


def failed(frame):
    row = quality.quality_summary(frame).first()
    assert row.passed == (not row.failed)
    return list(row.failed)


def test_healthy(spark):
    checks = report(spark, [f"e{i}" for i in range(10)])
    assert failed(checks) == [] and checks.count() == 5
    assert quality.quality_gate(checks) is True
    assert {r.name: r.expected for r in checks.collect()}["payment_failure_rate_bounded"] == "<= 0.8"


def test_duplicates_and_negative_value(spark):
    checks = report(spark, ["a"] * 2 + [f"e{i}" for i in range(8)], lowest=-5)
    assert failed(checks) == ["fact_orders_unique_event_id", "gmv_non_negative"]
    with pytest.raises(quality.QualityFailure):
        quality.quality_gate(checks)


def test_bounds(spark):
    assert failed(report(spark, ["a"], rate=0.8, age=900)) == []
    assert failed(report(spark, ["a"], rate=0.81, age=901)) == ["gold_watermark_fresh", "payment_failure_rate_bounded"]
    assert failed(report(spark, ["a"], lowest=None, rate=None, age=None)) == []


def test_no_facts_is_reported_but_skipped_by_the_gate(spark):
    checks = report(spark, [])
    assert failed(checks) == ["gold_not_empty"]
    assert quality.quality_gate(checks) is False


def test_reconcile(spark):
    facts = spark.createDataFrame(
        [("a", "1", "paid"), ("b", "2", "created"), ("c", "3", "cancelled"), ("d", "2", "paid")],
        "event_id string, order_id string, status string",
    )
    payments = spark.createDataFrame([("p", "1"), ("q", "1")], "event_id string, order_id string")
    letters = spark.createDataFrame([("x",)], "reason string")
    frame = quality.reconcile(facts, payments, letters)
    row = frame.first()
    assert (row.fact_orders, row.fact_payments, row.unpaid_non_cancelled, row.dead_letters) == (4, 2, 2, 1)
    assert row.unpaid_ratio_all_orders == 0.5 and row.passed
    quality.reconcile_gate(frame)
    with pytest.raises(quality.QualityFailure):
        quality.reconcile_gate(quality.reconcile(facts, payments, letters, max_ratio=0.4))
    empty = quality.reconcile(facts.limit(0), payments, letters).first()
    assert empty.unpaid_ratio_all_orders == 0.0 and empty.passed
