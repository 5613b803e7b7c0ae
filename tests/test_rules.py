"""Validation rules: the first broken rule names the reason."""

import pytest
from pyspark.sql import types as T

from merchlake.contracts import EVENT_FIELDS, TOPICS
from merchlake.operators.dead_letters import dead_letter_rows, dlq_records
from merchlake.operators.envelope import kind_of_topic
from merchlake.operators.validate import accepted, quarantine_rows, with_reason

ORDER = dict(kind="orders", event_id="e", order_id="o", status="created", amount_cents=1, quantity=1)
PAYMENT = dict(kind="payments", event_id="e", order_id="o", status="captured", amount_cents=0)
STOCK = dict(kind="inventory", event_id="e", sku="s", warehouse_id="w", quantity=-5)
CLICK = dict(kind="clickstream", event_id="e", session_id="s", page="/")

CASES = [
    (ORDER, {}, None),
    (ORDER, {"amount_cents": -1}, "invalid_amount"),
    (ORDER, {"amount_cents": None}, "invalid_amount"),
    (ORDER, {"amount_cents": 0}, None),
    (ORDER, {"event_id": None}, "missing_keys"),
    (ORDER, {"event_id": ""}, "missing_keys"),
    (ORDER, {"order_id": ""}, "missing_keys"),
    (ORDER, {"status": "bogus"}, "invalid_status"),
    (ORDER, {"status": None}, "invalid_status"),
    (ORDER, {"quantity": 0}, "invalid_quantity"),
    (ORDER, {"quantity": None}, "invalid_quantity"),
    (ORDER, {"status": "bogus", "amount_cents": -1}, "invalid_amount"),
    (ORDER, {"order_id": None, "status": "bogus", "amount_cents": -1}, "missing_keys"),
    (PAYMENT, {}, None),
    (PAYMENT, {"status": "bogus", "amount_cents": -1}, "invalid_status"),
    (PAYMENT, {"amount_cents": -1}, "invalid_amount"),
    (PAYMENT, {"order_id": ""}, "missing_keys"),
    (STOCK, {}, None),
    (STOCK, {"warehouse_id": None}, "missing_keys"),
    (STOCK, {"quantity": None}, "invalid_quantity"),
    (CLICK, {}, None),
    (CLICK, {"page": ""}, "missing_keys"),
    (CLICK, {"session_id": None}, "missing_keys"),
]


def test_first_broken_rule_wins(spark):
    schema = T.StructType([*EVENT_FIELDS]).add("kind", "string").add("case", "integer")
    rows = [{**base, **change, "case": i} for i, (base, change, _) in enumerate(CASES)]
    found = {r["case"]: r["reason"] for r in with_reason(spark.createDataFrame(rows, schema)).collect()}
    assert [found[i] for i in range(len(CASES))] == [reason for *_, reason in CASES]


@pytest.fixture
def checked(spark):
    rows = [
        (TOPICS["orders"], 0, 1, "k1", bytearray(b"\x00\x01"), "orders", "e1", None),
        (TOPICS["orders"], 0, 2, "k2", bytearray(b"\x00\x02"), "orders", "e2", "invalid_amount"),
        (TOPICS["payments"], 1, 3, "k3", None, "payments", "", "missing_keys"),
        ("other.topic", 0, 4, "k4", bytearray(b"x"), None, None, "unknown_topic"),
    ]
    columns = (
        "topic string, partition int, offset bigint, key string, value binary, kind string,"
        " event_id string, reason string"
    )
    frame = spark.createDataFrame(rows, columns)
    return frame.selectExpr("*", "timestamp_millis(0) AS ingest_ts")


def test_split_and_dead_letters(spark, checked):
    assert [r.offset for r in accepted(checked).collect()] == [1]
    rejects = quarantine_rows(checked)
    assert sorted(r.offset for r in rejects.collect()) == [2, 3, 4]

    records = {r.key: r for r in dlq_records(rejects).collect()}
    assert set(records) == {"k2", "k3"}
    assert records["k2"].topic == TOPICS["orders"] + ".dlq"
    assert bytes(records["k2"].value) == b"\x00\x02"
    assert [(h.key, bytes(h.value)) for h in records["k2"].headers] == [("reason", b"invalid_amount")]

    letters = {r.offset: r for r in dead_letter_rows(rejects).collect()}
    assert letters[2].event_id == "e2" and letters[2].payload == "AAI="
    assert letters[3].event_id is None and letters[3].payload is None
    assert letters[4].topic == "other.topic"


def test_kind_of_topic(spark):
    frame = spark.createDataFrame([(t,) for t in [*TOPICS.values(), "x", None]], "topic string")
    kinds = [r[0] for r in frame.select(kind_of_topic(frame.topic)).collect()]
    assert kinds == [*TOPICS, None, None]
