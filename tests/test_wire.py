"""Wire header, decoding and encoding."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.contracts import EVENT_FIELDS, TOPICS, contract, contract_json
from merchlake.functions import wire
from merchlake.operators.wire_codec import conform_to_reader, decode_wire, encode_events

ORDER = dict(
    kind="orders", topic=TOPICS["orders"], event_id="e1", trace_id="t1", order_id="o1", customer_id="c1",
    status="created", amount_cents=1999, currency="USD", sku="SKU-TEE-001", quantity=1,
    event_ts=1_700_000_000_000,
)
# The same order, written out by hand: lengths and numbers are zig-zag variable-length integers.
ORDER_BYTES = bytes.fromhex("0000000007") + b"".join(
    [b"\x04e1", b"\x04t1", b"\x04o1", b"\x04c1", b"\x00", b"\x9e\x1f", b"\x06USD", b"\x16SKU-TEE-001", b"\x02",
     b"\x80\xa0\xab\xfe\xf9\x62"]
)
SCHEMA = T.StructType([*EVENT_FIELDS]).add("kind", "string").add("topic", "string").add("n", "integer")


def encode(spark, rows, writer="orders", schema_id=7):
    frame = spark.createDataFrame([{**r, "n": i} for i, r in enumerate(rows)], SCHEMA)
    return encode_events(frame, F.lit(writer), F.lit(schema_id)).select("n", "topic", "value")


def wire_rows(spark, values, topic=TOPICS["orders"]):
    rows = [(i, topic, None if v is None else bytearray(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n int, topic string, value binary")


def decoded(frame, writers=None):
    return {r.n: r for r in decode_wire(frame, writers).collect()}


def test_known_bytes(spark):
    assert bytes(encode(spark, [ORDER]).first().value) == ORDER_BYTES
    row = decoded(wire_rows(spark, [ORDER_BYTES, ORDER_BYTES + b"trailing"]))
    for n in (0, 1):
        assert row[n].reason is None and row[n].schema_id == 7
        assert {k: row[n][k] for k in ORDER if k != "topic"} == {k: v for k, v in ORDER.items() if k != "topic"}


def test_header_reasons(spark):
    values = [None, b"", b"\x01", b"\x00\x00", b"\x00\x00\x00\x00\x01"]
    frame = wire_rows(spark, values)
    got = frame.select(wire.header_reason(F.col("value")), wire.schema_id(F.col("value"))).collect()
    assert [r[0] for r in got] == [wire.NOT_WIRE] * 3 + [wire.TRUNCATED, None]
    assert [r[1] for r in got] == [None] * 4 + [1]


def test_poison_and_damage(spark):
    values = [
        b"\x00\x00\x00\x00\x01not-avro",
        ORDER_BYTES[:-1],
        ORDER_BYTES.replace(b"\x04c1\x00", b"\x04c1\x10"),  # no such status
        ORDER_BYTES.replace(b"\x04e1", b"\x04\xff\xfe"),  # not UTF-8
        ORDER_BYTES[:5] + b"\xff" * 11,
        ORDER_BYTES[:5],
        ORDER_BYTES[:5] + b"\x03",  # negative length
        ORDER_BYTES,
        b"\x01\x02",
    ]
    rows = decoded(wire_rows(spark, values))
    assert [rows[i].reason for i in range(7)] == ["decode_error"] * 7
    assert rows[7].reason is None and rows[7].order_id == "o1"
    assert rows[8].reason == wire.NOT_WIRE
    assert decoded(wire_rows(spark, [ORDER_BYTES], "x"))[0].reason == "unknown_topic"


def test_older_order_read_by_newer_reader(spark):
    row = decoded(encode(spark, [{**ORDER, "amount_cents": 500}], schema_id=1), {1: "orders", 2: "orders_v11"})[0]
    assert row.coupon_code is None and row.amount_cents == 500 and row.reason is None


def test_newer_order_keeps_its_coupon(spark):
    sent = encode(spark, [{**ORDER, "coupon_code": "C"}, ORDER], "orders_v11", 2)
    rows = decoded(sent, {1: "orders", 2: "orders_v11"})
    assert [rows[0].coupon_code, rows[1].coupon_code] == ["C", None]


def test_what_cannot_be_encoded_is_null(spark):
    values = [r.value for r in encode(spark, [{**ORDER, "status": "bogus"}, {**ORDER, "sku": None}]).collect()]
    assert values == [None, None]


def test_conform_to_reader(spark):
    first = spark.createDataFrame([], contract("orders"))
    assert conform_to_reader(first, contract("orders_v11")).schema.names == contract("orders_v11").names
    plain = spark.range(1).selectExpr("'e' AS event_id")
    row = conform_to_reader(plain, contract("payments"), {"currency": "USD"}).first()
    assert row.currency == "USD" and row.event_id == "e" and row.amount_cents is None


@pytest.mark.parametrize("name", ["orders", "orders_v11", "payments", "inventory", "clickstream"])
def test_contracts(name):
    import json

    spec = json.loads(contract_json(name))
    fields = {f["name"]: f for f in spec["fields"]}
    assert spec["type"] == "record" and {"event_id", "event_ts"} <= set(fields)
    if name == "orders_v11":
        assert fields["coupon_code"] == {"name": "coupon_code", "type": ["null", "string"], "default": None}


texts = st.text(st.characters(codec="utf-8"), max_size=200)
clicks = st.fixed_dictionaries(
    dict(event_id=texts, trace_id=texts, session_id=texts, page=texts, customer_id=st.none() | texts,
         sku=st.none() | texts, event_ts=st.integers(-(2**63), 2**63 - 1))
)


@settings(max_examples=5, deadline=None)
@given(st.lists(clicks, min_size=1, max_size=40))
def test_round_trip_of_any_click(spark, rows):
    topic = {"kind": "clickstream", "topic": TOPICS["clickstream"]}
    back = decoded(encode(spark, [{**r, **topic} for r in rows], "clickstream", 5))
    assert [{k: back[i][k] for k in r} for i, r in enumerate(rows)] == rows
