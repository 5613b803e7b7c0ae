"""Declared data model: topics, event contracts and table schemas.

Everything else in the package derives its column lists from here.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

# --- fixed values shared with producers and consumers of the topics ---------------------------
TOPICS = {
    "orders": "ecommerce.orders.v1",
    "payments": "ecommerce.payments.v1",
    "inventory": "ecommerce.inventory.v1",
    "clickstream": "ecommerce.clickstream.v1",
}
DLQ_SUFFIX = ".dlq"
DLQ_TOPICS = {topic: topic + DLQ_SUFFIX for topic in TOPICS.values()}

ORDER_STATUSES = ("created", "paid", "cancelled", "fulfilled")
PAYMENT_STATUSES = ("authorized", "captured", "failed")
INVENTORY_REASONS = ("sale", "restock", "adjustment")

DEFAULT_CURRENCY = "USD"
WATERMARK_LAG_MS = 30 * 60 * 1000
HOUR_MS = 3_600_000
MAX_FAILURE_RATE = 0.8
MAX_WATERMARK_AGE_S = 900.0
MAX_UNPAID_RATIO = 0.5

WIRE_MAGIC = 0
WIRE_HEADER_BYTES = 5

# --- event contracts: (field, type); a tuple is an enum, a trailing "?" a nullable field -------
_ORDER_V1 = (
    ("event_id", "string"),
    ("trace_id", "string"),
    ("order_id", "string"),
    ("customer_id", "string"),
    ("status", ORDER_STATUSES),
    ("amount_cents", "long"),
    ("currency", "string"),
    ("sku", "string"),
    ("quantity", "int"),
    ("event_ts", "long"),
)
CONTRACTS = {
    "orders": _ORDER_V1,
    "orders_v11": _ORDER_V1 + (("coupon_code", "string?"),),
    "payments": (
        ("event_id", "string"),
        ("trace_id", "string"),
        ("payment_id", "string"),
        ("order_id", "string"),
        ("status", PAYMENT_STATUSES),
        ("amount_cents", "long"),
        ("currency", "string"),
        ("event_ts", "long"),
    ),
    "inventory": (
        ("event_id", "string"),
        ("trace_id", "string"),
        ("sku", "string"),
        ("warehouse_id", "string"),
        ("quantity", "int"),
        ("reason", INVENTORY_REASONS),
        ("event_ts", "long"),
    ),
    "clickstream": (
        ("event_id", "string"),
        ("trace_id", "string"),
        ("session_id", "string"),
        ("customer_id", "string?"),
        ("page", "string"),
        ("sku", "string?"),
        ("event_ts", "long"),
    ),
}
RECORD_NAMES = {
    "orders": ("OrderEvent", "OrderStatus"),
    "orders_v11": ("OrderEvent", "OrderStatus"),
    "payments": ("PaymentEvent", "PaymentStatus"),
    "inventory": ("InventoryEvent", "InventoryReason"),
    "clickstream": ("ClickstreamEvent", None),
}
FIELD_DEFAULTS = {"currency": DEFAULT_CURRENCY}

# The contract a reader of each kind expects, and the writer assumed when the schema id in the
# header is not registered.
READER_OF_KIND = {
    "orders": "orders_v11",
    "payments": "payments",
    "inventory": "inventory",
    "clickstream": "clickstream",
}
DEFAULT_WRITER_OF_KIND = {kind: kind for kind in TOPICS}

_SPARK_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType()}


def base_type(field_type) -> str:
    """Physical type of a contract field: ``string``, ``long`` or ``int``."""
    return "string" if isinstance(field_type, tuple) else field_type.rstrip("?")


def is_nullable(field_type) -> bool:
    return isinstance(field_type, str) and field_type.endswith("?")


def contract(name: str) -> T.StructType:
    """Spark schema of a contract."""
    return T.StructType(
        [T.StructField(f, _SPARK_TYPES[base_type(t)], is_nullable(t)) for f, t in CONTRACTS[name]]
    )


def contract_json(name: str) -> str:
    """The contract as Avro JSON, for ``from_avro`` / ``to_avro``."""
    record, enum = RECORD_NAMES[name]
    fields = []
    for field, ftype in CONTRACTS[name]:
        if isinstance(ftype, tuple):
            spec = {"name": field, "type": {"type": "enum", "name": enum, "symbols": list(ftype)}}
        elif is_nullable(ftype):
            spec = {"name": field, "type": ["null", base_type(ftype)], "default": None}
        else:
            spec = {"name": field, "type": ftype}
            if field in FIELD_DEFAULTS:
                spec["default"] = FIELD_DEFAULTS[field]
        fields.append(spec)
    return json.dumps({"type": "record", "name": record, "fields": fields})


# --- one wide row for every kind of event ------------------------------------------------------
# ``reason`` is taken by the rejection reason, so the inventory field travels as ``stock_reason``.
WIDE_NAME = {"reason": "stock_reason"}


def _wide_fields() -> T.StructType:
    seen: dict[str, T.DataType] = {}
    for fields in CONTRACTS.values():
        for field, ftype in fields:
            seen.setdefault(WIDE_NAME.get(field, field), _SPARK_TYPES[base_type(ftype)])
    return T.StructType([T.StructField(f, t, True) for f, t in seen.items()])


EVENT_FIELDS = _wide_fields()

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("kafka_ts", T.TimestampType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("dt", T.StringType()),
    ]
)

SILVER_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("payment_status", T.StringType()),
        T.StructField("amount_cents", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("warehouse_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("coupon_code", T.StringType()),
        T.StructField("event_ts", T.LongType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("topic", T.StringType()),
    ]
)
# Fields the serving tables need that the silver row of the data model leaves out.
SILVER_EXTRA = T.StructType(
    [
        T.StructField("payment_id", T.StringType()),
        T.StructField("payment_event_id", T.StringType()),
        T.StructField("stock_reason", T.StringType()),
    ]
)

QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("event_id", T.StringType()),
    ]
)

# --- serving tables: key columns and schema ----------------------------------------------------
SERVING_KEYS = {
    "fact_orders": ("event_id",),
    "fact_payments": ("event_id",),
    "gold_hourly_gmv": ("hour_ts", "currency"),
    "gold_payment_stats": ("hour_ts",),
    "gold_stockouts": ("sku", "warehouse_id", "event_id"),
    "pipeline_watermarks": ("job_name",),
}
_COLUMN_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def _columns(text: str) -> T.StructType:
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _COLUMN_TYPES[kind]) for name, kind in pairs])


SERVING_SCHEMAS = {
    "fact_orders": _columns(
        "event_id string, order_id string, customer_id string, status string,"
        " payment_status string, amount_cents bigint, currency string, coupon_code string,"
        " event_ts timestamp, ingest_ts timestamp, kafka_partition int, kafka_offset bigint,"
        " updated_at timestamp"
    ),
    "fact_payments": _columns(
        "event_id string, payment_id string, order_id string, status string,"
        " amount_cents bigint, currency string, event_ts timestamp, updated_at timestamp"
    ),
    "gold_hourly_gmv": _columns(
        "hour_ts timestamp, currency string, gmv_cents bigint, order_count bigint,"
        " updated_at timestamp"
    ),
    "gold_payment_stats": _columns(
        "hour_ts timestamp, paid_count bigint, failed_count bigint, failure_rate double,"
        " updated_at timestamp"
    ),
    "gold_stockouts": _columns(
        "sku string, warehouse_id string, quantity int, event_id string, event_ts timestamp"
    ),
    "pipeline_watermarks": _columns(
        "job_name string, last_batch_id bigint, last_event_ts timestamp, rows_written bigint,"
        " updated_at timestamp"
    ),
}
