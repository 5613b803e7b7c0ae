"""Expected results of the catalog queries as DuckDB SQL.

Only the derived input tables share their mapping with the Spark side; every operator is stated
here on its own. Timestamps are epoch millis, bytes are hex.
"""

from __future__ import annotations

import re

from merchlake import fixtures as fx
from merchlake.catalog import batch_queries as bq
from merchlake.catalog.stream_queries import SILVER_LAG_MS
from merchlake.contracts import EVENT_FIELDS, HOUR_MS, TOPICS, WATERMARK_LAG_MS

H = HOUR_MS
_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER"}
_TOPIC_LIST = ", ".join(f"'{t}'" for t in TOPICS.values())

ORDER_REASON = """CASE
    WHEN coalesce(event_id, '') = '' OR coalesce(order_id, '') = '' THEN 'missing_keys'
    WHEN amount_cents IS NULL OR amount_cents < 0 THEN 'invalid_amount'
    WHEN status IS NULL OR status NOT IN ('created', 'paid', 'cancelled', 'fulfilled') THEN 'invalid_status'
    WHEN quantity IS NULL OR quantity < 1 THEN 'invalid_quantity' END"""
PAYMENT_REASON = """CASE
    WHEN coalesce(event_id, '') = '' OR coalesce(order_id, '') = '' THEN 'missing_keys'
    WHEN status IS NULL OR status NOT IN ('authorized', 'captured', 'failed') THEN 'invalid_status'
    WHEN amount_cents IS NULL OR amount_cents < 0 THEN 'invalid_amount' END"""
INVENTORY_REASON = """CASE
    WHEN coalesce(event_id, '') = '' OR coalesce(sku, '') = '' OR coalesce(warehouse_id, '') = ''
    THEN 'missing_keys' WHEN quantity IS NULL THEN 'invalid_quantity' END"""
CLICK_REASON = """CASE
    WHEN coalesce(event_id, '') = '' OR coalesce(session_id, '') = '' OR coalesce(page, '') = ''
    THEN 'missing_keys' END"""
RULE = f"""CASE kind WHEN 'orders' THEN {ORDER_REASON} WHEN 'payments' THEN {PAYMENT_REASON}
    WHEN 'inventory' THEN {INVENTORY_REASON} ELSE {CLICK_REASON} END"""

# A zero-row table that fixes name and type of every wide column.
_SHAPE = "shape AS (SELECT " + ", ".join(
    f"CAST(NULL AS {_SQL_TYPES[f.dataType.simpleString()]}) AS {f.name}" for f in EVENT_FIELDS
) + " LIMIT 0)"


def _union(name: str, tables) -> str:
    return f"{name} AS (SELECT * FROM shape UNION ALL BY NAME " + " UNION ALL BY NAME ".join(
        f"SELECT * FROM {t}" for t in tables
    ) + ")"


KEY = "coalesce(order_id, sku, event_id)"
PAYLOAD = f"encode(concat_ws('|', kind, event_id, {KEY}))"
WAVE_MS = f"({fx.EPOCH_2024_MS} + (wave + 1)::BIGINT * {fx.WAVE_DAYS * fx.DAY_MS})"
DT = f"strftime(make_timestamp({WAVE_MS} * 1000), '%Y-%m-%d')"
CURRENCY = "coalesce(nullif(currency, ''), 'USD')"
HOUR = f"event_ts - (event_ts % {H} + {H}) % {H}"

STATIC = (
    [
        *fx.oracle_ctes(*fx.TABLES),
        _SHAPE,
        _union("everything", fx.TABLES),
        f"checked AS (SELECT *, {RULE} AS reason FROM everything)",
        "good AS (SELECT * FROM checked WHERE reason IS NULL)",
        """uniq AS (SELECT * FROM good QUALIFY row_number() OVER (
            PARTITION BY kind, event_id ORDER BY topic, partition, offset) = 1)""",
        "good_orders AS (SELECT * FROM uniq WHERE kind = 'orders')",
        "good_payments AS (SELECT * FROM uniq WHERE kind = 'payments')",
        """latest AS (SELECT * FROM good_payments QUALIFY row_number() OVER (
            PARTITION BY order_id ORDER BY coalesce(event_ts, 0) DESC, offset DESC, event_id) = 1)""",
        f"""facts AS (SELECT o.event_id, o.order_id, o.customer_id, o.status, p.status AS payment_status,
            o.amount_cents::BIGINT AS amount_cents, coalesce(nullif(o.currency, ''), 'USD') AS currency,
            o.coupon_code, o.event_ts, {bq.AS_OF_MS}::BIGINT AS ingest_ts,
            o.partition AS kafka_partition, o.offset AS kafka_offset
            FROM good_orders o LEFT JOIN latest p ON o.order_id = p.order_id)""",
        f"""pay_facts AS (SELECT event_id, payment_id, order_id, status, amount_cents::BIGINT AS amount_cents,
            {CURRENCY} AS currency, event_ts FROM good_payments)""",
    ]
)
DELIVERED = (
    [
        *fx.oracle_ctes(*fx.DELIVERIES),
        _SHAPE,
        _union("everything", fx.DELIVERIES),
        f"""checked AS (SELECT *, CASE WHEN topic NOT IN ({_TOPIC_LIST}) THEN 'unknown_topic'
            WHEN poison = 1 THEN 'decode_error' ELSE {RULE} END AS reason FROM everything)""",
        "good AS (SELECT * FROM checked WHERE reason IS NULL)",
    ]
)


def _needed(ctes: list[str], select: str) -> str:
    """The statement with those of the CTEs that it uses, shared ones computed once."""
    texts = {re.match(r"\w+", c)[0]: c for c in ctes}
    uses = {name: {n for n in re.findall(r"\w+", text) if n in texts and n != name} for name, text in texts.items()}
    wanted: set[str] = set()
    waiting = [n for n in set(re.findall(r"\w+", select)) if n in texts]
    while waiting:
        name = waiting.pop()
        if name not in wanted:
            wanted.add(name)
            waiting.extend(uses[name])
    readers = [select, *(texts[n] for n in wanted)]
    shared = {n for n in wanted if sum(len(re.findall(rf"\b{n}\b", t)) for t in readers) > 2}
    # Both sides of the join by order id, which else would be planned anew inside it.
    shared |= wanted & {"good_orders", "good_payments", "latest", "facts"}
    parts = [re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", c) if n in shared else c for n, c in texts.items() if n in wanted]
    return "WITH " + ",\n".join(parts) + "\n" + select if parts else select


def static(select: str, *extra: str) -> str:
    return _needed([*STATIC, *extra], select)


def delivered(select: str, *extra: str) -> str:
    return _needed([*DELIVERED, *extra], select)


def _gmv(source: str) -> str:
    return f"""SELECT {HOUR} AS hour_ts_ms, {CURRENCY} AS currency,
        sum(amount_cents)::BIGINT AS gmv_cents, count(*) AS order_count
        FROM {source} WHERE status IS DISTINCT FROM 'cancelled' GROUP BY ALL"""


def _stats(source: str) -> str:
    return f"""SELECT {HOUR} AS hour_ts_ms,
        count(*) FILTER (WHERE status IS DISTINCT FROM 'failed') AS paid_count,
        count(*) FILTER (WHERE status = 'failed') AS failed_count,
        CASE WHEN count(*) = 0 THEN 0.0::DOUBLE
             ELSE (count(*) FILTER (WHERE status = 'failed'))::DOUBLE / count(*)::DOUBLE END AS failure_rate
        FROM {source} GROUP BY ALL"""


def _silver_ctes(scope: str, lag_ms: int) -> list[str]:
    """Silver rows of each batch; ``scope`` lists the batch columns, empty for a single batch."""
    by = f"{scope}, " if scope else ""
    newest = f"SELECT {by}max(event_ts) AS newest FROM good" + (f" GROUP BY {scope}" if scope else "")
    same = f"USING ({scope})" if scope else "ON true"
    match = "p.wave = k.wave AND" if scope else ""
    return [
        f"newest AS ({newest})",
        f"""unique_rows AS (SELECT * FROM good QUALIFY row_number() OVER (
            PARTITION BY {by}kind, event_id ORDER BY topic, partition, offset) = 1)""",
        f"kept AS (SELECT u.* FROM unique_rows u JOIN newest n {same} WHERE event_ts >= n.newest - {lag_ms})",
        f"""last_paid AS (SELECT * FROM kept WHERE kind = 'payments' QUALIFY row_number() OVER (
            PARTITION BY {by}order_id
            ORDER BY event_ts DESC, partition DESC, offset DESC, event_id) = 1)""",
        f"""silver AS (SELECT k.*, p.status AS payment_status FROM kept k LEFT JOIN last_paid p
            ON {match} k.kind = 'orders' AND p.order_id = k.order_id)""",
    ]


SILVER_COLUMNS = f"""kind, event_id, trace_id, order_id, customer_id, status, payment_status,
    amount_cents::BIGINT AS amount_cents, currency, sku, quantity::INTEGER AS quantity, warehouse_id,
    session_id, page, coupon_code, event_ts, {WAVE_MS} AS ingest_ts, partition AS kafka_partition,
    offset AS kafka_offset, topic"""

_FACT_BATCHES = [
    f"stored AS (SELECT * FROM facts WHERE event_ts < {bq.ORDERS_STORED_BEFORE_MS})",
    f"""resent AS (SELECT * REPLACE (CASE WHEN status = 'created' THEN 'paid' ELSE status END AS status,
    CAST(NULL AS VARCHAR) AS payment_status, amount_cents + 100 AS amount_cents, 'LATE' AS coupon_code,
    'CHF' AS currency, kafka_offset + 1 AS kafka_offset)
    FROM facts WHERE event_ts >= {bq.ORDERS_RESENT_SINCE_MS})""",
]


def _two(source_kind: str) -> str:
    """Stored rows and batch rows of a two-batch merge, each deduplicated on its own."""
    return f"""two AS (SELECT * FROM good WHERE kind = '{source_kind}' QUALIFY row_number() OVER (
        PARTITION BY partition = 0, event_id ORDER BY topic, partition, offset) = 1)"""


_UPDATED = f"max(CASE WHEN partition = 0 THEN {bq.MERGED_AT_MS} ELSE {bq.AS_OF_MS} END)::BIGINT AS updated_at"

_REPORT = """
SELECT 'gold_not_empty' AS name, n > 0 AS passed, n::DOUBLE AS actual, '> 0' AS expected, '' AS detail FROM counts
UNION ALL SELECT 'fact_orders_unique_event_id', n = 0 OR ids::DOUBLE / n = 1.0,
    CASE WHEN n = 0 THEN 1.0 ELSE ids::DOUBLE / n END, '== 1.0', '' FROM counts
UNION ALL SELECT 'gmv_non_negative', lowest IS NULL OR lowest >= 0, lowest::DOUBLE, '>= 0', '' FROM counts
UNION ALL SELECT 'payment_failure_rate_bounded', highest IS NULL OR highest <= 0.8, highest, '<= 0.8', '' FROM counts
UNION ALL SELECT 'gold_watermark_fresh', age <= 900, age, '<= 900s', '' FROM counts"""


def _counts(rows: str, gmv: str, stats: str, age: int) -> list[str]:
    return [
        f"gmv AS ({gmv})",
        f"stats AS ({stats})",
        f"""counts AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, (SELECT min(gmv_cents) FROM gmv) AS lowest,
    (SELECT max(failure_rate) FROM stats) AS highest, {age}::DOUBLE AS age FROM {rows})""",
    ]


def _batch_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["bronze_envelope"] = delivered(
        f"""SELECT topic, partition, offset, {WAVE_MS} AS kafka_ts, {KEY} AS key, hex({PAYLOAD}) AS value,
        {WAVE_MS} AS ingest_ts, {DT} AS dt FROM everything"""
    )
    out["bronze_scan"] = delivered(
        f"""SELECT topic, {DT} AS dt, count(*) AS n_rows, max(offset) AS max_offset,
        sum(octet_length({PAYLOAD}))::BIGINT AS n_bytes FROM everything
        WHERE topic IN ('{TOPICS["orders"]}', '{TOPICS["payments"]}') GROUP BY ALL"""
    )
    out["topic_kind"] = delivered(
        f"""SELECT topic, event_id, offset,
        CASE WHEN topic IN ({_TOPIC_LIST}) THEN kind END AS found_kind FROM everything"""
    )
    out["wire_header"] = f"""SELECT event_id,
        CASE WHEN value IS NULL OR octet_length(value) = 0 OR hex(value)[1:2] <> '00' THEN 'not_confluent_avro'
             WHEN octet_length(value) < 5 THEN 'truncated_confluent_header' END AS reason,
        CASE WHEN octet_length(value) >= 5 AND hex(value)[1:2] = '00'
             THEN ('0x' || hex(value)[3:10])::BIGINT END AS schema_id
        FROM (SELECT event_id, {fx.WIRE_EXPR} AS value FROM events)"""
    blank = ", ".join(
        f"CASE WHEN lost THEN NULL ELSE {f.name}::{_SQL_TYPES[f.dataType.simpleString()]} END AS {f.name}"
        for f in EVENT_FIELDS
    )
    out["wire_decode"] = delivered(
        f"""SELECT topic, partition, offset, CASE WHEN topic IN ({_TOPIC_LIST}) THEN kind END AS kind,
        CASE WHEN poison = 1 THEN 1 WHEN kind = 'orders' AND coupon_code IS NOT NULL THEN 2
             WHEN kind = 'orders' THEN 1 WHEN kind = 'payments' THEN 3 WHEN kind = 'inventory' THEN 4
             ELSE 5 END::BIGINT AS schema_id, {blank},
        CASE WHEN topic NOT IN ({_TOPIC_LIST}) THEN 'unknown_topic' WHEN poison = 1 THEN 'decode_error' END AS reason
        FROM (SELECT *, topic NOT IN ({_TOPIC_LIST}) OR poison = 1 AS lost FROM everything)"""
    )
    typed = ", ".join(
        f"CASE WHEN kind IN ('orders', 'payments') THEN {CURRENCY} END AS currency"
        if f.name == "currency"
        else f"{f.name}::{_SQL_TYPES[f.dataType.simpleString()]} AS {f.name}"
        for f in EVENT_FIELDS
    )
    out["wire_roundtrip"] = static(
        f"SELECT topic, partition, offset, {typed}, CAST(NULL AS VARCHAR) AS reason FROM good"
    )
    out["evolve_orders"] = static(
        """SELECT event_id, trace_id, order_id, customer_id, status, amount_cents::BIGINT AS amount_cents,
        currency, sku, quantity::INTEGER AS quantity, event_ts, CAST(NULL AS VARCHAR) AS coupon_code
        FROM orders_ev"""
    )
    for name, kind, columns in (
        ("validate_orders", "orders", "order_id, status, amount_cents::BIGINT AS amount_cents, quantity"),
        ("validate_payments", "payments", "order_id, status, amount_cents::BIGINT AS amount_cents"),
        ("validate_inventory", "inventory", "sku, warehouse_id, quantity"),
        ("validate_clicks", "clickstream", "session_id, page"),
    ):
        out[name] = static(f"SELECT event_id, offset, {columns}, reason FROM checked WHERE kind = '{kind}'")
    out["accepted"] = static(
        """SELECT kind, topic, partition, offset, event_id, status, amount_cents::BIGINT AS amount_cents,
        event_ts FROM good"""
    )
    out["quarantine"] = static(
        f"""SELECT topic, reason, {KEY} AS key, hex({PAYLOAD}) AS value, {bq.AS_OF_MS}::BIGINT AS ingest_ts,
        partition, offset, event_id FROM checked WHERE reason IS NOT NULL"""
    )
    out["dlq_route"] = delivered(
        f"""SELECT topic || '.dlq' AS topic, {KEY} AS key, hex({PAYLOAD}) AS value, reason FROM checked
        WHERE reason IS NOT NULL AND topic IN ({_TOPIC_LIST})"""
    )
    out["dead_letters"] = delivered(
        f"""SELECT topic, partition, offset, nullif(event_id, '') AS event_id, reason,
        to_base64({PAYLOAD}) AS payload, {WAVE_MS} AS observed_at FROM checked WHERE reason IS NOT NULL"""
    )
    out["silver_flatten"] = static(
        """SELECT kind, event_id, trace_id, order_id, customer_id, status, CAST(NULL AS VARCHAR) AS payment_status,
        amount_cents::BIGINT AS amount_cents, currency, sku, quantity::INTEGER AS quantity, warehouse_id,
        session_id, page, coupon_code, event_ts, """
        + f"""{bq.AS_OF_MS}::BIGINT AS ingest_ts, partition AS kafka_partition, offset AS kafka_offset,
        topic FROM good"""
    )
    out["silver_union"] = delivered(
        f"SELECT {SILVER_COLUMNS} FROM silver", *_silver_ctes("", bq.UNION_LAG_MS)
    )
    out["dedupe_events"] = static(
        "SELECT event_id, order_id, offset, status, amount_cents::BIGINT AS amount_cents FROM good_payments"
    )
    out["drop_late"] = delivered(
        f"""SELECT kind, event_id, offset, event_ts FROM everything
        WHERE event_ts >= (SELECT max(event_ts) FROM everything) - {bq.DROP_LAG_MS}"""
    )
    out["orders_latest_payment"] = static(
        """SELECT o.event_id, o.order_id, o.status, p.status AS payment_status, p.event_id AS payment_event_id
        FROM good_orders o LEFT JOIN latest p ON o.order_id = p.order_id"""
    )
    out["unpaid_orders"] = static(
        """SELECT o.event_id, o.order_id, o.status, o.amount_cents::BIGINT AS amount_cents FROM good o
        WHERE o.kind = 'orders' AND o.status <> 'cancelled' AND NOT EXISTS (
            SELECT 1 FROM good p WHERE p.kind = 'payments' AND p.order_id = o.order_id)"""
    )
    out["hourly_gmv"] = static(_gmv("good_orders"))
    out["payment_stats"] = static(_stats("good_payments"))
    out["stockouts"] = static(
        """SELECT sku, warehouse_id, coalesce(quantity, 0)::INTEGER AS quantity, event_id, event_ts
        FROM good WHERE kind = 'inventory' AND coalesce(quantity, 0) <= 0"""
    )
    out["fact_orders"] = static("SELECT * FROM facts")
    out["fact_payments"] = static("SELECT * FROM pay_facts")
    out["gmv_last_24h"] = delivered(
        f"""SELECT hour_ts_ms AS hour_ts, currency, gmv_cents, order_count
        FROM ({_gmv("unique_orders")}) WHERE hour_ts_ms >= {bq.AS_OF_MS - 24 * H}
        ORDER BY hour_ts DESC""",
        """unique_orders AS (SELECT * FROM good WHERE kind = 'orders' QUALIFY row_number() OVER (
            PARTITION BY event_id ORDER BY topic, partition, offset) = 1)""",
    )
    out["rebuild_gmv"] = static(
        f"""SELECT {HOUR} AS hour_ts, currency, sum(amount_cents)::BIGINT AS gmv_cents, count(*) AS order_count
        FROM facts WHERE status <> 'cancelled' GROUP BY ALL"""
    )
    out["rebuild_payment_stats"] = static(
        f"""SELECT {HOUR} AS hour_ts, count(*) FILTER (WHERE status <> 'failed') AS paid_count,
        count(*) FILTER (WHERE status = 'failed') AS failed_count,
        (count(*) FILTER (WHERE status = 'failed'))::DOUBLE / count(*) AS failure_rate
        FROM pay_facts GROUP BY ALL"""
    )
    first = ("order_id", "customer_id", "currency", "event_ts", "ingest_ts", "kafka_partition", "kafka_offset")
    last = ("status", "payment_status", "amount_cents", "coupon_code")
    out["upsert_fact_orders"] = static(
        "SELECT coalesce(s.event_id, r.event_id) AS event_id, "
        + ", ".join(f"CASE WHEN s.event_id IS NOT NULL THEN s.{c} ELSE r.{c} END AS {c}" for c in first)
        + ", "
        + ", ".join(f"CASE WHEN r.event_id IS NOT NULL THEN r.{c} ELSE s.{c} END AS {c}" for c in last)
        + f""", CASE WHEN r.event_id IS NOT NULL THEN {bq.AS_OF_MS} ELSE {bq.MERGED_AT_MS} END::BIGINT AS updated_at
        FROM stored s FULL JOIN resent r ON s.event_id = r.event_id""",
        *_FACT_BATCHES,
    )
    out["refresh_gmv"] = static(
        f"""SELECT {HOUR} AS hour_ts, currency, sum(amount_cents)::BIGINT AS gmv_cents, count(*) AS order_count,
        CASE WHEN {HOUR} >= {bq.ORDERS_RESENT_SINCE_MS} THEN {bq.AS_OF_MS} ELSE {bq.MERGED_AT_MS} END::BIGINT AS updated_at
        FROM (SELECT coalesce(s.event_ts, r.event_ts) AS event_ts, coalesce(s.currency, r.currency) AS currency,
            coalesce(r.status, s.status) AS status, coalesce(r.amount_cents, s.amount_cents) AS amount_cents
            FROM stored s FULL JOIN resent r ON s.event_id = r.event_id)
        WHERE status <> 'cancelled' GROUP BY ALL""",
        *_FACT_BATCHES,
    )
    first = ("payment_id", "order_id", "amount_cents", "currency", "event_ts")
    out["upsert_fact_payments"] = static(
        "SELECT coalesce(s.event_id, r.event_id) AS event_id, "
        + ", ".join(f"CASE WHEN s.event_id IS NOT NULL THEN s.{c} ELSE r.{c} END AS {c}" for c in first)
        + f""", coalesce(r.status, s.status) AS status,
        CASE WHEN r.event_id IS NOT NULL THEN {bq.AS_OF_MS} ELSE {bq.MERGED_AT_MS} END::BIGINT AS updated_at
        FROM (SELECT * FROM two WHERE early) s FULL JOIN (SELECT * FROM two WHERE NOT early) r
        ON s.event_id = r.event_id""",
        f"""two AS (SELECT event_id, payment_id, order_id, status, amount_cents::BIGINT AS amount_cents,
            {CURRENCY} AS currency, event_ts, event_ts < {bq.PAYMENTS_SPLIT_MS} AS early
            FROM good WHERE kind = 'payments' QUALIFY row_number() OVER (
            PARTITION BY early, event_id ORDER BY topic, partition, offset) = 1)""",
    )
    out["merge_hourly_gmv"] = static(
        f"""SELECT {HOUR} AS hour_ts, {CURRENCY} AS currency, sum(amount_cents)::BIGINT AS gmv_cents,
        count(*) AS order_count, {_UPDATED} FROM two WHERE status <> 'cancelled' GROUP BY 1, 2""",
        _two("orders"),
    )
    out["merge_payment_stats"] = static(
        f"""SELECT {HOUR} AS hour_ts, count(*) FILTER (WHERE status <> 'failed') AS paid_count,
        count(*) FILTER (WHERE status = 'failed') AS failed_count,
        (count(*) FILTER (WHERE status = 'failed'))::DOUBLE / count(*) AS failure_rate, {_UPDATED}
        FROM two GROUP BY 1""",
        _two("payments"),
    )
    out["insert_new_stockouts"] = static(
        f"""SELECT sku, warehouse_id,
        CASE WHEN event_ts < {bq.STOCK_STORED_BEFORE_MS} THEN quantity ELSE -99 END::INTEGER AS quantity,
        event_id, event_ts FROM good WHERE kind = 'inventory' AND quantity <= 0"""
    )
    out["job_watermark"] = static(
        f"""SELECT 'gold' AS job_name, 1::BIGINT AS last_batch_id,
        (SELECT max(event_ts) FROM facts WHERE event_ts >= {bq.ORDERS_STORED_BEFORE_MS}) AS last_event_ts,
        (SELECT count(*) FROM facts) AS rows_written, {bq.AS_OF_MS}::BIGINT AS updated_at"""
    )
    out["key_uniqueness"] = static(
        "SELECT count(*) AS row_count, count(DISTINCT event_id) AS distinct_ids FROM good WHERE kind = 'payments'"
    )
    out["quality_report"] = static(
        _REPORT, *_counts("facts", _gmv("good_orders"), _stats("good_payments"), 600)
    )
    out["quality_summary"] = static(
        """SELECT bool_and(passed) AS passed,
        coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT passed), '') AS failed FROM report""",
        "dup_payments AS (SELECT * FROM good WHERE kind = 'payments')",
        *_counts("dup_payments", _gmv("dup_payments"), _stats("dup_payments"), 3600),
        f"report AS ({_REPORT})",
    )
    failing = [
        "dup_payments AS (SELECT * FROM good WHERE kind = 'payments')",
        *_counts("dup_payments", _gmv("dup_payments"), _stats("dup_payments"), 3600),
        f"report AS ({_REPORT})",
    ]
    out["quality_results"] = static("SELECT name, passed, actual, expected, detail FROM report", *failing)
    out["quality_gates"] = static(
        """SELECT 'quality' AS gate, CASE WHEN NOT bool_or(passed) FILTER (WHERE name = 'gold_not_empty') THEN 'skipped'
            WHEN bool_and(passed) THEN 'passed' ELSE 'raised' END AS outcome FROM report
        UNION ALL SELECT 'reconcile', CASE WHEN unpaid::DOUBLE / n <= 0.5 THEN 'passed' ELSE 'raised' END
        FROM (SELECT (SELECT count(*) FROM facts) AS n, (SELECT count(*) FROM facts o
            LEFT JOIN pay_facts p ON p.order_id = o.order_id
            WHERE p.event_id IS NULL AND o.status <> 'cancelled') AS unpaid)""",
        *failing,
    )
    out["reconcile"] = static(
        """SELECT n AS fact_orders, (SELECT count(*) FROM pay_facts) AS fact_payments,
        unpaid AS unpaid_non_cancelled, (SELECT count(*) FROM checked WHERE reason IS NOT NULL) AS dead_letters,
        unpaid::DOUBLE / n AS unpaid_ratio_all_orders, unpaid::DOUBLE / n <= 0.5 AS passed
        FROM (SELECT (SELECT count(*) FROM facts) AS n, (SELECT count(*) FROM facts o
            LEFT JOIN pay_facts p ON p.order_id = o.order_id
            WHERE p.event_id IS NULL AND o.status <> 'cancelled') AS unpaid)"""
    )
    out["batch_metrics"] = delivered(
        f"""SELECT count(*) AS valid, (SELECT count(*) FROM checked WHERE reason IS NOT NULL) AS quarantined,
        (SELECT max(event_ts) FROM good) AS max_event_ts, count(*) FILTER (WHERE kind = 'orders') AS orders,
        (SELECT count(*) FROM (SELECT DISTINCT {HOUR}, {CURRENCY} FROM silver
            WHERE kind = 'orders' AND status <> 'cancelled')) AS gmv_buckets,
        count(*) FILTER (WHERE kind = 'inventory' AND quantity <= 0) AS stockouts FROM silver""",
        *_silver_ctes("", bq.UNION_LAG_MS),
    )
    out["topic_high_water"] = delivered(
        """SELECT topic, sum(end_offset)::BIGINT AS high_water FROM (
            SELECT topic, partition, max(offset) + 1 AS end_offset FROM everything GROUP BY ALL) GROUP BY ALL"""
    )
    out["consumer_lag"] = delivered(
        """SELECT consumer, topic, sum(end_offset - coalesce(position, first_offset))::BIGINT AS lag FROM (
            SELECT consumer, topic, partition, max(offset) + 1 AS end_offset, min(offset) AS first_offset,
                max(offset) FILTER (WHERE wave < waves) + 1 AS position
            FROM everything, (VALUES ('gold', 1), ('silver', 3)) AS c(consumer, waves) GROUP BY ALL)
        GROUP BY ALL"""
    )
    return out


def _stream_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["stream_bronze"] = delivered(
        f"""SELECT topic, partition, offset, {WAVE_MS} AS kafka_ts, {KEY} AS key, {WAVE_MS} AS ingest_ts,
        {DT} AS dt FROM everything"""
    )
    waves = _silver_ctes("wave", SILVER_LAG_MS)
    out["stream_silver"] = delivered(
        f"SELECT {SILVER_COLUMNS}, payment_id, {DT} AS dt, wave::BIGINT AS batch_id FROM silver", *waves
    )
    out["stream_quarantine"] = delivered(
        f"""SELECT topic, reason, {KEY} AS key, partition, offset,
        CASE WHEN reason NOT IN ('unknown_topic', 'decode_error') THEN event_id END AS event_id,
        {DT} AS dt, wave::BIGINT AS batch_id FROM checked WHERE reason IS NOT NULL"""
    )
    for name, last_batch in (
        ("stream_gold", fx.WAVES - 1),
        ("stream_gold_backlog", 0),
        ("stream_gold_replayed", fx.WAVES),
    ):
        out[name] = delivered(
            f"""SELECT 'fact_orders' AS table_name, o.event_id AS row_key,
                concat_ws('|', o.status, p.status, coalesce(nullif(o.currency, ''), 'USD'), o.coupon_code) AS label,
                o.amount_cents::BIGINT AS amount, o.offset::BIGINT AS number
            FROM silver_orders o LEFT JOIN paid p ON p.order_id = o.order_id
            UNION ALL SELECT 'fact_payments', event_id, concat_ws('|', payment_id, status), amount_cents::BIGINT, event_ts
            FROM silver WHERE kind = 'payments'
            UNION ALL SELECT 'gold_hourly_gmv', hour_ts_ms::VARCHAR, currency, gmv_cents, order_count
            FROM ({_gmv("silver_orders")})
            UNION ALL SELECT 'gold_payment_stats', hour_ts_ms::VARCHAR, NULL, paid_count, failed_count
            FROM ({_stats("silver_payments")})
            UNION ALL SELECT 'gold_stockouts', event_id, concat_ws('|', sku, warehouse_id), quantity::BIGINT, event_ts
            FROM silver WHERE kind = 'inventory' AND quantity <= 0
            UNION ALL SELECT 'pipeline_watermarks', 'gold', NULL, {last_batch}, count(*) FROM silver_orders""",
            *waves,
            "silver_orders AS (SELECT * FROM silver WHERE kind = 'orders')",
            "silver_payments AS (SELECT * FROM silver WHERE kind = 'payments')",
            """paid AS (SELECT * FROM silver_payments QUALIFY row_number() OVER (
                PARTITION BY order_id ORDER BY event_ts DESC, event_id) = 1)""",
        )
    out["stream_late_rows"] = delivered(
        f"""SELECT kind, event_id, event_ts, wave::BIGINT AS batch_id,
        CASE WHEN event_ts < newest - {WATERMARK_LAG_MS} THEN 'late' ELSE 'kept' END AS outcome
        FROM once JOIN marks USING (wave)""",
        """once AS (SELECT * FROM good QUALIFY row_number() OVER (
            PARTITION BY wave, kind, event_id ORDER BY topic, partition, offset) = 1)""",
        """marks AS (SELECT w.wave, (SELECT max(g.event_ts) FROM good g WHERE g.wave < w.wave) AS newest
            FROM (SELECT DISTINCT wave FROM good) w)""",
    )
    columns = "event_id, order_id, status, amount_cents::BIGINT AS amount_cents, event_ts"
    out["stream_dedupe"] = delivered(f"SELECT DISTINCT {columns} FROM orders_in WHERE event_id <> ''")
    out["stream_drop_late"] = delivered(
        f"""SELECT DISTINCT {columns} FROM orders_in o WHERE event_id <> '' AND (wave = 0 OR event_ts >=
            (SELECT m.newest FROM marks m WHERE m.wave = o.wave) - {WATERMARK_LAG_MS})""",
        """marks AS (SELECT w.wave, (SELECT max(i.event_ts) FROM orders_in i
            WHERE i.wave < w.wave AND i.event_id <> '') AS newest
            FROM (SELECT DISTINCT wave FROM orders_in) w)""",
    )
    # A wave moves the mark to the slowest or fastest of the four kinds it brings; a kind it does not bring holds still.
    out["stream_marks"] = delivered(
        f"""SELECT DISTINCT policy, kind, event_id, event_ts FROM arrived JOIN marks USING (wave)
        WHERE newest IS NULL OR event_ts >= newest - {WATERMARK_LAG_MS}""",
        f"""arrived AS (SELECT kind, event_id, event_ts,
            CASE WHEN kind = 'clickstream' THEN least({fx.WAVES - 1}, wave + 1) ELSE wave END AS wave
            FROM good WHERE event_id <> '')""",
        "ends AS (SELECT wave, kind, max(event_ts) AS ts FROM arrived GROUP BY ALL)",
        """moved AS (SELECT 'max' AS policy, wave, max(ts) AS ts FROM ends GROUP BY wave
            UNION ALL SELECT 'min', wave, min(ts) FROM ends GROUP BY wave HAVING count(*) = 4)""",
        """marks AS (SELECT policy, w.wave,
            (SELECT max(m.ts) FROM moved m WHERE m.policy = p.policy AND m.wave < w.wave) AS newest
            FROM (SELECT DISTINCT wave FROM arrived) w, (VALUES ('min'), ('max')) AS p(policy))""",
    )
    # A row is late when the mark of the waves before has passed the end of its hour.
    in_time = [
        """marks AS (SELECT w.wave, (SELECT max(s.event_ts) FROM sent s WHERE s.wave < w.wave) AS newest
            FROM (SELECT DISTINCT wave FROM sent) w)""",
        f"""rows_in AS (SELECT s.* FROM sent s JOIN marks m ON s.wave = m.wave WHERE m.newest IS NULL
            OR floor(s.event_ts / {H}.0) * {H} + {H} >= m.newest - {WATERMARK_LAG_MS})""",
    ]
    out["stream_hourly_gmv"] = delivered(
        f"SELECT hour_ts_ms AS hour_ts, currency, gmv_cents, order_count FROM ({_gmv('rows_in')})",
        "sent AS (SELECT * FROM good WHERE kind = 'orders' AND status <> 'cancelled')",
        *in_time,
    )
    out["stream_payment_stats"] = delivered(
        f"SELECT hour_ts_ms AS hour_ts, paid_count, failed_count, failure_rate FROM ({_stats('rows_in')})",
        "sent AS (SELECT * FROM good WHERE kind = 'payments')",
        *in_time,
    )
    out["stream_orders_payments"] = delivered(
        f"""SELECT o.event_id AS order_event_id, o.order_id, o.status AS order_status,
            p.event_id AS payment_event_id, p.status AS payment_status
        FROM (SELECT DISTINCT event_id, order_id, status, event_ts FROM good WHERE kind = 'orders') o
        LEFT JOIN (SELECT * FROM good WHERE kind = 'payments') p ON p.order_id = o.order_id
            AND p.event_ts BETWEEN o.event_ts - {WATERMARK_LAG_MS} AND o.event_ts + {WATERMARK_LAG_MS}
        QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY p.event_ts DESC NULLS LAST, p.event_id) = 1"""
    )
    return out


def oracle_sql() -> dict[str, str]:
    """Expected results by query name. ``offset`` is a reserved word there and gets quoted."""
    texts = {**_batch_sql(), **_stream_sql()}
    return {name: re.sub(r"\boffset\b", '"offset"', text) for name, text in texts.items()}
