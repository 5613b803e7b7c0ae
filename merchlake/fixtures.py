"""Event tables derived from the provided test tables.

Each expression list is valid in Spark SQL and in DuckDB, so both engines start from the same
input. Faults (missing keys, bad amounts, copies, late arrival, poison bytes) are part of the
mapping; every row of the source tables is used.

``MS(c)`` and the other upper-case helpers are replaced per engine by :func:`render`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.contracts import EVENT_FIELDS, TOPICS
from merchlake.operators.wire_codec import encode_events

EPOCH_2024_MS = 1_704_067_200_000
DAY_MS = 86_400_000
WAVES = 5
WAVE_DAYS = 6
UNKNOWN_TOPIC_NAME = "ecommerce.refunds.v1"
POISON_HEX = "00000000016e6f742d6176726f"
SCHEMA_IDS = {1: "orders", 2: "orders_v11", 3: "payments", 4: "inventory", 5: "clickstream"}

_ENGINES = {
    "spark": {"MS": "unix_millis(cast({} as timestamp))", "LIST": "array", "EXPLODE": "explode"},
    "duckdb": {"MS": "(epoch_us({})//1000)", "LIST": "list_value", "EXPLODE": "unnest"},
}


def render(text: str, engine: str) -> str:
    import re

    names = _ENGINES[engine]
    text = re.sub(r"MS\((\w+)\)", lambda m: names["MS"].format(m.group(1)), text)
    return text.replace("LIST(", names["LIST"] + "(").replace("EXPLODE(", names["EXPLODE"] + "(")


# --- tables over orders, lineitem and events ----------------------------------------------------
TABLES: dict[str, tuple[str, list[str]]] = {
    "orders_ev": (
        "orders",
        [
            "'orders' AS kind",
            f"'{TOPICS['orders']}' AS topic",
            "cast(o_orderkey % 3 as int) AS partition",
            "o_orderkey AS offset",
            "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'o-' || cast(o_orderkey as string) END AS event_id",
            "'t-' || cast(o_orderkey as string) AS trace_id",
            "cast(o_orderkey as string) AS order_id",
            "'cust-' || cast(o_custkey as string) AS customer_id",
            "CASE WHEN o_orderkey % 103 = 0 THEN 'bogus' WHEN o_orderstatus = 'O' THEN 'created'"
            " WHEN o_orderstatus = 'F' THEN 'fulfilled' ELSE 'cancelled' END AS status",
            "(CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE 1 END)"
            " * cast(round(o_totalprice * 100) as bigint) AS amount_cents",
            "CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'USD' END AS currency",
            "'SKU-' || cast(o_custkey % 20 as string) AS sku",
            "cast(o_orderkey % 5 as int) AS quantity",
            "MS(o_orderdate) + (o_orderkey % 24) * 3600000 AS event_ts",
        ],
    ),
    "payments_ev": (
        "lineitem",
        [
            "'payments' AS kind",
            f"'{TOPICS['payments']}' AS topic",
            "cast(l_orderkey % 3 as int) AS partition",
            # Lines may share order, number, part and supplier; the day tells them apart.
            "(l_partkey * 100000 + l_suppkey) * 100000 + cast(floor(MS(l_shipdate) / 86400000) as bigint) AS offset",
            "'p-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) AS event_id",
            "'t-' || cast(l_orderkey as string) AS trace_id",
            "'pay-' || cast(l_orderkey as string) AS payment_id",
            "CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '' ELSE cast(l_orderkey as string) END AS order_id",
            "CASE WHEN (l_orderkey + l_linenumber) % 103 = 0 THEN 'bogus' WHEN l_returnflag = 'R' THEN 'failed'"
            " WHEN l_returnflag = 'A' THEN 'authorized' ELSE 'captured' END AS status",
            "(CASE WHEN (l_orderkey + l_linenumber) % 101 = 0 THEN -1 ELSE 1 END)"
            " * cast(round(l_extendedprice * 100) as bigint) AS amount_cents",
            "'USD' AS currency",
            "MS(l_shipdate) + (l_linenumber % 24) * 3600000 AS event_ts",
        ],
    ),
    "inventory_ev": (
        "events",
        [
            "'inventory' AS kind",
            f"'{TOPICS['inventory']}' AS topic",
            "cast(user_id % 20 % 3 as int) AS partition",
            "event_id AS offset",
            "'i-' || cast(event_id as string) AS event_id",
            "'t-' || cast(event_id as string) AS trace_id",
            "CASE WHEN event_id % 89 = 0 THEN '' ELSE 'SKU-' || cast(user_id % 20 as string) END AS sku",
            "'wh-' || cast(event_id % 3 as string) AS warehouse_id",
            "CASE WHEN event_id % 83 = 0 THEN NULL ELSE cast(floor(value) as int) - 2 END AS quantity",
            "CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'restock'"
            " ELSE 'adjustment' END AS stock_reason",
            "MS(ts) AS event_ts",
        ],
    ),
    "clicks_ev": (
        "events",
        [
            "'clickstream' AS kind",
            f"'{TOPICS['clickstream']}' AS topic",
            "cast(event_id % 3 as int) AS partition",
            "event_id AS offset",
            "'c-' || cast(event_id as string) AS event_id",
            "'t-' || cast(event_id as string) AS trace_id",
            "CASE WHEN event_id % 97 = 0 THEN '' ELSE 's-' || cast(user_id as string) END AS session_id",
            "CASE WHEN event_id % 10 < 3 THEN NULL ELSE 'cust-' || cast(user_id as string) END AS customer_id",
            "CASE WHEN event_type = 'error' THEN '' ELSE '/' || event_type END AS page",
            "CASE WHEN event_id % 10 < 4 THEN NULL ELSE 'SKU-' || cast(user_id % 20 as string) END AS sku",
            "MS(ts) AS event_ts",
        ],
    ),
}

# --- deliveries: all four kinds over the 30 days of events, in five waves ------------------------
# Purchases are delivered twice. A wave is six days; some sign-ups arrive two waves late.
_DELIVERED = (
    "(SELECT *, EXPLODE(CASE WHEN event_type = 'purchase' THEN LIST(0, 1) ELSE LIST(0) END) AS copy"
    " FROM events{where})"
)
_WAVE = f"least({WAVES - 1}, cast(floor(({{ms}} - {EPOCH_2024_MS}) / {WAVE_DAYS * DAY_MS}) as int){{late}}) AS wave"
_LATE = " + CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 2 ELSE 0 END"
_PAID_MS = "MS(ts) + (event_id % 40 + copy * 10) * 60000"

DELIVERIES: dict[str, tuple[str, list[str]]] = {
    "orders_in": (
        _DELIVERED.format(where=""),
        [
            "'orders' AS kind",
            f"'{TOPICS['orders']}' AS topic",
            "cast(event_id % 3 as int) AS partition",
            "event_id * 2 + copy AS offset",
            "CASE WHEN event_id % 97 = 0 THEN '' ELSE 'o-' || cast(event_id as string) END AS event_id",
            "'t-' || cast(event_id as string) AS trace_id",
            "'ord-' || cast(event_id as string) AS order_id",
            "'cust-' || cast(user_id as string) AS customer_id",
            "CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'purchase' THEN 'paid'"
            " WHEN 'signup' THEN 'fulfilled' ELSE 'created' END AS status",
            "(CASE WHEN event_id % 101 = 0 THEN -1 ELSE 1 END) * (cast(round(value * 100) as bigint) + 1)"
            " AS amount_cents",
            "CASE event_id % 4 WHEN 0 THEN 'EUR' WHEN 2 THEN '' ELSE 'USD' END AS currency",
            "'SKU-' || cast(user_id % 20 as string) AS sku",
            "cast(event_id % 17 as int) AS quantity",
            "CASE WHEN event_type = 'purchase' THEN 'SAVE-' || cast(user_id % 7 as string) END AS coupon_code",
            "MS(ts) AS event_ts",
            "CASE WHEN event_id % 113 = 0 THEN 1 ELSE 0 END AS poison",
            _WAVE.format(ms="MS(ts)", late=_LATE),
        ],
    ),
    "payments_in": (
        _DELIVERED.format(where=""),
        [
            "'payments' AS kind",
            f"'{TOPICS['payments']}' AS topic",
            "cast(event_id % 3 as int) AS partition",
            "event_id * 2 + copy AS offset",
            "'p-' || cast(event_id as string) || '-' || cast(copy as string) AS event_id",
            "'t-' || cast(event_id as string) AS trace_id",
            "'pay-' || cast(event_id as string) AS payment_id",
            "'ord-' || cast(event_id as string) AS order_id",
            "CASE WHEN event_type = 'signup' THEN 'failed' WHEN event_type = 'click' OR"
            " (event_type = 'purchase' AND copy = 0) THEN 'authorized' ELSE 'captured' END AS status",
            "(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) * (cast(round(value * 100) as bigint) + 1)"
            " AS amount_cents",
            "'USD' AS currency",
            f"{_PAID_MS} AS event_ts",
            "CASE WHEN event_id % 109 = 0 THEN 1 ELSE 0 END AS poison",
            _WAVE.format(ms=f"({_PAID_MS})", late=""),
        ],
    ),
    "inventory_in": (
        "events",
        [
            "'inventory' AS kind",
            f"CASE WHEN event_id % 127 = 0 THEN '{UNKNOWN_TOPIC_NAME}' ELSE '{TOPICS['inventory']}' END AS topic",
            "cast(user_id % 20 % 3 as int) AS partition",
            "event_id AS offset",
            "'i-' || cast(event_id as string) AS event_id",
            "'t-' || cast(event_id as string) AS trace_id",
            "'SKU-' || cast(user_id % 20 as string) AS sku",
            "'wh-' || cast(event_id % 3 as string) AS warehouse_id",
            "cast(floor(value) as int) - 2 AS quantity",
            "CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'restock'"
            " ELSE 'adjustment' END AS stock_reason",
            "MS(ts) AS event_ts",
            "0 AS poison",
            _WAVE.format(ms="MS(ts)", late=_LATE),
        ],
    ),
    "clicks_in": (
        "events",
        [
            "'clickstream' AS kind",
            f"'{TOPICS['clickstream']}' AS topic",
            "cast(event_id % 3 as int) AS partition",
            "event_id AS offset",
            "'c-' || cast(event_id as string) AS event_id",
            "'t-' || cast(event_id as string) AS trace_id",
            "CASE WHEN event_id % 97 = 0 THEN '' ELSE 's-' || cast(user_id as string) END AS session_id",
            "CASE WHEN event_id % 10 < 3 THEN NULL ELSE 'cust-' || cast(user_id as string) END AS customer_id",
            "CASE WHEN event_type = 'error' THEN '' ELSE '/' || event_type END AS page",
            "CASE WHEN event_id % 10 < 4 THEN NULL ELSE 'SKU-' || cast(user_id % 20 as string) END AS sku",
            "MS(ts) AS event_ts",
            "0 AS poison",
            _WAVE.format(ms="MS(ts)", late=_LATE),
        ],
    ),
}

WIRE_EXPR = (
    "CASE WHEN event_id % 50 = 0 THEN unhex('01') WHEN event_id % 51 = 0 THEN unhex('0000')"
    " WHEN event_id % 53 = 0 THEN NULL"
    " ELSE unhex('00' || lpad(hex(event_id % 7 + 1), 8, '0') || hex(event_type)) END"
)


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _build(spark: SparkSession, sf_dir: str, source: str, columns: list[str]) -> DataFrame:
    table = next(t for t in ("lineitem", "events", "orders") if t in source)
    frame = source_table(spark, sf_dir, table)
    inner = render(source, "spark").replace(f"FROM {table}", "FROM {t}")
    if source != table:
        frame = spark.sql(inner.strip("()") if inner.count("(") == 1 else inner[1:-1], t=frame)
    return frame.selectExpr(*[render(c, "spark") for c in columns])


def event_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of :data:`TABLES` or :data:`DELIVERIES`."""
    source, columns = {**TABLES, **DELIVERIES}[name]
    return _build(spark, sf_dir, source, columns)


def widen(df: DataFrame) -> DataFrame:
    """Give a typed event table every wide event column."""
    missing = [f for f in EVENT_FIELDS if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def _all(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    frames = [widen(event_table(spark, sf_dir, n)) for n in names]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four static tables as wide rows, with key, bytes and a fixed ingest stamp."""
    return _with_transport(_all(spark, sf_dir, TABLES))


def _with_transport(wide: DataFrame) -> DataFrame:
    key = F.coalesce("order_id", "sku", "event_id")
    return wide.withColumns(
        {
            "key": key,
            "value": F.concat_ws("|", "kind", "event_id", key).cast("binary"),
            "ingest_ts": F.timestamp_millis(F.lit(EPOCH_2024_MS + 30 * DAY_MS)),
        }
    )


def all_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four delivery tables as wide rows with their wave."""
    return _all(spark, sf_dir, DELIVERIES)


def wave_stamp(wave) -> F.Column:
    """Arrival time of a wave: the end of its last day."""
    return F.timestamp_millis(F.lit(EPOCH_2024_MS) + (wave + 1).cast("bigint") * (WAVE_DAYS * DAY_MS))


def kafka_records(deliveries: DataFrame) -> DataFrame:
    """Deliveries as Kafka records in wire format, still carrying their wave.

    Orders with a coupon are written with the newer contract. Poisoned rows get bytes that look
    like a message but hold no Avro.
    """
    newer = (F.col("kind") == "orders") & F.col("coupon_code").isNotNull()
    writer = F.when(newer, F.lit("orders_v11")).otherwise(F.col("kind"))
    ids = {name: number for number, name in SCHEMA_IDS.items()}
    schema_id = F.create_map(*[F.lit(x) for item in ids.items() for x in item])[writer]
    encoded = encode_events(deliveries, writer, schema_id)
    value = F.when(F.col("poison") == 1, F.unhex(F.lit(POISON_HEX))).otherwise(F.col("value"))
    return encoded.select(
        "topic",
        "partition",
        "offset",
        wave_stamp(F.col("wave")).alias("timestamp"),
        F.coalesce("order_id", "sku", "event_id").cast("binary").alias("key"),
        value.alias("value"),
        "wave",
    )


# --- the same tables as DuckDB text --------------------------------------------------------------


def _cte(name: str, source: str, columns: list[str]) -> str:
    body = ",\n  ".join(render(c, "duckdb") for c in columns)
    return f"{name} AS (\n  SELECT {body}\n  FROM {render(source, 'duckdb')} AS src)"


def oracle_ctes(*names: str) -> list[str]:
    """CTE definitions of the named tables, without the leading WITH."""
    tables = {**TABLES, **DELIVERIES}
    return [_cte(n, *tables[n]) for n in names]
