"""Native stateful operators over typed event streams.

State is bounded by the watermark and lives in the state store of the session.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Mapping
from datetime import timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from merchlake.contracts import WATERMARK_LAG_MS
from merchlake.functions.scalars import (
    currency_or_default,
    guarded_ratio,
    is_missing,
    millis_to_timestamp,
)
from merchlake.operators.metrics import not_cancelled

DEDUPE_SALTS = 256
SLICE_MS = 3_600_000
# Order ids of one slice of time are held in this many groups.
ORDER_BUCKETS = 16
# Rows handed to the state store at once.
STATE_ROWS = 5_000
_STATE_COLUMNS = ["order_id", "event_id", "status", "at"]
# The slowest of several watermarks counts, or the fastest. A query keeps what it was first started with.
MARK_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def with_event_time(events: DataFrame, lag_ms: int = WATERMARK_LAG_MS) -> DataFrame:
    """Watermark on the event time.

    The engine drops an event at or below the mark; one extra millisecond of delay keeps the
    boundary, as the batch rule does. A stream that already has its watermark is left alone.
    """
    if "event_time" in events.columns:
        return events
    timed = events.withColumn("event_time", millis_to_timestamp(F.col("event_ts")))
    return timed.withWatermark("event_time", f"{lag_ms + 1} milliseconds")


def dedupe_stream(events: DataFrame, salts: int = DEDUPE_SALTS, lag_ms: int = WATERMARK_LAG_MS) -> DataFrame:
    """Drop repeated event ids, and late events, across batches.

    Copies of one id are first reduced under a salt taken from their source position, so an id
    repeated very often reaches the second step at most once per salt and time. ``salts=1`` leaves
    the first step out.
    """
    timed = with_event_time(events.filter(~is_missing(F.col("event_id"))), lag_ms)
    if salts > 1:
        salt = F.pmod(F.xxhash64("partition", "offset"), F.lit(salts)).cast("int")
        timed = (
            timed.withColumn("_salt", salt).dropDuplicatesWithinWatermark(["event_id", "_salt"]).drop("_salt")
        )
    return timed.dropDuplicatesWithinWatermark(["event_id"])


def dedupe_kinds_stream(
    kinds: Mapping[str, DataFrame], salts: int = DEDUPE_SALTS, lag_ms: int = WATERMARK_LAG_MS
) -> DataFrame:
    """Events of several kinds, each kind with a watermark of its own; repeated ids and late events are dropped.

    What is late follows from the marks of all kinds under ``MARK_POLICY``: with ``min`` a kind that comes slowly, or not
    at all, holds the common mark back, and nothing of it is lost; with ``max`` the fastest kind sets the mark and state
    is let go soonest. An id is an id within its kind.
    """
    named = [with_event_time(events, lag_ms).withColumn("kind", F.lit(kind)) for kind, events in kinds.items()]
    every = reduce(DataFrame.unionByName, named).filter(~is_missing(F.col("event_id")))
    if salts > 1:
        salt = F.pmod(F.xxhash64("partition", "offset"), F.lit(salts)).cast("int")
        every = every.withColumn("_salt", salt).dropDuplicatesWithinWatermark(["kind", "event_id", "_salt"]).drop("_salt")
    return every.dropDuplicatesWithinWatermark(["kind", "event_id"])


def windowed_gmv(orders: DataFrame, lag_ms: int = WATERMARK_LAG_MS) -> DataFrame:
    """Order value per hour and currency. Only orders that count move the watermark."""
    return (
        with_event_time(orders.filter(not_cancelled()), lag_ms)
        .groupBy(F.window("event_time", "1 hour").alias("w"), currency_or_default(F.col("currency")).alias("currency"))
        .agg(F.sum("amount_cents").alias("gmv_cents"), F.count("*").alias("order_count"))
        .select(F.col("w.start").alias("hour_ts"), "currency", "gmv_cents", "order_count")
    )


def windowed_payment_stats(payments: DataFrame, lag_ms: int = WATERMARK_LAG_MS) -> DataFrame:
    """Paid and failed payment events per hour."""
    failed = F.col("status").eqNullSafe("failed")
    return (
        with_event_time(payments, lag_ms)
        .groupBy(F.window("event_time", "1 hour").alias("w"))
        .agg(F.count_if(~failed).alias("paid_count"), F.count_if(failed).alias("failed_count"))
        .select(
            F.col("w.start").alias("hour_ts"),
            "paid_count",
            "failed_count",
            guarded_ratio(F.col("failed_count"), F.col("paid_count") + F.col("failed_count")).alias("failure_rate"),
        )
    )


def join_orders_payments_stream(
    orders: DataFrame, payments: DataFrame, lag_ms: int = WATERMARK_LAG_MS, hot: DataFrame | None = None
) -> DataFrame:
    """Payments within ``lag_ms`` of an order event, and order events that find none.

    ``hot`` (``order_id``, ``salts``; see :func:`merchlake.operators.skew.hot_keys`) lists orders
    known to be very frequent. Their order events are spread over salts and their payments copied to
    every salt. It only balances the work: an order missing from it is joined all the same.
    """
    left = with_event_time(orders, lag_ms).select(
        "order_id",
        F.col("event_id").alias("order_event_id"),
        F.col("status").alias("order_status"),
        F.col("event_time").alias("order_time"),
    )
    right = with_event_time(payments, lag_ms).select(
        F.col("order_id").alias("_order_id"),
        F.col("event_id").alias("payment_event_id"),
        F.col("status").alias("payment_status"),
        F.col("event_time").alias("payment_time"),
    )
    if hot is None:
        left, right = left.withColumn("_salt", F.lit(0)), right.withColumn("_right_salt", F.lit(0))
    else:
        salts = F.coalesce("salts", F.lit(1))
        left = left.join(F.broadcast(hot), "order_id", "left").withColumn(
            "_salt", F.pmod(F.xxhash64("order_event_id"), salts).cast("int")
        ).drop("salts")
        hot_right = hot.withColumnRenamed("order_id", "_order_id")
        right = right.join(F.broadcast(hot_right), "_order_id", "left").withColumn(
            "_right_salt", F.explode(F.sequence(F.lit(0), salts - 1))
        ).drop("salts")
    tolerance = F.lit(timedelta(milliseconds=lag_ms))
    near = F.col("payment_time").between(F.col("order_time") - tolerance, F.col("order_time") + tolerance)
    same = (F.col("order_id") == F.col("_order_id")) & (F.col("_salt") == F.col("_right_salt"))
    return left.join(right, same & near, "left_outer").drop("_order_id", "_salt", "_right_salt")


class LatestPayment(StatefulProcessor):
    """Orders of one slice of time and one bucket of order ids, and the payments near that slice.

    Both are lists in state, read and written by whole batches of rows, since every call to the state store from Python is
    a message of its own. Copies inside a batch are not stored; copies that come with later batches rest in state until
    the slice ends. Once the watermark has passed every payment that could count, one timer lets all orders out, each with
    its newest payment, and empties the state.
    """

    def __init__(self, lag_ms: int, slice_ms: int):
        self._lag_ms, self._slice_ms = lag_ms, slice_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._orders = handle.getListState("orders", "order_id string, event_id string, status string, at bigint")
        self._payments = handle.getListState("payments", "order_id string, event_id string, status string, at bigint")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            orders, payments = frame[frame["is_order"]], frame[~frame["is_order"]]
            self._append(self._orders, orders.drop_duplicates(["order_id", "event_id"]))
            self._append(self._payments, payments.drop_duplicates(["order_id", "at", "event_id"], keep="last"))
        self._handle.registerTimer(int(key[0]) + self._slice_ms + self._lag_ms)
        return iter(())

    @staticmethod
    def _append(state, frame: pd.DataFrame) -> None:
        for start in range(0, len(frame), STATE_ROWS):
            part = frame.iloc[start : start + STATE_ROWS]
            state.appendList(list(zip(*[part[name].tolist() for name in _STATE_COLUMNS], strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        orders, payments = (
            pd.DataFrame(list(state.get()), columns=_STATE_COLUMNS).astype({"at": "int64"})
            for state in (self._orders, self._payments)
        )
        self._orders.clear()
        self._payments.clear()
        if len(orders):
            yield newest_payments(orders, payments, self._lag_ms)


def newest_payments(orders: pd.DataFrame, payments: pd.DataFrame, lag_ms: int) -> pd.DataFrame:
    """The orders of a slice, one row per order event, with the newest payment of their order at most ``lag_ms`` away."""
    orders = orders.drop_duplicates(["order_id", "event_id"]).copy()
    orders["upto"] = orders["at"] + lag_ms
    # Of an event delivered again the last status counts, of payments at one time the least event id.
    payments = payments.drop_duplicates(["order_id", "at", "event_id"], keep="last")
    payments = payments.sort_values(["at", "event_id"]).drop_duplicates(["order_id", "at"])
    payments = payments.rename(columns={"event_id": "payment_event_id", "status": "payment_status"})
    payments["payment_ms"] = payments["at"].astype("Int64")
    found = pd.merge_asof(
        orders.sort_values("upto"), payments.rename(columns={"at": "upto"}), on="upto", by="order_id", tolerance=2 * lag_ms
    )
    found = found.rename(columns={"event_id": "order_event_id", "status": "order_status", "at": "order_ms"})
    names = ["order_id", "order_event_id", "order_status", "order_ms"]
    found = found[[*names, "payment_event_id", "payment_status", "payment_ms"]]
    texts = ["payment_event_id", "payment_status"]
    return found.assign(**{name: found[name].astype(object).where(found[name].notna(), None) for name in texts})


def latest_payment_stream(
    orders: DataFrame,
    payments: DataFrame,
    lag_ms: int = WATERMARK_LAG_MS,
    slice_ms: int = SLICE_MS,
    buckets: int = ORDER_BUCKETS,
) -> DataFrame:
    """Every order event once, with the newest payment of its order within ``lag_ms`` of it, if any.

    Unlike :func:`join_orders_payments_stream` it forms no pairs: state and output are linear in the events. State is
    kept per slice of time and bucket of order ids (by hash; ``buckets`` is fixed with the first start of a stream), so
    that rows pass Python and the state store in bulk: a task holds the events of one bucket and slice, and more buckets
    make that less. An id that is never quiet is spread over its slices; a payment goes to each slice that it can reach (two at most, if a slice is no shorter than twice ``lag_ms``). Of payments at the same time
    the least event id counts. Copies of an order event are dropped, as are events without id or time and late ones. An
    order comes out once the watermark is ``lag_ms`` past its slice. Needs the RocksDB state store.
    """

    def start(at: Column) -> Column:
        return at - F.pmod(at, F.lit(slice_ms))

    def side(events: DataFrame, is_order: bool, slices: Column) -> DataFrame:
        known = events.filter(~is_missing(F.col("event_id")) & F.col("event_ts").isNotNull())
        return with_event_time(known, lag_ms).select(
            "order_id", F.lit(is_order).alias("is_order"), "event_id", "status",
            F.col("event_ts").cast("bigint").alias("at"), "event_time", slices.alias("slice"),
        )

    at, lag = F.col("event_ts").cast("bigint"), F.lit(lag_ms)
    reached = F.explode(F.sequence(start(at - lag), start(at + lag), F.lit(slice_ms).cast("bigint")))
    both = side(orders, True, start(at)).unionByName(
        side(payments.filter(F.col("order_id").isNotNull()), False, reached)
    )
    found = both.withColumn("bucket", F.pmod(F.xxhash64("order_id"), F.lit(buckets))).groupBy("slice", "bucket").transformWithStateInPandas(
        LatestPayment(lag_ms, slice_ms),
        outputStructType="order_id string, order_event_id string, order_status string, order_ms bigint, "
        "payment_event_id string, payment_status string, payment_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select(
        "order_id", "order_event_id", "order_status", F.timestamp_millis("order_ms").alias("order_time"),
        "payment_event_id", "payment_status", F.timestamp_millis("payment_ms").alias("payment_time"),
    )


def state_sizes(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Rows that each store of a stopped query holds after ``batch_id`` (its newest batch, if None).

    Returns ``operator_id, operator, store, rows``. State variables of a processor are counted one by one, a map by its
    entries. One job per store; a query has a handful.
    """
    counts = []
    for op in spark.read.format("state-metadata").load(checkpoint).collect():
        named = json.loads(op.operatorProperties or "{}").get("stateVariables", [])
        named = json.loads(named) if isinstance(named, str) else named
        variables = [v["stateName"] for v in named if not v["stateName"].startswith("$")]
        for name in variables or [None]:
            reader = spark.read.format("statestore").option("operatorId", op.operatorId)
            reader = reader.option("stateVarName", name) if name else reader.option("storeName", op.stateStoreName)
            if batch_id is not None:
                reader = reader.option("batchId", batch_id)
            labels = [F.lit(v).alias(n) for n, v in
                      (("operator_id", op.operatorId), ("operator", op.operatorName), ("store", name or op.stateStoreName))]
            counts.append(reader.load(checkpoint).groupBy().count().select(*labels, F.col("count").alias("rows")))
    return reduce(DataFrame.unionByName, counts)


def window_updates_writer(updates: DataFrame, path: str, checkpoint: str):
    """Write window rows in update mode: each batch holds the new values of the hours it touched."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        updates.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
    )


def append_writer(rows: DataFrame, path: str, checkpoint: str):
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
