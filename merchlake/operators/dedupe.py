"""Keep-first deduplication in arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions.scalars import is_missing

ARRIVAL = ("topic", "partition", "offset")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` is planned as a group limit on both sides of the shuffle, so a key with
    very many rows is cut to one row per map task before it travels.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def dedupe_events(
    events: DataFrame, keys: Sequence[str] = ("event_id",), arrival: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Keep the first arrival of each event id; rows without an id are dropped."""
    return first_per_key(events.filter(~is_missing(F.col("event_id"))), keys, arrival)
