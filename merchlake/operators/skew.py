"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above 1/PIECES of all rows, so there can never be more than PIECES hot keys.
PIECES = 1000


def hot_keys(df: DataFrame, key: str, pieces: int = PIECES) -> DataFrame:
    """Keys with more than ``1/pieces`` of the rows, and how many salts spread each of them.

    At most ``pieces`` rows whatever the input, and the salts add up to at most twice that. The
    list only steers how work is spread, so it may be taken from any cheap stand-in for the rows
    that are joined later, such as the rows before deduplication.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * pieces > total).select(
        key, F.ceil(F.col("_n") * pieces / total).cast("int").alias("salts")
    )


def skew_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    pieces: int = PIECES,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join onto a ``right`` side that has one row per ``key`` (a string).

    Rows of hot keys get their match from a broadcast of those few right rows and are shuffled
    under a filler key made from the ``spread`` columns; all other rows join by key. Which match
    counts is decided by the hot flag, so a filler equal to a real key cannot change the result.
    """
    hot = hot_keys(left, key, pieces) if hot is None else hot
    payload = [c for c in right.columns if c != key]
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    # Bounded: one right row per hot key.
    few = few.select(key, F.struct(*payload).alias("_hot_match"))
    flags = hot.select(key, F.lit(True).alias("_hot")).join(F.broadcast(few), key, "left")
    flagged = left.join(F.broadcast(flags), key, "left")
    filler = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*spread), F.lit(pieces)).cast("string"))
    flagged = flagged.withColumn(
        "_join_key", F.when(F.col("_hot") | F.col(key).isNull(), filler).otherwise(F.col(key))
    )
    build = right.select(F.col(key).alias("_join_key"), F.struct(*payload).alias("_match"))
    joined = flagged.join(build, "_join_key", "left")
    match = F.when(F.col("_hot"), F.col("_hot_match")).when(F.col(key).isNotNull(), F.col("_match"))
    return joined.withColumn("_match", match).select(
        *left.columns, *[F.col("_match")[c].alias(c) for c in payload]
    )
