"""Bloom filters as rows of bits, built and asked with column functions alone.

A filter is a table of blocks of 32,768 bits. A key belongs to one block and sets a few bits in it, so a filter is built
by one aggregation and asked by one join on the block, which is broadcast: rows that are asked stay where they are. Keys
that were put in are always found; of others a few are found as well, so an exact step has to follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
PROBES = 5
KEYS_PER_BLOCK = 2_500
# 32 MB of bits. Beyond 20 million keys the blocks grow fuller and let more through.
MAX_BLOCKS = 8_192


def block_count(keys: int) -> int:
    """Blocks for a number of keys: one key in a hundred that was not put in is found, up to ``MAX_BLOCKS``."""
    return max(1, min(MAX_BLOCKS, -(-keys // KEYS_PER_BLOCK)))


def _block(columns: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit("block")), F.lit(blocks))


def _positions(columns: Sequence[str]) -> list[Column]:
    first, step = F.xxhash64(*columns), F.xxhash64(*columns, F.lit("step"))
    return [F.pmod(F.pmod(first, F.lit(BLOCK_BITS)) + F.lit(n) * F.pmod(step, F.lit(BLOCK_BITS)), F.lit(BLOCK_BITS))
            for n in range(PROBES)]


def bloom_filter(keys: DataFrame, columns: Sequence[str], blocks: int) -> DataFrame:
    """``block`` and ``bits`` of the keys: at most ``blocks`` rows of 4 KB, however many keys there are."""
    placed = keys.select(_block(columns, blocks).alias("block"), F.explode(F.array(*_positions(columns))).alias("at"))
    return placed.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def maybe_in(rows: DataFrame, bloom: DataFrame, columns: Sequence[str], blocks: int) -> DataFrame:
    """Rows whose key may be among those of the filter; NULL counts as a value of its own."""
    asked = rows.withColumn("_block", _block(columns, blocks)).withColumn("_at", F.array(*_positions(columns)))
    found = F.col("_block") == F.col("block")
    for n in range(PROBES):
        at = F.col("_at")[n]
        byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        found = found & (F.getbit(byte, at % 8) == 1)
    return asked.join(F.broadcast(bloom), found, "left_semi").drop("_block", "_at")
