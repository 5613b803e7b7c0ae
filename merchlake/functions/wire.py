"""Header of a message: one zero byte, a big-endian schema id, then the Avro body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.contracts import WIRE_HEADER_BYTES, WIRE_MAGIC

NOT_WIRE = "not_confluent_avro"
TRUNCATED = "truncated_confluent_header"


def header_reason(value: Column) -> Column:
    """Why a value has no usable header, or NULL."""
    first = F.substring(value, 1, 1)
    return F.when(
        value.isNull() | (F.octet_length(value) == 0) | (first != F.lit(bytes([WIRE_MAGIC]))),
        F.lit(NOT_WIRE),
    ).when(F.octet_length(value) < WIRE_HEADER_BYTES, F.lit(TRUNCATED))


def schema_id(value: Column) -> Column:
    """Schema id of a value with a good header, otherwise NULL."""
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint")
    return F.when(header_reason(value).isNull(), number)


def body(value: Column) -> Column:
    return F.substring(value, WIRE_HEADER_BYTES + 1, 2**31 - 1)
