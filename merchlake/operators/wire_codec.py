"""Decode and encode whole tables or streams of wire values."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import merchlake
from merchlake.contracts import (
    CONTRACTS,
    DEFAULT_WRITER_OF_KIND,
    EVENT_FIELDS,
    READER_OF_KIND,
    TOPICS,
)
from merchlake.functions import wire
from merchlake.operators import wire_kernels
from merchlake.operators.envelope import kind_of_topic

UNKNOWN_TOPIC = "unknown_topic"
DECODE_ERROR = "decode_error"


def conform_to_reader(df: DataFrame, reader, defaults: dict | None = None) -> DataFrame:
    """Project onto a reader schema; fields the writer lacks take their default or NULL."""
    columns = []
    for field in reader.fields:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            default = (defaults or {}).get(field.name)
            columns.append(F.lit(default).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def writer_contract(kind: Column, schema_id: Column, writers: dict[int, str]) -> Column:
    """Contract a value was written with: by schema id, else the first version of its kind."""
    chosen = None
    for name in CONTRACTS:
        ids = sorted(i for i, contract in writers.items() if contract == name)
        owner = [k for k in TOPICS if name in (DEFAULT_WRITER_OF_KIND[k], READER_OF_KIND[k])]
        if not ids:
            continue
        hit = (kind == owner[0]) & schema_id.isin(ids)
        chosen = F.when(hit, F.lit(name)) if chosen is None else chosen.when(hit, F.lit(name))
    default = None
    for k, name in DEFAULT_WRITER_OF_KIND.items():
        default = F.when(kind == k, F.lit(name)) if default is None else default.when(kind == k, F.lit(name))
    return default if chosen is None else chosen.otherwise(default)


# Tasks get the kernels with the query, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(merchlake)


def _evaluated_once(kernel, return_type: T.DataType):
    """A kernel as a function whose call the optimizer neither copies into filters nor repeats."""
    return F.arrow_udf(kernel, returnType=return_type).asNondeterministic()


def _arrow_body(value: Column, writer: Column) -> Column:
    return _evaluated_once(wire_kernels.decode_values, EVENT_FIELDS)(value, writer)


def decode_wire(df: DataFrame, writers: dict[int, str] | None = None) -> DataFrame:
    """Add ``kind``, ``schema_id``, every event field and ``reason`` to envelope rows.

    ``reason`` is NULL for a decoded row. ``writers`` maps schema ids to contract names.
    """
    kind = kind_of_topic(F.col("topic"))
    header = wire.header_reason(F.col("value"))
    staged = df.withColumns(
        {
            "kind": kind,
            "schema_id": wire.schema_id(F.col("value")),
            "reason": F.when(kind.isNull(), F.lit(UNKNOWN_TOPIC)).otherwise(header),
        }
    )
    writer = F.when(
        F.col("reason").isNull(), writer_contract(F.col("kind"), F.col("schema_id"), writers or {})
    )
    body = F.col("_body")
    return (
        staged.withColumn("_body", _arrow_body(F.col("value"), writer))
        .select(
            *df.columns,
            "kind",
            "schema_id",
            *[body[f.name].alias(f.name) for f in EVENT_FIELDS],
            F.coalesce("reason", F.when(body.isNull(), F.lit(DECODE_ERROR))).alias("reason"),
        )
    )


def encode_events(df: DataFrame, writer: Column, schema_id: Column) -> DataFrame:
    """Set ``value`` to the wire bytes of wide event rows.

    ``writer`` names the contract of each row. The value is NULL for a row without a contract,
    without a required field or with a symbol its enum does not have.
    """
    encode = _evaluated_once(wire_kernels.encode_rows, T.BinaryType())
    record = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_FIELDS])
    return df.withColumn("value", encode(record, writer, schema_id.cast("bigint")))
